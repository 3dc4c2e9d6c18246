"""What is costly per sentence stands once in the optimized plan, and is spread over the cores."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.dims import spread
from corpusloom.workload import derive, load


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(
        [(1, "en", "The quick foxes jumped, 12 times\n\n \nOver Paris"), (2, "en", None), (3, "fr", "Été 12 Σας İx ²")],
        "doc_id long, lang string, text string").write.parquet(f"{root}/documents.parquet")
    return root


@pytest.fixture()
def wide(spark):
    """Plans in full."""
    names = ("spark.sql.debug.maxToStringFields", "spark.sql.maxMetadataStringLength")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, 100_000)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_lines_are_tokenized_once(spark, folder, wide):
    text = plan(derive.annotated_lines(spark, folder))
    assert text.count("regexp_extract_all") == 1
    assert "Sing" in text and text.count("CASE") < 20  # features come from constants


def test_annotation_of_odd_words(spark, folder):
    rows = {r.sent_key: r.words for r in derive.annotated_lines(spark, folder).collect()}
    assert set(rows) == {"1:0", "1:3", "3:0"}
    got = [(w.form, w.lemma, w.upos, w.xpos, w.feats, w.head, w.deprel) for w in rows["1:0"]]
    assert got[0] == ("The", "the", "DET", "DET1", {"PronType": "Art"}, 0, "root")
    assert got[2] == ("foxes", "foxes", "ADJ", "ADJ1", {"Number": "Plur", "Gender": "Masc", "Degree": "Pos"}, 1, "amod")
    assert got[4] == (",", ",", "PUNCT", None, None, 2, "punct")
    assert got[5] == ("12", "12", "NUM", "NUM0", {"NumType": "Card"}, 3, "nummod")
    assert [w.upos for w in rows["3:0"]] == ["DET", "NUM", "DET", "ADP", "ADP"]


def test_nodes_are_searched_once(spark, folder, wide):
    for name, mark in (("match_feat_regex", "plur"), ("pair_candidates", "VERB")):
        assert plan(load()[0][name](spark, folder)).count(mark) == 1, name


def test_one_file_with_one_row_group_is_spread(spark, tmp_path):
    path = str(tmp_path / "rows")
    cores = spark.sparkContext.defaultParallelism
    spark.range(20_000 * cores).coalesce(1).selectExpr("id", "md5(string(id)) AS text").write.parquet(path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "16k")
    try:
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= cores
        sizes = spread(rows, "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert len(sizes) >= cores and sum(r["count"] for r in sizes) == 20_000 * cores
