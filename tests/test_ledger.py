import glob
import random

import pytest
from pyspark.sql import functions as F

from corpusloom import probe_folder
from corpusloom.plans import probe
from corpusloom.sources import taskfile
from corpusloom.sources.ledger import Ledger, clustered

VECTORS = "id string, task string, stage string, label string, layer int, features array<double>"
TASK = "lang string, task string, stage string, label string, text string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(2)
    rows = []
    for task in ("01", "1", "x/y"):
        for i in range(40):
            label = "ab"[i % 2]
            for layer in (1, 2):
                rows.append((f"{task}:{i}", task, ("tr", "va", "te")[i % 3], label, layer,
                             [rng.random() + (label == "b"), rng.random()]))
    return spark.createDataFrame(rows, VECTORS).cache()


def test_a_stopped_sweep_goes_on(spark, vectors, tmp_path, monkeypatch):
    whole = probe._probe_one
    fits = []

    def stopped(rows, *rest):
        if len(fits) == 2:
            raise KeyboardInterrupt
        fits.append(1)
        return whole(rows, *rest)

    def counted(rows, *rest):
        fits.append(1)
        return whole(rows, *rest)

    options = {"max_iter": 5, "at_once": 1, "ledger": str(tmp_path / "run")}
    monkeypatch.setattr(probe, "_probe_one", stopped)
    with pytest.raises(KeyboardInterrupt):
        probe.sweep_tasks(vectors, "id", **options)
    assert len(fits) == 2
    monkeypatch.setattr(probe, "_probe_one", counted)
    out = probe.sweep_tasks(vectors, "id", **options).collect()
    assert len(fits) == 6  # three tasks of two layers, two of them done before
    assert {(r.task, r.layer, r.status) for r in out} == {(t, n, "ok") for t in ("01", "1", "x/y") for n in (1, 2)}
    assert len(out) == len({(r.task, r.layer, r.stage, r.metric) for r in out}) == 6 * 3 * 3
    again = probe.sweep_tasks(vectors, "id", **options).collect()
    assert len(fits) == 6 and sorted(map(str, again)) == sorted(map(str, out))
    with pytest.raises(ValueError, match="begun with"):
        probe.sweep_tasks(vectors, "id", **{**options, "max_iter": 6})


def test_failed_fits_are_tried_again(spark, vectors, tmp_path, monkeypatch):
    whole, one = probe._probe_one, vectors.filter("task = '1'")

    def failing(rows, *rest):
        if rows.filter("layer = 2").limit(1).count():
            raise RuntimeError("out of luck")
        return whole(rows, *rest)

    options = {"max_iter": 5, "ledger": str(tmp_path / "run")}
    monkeypatch.setattr(probe, "_probe_one", failing)
    first = probe.sweep_tasks(one, "id", **options).collect()
    assert {r.status for r in first if r.layer == 2} == {"RuntimeError: out of luck"}
    monkeypatch.setattr(probe, "_probe_one", whole)
    assert {(r.layer, r.status) for r in probe.sweep_tasks(one, "id", **options).collect()} == {(1, "ok"), (2, "ok")}


def test_a_second_run_of_a_folder_encodes_nothing(spark, tmp_path):
    rows = [("en", "t", ("tr", "va", "te")[i % 3], "ab"[i % 2], f"text {i} {'yes' if i % 2 else 'no'}") for i in range(30)]
    taskfile.write_tasks(spark.createDataFrame(rows, TASK), str(tmp_path / "tasks"))
    options = {"layers": 2, "max_iter": 5, "ledger": str(tmp_path / "run")}
    first = probe_folder(spark, str(tmp_path / "tasks"), **options).collect()

    def no_model():
        raise AssertionError("a text was encoded again")

    second = probe_folder(spark, str(tmp_path / "tasks"), make_predict_fn=no_model, **options).collect()
    assert sorted(map(str, first)) == sorted(map(str, second)) and first
    with pytest.raises(ValueError, match="begun with"):
        probe_folder(spark, str(tmp_path / "tasks"), **{**options, "layers": 3})


def test_a_table_without_a_mark_is_made_anew(spark, tmp_path):
    book = Ledger(spark, str(tmp_path))
    # left by a job that was stopped: rows, but no mark
    spark.range(5).write.parquet(book.at("numbers"))
    assert book.table("numbers", lambda: spark.range(3)).count() == 3
    assert book.table("numbers", lambda: spark.range(9)).count() == 3
    empty = book.table("empty", lambda: spark.range(0).withColumn("part", F.lit("a")), "part")
    assert empty.columns == ["id", "part"] and empty.count() == 0
    assert book.appended("steps", "id bigint").count() == 0


def test_files_follow_the_data(spark, tmp_path):
    tasks = spark.range(4000).select(
        F.lit("en").alias("lang"), F.concat(F.lit("t"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 20)).alias("task"),
        F.lit("tr").alias("stage"), F.lit("a").alias("label"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("text"),
    ).repartition(16)
    taskfile.write_tasks(tasks, str(tmp_path / "small"), "parquet")
    assert len(glob.glob(str(tmp_path / "small" / "*" / "*" / "*.parquet"))) == 20
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "40k")
    try:
        clustered(tasks, "lang", "task").write.partitionBy("lang", "task").parquet(str(tmp_path / "large"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    large = glob.glob(str(tmp_path / "large" / "*" / "task=t0" / "*.parquet"))
    assert len(large) >= 2
    assert len(glob.glob(str(tmp_path / "large" / "*" / "*" / "*.parquet"))) <= 20 * 3 + len(large)
    assert spark.read.parquet(str(tmp_path / "large")).count() == 4000
