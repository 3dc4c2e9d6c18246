import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 7919}x{i}" for i in range(30_000))
PARA = "the quick brown fox jumps over a lazy dog while seven other foxes look on from the far side of the river"

# nulls, empty and blank texts, ties, repeated rows, near copies, a very long text
ROWS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, PARA), (4, PARA), (None, PARA.upper()), (5, PARA + " indeed"),
    (6, "one two"), (7, "One two"), (8, "a b c a b c a b c"), (9, LONG), (10, LONG + " tail"),
    (11, "Mail joe.d@x.example.com, bob@y.org or call +1 (988) 555-2485 from 10.0.0.255 with 4532015112830366."),
    (12, "Licensed CC BY. cc by cc-by GENERAL public\nlicense; All Rights Reserved"),
    (13, "é" * 40 + " Ünï cödé 日本語 ß 𝔘𝔫 x@é.com a@b.c@d.e 1.2.3.4.5.6.7.8 " + "line\n" * 9),
    (None, None), (-7, "### *** $$$ | | | <>"), (14, "line one here\nline two here\nline three here\n" * 2),
]
CLASH = ("kept", "n_words", "__row", "__id", "__text", "size", "label", "key", "node", "row", "source_size", "failed")


def table(spark, rows, **more):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.withColumn("lang", F.lit("en")).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    frame = frame.withColumn("n_chars", F.length("text").cast("long"))
    for name in more.get("clash", ()):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """The odd rows, with columns of clashing names, as a table of several files."""
    path = str(tmp_path_factory.mktemp("odd") / "t")
    table(spark, ROWS, clash=CLASH).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "t")
    table(spark, ROWS[:0], clash=CLASH).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def pairs(odd):
    """(id, text) of the odd rows."""
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
