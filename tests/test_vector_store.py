import pytest
from pyspark.sql import functions as F

from corpusloom.functions.encoder import hashed_ngrams
from corpusloom.plans import probe
from corpusloom.sources.vectors import VectorStore


def counting(path, layers=2, width=8):
    """The small model, noting how many rows it is given."""

    def make():
        model = hashed_ngrams(layers, width)()

        def predict(texts):
            with open(path, "a") as out:
                out.write(f"{len(texts)}\n")
            return model(texts)

        return predict

    return make


def _vectors(spark, texts, tmp_path, keep=True):
    note = tmp_path / "rows"
    note.write_text("")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = probe.encode_layers(rows, "id", layers=2, width=8, make_predict_fn=counting(str(note)),
                              keep_in=str(tmp_path / "store") if keep else None)
    found = sorted((r.id, r.layer, tuple(r.features)) for r in out.collect())
    return found, sum(map(int, note.read_text().split()))


def test_only_new_texts_are_encoded(spark, tmp_path):
    texts = [f"text number {i % 30}" for i in range(50)] + [""]
    first, n = _vectors(spark, texts, tmp_path)
    assert n == 31
    again, n = _vectors(spark, texts, tmp_path)
    assert n == 0 and again == first
    more, n = _vectors(spark, [*texts, "something new", "something else", "something new"], tmp_path)
    assert n == 2 and more[:len(first)] == first
    plain, _ = _vectors(spark, [*texts, "something new", "something else", "something new"], tmp_path, keep=False)
    assert more == plain and len(plain) == 2 * 54


def test_store_of_other_settings_is_refused(spark, tmp_path):
    _vectors(spark, ["a"], tmp_path)
    with pytest.raises(ValueError, match="begun with"):
        VectorStore(spark, str(tmp_path / "store"), {"layers": 3, "width": 8, "pooling": None})


def test_unfinished_batches_and_doubles(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"), {"m": 1})
    assert store.read().count() == 0

    def made(value):
        return lambda texts: texts.select("text_id", F.array(F.array(F.lit(value).cast("float"))).alias("layers"))

    texts = spark.range(40).select(F.sha2(F.col("id").cast("string"), 256).alias("text_id"), F.lit("t").alias("text"))
    store.add(texts, made(1.0))
    # a batch that was stopped before its mark, and one of a run beside the first
    left = made(7.0)(texts).select(F.unhex("text_id").alias("id"), "layers", F.substring("text_id", 1, 1).alias("bucket"))
    left.write.partitionBy("bucket").parquet(store.book.at("vectors/batch=0"))
    assert {r.layers[0][0] for r in store.read().collect()} == {1.0} and store.read().count() == 40
    store.book.table("vectors/batch=z", lambda: left, "bucket")
    assert {r.layers[0][0] for r in store.read().collect()} == {1.0} and store.read().count() == 40


def test_only_the_buckets_asked_for_are_read(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"), {"m": 1})
    texts = spark.range(200).select(F.sha2(F.col("id").cast("string"), 256).alias("text_id"), F.lit("t").alias("text"))
    store.add(texts, lambda t: t.select("text_id", F.array(F.array(F.lit(1.0).cast("float"))).alias("layers")))
    few = texts.filter(F.col("text_id").startswith("a"))
    files = store.read(few).inputFiles()
    plan = store.read(few)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert store.read(few).filter(~F.col("text_id").startswith("a")).isEmpty() and files
