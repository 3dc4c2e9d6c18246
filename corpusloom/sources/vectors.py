"""Vectors that the user brings along, any frame of features, label and stage, and vectors kept on disk by text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import Ledger

# Vectors of a text's layers under the bytes of its hash; a folder per run and first digit of the hash.
STORED = "id binary, layers array<array<float>>, batch string, bucket string"


def from_frame(df: DataFrame, features: str, label: str, stage: str, sample_id: str) -> DataFrame:
    """The long vector table with one layer, numbered 0."""
    return df.select(
        F.col(sample_id).alias("sample_id"), F.col(stage).alias("stage"), F.lit(0).alias("layer"),
        F.col(features).alias("features"), F.col(label).alias("label"),
    )


def classes(vectors: DataFrame) -> DataFrame:
    """The classes are those of the training rows."""
    return vectors.filter("stage = 'tr'").select("label").distinct()


class VectorStore:
    """Layer vectors by the hash of their text, in a folder that belongs to one model and its settings.

    Every run adds the texts that are missing as one batch, which counts once it is whole. Reading takes only the
    buckets that the texts asked for fall into. Two runs at once may both add a text: the batch first in order counts.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark = spark
        self.book = Ledger(spark, path).settle_on("vectors", settings)

    def read(self, texts: DataFrame | None = None) -> DataFrame:
        """(text_id, layers) of the store, with ``texts`` (text_id) of their buckets only."""
        batches = [name.split("=", 1)[1] for name in self.book.done("vectors/")]
        if not batches:
            return self.spark.createDataFrame([], "text_id string, layers array<array<float>>")
        rows = self.spark.read.schema(STORED).parquet(self.book.at("vectors")).filter(F.col("batch").isin(batches))
        if texts is not None:
            # at most 16 values
            buckets = [r["b"] for r in texts.select(F.substring("text_id", 1, 1).alias("b")).distinct().collect()]
            rows = rows.filter(F.col("bucket").isin(buckets))
        named = rows.withColumn("text_id", F.lower(F.hex("id")))
        if len(batches) == 1:
            return named.select("text_id", "layers")
        return named.groupBy("text_id").agg(F.min_by("layers", "batch").alias("layers"))

    def add(self, texts: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> None:
        """Encode the different ``texts`` (text_id, text) that are missing; ``encode`` gives (text_id, layers)."""
        missing = texts.join(self.read(texts).select("text_id"), "text_id", "left_anti")
        if missing.isEmpty():
            return
        self.book.table(f"vectors/batch={uuid.uuid4().hex}", lambda: encode(missing).select(
            F.unhex("text_id").alias("id"), "layers", F.substring("text_id", 1, 1).alias("bucket")), "bucket")
