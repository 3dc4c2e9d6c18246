"""What several of the operators share.

Rows are told apart by ``__row``, the number that ``monotonically_increasing_id`` gives them:
unique even where ids are null or repeat. Its
upper bits are the number of the scan's partition, called the row's *run*. Grouping by
(run, key) before grouping by key leaves at most one row of a key per partition, so one key with a
third of all rows costs no more than others, also when its result is joined back.

A second scan may number the same rows otherwise: how files are split hangs on the cores that are
registered at that moment. So whoever joins on ``__row`` takes the numbers from one written table: either
all that is needed later goes into it with the number, or the input itself is written by ``stored``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persist_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "[\\x20\\x09-\\x0D]+"
RUN_BITS = 33
BLOCK_BYTES = 4_000_000


class Stored(NamedTuple):
    """A table written with the numbers of its rows: every read of it has the same ones."""

    rows: DataFrame
    number: str  # the column of numbers
    columns: list[str]  # the others

    @property
    def sparkSession(self) -> SparkSession:
        return self.rows.sparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame | Stored, *columns: str) -> Stored:
    """``df`` (or the named columns of it) numbered and written; what is stored already stays as it is."""
    if isinstance(df, Stored):
        return df
    names, number = list(dict.fromkeys(columns)) or df.columns, "__row"
    while number in (c.lower() for c in names):
        number += "_"
    rows = df.select(F.monotonically_increasing_id().alias(number), *[F.col(f"`{c}`") for c in names])
    return Stored(persist_table(rows, "rows", compression="zstd"), number, names)


def numbered(df: DataFrame | Stored, **columns: Column | str) -> DataFrame:
    """``__row`` and the named columns of ``df``, nothing else: other columns can clash with nothing."""
    picked = [(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    if isinstance(df, Stored):
        return df.rows.select(F.col(df.number).alias("__row"), *picked)
    return df.select(F.monotonically_increasing_id().alias("__row"), *picked)


def whole(df: Stored) -> DataFrame:
    """``__row`` and all columns of ``df`` in one struct ``__all``."""
    names = [F.col(f"`{c}`") for c in df.columns]
    return df.rows.select(F.col(df.number).alias("__row"), F.struct(*names).alias("__all"))


def run_of(row: str = "__row") -> Column:
    return F.shiftright(F.col(row), RUN_BITS).cast("int")


def text_of(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is.

    ``lower`` changes non-ASCII letters too, so it serves texts that have none.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, gap: str = SPACES) -> Column:
    """Words between gaps; an empty text has none."""
    parts = F.split(text, gap)
    return F.filter(parts, lambda w: w != "") if gap is None else F.array_remove(parts, "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows per Arrow batch while the block runs: whole texts are long, so batches have few rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have about ``size`` bytes together, or whose lists as many entries; what is longer
    is a slice by itself."""
    values = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    begin, held = 0, 0
    for i, n in enumerate(length(values).fill_null(0).to_pylist()):
        if held and held + n > size:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def by_group(rows: DataFrame, keys: list[str], best: Column, *more: Column) -> DataFrame:
    """``rows`` grouped twice: (run, keys) with ``__best``, ``__rows`` of the whole group of equal keys.

    ``rows`` needs ``__row``. The result has one row per run and key, to be joined back on both.
    """
    runs = rows.groupBy(run_of().alias("__run"), *keys).agg(F.min(best).alias("__b"), F.count(F.lit(1)).alias("__c"))
    groups = runs.groupBy(*keys).agg(F.min("__b").alias("__best"), F.sum("__c").alias("__rows"))
    return runs.select("__run", *keys).join(groups, keys)
