"""Joining a large table with a small one whose size is checked, not assumed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import persist_table

# Rows a driver may hold and every executor may receive.
SMALL_ROWS = 200_000
SALTS = 32


def small_or_none(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` as a local table if it has at most ``max_rows`` rows, else None.

    Runs ``df`` once; at most ``max_rows`` + 1 rows ever reach the driver.
    """
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        return None
    table = pa.Table.from_pylist([r.asDict(recursive=True) for r in rows], to_arrow_schema(df.schema))
    return df.sparkSession.createDataFrame(table, df.schema)


def settle(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` computed once: kept local when small, else written to the shared folder."""
    local = small_or_none(df, max_rows)
    return local if local is not None else persist_table(df, "settled")


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               max_rows: int = SMALL_ROWS) -> DataFrame:
    """Join on keys that may be badly skewed in ``big`` but are unique in ``small``.

    Up to ``max_rows`` the small side is broadcast, so ``big`` does not move. Beyond
    that it is repeated per salt and joined by shuffle, which spreads any one key
    over SALTS tasks.
    """
    local = small_or_none(small, max_rows)
    if local is not None:
        return big.join(F.broadcast(local), on, how)
    return join_salted(big, small, on, how)


def join_salted(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Shuffle join that splits every key of ``big`` over ``salts`` tasks.

    The salt is a hash of the whole row, so a task that is run again deals its
    rows out as before. Rows of ``big`` should carry their own key.
    """
    salt = F.pmod(F.xxhash64(*_hashable(big)), F.lit(salts)).cast("int")
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("__salt", salt).join(spread, [*on, "__salt"], how).drop("__salt")


def _hashable(df: DataFrame) -> list[Column]:
    """Columns that Spark can hash (maps cannot be)."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share when an input comes in fewer files than there are cores.

    A large file is cut into many splits, but rows come only with the splits that hold the middle of a row group, which
    may be few. Inputs of many files pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    if parts >= cores and len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(cores, parts), key)
