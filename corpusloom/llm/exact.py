"""Exact dedup: sorted runs of digests, merged up a tree.

Every partition of the input makes a run: one row per digest with the identifier that stays and
the number of rows. In each round 2**fan_bits neighbouring runs become one; an exchange brings the
rows of a digest in sibling runs together, and the merged run is written sorted by digest. A round
holds at most one row per digest and run, so a text with a third of all rows weighs no more than
others, and the last run, of the whole table, is still spread over tasks by digest.

A digest alone does not make texts equal: the normalised length in bytes and a second hash go
with it through every level, and rows that differ in them never merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_table
from .common import ascii_lower, numbered, run_of, stored, text_of, whole

KEY = ["__digest", "__bytes", "__check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=ascii_lower) -> DataFrame:
    """``__row``, id, SHA-256 and the two verifying columns of every row, stored."""
    rows = numbered(docs, __id=id_col, __text=normalise(text_of(F.col(f"`{text_col}`"))))
    return persist_table(rows.select(
        "__row", "__id", F.unhex(F.sha2("__text", 256)).alias("__digest"),
        F.octet_length("__text").alias("__bytes"), F.xxhash64("__text").alias("__check"),
    ), "digests")


def _winner(keep: str) -> Column:
    who = F.struct("__id", "__row")
    return (F.max if keep == "largest" else F.min)(who)


def merge_runs(rows: DataFrame, keep: str = "largest", fan_bits: int = 3) -> tuple[DataFrame, DataFrame]:
    """The runs of the leaves, and the single run at the root (``__best``, ``__n`` per digest)."""
    best = F.max if keep == "largest" else F.min
    if keep == "smallest":  # a null id loses against any other
        rows = rows.withColumn("__id", F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id")))
    leaves = persist_table(
        rows.groupBy(run_of().alias("__run"), *KEY).agg(_winner(keep).alias("__best"), F.count(F.lit(1)).alias("__n"))
        .sortWithinPartitions("__run", "__digest"), "runs")
    last = leaves.agg(F.max("__run")).first()[0] or 0
    runs = leaves
    while last > 0:
        runs = persist_table(
            runs.groupBy(F.shiftright("__run", fan_bits).alias("__run"), *KEY)
            .agg(best("__best").alias("__best"), F.sum("__n").alias("__n"))
            .sortWithinPartitions("__run", "__digest"), "runs")
        last >>= fan_bits
    return leaves, runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                fan_bits: int = 3) -> DataFrame:
    """One row per input row: ``__row``, id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    A null text counts as empty, and all empty texts are equal. ``keep`` names the row of a group that
    stays: 'largest' or 'smallest' id. A null id stays only if its group has no other, and of rows
    that share the id that stays one is kept. An empty table gives an empty result.
    """
    rows = digests(docs, id_col, text_col)
    leaves, root = merge_runs(rows, keep, fan_bits)
    known = leaves.select("__run", *KEY).join(root.drop("__run"), KEY)
    best_id = F.col("__best.__id.id") if keep == "smallest" else F.col("__best.__id")
    return rows.withColumn("__run", run_of()).join(known, ["__run", *KEY]).select(
        "__row", F.col("__id").alias(id_col), best_id.alias("keep_id"), F.col("__n").alias("group_size"),
        (F.col("__row") == F.col("__best.__row")).alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = stored(docs)
    kept = exact_dedup(docs, id_col, text_col, keep).filter("kept").select("__row")
    return whole(docs).join(kept, "__row", "left_semi").select("__all.*")
