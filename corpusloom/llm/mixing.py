"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of the mix are equal blocks. Sources get blocks by the highest quotients
target / (2 * blocks + 1), and the blocks of a source go to its shards by the highest quotients of
the shards' sizes. Words beyond the limit of a shard go to its source's shards with room, so every shard works to
a whole quota of its own and no word of a source is lost between them. In a shard the documents of a
source stand in a seeded order as one ring of words, cut in blocks from a seeded place on; the quota
is taken from there, round and round if it is larger than the ring. So a document is taken
whole several times and in part at most once more, and what a task holds is bounded by the shard.

The tables of sources and of (source, shard) are small beside the documents: a row per source, and
for each source a row per shard; a source has shards by its own words, one if it is small. The first is handled in one task, the second in one task per source.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dims import join_small
from ..session import persist_table
from .common import SPACES, numbered, split_words, stored, text_of, whole

BLOCK_WORDS = 64
SHARD_ROWS = 20_000
SHARD_BLOCKS = 256  # a source has no more shards than make this many blocks each
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)


def word_count(text: Column, gap: str = SPACES) -> Column:
    return F.size(split_words(text, gap)).cast("long")


def fill(sizes: list[int], weights: list[int], max_epochs: int = MAX_EPOCHS) -> list[Fraction]:
    """Targets that share the sum of the sizes by weight, none above ``max_epochs`` times its size.

    The excess of sources at their limit is shared again among the others. Exact, in O(n log n).
    """
    rest, weight = Fraction(sum(sizes)), sum(weights)
    order = sorted(range(len(sizes)), key=lambda i: (Fraction(max_epochs * sizes[i], weights[i]), i))
    out: list[Fraction] = [Fraction(0)] * len(sizes)
    for i in order:
        share = rest * weights[i] / weight
        out[i] = min(share, Fraction(max_epochs * sizes[i]))
        rest -= out[i]
        weight -= weights[i]
    return out


def apportion(claims: list[Fraction], seats: int) -> list[int]:
    """Seats by the highest quotients claim / (2 * seats + 1); of equal quotients the earlier claim's.

    Starts from the rounded exact share, which is off by less than the number of claims, and moves the
    seats that are missing or too many.
    """
    total = sum(claims)
    if not total or seats <= 0:
        return [0] * len(claims)
    out = [int(c * seats / total + Fraction(1, 2)) for c in claims]
    over = sum(out) - seats
    if over > 0:  # the last seats given go first
        heap = [(c / (2 * s - 1), -i) for i, (c, s) in enumerate(zip(claims, out)) if s]
        heapq.heapify(heap)
        for _ in range(over):
            _, i = heapq.heappop(heap)
            out[-i] -= 1
            if out[-i]:
                heapq.heappush(heap, (claims[-i] / (2 * out[-i] - 1), i))
    elif over < 0:
        heap = [(-c / (2 * s + 1), i) for i, (c, s) in enumerate(zip(claims, out)) if c]
        heapq.heapify(heap)
        for _ in range(-over):
            _, i = heapq.heappop(heap)
            out[i] += 1
            heapq.heappush(heap, (-claims[i] / (2 * out[i] + 1), i))
    return out


def _sources(weights: tuple[int, ...], max_epochs: int, block: int):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        # Spark's order of strings is that of code points; nulls come last
        table = table.sort_values("place").reset_index(drop=True)
        sizes = [int(n) for n in table["source_size"]]
        claims = fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], max_epochs)
        table["target"] = [float(c) for c in claims]
        table["blocks"] = apportion(claims, round(Fraction(sum(sizes), block)))
        return table[["source", "source_size", "target", "blocks"]]

    return run


def shard_words(sizes: list[int], blocks: int, max_epochs: int, block: int) -> list[int]:
    """Words for each shard of a source: blocks by apportionment, none above ``max_epochs`` times its size.

    What is above goes to other shards by the room they have; only what no shard has room for is left out.
    """
    limits = [max_epochs * n for n in sizes]
    given = [block * q for q in apportion([Fraction(n) for n in sizes], blocks)]
    out = [min(g, most) for g, most in zip(given, limits)]
    rooms = [most - w for w, most in zip(out, limits)]
    excess, room = min(sum(given) - sum(out), sum(rooms)), sum(rooms)
    for i, r in enumerate(rooms):  # in proportion to the room, in whole words, exact in sum
        if not excess:
            break
        more = -(-excess * r // room)
        out[i] += more
        excess -= more
        room -= r
    return out


def _shards(max_epochs: int, block: int):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("shard").reset_index(drop=True)
        sizes = [int(n) for n in table["shard_size"]]
        table["quota"] = shard_words(sizes, int(table["blocks"].iloc[0]), max_epochs, block)
        return table[["source", "shard", "shard_size", "source_size", "target", "quota"]]

    return run


def quotas(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
           block: int = BLOCK_WORDS) -> DataFrame:
    """Per (source, shard) of rows (source, shard, size): sizes, target, and ``quota`` in words, stored."""
    shards = persist_table(sized.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")), "shards")
    # one row per source: few enough to be numbered in one task
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = shards.groupBy("source").agg(F.sum("shard_size").alias("source_size"))
    sources = sources.withColumn("place", F.row_number().over(order)).withColumn("one", F.lit(1))
    given = sources.groupBy("one").applyInPandas(
        _sources(weights, max_epochs, block), "source string, source_size long, target double, blocks long")
    given = shards.join(given, shards["source"].eqNullSafe(given["source"])).select(
        shards["source"], "shard", "shard_size", "source_size", "target", "blocks")
    return persist_table(given.groupBy("source").applyInPandas(
        _shards(max_epochs, block), "source string, shard int, shard_size long, source_size long, target double, quota long"), "quotas")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK_WORDS, seed: int = 11,
        shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per input row: ``__row``, id, ``size``, ``source_size``, ``target``, ``taken``, and where the
    part begins: ``part`` words from word ``first`` on, after ``whole_times`` copies.

    Size is the number of words (runs of anything but white space; null text: 0). Sources in the order of
    code points, null (a source of its own) last, have the weights in turn. The order of documents hangs on
    seed, id and text; rows equal in both stand side by side. A source or a corpus without words is taken 0 times.
    An empty table gives an empty result.
    """
    rows = numbered(docs, __id=id_col, source=F.col(f"`{source_col}`").cast("string"), __text=text_col)
    rows = rows.select("__row", "__id", "source", word_count(text_of("__text")).alias("size"),
                       F.xxhash64(F.lit(seed), "__id", "__text").alias("__hash"))
    rows = persist_table(rows, "sized")
    shards = max(1, -(-rows.count() // shard_rows))
    named = F.xxhash64(F.col("source").isNull(), "source")
    own = rows.groupBy(named.alias("__named")).agg(F.sum("size").alias("__words")).select("__named", F.least(
        F.lit(shards), F.greatest(F.floor(F.col("__words") / (block * SHARD_BLOCKS)), F.lit(1))).cast("int").alias("__shards"))
    rows = join_small(rows.withColumn("__named", named), own, ["__named"]).drop("__named")
    # rows without words take no place in a ring, so they are spread over all shards
    rows = rows.withColumn("shard", F.pmod("__hash", F.when(F.col("size") > 0, F.col("__shards")).otherwise(shards)).cast("int"))
    table = quotas(rows, weights, max_epochs, block)
    ring = Window.partitionBy("source", "shard").orderBy("__hash", "__id", "__row")
    rows = rows.withColumn("__from", F.sum("size").over(ring) - F.col("size"))
    key = F.xxhash64(F.col("source").isNull(), "source", "shard")
    table = table.select(key.alias("__key"), "shard_size", "source_size", "target", "quota")
    rows = join_small(rows.withColumn("__key", key), table, ["__key"])
    z = F.greatest("shard_size", F.lit(1))
    want = F.col("quota")
    start = F.pmod(F.xxhash64(F.lit(seed), "__key"), F.expr(f"greatest(cast(ceil(shard_size / {block}) as bigint), 1L)")) * block
    rows = rows.withColumn("whole_times", F.floor(want / z).cast("long")).withColumn("__rest", F.pmod(want, z))
    # places round the ring, counted from its start
    rows = rows.withColumn("__at", F.pmod(F.col("__from") - start, z)).withColumn("__end", F.col("__at") + F.col("size"))
    head = F.greatest(F.least("__end", "__rest") - F.col("__at"), F.lit(0))
    tail = F.greatest(F.least(F.col("__end") - z, F.col("__rest")), F.lit(0))  # the part past the end of the ring
    # a document that lies over both ends of the part gives its first words, as many as both ends hold
    rows = rows.withColumn("part", head + tail)
    begin = F.when(head > 0, 0).otherwise(F.col("size") - (F.col("__end") - z))
    return rows.select(
        "__row", F.col("__id").alias(id_col), "size", "source_size", "target",
        (F.col("whole_times") * F.col("size") + F.col("part")).alias("taken"), "whole_times", "part",
        F.when(F.col("part") > 0, begin).otherwise(0).cast("long").alias("first"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row once for each time that it is taken whole, and
    once with the words of its part, joined by single spaces.

    Rows that are taken not at all, and rows without words, are left out. ``length_col``, if there, follows the text.
    """
    kinds, docs = docs.dtypes, stored(docs)
    taken = mix(docs, id_col, text_col, source_col, **options).filter("taken > 0").select(
        "__row", "size", "whole_times", "part", "first")
    rows = whole(docs).join(taken, "__row")
    words = split_words(text_of(F.col(f"__all.`{text_col}`")))
    cut = F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("part").cast("int")), " ")
    full = F.array_repeat(F.col(f"__all.`{text_col}`"), F.col("whole_times").cast("int"))
    rows = rows.withColumn("__texts", F.when(F.col("part") > 0, F.array_append(full, cut)).otherwise(full))
    rows = rows.select("__all", F.explode("__texts").alias("__text"))
    out = []
    for name, kind in kinds:
        column = F.col(f"__all.`{name}`")
        if name == text_col:
            column = F.col("__text")
        elif name == length_col:
            column = F.length("__text").cast(kind)
        out.append(column.alias(name))
    return rows.select(*out)
