"""Near duplicates by min-max hashing.

Each permutation of the shingles gives two values, its minimum and its maximum, so a signature of
given length takes half the hash evaluations. Both agree for two sets with the probability of their
Jaccard similarity. Minima and maxima make bands; texts that share a band are candidates, and a link
counts only if the full shingle sets confirm it.

Sets are first collapsed to classes of equal sets, so copies are compared once. Then:

1. Each class is compared with the least edited class that shares a band with it. That settles
   nearly all of a group, however large, with one comparison for each member.
2. In the bands that still hold several components, all members outside the largest one are compared
   with the members of other components, if the numbers of shingles that a set shares with any other set
   allow a link. Members of one component never meet again. Keys with many members are compared in
   blocks of bounded size, many pairs in one matrix product, and give one link for two
   components; pairs are rows only for keys with few members. No pair that could be a link is left out.

With 16 bands of 5 minima and 16 of 5 maxima, two sets at a similarity of exactly 0.8 share none with a
probability of (1 - 0.8**5)**32, about 3 in a million, and less above.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dims import SMALL_ROWS
from ..session import persist_table
from .common import SPACES, arrow_rows, ascii_lower, by_group, numbered, run_of, split_words, stored, text_of, whole
from .components import components

KEY = ["__k1", "__k2", "__n"]
BLOCK = 1 << 16
LARGE_KEY = 32    # members from which on a key's sets are compared in blocks
BLOCK_SETS = 512  # outside sets of a block; a block of all sets has twice as many
BLOCK_SHINGLES = 400_000  # of the outside sets of a block
COLUMNS = 4096    # shingles of one matrix product


def shingles(words: Column, size: int = 4) -> Column:
    """Distinct 64-bit hashes of ``size`` consecutive words, sorted; fewer words are one shingle, none are none."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    hashed = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) > 0, F.sort_array(F.array_distinct(hashed))).otherwise(
        F.array().cast("array<bigint>"))


def signer(bands: int, rows: int, seed: int):
    """Function on Arrow batches: column ``__set`` becomes ``__bands``, ``bands`` keys (none for an empty set)."""
    draw = random.Random(seed)
    perms = bands * rows // 2
    factors = [draw.getrandbits(64) | 1 for _ in range(perms)]
    shifts = [draw.getrandbits(64) for _ in range(perms)]
    weights = np.array([draw.getrandbits(64) | 1 for _ in range(rows)], dtype=np.uint64)

    def sign(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Band keys of the sets that begin at ``starts``; none is empty."""
        low = np.empty((len(starts), perms), dtype=np.uint64)
        high = np.empty_like(low)
        with np.errstate(over="ignore"):
            for p in range(perms):
                v = values * np.uint64(factors[p]) + np.uint64(shifts[p])
                low[:, p] = np.minimum.reduceat(v, starts)
                high[:, p] = np.maximum.reduceat(v, starts)
            parts = np.concatenate([low, high], axis=1).reshape(len(starts), bands, rows)
            parts = (parts ^ (parts >> np.uint64(29))) * weights
            keys = parts.sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            keys = (keys ^ (keys >> np.uint64(31))) * weights[0]
        return (keys ^ (keys >> np.uint64(30))).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("__set")
            offsets = sets.offsets.to_numpy()
            values = sets.values.to_numpy().view(np.uint64)
            full = np.flatnonzero(np.diff(offsets) > 0)
            keys = np.empty((len(full), bands), dtype=np.int64)
            at = 0
            while at < len(full):  # blocks that stay in the cache; a longer set is a block by itself
                begin = offsets[full[at]]
                end = max(at + 1, int(np.searchsorted(offsets[full], begin + BLOCK)))
                stop = offsets[full[end - 1] + 1]
                keys[at:end] = sign(values[begin:stop], offsets[full[at:end]] - begin)
                at = end
            sizes = np.zeros(len(sets) + 1, dtype=np.int32)
            sizes[full + 1] = bands
            column = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(keys.ravel()))
            kept = [n for n in batch.schema.names if n != "__set"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [column], [*kept, "__bands"])

    return run


def sets_of(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    rows = numbered(docs, __id=id_col, __text=text_col)
    words = split_words(ascii_lower(text_of("__text")), SPACES)
    return rows.select("__row", "__id", words.alias("__words")).select(
        "__row", "__id", shingles(F.col("__words"), size).alias("__set"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bands: int = 32,
             rows: int = 5, seed: int = 7) -> DataFrame:
    """``__row``, ``__id``, the class key (two hashes and the size of the set) and ``__bands``, stored."""
    sets = sets_of(docs, id_col, text_col, size).select(
        "__row", "__id", F.xxhash64("__set").alias("__k1"), F.xxhash64(F.lit(1), "__set").alias("__k2"),
        F.size("__set").alias("__n"), "__set")
    kinds = [f for f in sets.schema.fields if f.name != "__set"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kinds] + ["__bands array<bigint>"])
    with arrow_rows(docs.sparkSession, 500):
        return persist_table(sets.mapInArrow(signer(bands, rows, seed), schema), "sketches")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node) of keys that several of the nodes (node, ``__bands``) share, stored."""
    held = nodes.select("node", F.explode("__bands").alias("key"))
    shared = held.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    return persist_table(held.join(shared, "key"), "keys")


def describe(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, own) of the sets (node, ``__set``) that can have a link at all, stored; ``own`` counts the shingles
    that no other of the sets has.

    Two sets have at most min(n - own) shingles in common. Edited copies have own shingles, so this bound tells
    most copies of one text that are too far from each other without comparing them, and no others.
    """
    alone = sets.select("node", F.explode("__set").alias("s")).groupBy("s").agg(
        F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1")
    own = alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    rows = sets.select("node", F.size("__set").cast("long").alias("n")).join(own, "node", "left").select(
        "node", "n", F.coalesce("own", F.lit(0)).alias("own"))
    return persist_table(rows.filter(F.lit(100) * (F.col("n") - F.col("own")) >= F.lit(percent) * F.col("n")), "described")


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether the structs (n, own) of two sets allow the similarity."""
    most = F.least(*[F.col(f"{x}.n") - F.col(f"{x}.own") for x in (a, b)])
    return F.lit(100) * most >= F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity, stored."""
    left = sets.select(F.col("node").alias("a"), F.col("__set").alias("__a"))
    right = sets.select(F.col("node").alias("b"), F.col("__set").alias("__b"))
    both = F.size(F.array_intersect("__a", "__b"))
    union = F.size("__a") + F.size("__b") - both
    return persist_table(pairs.select("a", "b").join(left, "a").join(right, "b")
                         .filter(F.lit(100) * both >= F.lit(percent) * union).select("a", "b"), "links")


def _open_keys(held: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, node, x, label) of keys that still hold several components, and these keys (key, m, top, top_c):
    members, and the largest component with its members."""
    named = persist_table(held.select("key", "node", "x").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")), "named")
    per = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    keys = per.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"))
    keys = persist_table(keys.filter("m > top.c").select("key", "m", F.col("top.label").alias("top"),
                                                          F.col("top.c").alias("top_c")), "open")
    return named.join(keys.select("key", "top", "m"), "key"), keys


def _meet(percent: int):
    """Links between outside sets of one block and all sets of another, by products of their incidence matrices."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        out, every = table[table["outside"]], table[~table["outside"]]
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if len(out) and len(every):
            a_n, b_n = out["n"].to_numpy(), every["n"].to_numpy()
            ids = np.concatenate([*out["__set"], *every["__set"]])
            rows = np.repeat(np.arange(len(table)), np.concatenate([a_n, b_n]))
            names, place = np.unique(ids, return_inverse=True)
            left = rows < len(out)
            shared = (np.bincount(place[left], minlength=len(names)) > 0) & (np.bincount(place[~left], minlength=len(names)) > 0)
            column = np.cumsum(shared) - 1
            keep = shared[place]
            rows, place, left = rows[keep], column[place[keep]], left[keep]
            both = np.zeros((len(out), len(every)), dtype=np.float32)
            for at in range(0, int(shared.sum()), COLUMNS):
                here = (place >= at) & (place < at + COLUMNS)
                a = np.zeros((len(out), COLUMNS), dtype=np.float32)
                b = np.zeros((len(every), COLUMNS), dtype=np.float32)
                a[rows[here & left], place[here & left] - at] = 1
                b[rows[here & ~left] - len(out), place[here & ~left] - at] = 1
                both += a @ b.T
            union = a_n[:, None] + b_n[None, :] - both
            a_l, b_l = out["label"].to_numpy(), every["label"].to_numpy()
            for i, j in zip(*np.nonzero((100 * both >= percent * union) & (a_l[:, None] != b_l[None, :]))):
                found.setdefault((int(a_l[i]), int(b_l[j])), (int(out["node"].iloc[i]), int(every["node"].iloc[j])))
        return pd.DataFrame(list(found.values()), columns=["a", "b"]).astype("int64")

    return run


def _large_keys(members: DataFrame, keys: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links within the clusters that large keys make of their members, and (node, cluster), both stored.

    Clusters are dealt into blocks of outside and of all members, and every pair of blocks is compared in
    a task of its own. No pair leaves a task but one link between two components.
    """
    large = members.filter(F.col("m") > LARGE_KEY)
    edges = large.select(F.col("top").alias("a"), F.col("label").alias("b")).distinct()
    clusters = components(edges).select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    # the largest component of a cluster has nothing to be compared with itself; the others are outside
    inside = persist_table(large.select("node", "label", F.col("x.n").alias("n")).distinct().join(clusters, "label"), "clusters")
    # weights are in sets of usual length, so blocks of long sets have fewer of them
    weight = F.greatest(F.lit(1.0), F.col("n") / (BLOCK_SHINGLES / BLOCK_SETS))
    sizes = inside.groupBy("cluster", "label").agg(F.sum(weight).alias("c")).groupBy("cluster").agg(
        F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"))
    sizes = sizes.select("cluster", F.col("top.label").alias("top"),
                         F.ceil((F.col("m") - F.col("top.c")) / BLOCK_SETS).cast("int").alias("blocks_a"),
                         F.ceil(F.col("m") / (2 * BLOCK_SETS)).cast("int").alias("blocks_b"))
    rows = inside.join(sizes.filter("blocks_a > 0"), "cluster").join(sets, "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    outside = rows.filter("label <> top").withColumn("i", deal(F.col("blocks_a"))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1))).withColumn("outside", F.lit(True))
    every = rows.withColumn("j", deal(F.col("blocks_b"))).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1))).withColumn("outside", F.lit(False))
    columns = ["cluster", "i", "j", "outside", "node", "label", "n", "__set"]
    met = outside.select(*columns).unionByName(every.select(*columns)).groupBy("cluster", "i", "j")
    return persist_table(met.applyInPandas(_meet(percent), "a long, b long"), "links"), inside.select("node", "cluster")


def find_links(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all nodes (node, ``__bands``) which share a key and are similar in full (``sets``).

    Not every such pair is among them: those whose ends others connect may be missing.
    """
    keys = shared_keys(nodes)
    wanted = persist_table(keys.select("node").distinct(), "wanted")
    many = wanted.count()
    # ids of candidates only; beyond the bound both sides are shuffled
    sets = persist_table(sets.join(F.broadcast(wanted) if many <= SMALL_ROWS else wanted, "node"), "sets")
    held = persist_table(keys.join(describe(sets, percent), "node").select(
        "key", "node", F.struct("n", "own").alias("x")), "held")
    rank = (F.col("x.own") * 1_000_000 / F.col("x.n")).cast("long")  # the least edited of a key leads it
    lead = held.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "node", "x")).alias("lead"))
    first = held.join(lead, "key").filter((F.col("node") != F.col("lead.node")) & _alike("x", "lead.x", percent))
    first = first.groupBy("node").agg(F.min("lead").alias("lead"))
    links = confirm(first.select(F.col("node").alias("b"), F.col("lead.node").alias("a")), sets, percent)
    members, keys = _open_keys(held, components(links))
    if keys.isEmpty():
        return links
    done = F.lit(False)
    if not keys.filter(F.col("m") > LARGE_KEY).isEmpty():
        more, clusters = _large_keys(members, keys, sets, percent)
        links = links.unionByName(more)
        members, keys = _open_keys(held, components(links))
        members = members.join(clusters, "node", "left")
        done = F.coalesce(F.col("o_cluster") == F.col("cluster"), F.lit(False))  # compared in blocks
    else:
        members = members.withColumn("cluster", F.lit(None).cast("long"))
    # a large key lies within one cluster, so what is left are keys of few members
    few = persist_table(members.filter(F.col("m") <= LARGE_KEY), "few")
    outside = few.filter("label <> top").select(
        "key", F.col("node").alias("o"), F.col("x").alias("o_x"), F.col("label").alias("o_label"), F.col("cluster").alias("o_cluster"))
    met = (outside["key"] == few["key"]) & (F.col("o_label") != F.col("label")) & ~done & _alike("o_x", "x", percent)
    pairs = outside.join(few, met).select(F.least("o", "node").alias("a"), F.greatest("o", "node").alias("b")).distinct()
    return links.unionByName(confirm(pairs, sets, percent))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80,
                bands: int = 32, rows: int = 5, seed: int = 7) -> DataFrame:
    """One row per input row: ``__row``, id, ``n_shingles``, ``component_id``, ``kept``.

    Texts are linked if 100 * intersection >= percent * union of their sets of distinct ``size``-word shingles
    (words between white space, A-Z in lower case). A null or empty text has no shingle and is linked with
    nothing. ``component_id`` is the smallest id of the component; one row of a component is kept,
    the first with that id. Null ids are larger than others; repeated rows are in one component. An
    empty table gives an empty result.
    """
    docs = stored(docs, id_col, text_col)
    rows_ = sketches(docs, id_col, text_col, size, bands, rows, seed)
    filled = rows_.filter("__n > 0")
    who = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    classes = persist_table(by_group(filled.drop("__bands"), KEY, who), "classes")
    nodes = filled.join(classes.select(F.col("__best.row").alias("__row")).distinct(), "__row", "left_semi").select(
        F.col("__row").alias("node"), "__bands")
    links = find_links(nodes, sets_of(docs, id_col, text_col, size).select(F.col("__row").alias("node"), "__set"), percent)
    labels = components(links)
    classes = classes.withColumn("node", F.col("__best.row"))
    heads = classes.join(labels, "node").groupBy("label").agg(F.min("__best").alias("__head"))
    known = classes.join(labels.join(heads, "label").select("node", "__head"), "node", "left").select(
        "__run", *KEY, F.coalesce("__head", "__best").alias("__head"))
    rows_ = rows_.select("__row", "__id", *KEY).withColumn("__run", run_of())
    return rows_.join(known, ["__run", *KEY], "left").select(
        "__row", F.col("__id").alias(id_col), F.col("__n").cast("long").alias("n_shingles"),
        F.when(F.col("__head").isNull(), F.col("__id")).otherwise(F.col("__head.id")).alias("component_id"),
        (F.col("__head").isNull() | (F.col("__head.row") == F.col("__row"))).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``docs``, with all its columns."""
    docs = stored(docs)
    kept = near_groups(docs, id_col, text_col, **options).filter("kept").select("__row")
    return whole(docs).join(kept, "__row", "left_semi").select("__all.*")
