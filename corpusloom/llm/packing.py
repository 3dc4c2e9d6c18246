"""Packing documents into windows by non-negative least squares over a length histogram.

Documents become token ids; a document longer than a window is cut into whole windows and a rest.
Rests are counted by length, in units of ``unit`` tokens. The plan is made from this histogram alone, whose size is
fixed: combinations of up to three lengths that fill a window exactly are enumerated, repeat counts are
the non-negative least-squares solution against the histogram, rounded down and filled up while the
histogram lasts. The n-th rest of a length then has its window by arithmetic.

What is left over, pieces without a place in a combination, is packed greedily: it is poured into the space that
rounding to units leaves at the windows' ends, and then into further windows. Poured pieces are cut where
a window ends. The last tokens are cut into sequences whose lengths are powers of two, which need no padding.

Ids are two bytes each while the work goes on. They are written once, and move once, when the pieces are cut.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dims import join_small
from ..session import persist_table
from .common import arrow_rows, blocks, numbered, text_of
from .recent import Recent, ids_of

WINDOW = 4096
UNIT = 32
END_ID = 2
CACHE_WORDS = 250_000   # a worker holds twice as many
BATCH_ROWS, BLOCK_BYTES = 2000, 6_000_000   # texts whose words are told apart together
BUCKET_ROWS = 100_000   # pieces that one task pours, and twelve times the windows
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"   # small letters that have one form only
# A mark behind a letter begins a token of its own; as a word of its own it leaves fewer different words.
STOP, APART = f"([{LETTERS}])([!-&(-/:-@\\[-`{{-~])", r"\1 \2"

_loaded: dict[str, tuple[Callable, Recent]] = {}


def _tokenizer(path: str) -> tuple[Callable[[list[str]], Iterator[bytes]], Recent]:
    """A function that gives words' ids, and the words it was asked for, per Python worker."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded.clear()
        _loaded[path] = _worker(Tokenizer.from_file(path)), Recent(CACHE_WORDS)
    return _loaded[path]


def _worker(tokenizer) -> Callable[[list[str]], Iterator[bytes]]:
    model, first, then = tokenizer.model, tokenizer.normalizer, tokenizer.pre_tokenizer
    # words of small letters that normalising leaves alone, and that are not cut, go straight to the model, spelt as it spells them
    spelling = {}
    for c in filter(re.compile(f"[{LETTERS}]").match, map(chr, range(256))):
        cut = then.pre_tokenize_str(c * 2) if then else []
        if len(cut) == 1 and (first is None or first.normalize_str(c * 2) == c * 2):
            spelling[ord(c)] = cut[0][0][:len(cut[0][0]) // 2]
    straight = re.compile(f"[{''.join(map(chr, spelling))}]+" if spelling else "(?!)").fullmatch

    def work(words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 10_000):
            part = words[at:at + 10_000]
            out = {w: array("H", [t.id for t in model.tokenize(w.translate(spelling))]).tobytes() for w in part if straight(w)}
            others = [w for w in part if w not in out]
            found = tokenizer.encode(others, is_pretokenized=True, add_special_tokens=False)
            raw = array("H", found.ids).tobytes()
            stop = (2 * np.cumsum(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(others)))).tolist()
            out.update((w, raw[a:b]) for w, a, b in zip(others, [0, *stop], stop))
            yield from map(out.__getitem__, part)

    return work


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, as 16-bit numbers without special tokens added, and where each text's begin (and the last ends).

    For tokenizers that drop white space and never look across it: words between blanks are looked up, and
    each new word is encoded once, many in a call. Lower case is taken beforehand, where it is ASCII; what could be a
    special token stays as written.
    """
    work, recent = _tokenizer(path)
    special = pc.match_substring(texts, "<|")
    plain = pc.replace_substring_regex(pc.ascii_lower(texts), STOP, APART)
    plain = pc.replace_substring(pc.if_else(special, texts, plain), "\n", " ")
    lists = pc.split_pattern(plain, " ")
    begin = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=begin[1:])
    return ids_of(lists.flatten(), begin, recent, work, "<u2")


def _cutter(path: str, window: int, unit: int, end_id: int):
    """Arrow batches of (``__row``, ``__id``, ``__text``) to pieces of at most a window."""
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in chain.from_iterable(blocks(b, "__text", BLOCK_BYTES) for b in batches):
            rows = []
            numbers, docs = batch.column("__row").to_pylist(), batch.column("__id").to_pylist()
            ids, begin = encode(batch.column("__text"), path)
            raw, begin = ids.tobytes(), (2 * begin).tolist()
            for row, doc, a, b in zip(numbers, docs, begin, begin[1:]):
                tokens = raw[a:b] + end
                total = len(tokens) // 2
                for start in range(0, total, window):
                    n = min(window, total - start)
                    size = -(-n // unit)
                    nth = seen.get(size, 0)
                    seen[size] = nth + 1
                    rows.append((row, doc, total, start, n, size, part, nth, tokens[2 * start:2 * (start + n)]))
            kinds = [pa.int64(), batch.schema.field("__id").type, pa.int64(), pa.int64(), pa.int32(), pa.int32(),
                     pa.int32(), pa.int64(), pa.binary()]
            names = ["__row", "__id", "total", "start", "n", "size", "part", "nth", "ids"]
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows[at:at + 2000]), kinds)], names)

    return run


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
             unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, stored: ``nth`` counts those of a ``size`` (in units) in their ``part``."""
    rows = numbered(docs, __id=id_col, __text=text_of(F.col(f"`{text_col}`")))
    kind = rows.schema["__id"].dataType.simpleString()
    schema = (f"__row long, __id {kind}, total long, start long, n int, size int, part int, nth long, ids binary")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return persist_table(rows.mapInArrow(_cutter(path, window, unit, end_id), schema), "tokens")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], dtype=bool)
    slope = a.T @ b
    for _ in range(rounds):
        slope_free = np.where(active, -np.inf, slope)
        j = int(np.argmax(slope_free))
        if slope_free[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[j] = True
        while True:
            solved = np.zeros_like(x)
            solved[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (solved <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - solved[low], 1e-300))
            x = x + step * (solved - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
        x = np.where(active, solved, 0.0)
        slope = a.T @ (b - a @ x)
    return x


def fillings(units: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Combinations of at most ``depth`` lengths that fill ``units`` exactly, longest first."""
    out = [(units,)]
    for k in range(2, depth + 1):
        for head in combinations_with_replacement(range(1, units), k - 1):
            last = units - sum(head)
            if last >= head[-1]:
                out.append(tuple(sorted((*head, last), reverse=True)))
    return sorted(out, reverse=True)


def plan(counts: dict[int, int], tokens: dict[int, int], units: int, unit: int, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with their repeats; never more pieces of a length than ``counts`` has.

    Repeats are lowered until what stays over can fill the space that rounding to units leaves.
    """
    combos = fillings(units, depth)
    total = sum(counts.values())
    if not total:
        return []
    single, several = combos[0], combos[1:]
    a = np.zeros((units, len(several)))
    for j, combo in enumerate(several):
        for size in combo:
            a[size - 1, j] += 1
    b = np.array([counts.get(s, 0) / total for s in range(1, units + 1)])
    b[units - 1] = 0
    x = nnls(a, b) * total if several else np.zeros(0)
    left = dict(counts)
    repeats: dict[tuple[int, ...], int] = {}

    def take(combo: tuple[int, ...], most: int) -> None:
        need = {s: combo.count(s) for s in combo}
        times = min(most, *(left.get(s, 0) // k for s, k in need.items()))
        if times > 0:
            repeats[combo] = repeats.get(combo, 0) + times
            for s, k in need.items():
                left[s] -= k * times

    take(single, left.get(units, 0))
    for j in np.argsort(-x, kind="stable"):
        if x[j] >= 1:
            take(several[j], int(x[j]))
    for combo in several:
        take(combo, total)
    mean = {s: tokens[s] / counts[s] for s in counts if counts[s]}
    gap = {c: units * unit - sum(mean[s] for s in c) for c in repeats}
    space = sum(gap[c] * r for c, r in repeats.items())
    over = sum(left[s] * mean[s] for s in left if left[s])
    while repeats and over < 1.02 * space + units * unit:
        wasteful = max(repeats, key=lambda c: (gap[c], c))
        if gap[wasteful] <= 0:
            break
        # each window given up brings its pieces and takes its gap away
        gain = units * unit - gap[wasteful] + 1.02 * gap[wasteful]
        times = min(repeats[wasteful], max(1, int(np.ceil((1.02 * space + units * unit - over) / gain))))
        repeats[wasteful] -= times
        if not repeats[wasteful]:
            del repeats[wasteful]
        space -= gap[wasteful] * times
        over += (units * unit - gap[wasteful]) * times
    return sorted(repeats.items(), reverse=True)


def _pourer(window: int, planned: int, buckets: int):
    """Pour the pieces of one bucket into its gaps, then into windows of its own."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        gaps = table[table["row"] < 0].sort_values("sequence")
        items = table[table["row"] >= 0].sort_values(["n", "row", "start"], ascending=[False, True, True])
        bucket = int(table["bucket"].iloc[0])
        total = int(items["n"].sum())
        room = gaps["n"].to_numpy(dtype=np.int64)
        names = gaps["sequence"].to_numpy(dtype=np.int64)
        rest = max(0, total - int(room.sum()))
        sizes = [window] * (rest // window)
        rest %= window
        while rest:
            size = 1 << (rest.bit_length() - 1)
            sizes.append(size)
            rest -= size
        fresh = planned + bucket + buckets * np.arange(len(sizes), dtype=np.int64)
        room = np.concatenate([room, np.array(sizes, dtype=np.int64)])
        names = np.concatenate([names, fresh])
        room_to = np.cumsum(room)
        item_to = np.cumsum(items["n"].to_numpy(dtype=np.int64))
        edges = np.unique(np.concatenate([[0], room_to[room_to < total], item_to]))
        at, to = edges[:-1], edges[1:]
        i, w = np.searchsorted(item_to, at, side="right"), np.searchsorted(room_to, at, side="right")
        return pd.DataFrame({
            "row": items["row"].to_numpy(dtype=np.int64)[i],
            "piece": items["start"].to_numpy(dtype=np.int64)[i],
            "skip": at - (item_to[i] - items["n"].to_numpy(dtype=np.int64)[i]),
            "n": to - at, "sequence": names[w], "place": at - (room_to[w] - room[w])})

    return run


def layout(tokens: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = 3) -> DataFrame:
    """Where everything goes: (row, piece, skip, n, sequence, offset); ``piece`` is the start of a stored piece
    and ``skip`` the tokens before this part of it."""
    spark = tokens.sparkSession
    if window % unit:
        raise ValueError("the window has to be a whole number of units")
    units = window // unit
    per_part = tokens.groupBy("part", "size").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    per_part = persist_table(per_part, "counts")
    histogram = per_part.groupBy("size").agg(F.sum("c"), F.sum("t")).collect()  # a row per length, ``units`` at most
    counts, held = {r[0]: r[1] for r in histogram}, {r[0]: r[2] for r in histogram}
    chosen = plan(counts, held, units, unit, depth)
    slots, first, taken = [], 0, {}
    for combo, times in chosen:
        for size in sorted(set(combo)):
            k = combo.count(size)
            begin = taken.get(size, 0)
            slots.append((size, begin, begin + k * times, k, first, sum(1 for s in combo if s > size)))
            taken[size] = begin + k * times
        first += times
    table = spark.createDataFrame(slots, "size int, slot_from long, slot_to long, k int, first long, before int")
    ahead = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", "size", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"))
    rows = join_small(tokens.select("__row", "start", "n", "size", "part", "nth"), starts, ["part", "size"])
    rows = rows.withColumn("slot", F.col("ahead") + F.col("nth"))
    inside = (rows["size"] == table["size"]) & (F.col("slot") >= F.col("slot_from")) & (F.col("slot") < F.col("slot_to"))
    # the table of slots has three rows for each combination at most, whatever the corpus
    rows = rows.join(F.broadcast(table), inside, "left").select(
        F.col("__row").alias("row"), F.col("start").alias("piece"), F.col("n").cast("long"),
        (F.col("first") + F.floor((F.col("slot") - F.col("slot_from")) / F.col("k"))).alias("sequence"),
        (F.col("before") + F.pmod(F.col("slot") - F.col("slot_from"), F.col("k").cast("long"))).alias("place"))
    rows = persist_table(rows, "planned")
    placed = rows.filter("sequence IS NOT NULL")
    over = rows.filter("sequence IS NULL")
    n_over = over.count()
    buckets = max(1, -(-n_over // BUCKET_ROWS), -(-first // (12 * BUCKET_ROWS)))
    gaps = placed.groupBy("sequence").agg((F.lit(window) - F.sum("n")).alias("n")).filter("n > 0").select(
        F.pmod("sequence", F.lit(buckets)).cast("int").alias("bucket"), F.lit(-1).cast("long").alias("row"),
        F.lit(0).cast("long").alias("start"), "n", "sequence")
    items = over.select(F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)).cast("int").alias("bucket"), "row",
                        F.col("piece").alias("start"), "n", F.lit(0).cast("long").alias("sequence"))
    poured = gaps.unionByName(items).groupBy("bucket").applyInPandas(
        _pourer(window, first, buckets), "row long, piece long, skip long, n long, sequence long, place long")
    everything = placed.select("row", "piece", F.lit(0).cast("long").alias("skip"), "n", "sequence", "place",
                               F.lit(0).alias("later")).unionByName(poured.withColumn("later", F.lit(1)))
    order = Window.partitionBy("sequence").orderBy("later", "place")
    return everything.withColumn("offset", F.sum("n").over(order) - F.col("n")).select(
        "row", "piece", "skip", "n", "sequence", "offset")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         unit: int = UNIT, end_id: int = END_ID, depth: int = 3) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``, the
    piece's token ids as little-endian 16-bit numbers.

    ``tokenizer`` is the file of a tokenizer of at most 65,536 ids that drops white space. A document is its ids and
    then ``end_id``; a null or empty text is that id alone. Each id lies in exactly one piece, and in a
    sequence pieces stand gapless from 0. Rows with null or repeated ids are documents like others; an empty table gives an
    empty result.
    """
    tokens = tokenise(docs, tokenizer, id_col, text_col, window, unit, end_id)
    parts = layout(tokens, window, unit, depth)
    stored = tokens.select(F.col("__row").alias("row"), F.col("start").alias("piece"), "__id", "total", "ids")
    cut = F.substring("ids", (2 * F.col("skip") + 1).cast("int"), (2 * F.col("n")).cast("int"))
    return parts.join(stored, ["row", "piece"]).select(
        F.col("__id").alias(id_col), (F.col("piece") + F.col("skip")).alias("start"), F.col("n").alias("length"),
        F.col("total").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset",
        cut.alias("ids"))


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        sums = [zlib.crc32(np.frombuffer(x.as_py(), dtype="<u2").astype("<u4").tobytes()) for x in batch.column("ids")]
        names = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(sums, pa.int64())],
                                         [*names, "ids_crc32"])


def digests(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``, the CRC-32 of the ids as little-endian 32-bit numbers."""
    kept = [f for f in pieces.schema.fields if f.name != "ids"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["ids_crc32 long"])
    return pieces.select(*[f"`{f.name}`" for f in kept], "ids").mapInArrow(_wide, schema)
