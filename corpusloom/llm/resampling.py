"""Quality selection by importance resampling.

Two generative models of hashed n-grams are counted: one of all texts, one of texts labelled as good. A text's
weight is the log ratio of the two for the whole text, the sum over its n-grams. Gumbel noise of the row is added, and the k largest keys are a sample without replacement in
proportion to the weights.

The raw model is counted over all texts. The good texts may be a sample of the labels, bounded by
``max_labels``; the share of rows to keep is that of all labels. A model has ``buckets`` numbers, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_table
from .common import arrow_rows, ascii_lower, numbered, split_words, text_of

BUCKETS = 1 << 14
MAX_LABELS = 100_000
BINS = 4096
RANK_ROWS = 50_000


def grams(words: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbouring words."""
    def pair(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1))

    ones = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    n = F.size(words)
    twos = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.pmod(pair(i), F.lit(buckets)).cast("int")))
    return F.concat(ones, F.coalesce(twos, F.array().cast("array<int>")))


def _rows(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    rows = numbered(docs, __id=id_col, __text=text_col)
    words = split_words(ascii_lower(text_of("__text")))
    return rows.select("__row", "__id", words.alias("__words")).select(
        "__row", "__id", grams(F.col("__words"), buckets).alias("__grams"))


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            lists = batch.column("__grams")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            counts[0] += np.bincount(values[offsets[0]:offsets[-1]], minlength=buckets)
            good = np.repeat(batch.column("__good").to_numpy(zero_copy_only=False), np.diff(offsets))
            counts[1] += np.bincount(values[offsets[0]:offsets[-1]][good], minlength=buckets)
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[0][seen]), pa.array(counts[1][seen])],
                                         ["bucket", "raw", "good"])

    return run


def log_ratios(docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               buckets: int = BUCKETS, smooth: float = 1.0) -> np.ndarray:
    """log(good / raw) per bucket; ``good_ids`` has one bounded column, the ids of good texts."""
    ids = good_ids.select(F.col(f"`{good_ids.columns[0]}`").alias("__id")).dropna().distinct()
    rows = _rows(docs, id_col, text_col, buckets).join(F.broadcast(ids.withColumn("__good", F.lit(True))), "__id", "left")
    rows = rows.select("__grams", F.coalesce("__good", F.lit(False)).alias("__good"))
    with arrow_rows(docs.sparkSession, 500):
        table = rows.mapInArrow(_counter(buckets), "bucket int, raw long, good long").groupBy("bucket").agg(
            F.sum("raw"), F.sum("good")).collect()  # a row per bucket
    raw, good = np.full(buckets, smooth), np.full(buckets, smooth)
    for b, r, g in table:
        raw[b] += r
        good[b] += g
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def _scorer(ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__grams")
            offsets = lists.offsets.to_numpy()
            values = ratios[lists.values.to_numpy()[offsets[0]:offsets[-1]]]
            sums = np.concatenate([[0.0], np.cumsum(values)])
            at = offsets - offsets[0]
            n = np.diff(at)
            mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)
            names = [c for c in batch.schema.names if c != "__grams"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(n, pa.int64()), pa.array(mean, mask=n == 0)],
                [*names, "n_grams", "mean"])

    return run


def scores(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", span: int | None = None,
           seed: int = 5) -> DataFrame:
    """``__row``, id, ``n_grams``, ``log_weight`` and ``key`` (with Gumbel noise of the row) of every row, stored.

    The weight is the sum over the n-grams; with ``span`` it is their mean times ``span``. A text without n-grams has null for both.
    """
    rows = _rows(docs, id_col, text_col, len(ratios))
    kind = rows.schema["__id"].dataType.simpleString()
    # 53 bits of the hash, in the middle of their steps: never 0 or 1
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__id", "__row"), 11).cast("double") + 0.5) / float(1 << 53)
    with arrow_rows(docs.sparkSession, 500):
        scored = rows.mapInArrow(_scorer(ratios), f"__row long, __id {kind}, n_grams long, mean double")
        return persist_table(scored.withColumn("log_weight", F.round(F.col("mean") * (F.col("n_grams") if span is None else F.lit(span)), 9)).withColumn(
            "key", F.col("log_weight") - F.log(-F.log(u))).drop("mean"), "scores")


def top_k(rows: DataFrame, k: int, key: str = "key", bins: int = BINS, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``rows`` (with ``__row``) and ``__top``: whether the row has one of the k largest keys.

    The place of the k-th key is narrowed by histograms; only the rows of its last bin are ranked, ties by
    ``__row``. Null keys are never among them.
    """
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k <= 0:
        return rows.withColumn("__top", F.lit(False))
    if k >= n:
        return rows.withColumn("__top", F.col(key).isNotNull())
    above, inside = 0, n  # rows above ``high`` (all of them are in), rows from ``low`` to ``high``
    while inside > rank_rows and low < high:
        width = (high - low) / bins
        if not width or low + width == low:
            break
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1))
        counts = rows.filter(F.col(key).between(low, high)).groupBy(place.alias("b")).agg(
            F.count(F.lit(1)), F.min(key), F.max(key)).collect()  # a row per bin
        for _, c, least, most in sorted(counts, reverse=True):
            if above + c >= k:
                if (least, most) == (low, high):
                    inside = 0
                low, high, inside = least, most, c if inside else 0
                break
            above += c
        if not inside:
            break
    ranked = rows.filter(F.col(key).between(low, high)).orderBy(F.desc(key), "__row").limit(k - above).select("__row")
    edge = ranked.withColumn("__edge", F.lit(True))
    return rows.join(edge, "__row", "left").withColumn(
        "__top", F.coalesce((F.col(key) > high) | F.col("__edge"), F.lit(False))).drop("__edge")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             quality_col: str = "quality", share: float | None = None, buckets: int = BUCKETS, span: int | None = None,
             max_labels: int = MAX_LABELS, seed: int = 5) -> DataFrame:
    """One row per input row: id, ``n_grams``, ``log_weight``, ``key`` and ``kept``.

    Good texts are those with ``quality_col`` = 1 in ``labels``; labels are used up to ``max_labels``, those with the
    smallest hashes of their ids. ``share`` of the rows is kept (by default the share of good texts among all
    labels; without good ones all texts with words). Texts without words (null, empty) have null weights and are not kept. Words are between white
    space, A-Z in lower case. Rows with null or repeated ids are sampled by themselves. An empty table gives an empty result.
    """
    some = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{quality_col}`").alias("__q")).dropna()
    n_labels, n_good = some.agg(F.count(F.lit(1)), F.count_if(F.col("__q") == 1)).first()
    some = persist_table(some.orderBy(F.xxhash64(F.lit(seed), "__id"), "__id", "__q").limit(max_labels), "labels")
    good = some.filter("__q = 1")
    ratios = log_ratios(docs, good.select("__id"), id_col, text_col, buckets) if good.count() else np.zeros(buckets)
    rows = scores(docs, ratios, id_col, text_col, span, seed)
    if share is None:
        share = n_good / n_labels if n_good else 1.0
    return top_k(rows, round(share * rows.count())).select(
        "__row", F.col("__id").alias(id_col), "n_grams", "log_weight", "key", F.col("__top").alias("kept"))
