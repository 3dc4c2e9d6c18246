"""Token lists and layer vectors in long form: one row per sample and layer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dims import join_salted, small_or_none

POOLINGS = ("first", "last", "sum", "avg")
# A text with more copies than this is spread over several tasks when joined back.
HOT_COPIES = 100_000


def length_filter(rows: DataFrame, max_len: int, tokens: str = "tokens") -> DataFrame:
    """Keep samples that fit the model; their labels go with them."""
    return rows.filter(F.size(tokens) <= max_len)


def dropped_rows(rows: DataFrame, max_len: int, stage: str = "stage", tokens: str = "tokens") -> DataFrame:
    """How many samples of each stage are too long."""
    return rows.groupBy(stage).agg(
        F.sum((F.size(tokens) > max_len).cast("bigint")).alias("dropped"),
        F.sum((F.size(tokens) <= max_len).cast("bigint")).alias("kept"),
    )


def length_truncate(rows: DataFrame, max_len: int, tokens: str = "tokens") -> DataFrame:
    """Cut token lists to the model's length."""
    return rows.withColumn(tokens, F.slice(tokens, 1, max_len))


def argmax(values: Column) -> Column:
    """Index of the largest element, from 0; the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def layer_explode(rows: DataFrame, layers: str = "layers") -> DataFrame:
    """Array of layer vectors to one row per layer: ``layer``, ``features``."""
    keep = [c for c in rows.columns if c != layers]
    return rows.select(*keep, F.posexplode(layers).alias("layer", "features"))


def layer_select(rows: DataFrame, probing_type: str = "layerwise", layer: str = "layer") -> DataFrame:
    """Layers to probe: all but the embedding output, or the single given vectors."""
    if probing_type == "layerwise":
        return rows.filter(F.col(layer) >= 1)
    if probing_type == "singlerun":
        return rows.filter(F.col(layer) == 0)
    raise NotImplementedError(f"unknown probing type: {probing_type}")


def pool(token_vectors: Column, how: str) -> Column:
    """Array of token vectors to one vector. Row-local: no shuffle."""
    if how == "first":
        return F.get(token_vectors, F.lit(0))
    if how == "last":
        return F.get(token_vectors, F.size(token_vectors) - 1)
    if how not in POOLINGS:
        raise NotImplementedError(f"unknown pooling: {how}")
    size = F.size(F.get(token_vectors, F.lit(0)))
    zero = F.transform(F.sequence(F.lit(1), size), lambda _: F.lit(0.0).cast("double"))
    total = F.aggregate(
        token_vectors, zero,
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")),
    )
    if how == "avg":
        count = F.size(token_vectors)
        total = F.transform(total, lambda x: x / count)
    return F.when(F.size(token_vectors) > 0, total)


def text_id(text: str = "text") -> Column:
    """Identity of a text: short enough to shuffle in place of the text."""
    return F.sha2(F.col(text), 256)


def encode_distinct(rows: DataFrame, encode: Callable[[DataFrame], DataFrame], key: str,
                    text: str = "text", store: DataFrame | None = None) -> DataFrame:
    """Encode each different text once and give the vectors to all of its rows.

    ``encode`` takes a frame of (text_id, text) and replaces the text by vector
    columns. ``store`` holds vectors computed before, by ``text_id``; only texts
    that are missing there are encoded. Copies of a text collapse before the
    shuffle, and rows travel without their text when they fetch their vectors.
    """
    marked = rows.withColumn("text_id", text_id(text))
    texts = marked.groupBy("text_id").agg(F.first(text).alias(text), F.count(F.lit(1)).alias("__n"))
    counts = texts.select("text_id", "__n")
    if store is None:
        vectors = encode(texts.select("text_id", text))
    else:
        fresh = encode(texts.select("text_id", text).join(store.select("text_id"), "text_id", "left_anti"))
        vectors = store.join(counts.select("text_id"), "text_id", "left_semi").unionByName(fresh)
    return join_copies(marked.drop(text), vectors, counts, key).drop("text_id")


def join_copies(rows: DataFrame, vectors: DataFrame, counts: DataFrame, key: str,
                hot_copies: int | None = None) -> DataFrame:
    """Join rows to one vector per text, spreading texts with very many copies.

    The vector of a hot text is repeated once per ``hot_copies`` rows, and its
    rows are dealt out over those repeats by their own key. At most
    rows / hot_copies texts are hot; the list is broadcast only after its size
    is known, and beyond that the join is salted as a whole.
    """
    hot_copies = hot_copies or HOT_COPIES
    hot = small_or_none(counts.filter(F.col("__n") > hot_copies).select(
        "text_id", F.ceil(F.col("__n") / hot_copies).cast("int").alias("__s")))
    if hot is None:
        return join_salted(rows, vectors, ["text_id"])
    if hot.isEmpty():
        return rows.join(vectors, "text_id")
    dealt = rows.join(F.broadcast(hot), "text_id", "left").withColumn(
        "__salt", F.coalesce(F.pmod(F.xxhash64(key), F.col("__s")).cast("int"), F.lit(0))).drop("__s")
    repeated = vectors.join(F.broadcast(hot), "text_id", "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__s", F.lit(1)) - 1))).drop("__s")
    return dealt.join(repeated, ["text_id", "__salt"]).drop("__salt")
