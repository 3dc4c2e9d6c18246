"""Expressions over one sentence: an array of word tokens with tree pointers.

A sentence is one row, its words one array, so everything here is row-local:
no shuffle, whatever the number of sentences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import Forest, lists_of, pieces, sizes, starts

TOKEN_TYPE = (
    "struct<id:int,id_kind:string,form:string,lemma:string,upos:string,xpos:string,"
    "feats:map<string,string>,head:int,deprel:string,deps:string,misc:string>"
)

# Words of a sentence from which on its preorder is found by ranks and no longer by paths.
LONG_SENTENCE = 512


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``; a column would be inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row. Spark would move a filter on a plain one below it, and compute it there too."""
    return rows.withColumn(name, F.explode_outer(F.array(value)))


def view(words: Column, *fields: str) -> Column:
    """The words with some of their fields only.

    A lambda over the whole token struct makes the scan read every field. Built
    from single fields, only those are read from Parquet.
    """
    return F.arrays_zip(*[words[f].alias(f) for f in fields])


def parse_feats(text: Column) -> Column:
    """``Case=Nom|Number=Sing`` to a map; ``_`` and NULL to NULL. A feature that comes twice keeps its last value."""
    items = F.split(text, r"\|")
    names = F.transform(items, lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    last = F.aggregate(
        F.reverse(items), F.expr("cast(map() as map<string,string>)"),
        lambda acc, x: F.when(F.map_contains_key(acc, F.split_part(x, F.lit("="), F.lit(1))), acc).otherwise(
            F.map_concat(acc, F.str_to_map(x, F.lit(r"\|"), F.lit("=")))))
    once = ~text.contains("|") | (F.size(F.array_distinct(names)) == F.size(names))
    return F.when(text.isNotNull() & ~text.isin("_", ""), F.when(
        once, F.str_to_map(text, F.lit(r"\|"), F.lit("="))).otherwise(last))


def feat(feats: Column, name: str) -> Column:
    """Value of a feature; NULL when the token lacks it or has no features."""
    return F.try_element_at(feats, F.lit(name))


def render_feats(feats: Column) -> Column:
    """Map back to text, keys sorted; ``_`` for none."""
    pairs = F.sort_array(
        F.transform(F.map_entries(feats), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )
    return F.coalesce(F.array_join(pairs, "|"), F.lit("_"))


def feats_texts(maps: pa.Array) -> pa.Array:
    """``render_feats`` of many maps."""
    n = sizes(maps)
    entry = np.repeat(maps.offsets.to_numpy()[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pairs = pc.binary_join_element_wise(maps.keys.take(pa.array(entry)), maps.items.take(pa.array(entry)), "=")
    owner = np.repeat(np.arange(len(n)), n)[pairs.is_valid().to_numpy(zero_copy_only=False)]
    pairs = pairs.drop_null().dictionary_encode()
    rank = np.empty(len(pairs.dictionary), np.int64)
    rank[pc.sort_indices(pairs.dictionary).to_numpy()] = np.arange(len(rank))
    order = np.lexsort((rank[pairs.indices.to_numpy()], owner))
    pairs = pairs.dictionary.take(pairs.indices.take(pa.array(order)))
    lists = pa.ListArray.from_arrays(pa.array(starts(np.bincount(owner, minlength=len(n))), pa.int32()), pairs)
    return pc.if_else(maps.is_valid(), pc.binary_join(lists, "|"), "_")


def contiguous(words: Column) -> Column:
    """True where word ids are 1..n in order, as the format demands."""
    return words["id"] == F.transform(words["id"], lambda _, i: i + 1)


def token_paths(words: Column) -> Column:
    """For every word the ids from the root down to it.

    A task takes its sentences in Arrow batches and goes up a step at a time for all their words, which costs what the paths
    are long. Array order of the paths is the preorder of the tree. Word ids have to be 1..n in order. A word
    that never reaches a root, on a cycle or under a missing head, gets NULL.
    """

    def paths(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for heads, ids in batches:
            for part in pieces(heads):
                yield _paths(heads[part], ids[part])

    return F.arrow_udf(paths, "array<array<int>>")(words["head"], words["id"])


def _paths(heads: pa.Array, ids: pa.Array) -> pa.Array:
    """``token_paths`` of a piece."""
    forest = Forest(heads)
    ends = np.cumsum(forest.depth)
    path = np.empty(forest.depth.sum(), np.int32)
    number = pc.fill_null(ids.flatten(), 0).to_numpy(zero_copy_only=False)
    word = at = np.flatnonzero(forest.depth)
    step = 0
    while len(word):
        step += 1
        path[ends[word] - step] = number[at]
        longer = forest.depth[word] > step
        word, at = word[longer], forest.above[at[longer]]
    unknown = pa.array(forest.depth == 0)
    each = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(path), mask=unknown if (forest.depth == 0).any() else None)
    return lists_of(forest.start, each, heads)


def preorder(words: Column, made_by: Callable[[pa.Array], pa.Array] | None = None) -> Column:
    """For every word a struct of ``rank``, its place in preorder from 1, and ``size``, the words below it and itself.

    A task takes its sentences in Arrow batches and walks the trees of many at once, a level at a time: up for the sizes, down
    for the ranks. Levels are found by pointer doubling, so n words take O(n log n) time and O(n) memory however deep the tree is.
    A word ``a`` stands above ``b``, or is ``b``, where ``a.rank <= b.rank < a.rank + a.size``. Several roots follow each other.
    Words are numbered by their place; a word that never reaches a root, on a cycle or under a missing head, gets NULL.
    ``made_by`` makes the words of a piece out of what ``words`` holds instead, so that words which are only ranked do not travel.
    """

    def ranked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for given in batches:
            for part in pieces(given):
                yield _ranks(heads_of(made_by(given[part])) if made_by else given[part])

    def heads_of(lists: pa.Array) -> pa.Array:
        return lists_of(starts(sizes(lists)), pc.struct_field(lists.flatten(), "head"), lists)

    return F.arrow_udf(ranked, "array<struct<rank:int,size:int>>")(words if made_by else words["head"])


def _ranks(heads: pa.Array) -> pa.Array:
    """``preorder`` of a piece."""
    forest = Forest(heads)
    at, size = forest.places()
    columns = {"rank": at - forest.start[forest.sentence] + 1, "size": size}
    each = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns.values()], list(columns), mask=pa.array(forest.depth == 0))
    return lists_of(forest.start, each, heads)


def preorder_key(words: Column, long: int = LONG_SENTENCE) -> Column:
    """For every word an array of numbers whose order is the preorder of the sentence; NULL as in ``preorder``.

    Up to ``long`` words it is the path, which is cheaper to find; beyond that the rank alone, for paths take
    words x depth. The order is the same.
    """
    by_rank = F.transform(preorder(F.when(F.size(words["head"]) > long, words)), lambda p: F.when(p.isNotNull(), F.array(p["rank"])))
    return F.when(F.size(words["head"]) <= long, token_paths(words)).otherwise(by_rank)


def _endless(heads: Column) -> Column:
    """True where some word never comes to a root by its heads, in ceil(log2 n) rounds."""
    rounds = F.ceil(F.log2(F.greatest(F.size(heads), F.lit(1)) + 1)).cast("int")
    ends = F.aggregate(F.sequence(F.lit(1), rounds), heads, lambda up, _: F.when(
        F.array_max(up) > 0, F.transform(up, lambda u: F.when(u == 0, u).otherwise(F.get(up, u - 1)))).otherwise(up))
    return F.array_max(ends) > 0


def tree_status(words: Column) -> Column:
    """``ok``, or why the sentence is not one rooted tree."""

    def status(t: Column) -> Column:
        heads = t["head"]
        n = F.size(heads)
        return (
            F.when(n == 0, "empty")
            .when(t["id"] != F.sequence(F.lit(1), n), "bad_ids")
            .when(F.exists(heads, lambda h: h.isNull()), "bad_head")
            .when((F.array_min(heads) < 0) | (F.array_max(heads) > n), "bad_head")
            .when(F.array_min(heads) > 0, "no_root")
            .when(F.size(F.array_remove(heads, 0)) < n - 1, "many_roots")
            .when(_endless(heads), "cycle")
            .otherwise("ok")
        )

    return let(F.struct(words["id"].alias("id"), words["head"].alias("head")), status)


def first_by_category(words: Column, upos: str | None = None, deprel: str | None = None,
                      match: str = "any", carry: tuple[str, ...] = ("id", "form", "upos", "deprel"),
                      whole: bool = False) -> Column:
    """Map from each category to its first token in preorder: the carried fields and ``value``.

    ``upos`` and ``deprel`` limit which tokens count. With both given, ``any``
    takes a token that meets either and ``all`` one that meets both. With ``whole``, sentences that are not one rooted
    tree (``tree_status``) give an empty map.

    A task takes its sentences in Arrow batches and walks the trees of many at once.
    """
    if match not in ("any", "all"):
        raise ValueError("match must be 'any' or 'all'")
    limits = {f: x for f, x in (("upos", upos), ("deprel", deprel)) if x is not None}
    fields = list(dict.fromkeys([*carry, *limits, "id"] if whole else [*carry, *limits]))
    types = {"id": "int"}
    value = "struct<" + ",".join(f"{f}:{types.get(f, 'string')}" for f in (*carry, "value")) + ">"

    def firsts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for heads, feats, *columns in batches:
            for part in pieces(heads):
                yield _firsts(heads[part], feats[part], {f: c[part] for f, c in zip(fields, columns)}, limits, match, carry, whole)

    found = F.arrow_udf(firsts, f"map<string,{value}>")
    return found(words["head"], words["feats"], *[words[f] for f in fields])


def _firsts(heads: pa.Array, feats: pa.Array, lists: dict[str, pa.Array], limits: dict[str, str], match: str,
            carry: tuple[str, ...], whole: bool) -> pa.Array:
    """``first_by_category`` of a piece."""
    forest = Forest(heads)
    flat = {f: c.flatten() for f, c in lists.items()}
    order = forest.preorder()
    if whole:
        order = order[forest.whole(lists["id"])[forest.sentence[order]]]
    if limits:
        tests = [pc.fill_null(pc.equal(flat[f], x), False).to_numpy(zero_copy_only=False) for f, x in limits.items()]
        order = order[np.logical_and.reduce(tests)[order] if match == "all" else np.logical_or.reduce(tests)[order]]
    maps = feats.flatten()
    n = sizes(maps)[order]
    # entries of the ordered tokens: their places among all entries, and their tokens
    ends = maps.offsets.to_numpy().astype(np.int64)
    of_piece = slice(ends[0], ends[-1])
    names, values = maps.keys[of_piece], maps.items[of_piece]
    begin = (ends[:-1] - ends[0])[order]
    entry = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    token = np.repeat(order, n)
    keys = names.dictionary_encode()
    code = keys.indices.to_numpy(zero_copy_only=False)[entry].astype(np.int64)
    _, first = np.unique(forest.sentence[token] * (len(keys.dictionary) + 1) + code, return_index=True)
    token, entry = pa.array(token[first]), pa.array(entry[first])
    found = pa.StructArray.from_arrays(
        [*[flat[f].take(token) for f in carry], values.take(entry)], [*carry, "value"])
    begins = starts(np.bincount(forest.sentence[token.to_numpy()], minlength=len(forest.n)))
    return pa.MapArray.from_arrays(
        pa.array(begins, pa.int32()), names.take(entry), found, mask=heads.is_null() if heads.null_count else None)
