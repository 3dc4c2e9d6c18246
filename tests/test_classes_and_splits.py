import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import classes as c
from corpusloom.operators import dims
from corpusloom.operators import split as sp
from corpusloom.operators import vectors as ve


def largest_remainder(counts: dict, draws: int) -> dict:
    total = sum(counts.values())
    out = {k: v * draws // total for k, v in counts.items()}
    rest = sorted(counts, key=lambda k: (-(counts[k] * draws % total), k))
    for k in rest[: draws - sum(out.values())]:
        out[k] += 1
    return out


def expected_sizes(counts: dict, partition) -> dict | None:
    """{class: (tr, va, te)}, None when the data is too small."""
    n, k = sum(counts.values()), len(counts)
    draw = int(partition[0] * n)
    if draw < k or n - draw < k or min(counts.values()) < 2:
        return None
    tr = largest_remainder(counts, draw)
    rest = {x: counts[x] - tr[x] for x in counts}
    if len(partition) == 2:
        return {x: (tr[x], 0, rest[x]) for x in counts}
    rest = {x: v for x, v in rest.items() if v > 1}
    n2 = sum(rest.values())
    draw2 = int(partition[2] / (partition[1] + partition[2]) * n2)
    if len(rest) < 2 or draw2 < len(rest) or n2 - draw2 < len(rest):
        return None
    te = largest_remainder(rest, draw2)
    return {x: (tr[x], rest[x] - te[x], te[x]) for x in rest}


def frame(spark, sizes: dict):
    rows = [(f"k{i}", label) for i, label in enumerate(x for x, n in sizes.items() for _ in range(n))]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, label string").repartition(5)


@pytest.mark.parametrize("sizes", [{"3": 4, "2": 2}, {"3": 8, "2": 4}, {"a": 37, "b": 11, "c": 5, "d": 23},
                                   {"hot": 900, "x": 40, "y": 7}, {"a": 10, "b": 10, "c": 10}, {"a": 9}])
@pytest.mark.parametrize("partition", [(0.8, 0.1, 0.1), (0.8, 0.2), (0.6, 0.3, 0.1)])
def test_split_sizes_and_members(spark, sizes, partition):
    rows, df = frame(spark, sizes)
    got = sp.stratified_split(df, "key", partition, seed=7).collect()
    want = expected_sizes(sizes, partition)
    if want is None:
        assert got == []
        return
    counts = Counter((r.label, r.stage) for r in got)
    for label, (tr, va, te) in want.items():
        assert (counts[label, "tr"], counts[label, "va"], counts[label, "te"]) == (tr, va, te)
    assert len({r.key for r in got}) == len(got) == sum(sizes[x] for x in want)
    # the members are those of a plain ranking by hash
    stage = {r.key: r.stage for r in got}
    for label, (tr, va, _) in want.items():
        keys = sorted((k for k, x in rows if x == label), key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))
        assert [stage[k] for k in keys] == ["tr"] * tr + ["va"] * va + ["te"] * (len(keys) - tr - va)


def test_known_small_cases(spark):
    """Six rows in two classes are too few for three parts and enough for two; twelve are too few again."""
    assert expected_sizes({"3": 4, "2": 2}, (0.8, 0.1, 0.1)) is None
    assert expected_sizes({"3": 4, "2": 2}, (0.8, 0.2)) == {"3": (3, 0, 1), "2": (1, 0, 1)}
    assert expected_sizes({"3": 8, "2": 4}, (0.8, 0.1, 0.1)) is None


def test_split_is_repeatable_and_seeded(spark):
    rows, df = frame(spark, {"a": 200, "b": 90})
    one = {tuple(r) for r in sp.stratified_split(df, "key").collect()}
    two = {tuple(r) for r in sp.stratified_split(df.repartition(2).orderBy("label"), "key").collect()}
    other = {tuple(r) for r in sp.stratified_split(df, "key", seed=4).collect()}
    assert one == two != other
    with pytest.raises(ValueError):
        sp.stratified_split(df, "key", shuffle=False)
    with pytest.raises(ValueError):
        sp.stratified_split(df, "key", (0.9, 0.2, 0.1))


def test_cuts_inside_one_prefix(spark):
    """With a single hash digit nearly every cut falls inside a prefix."""
    rows, df = frame(spark, {"a": 300, "b": 41})
    keyed = df.withColumn("o", F.concat(F.md5("key"), F.lit(":"), F.col("key")))
    ends = spark.createDataFrame([("a", "p", 1), ("a", "q", 150), ("a", "r", 300), ("b", "p", 40)], "label string, part string, end bigint")
    for digits in (1, 2, 4):
        cuts = {(r.label, r.part): r.cut for r in sp.cut_values(keyed, ["label"], "o", ends, digits).collect()}
        for label, part, end in (("a", "p", 1), ("a", "q", 150), ("a", "r", 300), ("b", "p", 40)):
            order = sorted(hashlib.md5(k.encode()).hexdigest() + ":" + k for k, x in rows if x == label)
            assert cuts[label, part] == order[end - 1]


def test_control_labels(spark):
    rows, df = frame(spark, {"a": 120, "b": 30, "c": 3})
    staged = df.withColumn("stage", F.when(F.xxhash64("key") % 4 == 0, "te").otherwise("tr"))
    got = sp.control_labels(staged, "key").collect()
    assert len(got) == len(rows)
    assert Counter((r.stage, r.label) for r in got) == Counter((r.stage, r.control_label) for r in got)
    assert any(r.label != r.control_label for r in got)
    both = Counter((r.label, r.control_label) for r in got)
    assert both["b", "b"] < 20  # not the old labels again


def test_drop_ambiguous_removes_every_copy(spark):
    texts = ["hot"] * 4000 + [f"t{i}" for i in range(2000)] + ["twice", "twice"]
    df = spark.createDataFrame([(i, t, str(i % 3)) for i, t in enumerate(texts)], "key int, text string, label string")
    got = c.drop_ambiguous(df).collect()
    assert sorted((r.key, r.text, r.label) for r in got) == sorted(
        (i, t, str(i % 3)) for i, t in enumerate(texts) if t.startswith("t") and t != "twice")


def test_large_dimension_takes_the_shuffle(spark):
    """Beyond the broadcast bound the join is salted; the result stays the same."""
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)], "id int, k string")
    small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        near = sorted(map(tuple, dims.join_small(big, small, ["k"], how).collect()), key=repr)
        far = sorted(map(tuple, dims.join_small(big, small, ["k"], how, max_rows=3).select(
            *dims.join_small(big, small, ["k"], how).columns).collect()), key=repr)
        assert near == far
    plan = dims.join_small(big, small, ["k"], max_rows=3)._jdf.queryExecution().toString()
    assert "__salt" in plan


def test_copies_are_dealt_out(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(3000)], "id int, text string")
    seen = spark.sparkContext.accumulator(0)

    def encode(texts):
        def count(batches):
            for b in batches:
                seen.add(len(b))
                b["n"] = b["text"].str.len()
                yield b[["text_id", "n"]]
        return texts.mapInPandas(count, "text_id string, n bigint")

    plain = sorted((r.id, r.n) for r in ve.encode_distinct(rows, encode, "id").collect())
    assert plain == sorted((i, len("hot" if i % 3 == 0 else f"t{i % 40}")) for i in range(3000))
    marked = rows.withColumn("text_id", ve.text_id())
    counts = marked.groupBy("text_id").agg(F.count(F.lit(1)).alias("__n"))
    vectors = marked.select("text_id", F.length("text").alias("n")).distinct()
    for hot in (100, 7, 1):
        got = ve.join_copies(marked, vectors, counts, "id", hot)
        assert sorted((r.id, r.n) for r in got.collect()) == plain


def test_labels(spark):
    df = spark.createDataFrame([("tr", "b"), ("tr", "a"), ("tr", "b"), ("va", "a"), ("te", "b")], "stage string, label string")
    mapping = c.label_map(df)
    assert {r.label: r.label_idx for r in mapping.collect()} == {"a": 0, "b": 1}
    assert sorted(r.label_idx for r in c.label_encode(df, mapping).collect()) == [0, 0, 1, 1, 1]
    weights = {r.label: r.weight for r in c.class_weights(df).collect()}
    assert weights == {"a": 3 / (2 * 1), "b": 3 / (2 * 2)}
    unseen = df.union(spark.createDataFrame([("va", "new")], df.schema))
    with pytest.raises(Exception, match="not seen in training"):
        c.label_encode(unseen, mapping).collect()
    assert c.labels_min_count(df, 3).count() == 3
    assert {r.label for r in c.unique_labels(unseen).collect()} == {"a", "b", "new"}


def test_lengths(spark):
    df = spark.createDataFrame([("tr", list("abc")), ("tr", list("abcd")), ("va", list("abcde"))], "stage string, tokens array<string>")
    assert ve.length_filter(df, 4).count() == 2  # a sample of just the maximum stays
    assert {r.stage: (r.dropped, r.kept) for r in ve.dropped_rows(df, 4).collect()} == {"tr": (0, 2), "va": (1, 0)}
    assert [len(r.tokens) for r in ve.length_truncate(df, 4).collect()] == [3, 4, 4]
