"""Seeded stratified splits and label permutation, without ranking whole classes.

Rows of a group are ordered by ``md5(seed:key)``. To give the first n rows one
part and the next m another, only the hash values at the cut positions are
needed. They come from row counts per hash prefix and a ranking of the few
prefixes that a cut falls into; then every row finds its part by comparing its
own hash. The texts are never shuffled and no group is ever held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import shuffle_key
from .classes import class_counts
from .dims import join_small, settle

# Seeds of the two builders.
FILTER_SEED = 3
MORPHOLOGY_SEED = 42
STAGES = ("tr", "va", "te")
COUNT = "decimal(38,0)"
# Hex digits of the hash counted per group: 65,536 counts. A class of 10^12 rows
# then ranks about 15 million rows per cut, spread over the cuts.
PREFIX_LEN = 4
# Cuts in a node of the search tree that places rows.
NODE = 64


def check_partition(partition) -> tuple[float, ...]:
    if len(partition) not in (2, 3) or abs(sum(partition) - 1.0) > 1e-9:
        raise ValueError(f"fractions must be two or three and add up to 1: {partition}")
    return tuple(float(p) for p in partition)


def share(counts: DataFrame, draws: str, total: str, by: list[str], label: str, out: str,
          n: str = "n") -> DataFrame:
    """Divide ``draws`` over the classes of a group by largest remainder, ties by label.

    Whole-number arithmetic on decimals, so it is exact at any size.
    """
    scaled = F.col(n).cast(COUNT) * F.col(draws).cast(COUNT)
    order = W.partitionBy(*by).orderBy(F.desc("__rest"), F.asc(label))
    return (
        counts.withColumn("__rest", F.when(F.col(total) > 0, scaled % F.col(total)).cast("bigint"))
        .withColumn("__whole", F.when(F.col(total) > 0, F.expr(
            f"cast((cast({n} as {COUNT}) * cast({draws} as {COUNT})) div {total} as bigint)")))
        .withColumn("__left", F.col(draws) - F.sum("__whole").over(W.partitionBy(*by)))
        .withColumn(out, F.col("__whole") + (F.row_number().over(order) <= F.col("__left")).cast("bigint"))
        .drop("__rest", "__whole", "__left")
    )


def split_quotas(counts: DataFrame, partition, by: tuple[str, ...] = (),
                 label: str = "label") -> DataFrame:
    """Rows of each class for each part: (by, label, n, n_tr, n_va, n_te).

    Training gets floor(p0 * N) rows. With three parts a class needs two rows
    outside training, and a group two such classes, or the group is left out.
    """
    parts = check_partition(partition)
    keys = list(by) or ["__all"]
    df = counts.select(*by, label, "n") if by else counts.select(F.lit(0).alias("__all"), label, "n")
    group = W.partitionBy(*keys)
    df = (
        df.withColumn("__N", F.sum("n").over(group))
        .withColumn("__k", F.count(F.lit(1)).over(group))
        .withColumn("__draw", F.floor(F.lit(parts[0]) * F.col("__N")))
    )
    df = share(df, "__draw", "__N", keys, label, "n_tr")
    # every part must be able to hold each class once, and a class needs two rows
    df = (
        df.withColumn("__low", F.min("n").over(group))
        .filter("__draw >= __k AND __N - __draw >= __k AND __low >= 2")
        .withColumn("__rest_n", F.col("n") - F.col("n_tr"))
    )
    if len(parts) == 2:
        out = df.withColumn("n_va", F.lit(0).cast("bigint")).withColumn("n_te", F.col("__rest_n"))
        return out.select(*by, label, "n", "n_tr", "n_va", "n_te")
    te_share = parts[2] / (parts[1] + parts[2])
    df = (
        df.filter("__rest_n > 1")
        .withColumn("__k2", F.count(F.lit(1)).over(group))
        .withColumn("__N2", F.sum("__rest_n").over(group))
        .withColumn("__draw2", F.floor(F.lit(te_share) * F.col("__N2")))
        .filter("__k2 >= 2 AND __draw2 >= __k2 AND __N2 - __draw2 >= __k2")
    )
    df = share(df, "__draw2", "__N2", keys, label, "n_te", n="__rest_n")
    return df.withColumn("n_va", F.col("__rest_n") - F.col("n_te")).select(
        *by, label, "n", "n_tr", "n_va", "n_te"
    )


def cut_values(rows: DataFrame, group: list[str], order: str, ends: DataFrame,
               prefix_len: int = PREFIX_LEN) -> DataFrame:
    """The ``order`` value of the row at each wanted position: (group, part, cut).

    ``ends`` is (group, part, end), ``end`` counted from 1 in hash order.
    """
    prefix = F.substring(order, 1, prefix_len)
    hist = rows.groupBy(*group, prefix.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    running = W.partitionBy(*group).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = hist.select(
        *group, F.coalesce(F.sum("__n").over(running), F.lit(0)).cast("bigint").alias("__pos"),
        F.lit(1).alias("__kind"), "__p", F.lit(None).cast(ends.schema["part"].dataType).alias("part"),
    )
    wanted = ends.filter("end > 0").select(
        *group, F.col("end").cast("bigint").alias("__pos"), F.lit(0).alias("__kind"),
        F.lit(None).cast("string").alias("__p"), "part",
    )
    # the prefix that holds position e is the last one that starts below e
    sweep = W.partitionBy(*group).orderBy("__pos", "__kind").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        starts.unionByName(wanted)
        .withColumn("__in", F.last("__p", ignorenulls=True).over(sweep))
        .withColumn("__from", F.last(F.when(F.col("__kind") == 1, F.col("__pos")), ignorenulls=True).over(sweep))
        .filter("__kind = 0 AND __in IS NOT NULL")
        .select(*group, "part", F.col("__in").alias("__p"), (F.col("__pos") - F.col("__from")).alias("__rank"))
    )
    placed = settle(placed)
    inside = join_small(
        rows.select(*group, prefix.alias("__p"), F.col(order).alias("cut")),
        placed.select(*group, "__p").distinct(), [*group, "__p"], "left_semi",
    )
    ranked = inside.withColumn(
        "__rank", F.row_number().over(W.partitionBy(*group, "__p").orderBy("cut")).cast("bigint")
    )
    return ranked.join(placed, [*group, "__p", "__rank"]).select(*group, "part", "cut")


def assign_parts(rows: DataFrame, quotas: DataFrame, group: list[str], key: Column,
                 seed: int, part_type: str = "string") -> DataFrame:
    """Add ``part``: the quotas' parts in order over the rows in seeded order.

    ``quotas`` is (group, pos, part, size): within a group, parts are filled by
    ``pos``. Rows of groups without quotas get NULL.
    """
    order = F.concat(shuffle_key(seed, key), F.lit(":"), key.cast("string"))
    keyed = rows.withColumn("__order", order)
    ends = quotas.withColumn(
        "end",
        F.sum("size").over(
            W.partitionBy(*group).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
        ),
    ).filter("size > 0")
    cuts = cut_values(
        keyed.select(*group, "__order"), group, "__order",
        ends.withColumn("part", F.struct("pos", "part")).select(*group, "part", "end"),
    )
    placed = place_between(keyed, cuts, group, "__order")
    return placed.withColumn("part", F.col("part").cast(part_type)).drop("__order")


def place_between(rows: DataFrame, cuts: DataFrame, group: list[str], order: str, wide: int = NODE) -> DataFrame:
    """Add ``part``: that of the first cut of the row's group at or above its ``order``; NULL above all cuts.

    ``cuts`` is (group, part, cut), ``part`` a struct with a field ``part``. A group's cuts are the leaves of a search
    tree whose nodes hold ``wide`` of them. A row goes down from the top, a join per level, and is compared with the
    cuts of a node each time; so a group of a million cuts takes three more joins than one of five, and no row and no
    message holds all cuts of a group.
    """
    within = W.partitionBy(*group).orderBy("cut")
    leaves = settle(cuts.select(
        *group, "cut", F.col("part.part").alias("part"), (F.row_number().over(within) - 1).cast("long").alias("__at")))
    most = leaves.agg(F.max("__at").alias("m")).first()["m"]
    levels = [_nodes(leaves, group, F.struct("cut", "part"), wide)]
    tops = leaves
    while most is not None and most >= wide:
        # the last cut of each node stands for it one level up
        tops = tops.groupBy(*group, F.expr(f"__at div {wide}").alias("__up")).agg(
            F.max("cut").alias("cut")).withColumnRenamed("__up", "__at")
        levels.append(_nodes(tops, group, F.struct("cut", "__at"), wide))
        most //= wide
    rows = rows.withColumn("__node", F.lit(0).cast("long"))
    reached = F.get(F.filter("__cuts", lambda c: c["cut"] >= F.col(order)), F.lit(0))
    for level in levels[:0:-1]:
        rows = join_small(rows, level, [*group, "__node"], "left").withColumn("__node", reached["__at"]).drop("__cuts")
    return join_small(rows, levels[0], [*group, "__node"], "left").withColumn("part", reached["part"]).drop("__cuts", "__node")


def _nodes(entries: DataFrame, group: list[str], entry: Column, wide: int) -> DataFrame:
    """Sorted arrays of ``wide`` entries: (group, __node, __cuts)."""
    return entries.groupBy(*group, F.expr(f"__at div {wide}").alias("__node")).agg(
        F.array_sort(F.collect_list(entry)).alias("__cuts"))


def stratified_split(rows: DataFrame, key: str, partition=(0.8, 0.1, 0.1), seed: int = FILTER_SEED,
                     by: tuple[str, ...] = (), label: str = "label",
                     stages: tuple[str, ...] | None = None, shuffle: bool = True) -> DataFrame:
    """Rows of each class divided into parts; adds ``stage``.

    ``key`` is unique to a row. Rows of classes or groups too small for the split
    are left out. Two fractions give ``tr`` and ``te``.
    """
    if not shuffle:
        raise ValueError("a stratified split needs shuffled rows")
    stages = stages or (STAGES if len(partition) == 3 else ("tr", "te"))
    group = [*by, label]
    counts = class_counts(rows, by, label)
    quotas = split_quotas(counts, partition, by, label)
    return split_by_quotas(rows, quotas, key, seed, group, stages)


def split_by_quotas(rows: DataFrame, quotas: DataFrame, key: str, seed: int, group: list[str],
                    stages: tuple[str, ...] = STAGES) -> DataFrame:
    names = stages if len(stages) == 3 else (stages[0], "", stages[1])
    long = quotas.select(
        *group,
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("pos"), F.lit(s).alias("part"), F.col(f"n_{c}").alias("size"))
            for i, (s, c) in enumerate(zip(names, STAGES))
        ])).alias("q"),
    ).select(*group, "q.pos", "q.part", "q.size")
    out = assign_parts(rows, long, group, F.col(key), seed)
    return out.filter(F.col("part").isNotNull()).withColumnRenamed("part", "stage")


def control_labels(rows: DataFrame, key: str, seed: int = MORPHOLOGY_SEED, stage: str = "stage",
                   label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Labels permuted at random within each stage, as ``control_label``.

    Sorted labels are dealt out over the rows in seeded order. That is a random
    permutation which keeps the class sizes, and needs no join of two rankings.
    """
    group = [*by, stage]
    counts = class_counts(rows, tuple(group), label)
    quotas = counts.select(
        *group, F.col(label).cast("string").alias("pos"), F.col(label).alias("part"),
        F.col("n").alias("size"),
    )
    kind = rows.schema[label].dataType.simpleString()
    out = assign_parts(rows, quotas, group, F.col(key), seed, kind)
    return out.withColumnRenamed("part", "control_label")


def shuffle_rows(rows: DataFrame, key: str, seed: int = MORPHOLOGY_SEED) -> DataFrame:
    """A repeatable random order inside each stage, as a sortable column."""
    return rows.withColumn("shuffle_key", shuffle_key(seed, F.col(key)))
