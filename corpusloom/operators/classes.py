"""Class tables: counts, rules on class size, label numbers and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import persist_table
from .dims import SMALL_ROWS, join_small, small_or_none
from .repeats import alone, bitmap, repeated_keys


def drop_ambiguous(rows: DataFrame, text: str = "text", by: tuple[str, ...] = (),
                   max_rows: int = SMALL_ROWS) -> DataFrame:
    """Remove every copy of a text that occurs more than once (within ``by``).

    ``rows`` is evaluated once: it is written with the hash of each text, and all that follows reads that table. Hashes
    are counted, few repeated ones are sent to every task, and many by a bitmap of fixed size; texts
    do not move, but for copies and the few texts that share a bit with one, and of copies one per task does. Rows
    without a text, or with a null in ``by``, are not copies of each other.
    """
    key = [*by, "__h"]
    marked = persist_table(rows.withColumn("__h", F.unhex(F.md5(text))), "hashed")
    copies = repeated_keys(marked.select(*key), key)
    few = small_or_none(copies, max_rows)
    if few is not None:
        return marked.join(F.broadcast(few), key, "left_anti").select(*rows.columns)
    return alone(marked, persist_table(bitmap(copies, key), "repeated"), key).select(*rows.columns)


def class_counts(rows: DataFrame, by: tuple[str, ...] = (), label: str = "label") -> DataFrame:
    return rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def class_ratio(rows: DataFrame, stage: str = "stage", label: str = "label") -> DataFrame:
    """Rows per class in each stage."""
    return class_counts(rows, (stage,), label)


def unique_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """The labels of all stages."""
    return rows.select(label).distinct()


def labels_min_count(rows: DataFrame, min_count: int = 2, by: tuple[str, ...] = (),
                     label: str = "label") -> DataFrame:
    """Keep rows of the classes that have at least ``min_count`` rows."""
    keep = class_counts(rows, by, label).filter(F.col("n") >= min_count).drop("n")
    return join_small(rows, keep, [*by, label], "left_semi")


def large_classes(counts: DataFrame, by: tuple[str, ...] = (), label: str = "label",
                  n_classes: int | None = None) -> DataFrame:
    """Class counts of the classes with more rows than there are classes.

    ``n_classes`` is given where classes without any row count as well.
    """
    if n_classes is not None:
        return counts.filter(F.col("n") > n_classes)
    task = W.partitionBy(*[F.col(c) for c in by], F.lit(0))
    return counts.withColumn("k", F.count(F.lit(1)).over(task)).filter("n > k")


def min_class_size(rows: DataFrame, by: tuple[str, ...] = (), label: str = "label") -> DataFrame:
    """Keep rows of the classes with more rows than there are classes."""
    keep = large_classes(class_counts(rows, by, label), by, label).select(*by, label)
    return join_small(rows, keep, [*by, label], "left_semi")


def label_map(rows: DataFrame, stage: str = "stage", label: str = "label",
              by: tuple[str, ...] = ()) -> DataFrame:
    """Sorted distinct training labels numbered from 0."""
    train = rows.filter(F.col(stage) == "tr").select(*by, label).distinct()
    order = W.partitionBy(*[F.col(c) for c in by], F.lit(0)).orderBy(label)
    return train.withColumn("label_idx", (F.row_number().over(order) - 1).cast("int"))


def label_encode(rows: DataFrame, mapping: DataFrame, label: str = "label",
                 by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``label_idx``; a label that training has not seen fails the job."""
    joined = join_small(rows, mapping, [*by, label], "left")
    known = F.assert_true(
        F.col("label_idx").isNotNull(),
        F.concat(F.lit("label not seen in training: "), F.col(label)),
    )
    # coalesce keeps the check in the plan: its value is used, not only computed
    return joined.withColumn("label_idx", F.coalesce(known.cast("int"), F.col("label_idx")))


def class_weights(rows: DataFrame, stage: str = "stage", label: str = "label",
                  by: tuple[str, ...] = ()) -> DataFrame:
    """Balanced weight of each training class: rows / (classes * rows of the class)."""
    counts = class_counts(rows.filter(F.col(stage) == "tr"), by, label)
    total = W.partitionBy(*[F.col(c) for c in by], F.lit(0))
    return counts.select(
        *by, label, "n",
        (F.sum("n").over(total) / (F.count(F.lit(1)).over(total) * F.col("n"))).alias("weight"),
    )
