"""The two task builders: sentences to labelled, split task rows."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import morphology as mo
from ..operators.classes import class_counts, drop_ambiguous, large_classes
from ..operators.dims import join_small, settle
from ..operators.split import (
    FILTER_SEED, MORPHOLOGY_SEED, STAGES, assign_parts, split_by_quotas, split_quotas,
)
from ..session import persist_table
from .pattern import Pattern

# Fractions for one file, and for the second of two.
ONE_FILE = DEFAULT_PARTITION = (0.8, 0.1, 0.1)
SECOND_FILE = (0.5, 0.5)


# --- syntactic pattern tasks --------------------------------------------------

def as_patterns(queries: dict, extra_categories: tuple[str, ...] = ()) -> dict[str, Pattern]:
    return {
        label: q if isinstance(q, Pattern) else Pattern(q[0], q[1], extra_categories)
        for label, q in queries.items()
    }


def filter_sentences(sentences: DataFrame, pattern: Pattern) -> DataFrame:
    """Sentences with at least one instance of the pattern. A filter: nothing moves."""
    return sentences.filter(pattern.exists(F.col("words")))


def filter_not_matching(sentences: DataFrame, pattern: Pattern) -> DataFrame:
    return sentences.filter(~F.coalesce(pattern.exists(F.col("words")), F.lit(False)))


def multi_class_rows(sentences: DataFrame, queries: dict, keep: tuple[str, ...]) -> DataFrame:
    """One row per sentence and class it matches; a lone class gets its complement.

    All patterns are tested in one pass, instead of a scan per class.
    """
    patterns = as_patterns(queries)
    if not patterns:
        raise ValueError("pass at least one query")
    hits = {
        label: F.coalesce(p.exists(F.col("words")), F.lit(False)) for label, p in patterns.items()
    }
    if len(hits) == 1:
        (label, hit), = hits.items()
        labels = F.array(F.when(hit, label).otherwise(f"not_{label}"))
    else:
        labels = F.filter(
            F.array(*[F.when(hit, label) for label, hit in hits.items()]), lambda x: x.isNotNull()
        )
    return sentences.select(*keep, F.explode(labels).alias("label"))


def build_filter_task(sentences: DataFrame, queries: dict, partition=DEFAULT_PARTITION,
                      key: str = "sent_key", text: str = "text", by: tuple[str, ...] = (),
                      seed: int = FILTER_SEED) -> DataFrame:
    """Pattern classes, ambiguous texts removed, split: (by, key, text, label, stage).

    Two fractions give ``tr`` and ``va``.
    """
    if abs(sum(partition) - 1.0) > 1e-9:
        warnings.warn(f"the parts {partition} do not add up to 1; {DEFAULT_PARTITION} is used")
        partition = DEFAULT_PARTITION
    rows = multi_class_rows(sentences, queries, (*by, key, text))
    rows = drop_ambiguous(rows, text, by)  # a filter on a written table, read several times below
    n_classes = max(len(queries), 2)
    counts = settle(large_classes(class_counts(rows, by), by, n_classes=n_classes))
    if counts.isEmpty():
        raise ValueError("no class has more sentences than there are classes")
    quotas = settle(split_quotas(counts, partition, by))
    if quotas.isEmpty():
        raise ValueError(f"not enough sentences for the partition {partition}")
    stages = STAGES if len(partition) == 3 else ("tr", "va")
    return split_by_quotas(rows, quotas, key, seed, [*by, "label"], stages)


# --- morphological tasks ------------------------------------------------------

@dataclass
class MorphologyTasks:
    """Task rows, what became of each task of the inventory, and of the sentences of each file.

    ``status`` tells of a complete task by ``check`` whether its parts hold the same classes.
    """

    rows: DataFrame
    status: DataFrame
    outcomes: DataFrame


def file_quotas(counts: DataFrame, corpora: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows of each class and file for each stage.

    ``counts`` is (by, role, subcategory, category, label, n), ``corpora`` comes
    from ``corpora_of``. A file with fewer than two classes of a task gives nothing.
    A lone file is divided in three; of two files the first is for training and the
    second divided; three files are the three stages.
    """
    task = [*by, "role", "subcategory", "category"]
    kinds = F.when(F.col("n_files") == 1, "all").when(
        (F.col("n_files") == 2) & (F.col("file_no") == 2), "rest"
    ).otherwise("whole")
    sized = counts.join(corpora, [*by, "role"]).withColumn("__kind", kinds)
    many = sized.groupBy(*task).agg(F.count(F.lit(1)).alias("__k")).filter("__k >= 2").drop("__k")
    sized = sized.join(many, task, "left_semi")
    zero = F.lit(0).cast("bigint")
    stage_of = F.element_at(F.array(*map(F.lit, STAGES)), F.col("file_no"))
    whole = sized.filter("__kind = 'whole'").select(
        *task, "label", "n",
        *[F.when(stage_of == s, F.col("n")).otherwise(zero).alias(f"n_{s}") for s in STAGES],
    )
    enough = lambda kind: large_classes(sized.filter(F.col("__kind") == kind).drop("n_files", "file_no", "__kind"), tuple(task))
    parts = split_quotas(enough("all"), ONE_FILE, tuple(task))
    # two parts: the first is validation here
    rest = split_quotas(enough("rest"), SECOND_FILE, tuple(task)).select(
        *task, "label", "n", zero.alias("n_tr"), F.col("n_tr").alias("n_va"), "n_te"
    )
    return whole.unionByName(parts).unionByName(rest)


def task_complete(quotas: DataFrame, corpora: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Tasks to which every file of the corpus gives a part."""
    task = [*by, "subcategory", "category"]
    files = corpora.select(*by, "n_files").distinct()
    got = quotas.groupBy(*task).agg(F.count_distinct("role").alias("n_ok"))
    return got.join(files, list(by)).filter("n_ok = n_files").select(*task)


def corpora_of(sentences: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Files of each corpus in the order train, dev, test: (by, role, n_files, file_no)."""
    files = sentences.select(*by, F.coalesce("role", F.lit("train")).alias("role")).distinct()
    rank = F.when(F.col("role") == "train", 0).when(F.col("role") == "dev", 1).otherwise(2)
    corpus = W.partitionBy(*by)
    return files.select(
        *by, "role", F.count(F.lit(1)).over(corpus).alias("n_files"),
        F.row_number().over(corpus.orderBy(rank, "role")).alias("file_no"),
    )


def build_ud_tasks(sentences: DataFrame, by: tuple[str, ...] = ("lang",), sorting: str | None = None,
                   upos: str | None = None, deprel: str | None = None, match: str = "any",
                   base_deprel: bool = False, key: str = "sent_key", text: str = "text",
                   seed: int = MORPHOLOGY_SEED) -> MorphologyTasks:
    """All grammatical categories of all corpora to split task rows, in one go.

    ``sentences`` has ``role`` (train, dev, test) per file and ``by`` naming the
    corpus. The labelled rows are written once; counts, quotas and rules work on
    small tables, and a last pass over the rows gives each its stage.
    """
    sentences = sentences.withColumn("role", F.coalesce("role", F.lit("train")))
    corpora = settle(corpora_of(sentences, by))
    if corpora.filter("n_files > 3").limit(1).count():
        raise NotImplementedError("a corpus has more than three files")
    rows = persist_table(
        mo.classify(sentences, (*by, "role", key, text), sorting, upos, deprel, match, base_deprel),
        "classified",
    )
    task = [*by, "role", "subcategory", "category"]
    counts = settle(class_counts(rows, tuple(task)))
    quotas = settle(file_quotas(counts, corpora, by))
    complete = settle(task_complete(quotas, corpora, by))
    status = _status(sentences, counts, complete, quotas, corpora, by, sorting)
    quotas = quotas.join(complete, [*by, "subcategory", "category"], "left_semi")
    status = status.join(label_checks(quotas, by), [*by, "subcategory", "category"], "left")
    out = _place(rows, quotas, [*task, "label"], key, seed)
    return MorphologyTasks(
        out.select(*by, mo.task_name().alias("task"), "stage", "label", key, text), status,
        mo.sentence_outcomes(sentences, (*by, "role"), text),
    )


def label_checks(quotas: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Whether the parts of each task hold the same classes, from the sizes of the parts: (by, subcategory, category, check)."""
    filled = F.filter(F.array(*[F.when(F.col(f"n_{s}") > 0, F.lit(s)) for s in STAGES]), lambda s: s.isNotNull())
    task = (*by, "subcategory", "category")
    return mo.split_label_check(quotas.select(*task, "label", F.explode(filled).alias("stage")), task)


def _place(rows: DataFrame, quotas: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """Stages by quotas. Files that go to one stage as a whole need no order."""
    one = F.when(F.col("n_tr") == F.col("n"), "tr").when(F.col("n_va") == F.col("n"), "va").when(
        F.col("n_te") == F.col("n"), "te")
    whole = quotas.select(*group, one.alias("stage")).filter("stage IS NOT NULL")
    direct = join_small(rows, whole, group)
    divided = quotas.filter(one.isNull())
    needed = join_small(rows, divided.select(*group), group, "left_semi")
    long = divided.select(*group, F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(s).alias("part"), F.col(f"n_{s}").alias("size"))
        for i, s in enumerate(STAGES)
    ])).alias("q")).select(*group, "q.pos", "q.part", "q.size")
    split = assign_parts(needed, long, group, F.col(key), seed).filter(
        F.col("part").isNotNull()).withColumnRenamed("part", "stage")
    return direct.unionByName(split)


def _status(sentences, counts, complete, quotas, corpora, by, sorting) -> DataFrame:
    """One row per task and file: ok, one_class, no_examples, not_enough_data or incomplete."""
    task = [*by, "subcategory", "category"]
    pairs = mo.category_pairs(sentences, sorting, by).join(corpora.select(*by, "role"), list(by))
    base = mo.task_status(counts, pairs, (*by, "role"))
    given = quotas.select(*by, "role", "subcategory", "category").distinct().withColumn("__given", F.lit(True))
    done = complete.withColumn("__done", F.lit(True))
    return (
        base.join(given, [*by, "role", "subcategory", "category"], "left").join(done, task, "left")
        .select(
            *task, "role", "n_classes",
            F.when(F.col("status") != "ok", F.col("status"))
            .when(F.col("__given").isNull(), "not_enough_data")
            .when(F.col("__done").isNull(), "incomplete").otherwise("ok").alias("status"),
        )
    )
