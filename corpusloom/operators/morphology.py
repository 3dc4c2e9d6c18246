"""Grammatical categories of sentences: inventory, labels, task rules.

``sentences`` has one row per sentence with ``words`` (the array of tokens),
``text`` and key columns. A subcategory is ``no_sorting``, a part of speech, a
relation, or both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.morph import first_by_category, tree_status, view
from ..functions.text import composite_key, deprel_base

SORTINGS = (None, "by_pos", "by_deprel", "by_pos_and_deprel")
UNSORTED = "no_sorting"


def _check_sorting(sorting: str | None) -> None:
    if sorting not in SORTINGS:
        raise ValueError(f"sorting must be one of {SORTINGS}")


def _subcategory(sorting: str | None, upos: Column, deprel: Column) -> Column:
    return {
        None: F.lit(UNSORTED),
        "by_pos": upos,
        "by_deprel": deprel,
        "by_pos_and_deprel": composite_key(upos, deprel),
    }[sorting]


def category_pairs(sentences: DataFrame, sorting: str | None = None,
                   by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (subcategory, category) pairs; relations are cut at the colon."""
    _check_sorting(sorting)
    known = {"by_pos": ("upos",), "by_deprel": ("deprel",), "by_pos_and_deprel": ("upos", "deprel")}
    fields = known.get(sorting, ())
    # words that agree in all that counts collapse in their task, before anything moves; names are made of what is left
    tokens = sentences.select(*by, F.explode(view(F.col("words"), "feats", *fields)).alias("t"))
    kinds = tokens.filter("t.feats IS NOT NULL").select(
        *by, F.map_keys("t.feats").alias("names"), *[F.col(f"t.{f}").alias(f"__{f}") for f in fields]).distinct()
    for field in fields:
        kinds = kinds.filter(F.col(f"__{field}") != "")
    sub = _subcategory(sorting, F.col("__upos") if "upos" in fields else F.lit(None),
                       deprel_base(F.col("__deprel")) if "deprel" in fields else F.lit(None))
    return kinds.select(*by, sub.alias("subcategory"), F.explode("names").alias("category")).distinct()


def category_inventory(sentences: DataFrame, sorting: str | None = None,
                       by: tuple[str, ...] = ()) -> DataFrame:
    """Sorted categories of each subcategory, as an array."""
    return category_pairs(sentences, sorting, by).groupBy(*by, "subcategory").agg(
        F.sort_array(F.collect_set("category")).alias("categories")
    )


def category_count(sentences: DataFrame, sorting: str | None = None,
                   by: tuple[str, ...] = ()) -> DataFrame:
    """Number of categories, summed over the subcategories."""
    return category_pairs(sentences, sorting, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_categories")
    )


def top_category_tokens(sentences: DataFrame, keep: tuple[str, ...], upos: str | None = None,
                        deprel: str | None = None, match: str = "any",
                        carry: tuple[str, ...] = ("id", "form", "upos", "deprel")) -> DataFrame:
    """For each sentence and category the first token in preorder that has it.

    All categories come out of one pass over the sentence row. Sentences that
    are not one rooted tree have no preorder and are left out.
    """
    firsts = first_by_category(F.col("words"), upos, deprel, match, carry, whole=True)
    return (
        sentences.select(*keep, F.explode(firsts).alias("category", "t"))
        .select(*keep, "category", *[F.col(f"t.{f}").alias(f) for f in (*carry, "value")])
    )


def classify(sentences: DataFrame, keep: tuple[str, ...], sorting: str | None = None,
             upos: str | None = None, deprel: str | None = None, match: str = "any",
             base_deprel: bool = False) -> DataFrame:
    """Label every sentence for every task at once: (keep, subcategory, category, label).

    The subcategory is that of the first token with the category. A relation
    counts under its full name, so ``nsubj:pass`` is not in the task ``nsubj``;
    ``base_deprel`` cuts it. Only subcategories of the inventory become tasks.
    """
    _check_sorting(sorting)
    if "metadata" in sentences.columns:
        sentences = sentences.filter(F.size("metadata") > 0)
    tokens = top_category_tokens(sentences, keep, upos, deprel, match, ("upos", "deprel"))
    relation = deprel_base(F.col("deprel")) if base_deprel else F.col("deprel")
    if sorting in ("by_deprel", "by_pos_and_deprel") and not base_deprel:
        # the inventory names relations without their subtype
        tokens = tokens.filter(~F.col("deprel").contains(":"))
    named = tokens.select(
        *keep, _subcategory(sorting, F.col("upos"), relation).alias("subcategory"),
        "category", F.col("value").alias("label"), "upos", "deprel",
    )
    if sorting in ("by_pos", "by_pos_and_deprel"):
        named = named.filter(F.col("upos").isNotNull())
    if sorting in ("by_deprel", "by_pos_and_deprel"):
        named = named.filter(F.col("deprel").isNotNull())
    return named.drop("upos", "deprel")


def sentence_outcomes(sentences: DataFrame, by: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Sentences by what becomes of them in ``classify``: (by, outcome, n).

    ``ok``, ``no_text`` (labelled, with a NULL text), and those that are left out: ``no_metadata``, or why
    the sentence is not one rooted tree.
    """
    tree = tree_status(F.col("words"))
    outcome = F.when(tree != "ok", tree).when(F.col(text).isNull(), "no_text").otherwise("ok")
    if "metadata" in sentences.columns:
        outcome = F.when(F.coalesce(F.size("metadata") > 0, F.lit(False)), outcome).otherwise("no_metadata")
    return sentences.groupBy(*by, outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def task_name() -> Column:
    return F.concat_ws("_", "subcategory", "category")


def task_status(counts: DataFrame, pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of classes of each inventory task and what follows from it.

    ``counts`` is (by, subcategory, category, label, n).
    """
    keys = [*by, "subcategory", "category"]
    classes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_classes"))
    return pairs.join(classes, keys, "left").select(
        *keys, F.coalesce("n_classes", F.lit(0)).cast("bigint").alias("n_classes"),
        F.when(F.col("n_classes").isNull(), "no_examples")
        .when(F.col("n_classes") == 1, "one_class").otherwise("ok").alias("status"),
    )


def split_label_check(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Do the parts of a task hold the same classes? ``counts`` is (by, stage, label, ...)."""
    per = counts.groupBy(*by).agg(*[
        F.sort_array(F.collect_set(F.when(F.col("stage") == s, F.col("label")))).alias(s)
        for s in ("tr", "va", "te")
    ])
    return per.select(
        *by,
        F.when(F.col("tr") != F.col("va"), "train_validation_differ")
        .when(F.col("va") != F.col("te"), "train_test_differ")
        .otherwise("same").alias("check"),
    )
