"""Classification scores from one confusion table per run.

The confusion table has at most classes x classes rows per run, so predictions
are read once, aggregated before the shuffle, and every score follows from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "f1", "classification_report")


def confusion(rows: DataFrame, by: tuple[str, ...] = (), label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    return rows.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_scores(conf: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class; 0 where undefined."""
    # one row per cell and role: as a true label and as a predicted one
    roles = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.lit(1).alias("true"), F.lit(0).alias("pred")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).alias("true"), F.lit(1).alias("pred")),
    ))
    hit = F.col("label") == F.col("prediction")
    sums = (
        conf.select(*by, "n", hit.alias("hit"), roles.alias("r"))
        .groupBy(*by, F.col("r.class").alias("class"))
        .agg(
            F.sum(F.when(F.col("hit") & (F.col("r.true") == 1), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.col("n") * F.col("r.true")).alias("support"),
            F.sum(F.col("n") * F.col("r.pred")).alias("predicted"),
        )
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(
        *by, "class", "support", "tp", "predicted",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def _accuracy() -> Column:
    return F.sum("tp") / F.sum("support")


def _weighted(name: str) -> Column:
    return F.sum(F.col(name) * F.col("support")) / F.sum("support")


def accuracy(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of equal labels."""
    return rows.groupBy(*by).agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")
    )


def f1_weighted(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """F1 of the classes weighted by their support."""
    return class_scores(confusion(rows, by), by).groupBy(*by).agg(_weighted("f1").alias("f1"))


def classification_report(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per class plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    scores = class_scores(confusion(rows, by), by)
    names = ("precision", "recall", "f1")
    per_class = scores.select(*by, F.col("class").cast("string").alias("class"), *names, "support")
    total = scores.groupBy(*by).agg(
        _accuracy().alias("acc"), F.sum("support").alias("support"),
        *[F.avg(n).alias(f"macro_{n}") for n in names],
        *[_weighted(n).alias(f"weighted_{n}") for n in names],
    )
    summary = total.select(*by, F.col("support").alias("support"), F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), *[F.col("acc").alias(n) for n in names]),
        *[
            F.struct(F.lit(f"{kind} avg").alias("class"), *[F.col(f"{kind}_{n}").alias(n) for n in names])
            for kind in ("macro", "weighted")
        ],
    )).alias("s")).select(*by, "s.*", "support")
    return per_class.unionByName(summary)


def compute_metrics(rows: DataFrame, names, by: tuple[str, ...] = ()) -> DataFrame:
    """The chosen metrics as a long table (by, metric, value).

    A classification report contributes one row per class and score.
    """
    names = [names] if isinstance(names, str) else list(names)
    known = [n for n in names if n in METRICS]
    if not known:
        raise NotImplementedError(f"none of the metrics is known: {names}")
    scores = class_scores(confusion(rows, by), by)
    parts = []
    if "accuracy" in known or "f1" in known:
        single = {"accuracy": _accuracy(), "f1": _weighted("f1")}
        wanted = [n for n in ("accuracy", "f1") if n in known]
        one = scores.groupBy(*by).agg(*[single[n].alias(n) for n in wanted])
        parts.append(one.unpivot(list(by), wanted, "metric", "value"))
    if "classification_report" in known:
        report = classification_report(rows, by)
        fields = ["precision", "recall", "f1"]
        long = report.unpivot([*by, "class"], fields, "field", "value")
        parts.append(long.select(*by, F.concat_ws("/", F.lit("report"), "class", "field").alias("metric"), "value"))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def log_loss(rows: DataFrame, probability: str = "probability", label: str = "label_idx",
             by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of -ln p(true class); ``probability`` is an array."""
    p = F.greatest(F.get(probability, F.col(label)), F.lit(1e-15))
    return rows.groupBy(*by).agg(F.avg(-F.log(p)).alias("log_loss"))
