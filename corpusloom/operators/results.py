"""Run results: means per layer, pivots, and task scores against control scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_COLUMNS = (
    "run_id", "task_language", "task_category", "hf_model_name", "classifier_name",
    "control", "layer", "epoch", "stage", "metric", "value", "log_path",
)


def aggregate_results(facts: DataFrame, metric: str = "f1", stage: str = "test") -> DataFrame:
    """Mean score per run and layer; layers are numbered from 1. A control run is a run of its own."""
    if metric not in ("f1", "accuracy") or stage not in ("val", "test"):
        raise ValueError("metric is 'f1' or 'accuracy', stage 'val' or 'test'")
    run = [c for c in ("run_id", "control") if c in facts.columns]  # logs know neither
    return (
        facts.filter((F.col("metric") == metric) & (F.col("stage") == stage))
        .groupBy("task_language", "task_category", "hf_model_name", "classifier_name", *run,
                 F.col("metric").alias("metric_names"), (F.col("layer") + 1).alias("layer"), "log_path")
        .agg(F.avg("value").alias("metric_scores"))
    )


def pivot_results(scores: DataFrame, values: list, x: str = "layer", y: str = "task_category",
                  value: str = "metric_scores") -> DataFrame:
    """Mean score with ``y`` as rows and the given values of ``x`` as columns."""
    return scores.groupBy(y).pivot(x, values).agg(F.avg(value))


def selectivity(facts: DataFrame, metric: str = "f1", stage: str = "test") -> DataFrame:
    """Score of the task minus score of its control run, per model, classifier and layer."""
    keys = ["task_language", "task_category", "hf_model_name", "classifier_name", "layer"]
    score = lambda flag: F.avg(F.when(F.col("control") == flag, F.col("value")))
    return (
        facts.filter((F.col("metric") == metric) & (F.col("stage") == stage))
        .groupBy(*keys)
        .agg(score(False).alias("task_score"), score(True).alias("control_score"))
        .withColumn("selectivity", F.col("task_score") - F.col("control_score"))
        .filter(F.col("selectivity").isNotNull())
    )
