"""Run logs: nested JSON files of single runs and the long fact table of all runs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the fields read from a log.
LOG_NAME = "log.json"
PARAM_FIELDS = ("task_language", "task_category", "hf_model_name", "classifier_name")
TEST_PREFIX = "test_"

SCORES = "map<string,string>"
LOG_SCHEMA = (
    "params variant,"  # whatever a run was started with
    f"results struct<val_score:{SCORES},test_score:{SCORES},"
    "train_loss:array<double>,val_loss:array<double>>"
)


def read_logs(spark: SparkSession, paths, filename: str = LOG_NAME) -> DataFrame:
    """Every log below the folders, each path once."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (
        spark.read.schema(LOG_SCHEMA).option("multiLine", "true")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", filename)
        .json(sorted(set(paths)))
        .select(F.col("_metadata.file_path").alias("log_path"), "params", "results")
    )


def parameter(name: str, kind: str = "string", params: str = "params") -> Column:
    """A run parameter by name, from a log or from the fact table; NULL where the run has none of that name or kind."""
    return F.try_variant_get(params, f"$.{name}", kind)


def parameters(values: dict) -> Column:
    """Run parameters (numbers, texts, lists and maps by name) as one variant."""
    return F.parse_json(F.lit(json.dumps(values, sort_keys=True)))


def log_scores(logs: DataFrame) -> DataFrame:
    """Scores as rows: (log_path, run fields, stage, metric, layer, epoch, value).

    Two shapes occur. In ``{layer: [values]}`` the key is the layer and the place
    in the list the epoch. In a bare list of test scores the place is the layer.
    A bare list of validation scores holds all epochs of each layer in turn; the
    number of test scores tells how many layers it covers.
    """
    stages = F.explode(F.array(
        F.struct(F.lit("val").alias("stage"), F.col("results.val_score").alias("scores")),
        F.struct(F.lit("test").alias("stage"), F.col("results.test_score").alias("scores")),
    )).alias("s")
    per_metric = (
        logs.select("log_path", *[parameter(p).alias(p) for p in PARAM_FIELDS],
                    F.col("results.test_score").alias("tests"), stages)
        .select("log_path", *PARAM_FIELDS, "tests", F.col("s.stage").alias("stage"),
                F.explode("s.scores").alias("metric", "json"))
    )
    flat = F.from_json("json", "array<double>")
    keyed = F.from_json("json", "map<string,array<double>>")
    layers = F.greatest(F.size(F.from_json(F.try_element_at("tests", F.col("metric")), "array<double>")), F.lit(1))
    epochs = F.greatest(F.floor(F.size(flat) / layers), F.lit(1))
    from_list = F.transform(flat, lambda v, i: F.struct(
        F.when(F.col("stage") == "test", i).otherwise(F.floor(i / epochs)).cast("int").alias("layer"),
        F.when(F.col("stage") == "test", F.lit(0)).otherwise(i % epochs).cast("int").alias("epoch"),
        v.alias("value"),
    ))
    from_map = F.flatten(F.transform(F.map_entries(keyed), lambda e: F.transform(
        e["value"], lambda v, i: F.struct(
            e["key"].cast("int").alias("layer"), i.cast("int").alias("epoch"), v.alias("value")
        )
    )))
    items = F.when(F.ltrim("json").startswith("["), from_list).otherwise(from_map)
    return per_metric.select("log_path", *PARAM_FIELDS, "stage", "metric", F.explode(items).alias("i")).select(
        "log_path", *PARAM_FIELDS, "stage", "metric", "i.layer", "i.epoch", "i.value"
    )


def write_facts(facts: DataFrame, path: str, task: str = "task_category") -> None:
    """Write run facts, one folder per run; runs of trial tasks are not kept. A run written again replaces itself."""
    (
        facts.filter(~F.coalesce(F.col(task), F.lit("")).startswith(TEST_PREFIX))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    )
