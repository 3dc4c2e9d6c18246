"""Queries that train models. Results depend on the solver, so only rows are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classes as c
from ..operators import results as rs
from ..operators import split as sp
from ..operators.vectors import layer_explode
from ..plans import probe
from ..session import fresh_path, persist_table
from . import derive as d
from .registry import query


def _vectors(spark, sf, layers: bool = False):
    tenth = F.col("vec_id") % 10
    stage = F.when(tenth < 8, "tr").when(tenth == 8, "va").otherwise("te")
    if layers:
        rows = layer_explode(d.layer_rows(spark, sf))
    else:
        rows = d.table(spark, sf, "embeddings").select(
            "vec_id", "label", F.lit(0).alias("layer"), F.col("embedding").alias("features"))
    return rows.withColumn("stage", stage).withColumn("label", F.col("label").cast("string"))


def _prepared(spark, sf, layers: bool = False):
    return probe.prepare(persist_table(_vectors(spark, sf, layers), "vectors"))


def _task(spark, sf):
    rows = persist_table(c.drop_ambiguous(d.lang_rows(spark, sf)), "task")
    return sp.stratified_split(c.min_class_size(rows), "doc_id").withColumnRenamed("doc_id", "key")


@query("encode_layers")
def encode_layers(spark, sf):
    out = probe.encode_layers(d.staged_rows(spark, sf), "doc_id")
    total = F.aggregate("features", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return out.select("doc_id", "stage", "label", "layer", F.size("features").alias("width"), F.round(total, 3).alias("total"))


@query("probe_logreg")
def probe_logreg(spark, sf):
    return probe.probe_scores(_prepared(spark, sf), "logreg")


@query("probe_mlp")
def probe_mlp(spark, sf):
    return probe.probe_scores(_prepared(spark, sf), "mlp", max_iter=20)


@query("probe_mdl_codelength")
def probe_mdl_codelength(spark, sf):
    return probe.code_length(_prepared(spark, sf), "vec_id")


@query("probe_layerwise")
def probe_layerwise(spark, sf):
    return probe.probe_layers(_prepared(spark, sf, layers=True), "vec_id", max_iter=30)


@query("probe_sweep")
def probe_sweep(spark, sf):
    """Every language of the vectors as a task of its own."""
    rows = persist_table(_vectors(spark, sf, layers=True).withColumn("task", F.concat(F.lit("t"), F.col("vec_id") % 3)), "vectors")
    prepared = probe.prepare(rows, ("task",))
    return probe.sweep(prepared, "vec_id", max_iter=20)


@query("run_probe")
def run_probe(spark, sf):
    """A probe and its control run, logged, and the difference of their scores."""
    task = persist_table(_task(spark, sf), "probe")
    path = fresh_path(spark, "facts")
    for control in (False, True):
        probe.run_probe(task, "key", "mixed", "lang", control=control, layers=3, max_iter=20,
                        run_id=f"lang-{'control' if control else 'task'}", log_to=path)
    return rs.selectivity(spark.read.parquet(path), "f1", "test")
