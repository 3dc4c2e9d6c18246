"""Queries on vectors, metrics and run results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as me
from ..operators import results as rs
from ..operators import vectors as ve
from ..operators.dims import join_small
from ..session import persist_table
from ..sources import vectors as vs
from . import derive as d
from .registry import query


def _stage(key: str):
    tenth = F.col(key) % 10
    return F.when(tenth < 8, "tr").when(tenth == 8, "va").otherwise("te")


SQL_STAGE = "CASE WHEN vec_id % 10 < 8 THEN 'tr' WHEN vec_id % 10 = 8 THEN 'va' ELSE 'te' END"


@query("vector_scan", f"""
WITH v AS (SELECT {SQL_STAGE} AS stage, label, embedding FROM embeddings),
c AS (SELECT DISTINCT label FROM v WHERE stage = 'tr')
SELECT stage, label, 0 AS layer, count(*) AS n,
  round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 4) AS vector_sum
FROM v JOIN c USING (label) GROUP BY stage, label""")
def vector_scan(spark, sf):
    emb = d.table(spark, sf, "embeddings").withColumn("stage", _stage("vec_id"))
    rows = vs.from_frame(emb, "embedding", "label", "stage", "vec_id")
    every = F.aggregate("features", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return join_small(rows, vs.classes(rows), ["label"], "left_semi").groupBy("stage", "label", "layer").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(every), 4).alias("vector_sum"))


@query("argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings")
def argmax(spark, sf):
    return d.table(spark, sf, "embeddings").select("vec_id", ve.argmax(F.col("embedding")).alias("best"))


def _vector_sums(rows):
    total = F.aggregate("features", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return rows.select("vec_id", "label", "layer", F.size("features").cast("bigint").alias("width"),
                       F.round(total, 6).alias("total"))


SQL_SUMS = "vec_id, label, CAST(layer AS INTEGER) AS layer, len(features) AS width, round(list_sum(list_transform(features, lambda x: CAST(x AS DOUBLE))), 6) AS total"


@query("layer_explode", f"WITH {d.SQL_LAYERS} SELECT {SQL_SUMS} FROM ly")
def layer_explode(spark, sf):
    return _vector_sums(ve.layer_explode(d.layer_rows(spark, sf)))


@query("layer_select", f"WITH {d.SQL_LAYERS} SELECT {SQL_SUMS} FROM ly WHERE layer >= 1")
def layer_select(spark, sf):
    return _vector_sums(ve.layer_select(ve.layer_explode(d.layer_rows(spark, sf))))


def _pool(how: str, value: str):
    @query(f"pool_{how}", f"""
WITH {d.SQL_LAYERS}, e AS (SELECT vec_id, layer, unnest(features) AS x, unnest(range({d.LAYER_WIDTH})) AS dim FROM ly)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round({value}, 6) AS value FROM e GROUP BY vec_id, dim""")
    def run(spark, sf):
        pooled = d.layer_rows(spark, sf).select("vec_id", ve.pool(F.col("layers"), how).alias("v"))
        return pooled.select("vec_id", F.posexplode("v").alias("dim", "value")).withColumn(
            "value", F.round(F.col("value").cast("double"), 6))


_pool("first", "arg_min(CAST(x AS DOUBLE), layer)")
_pool("last", "arg_max(CAST(x AS DOUBLE), layer)")
_pool("sum", "sum(CAST(x AS DOUBLE))")
_pool("avg", "avg(CAST(x AS DOUBLE))")


def _measure(texts):
    """An encoder made of built-in expressions: three numbers per text."""
    return texts.select("text_id", F.array(
        F.array(F.length("text").cast("double")),
        F.array(F.length(F.regexp_replace("text", r"[^\p{L}]", "")).cast("double")),
        F.array(F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double")),
    ).alias("layers"))


@query("encode_distinct", f"""
WITH {d.SQL_LANG}, m AS (SELECT doc_id, label, text, unnest(range(3)) AS layer FROM lr)
SELECT doc_id, label, CAST(layer AS INTEGER) AS layer, CAST(CASE layer WHEN 0 THEN length(text)
   WHEN 1 THEN length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))
   ELSE length(regexp_replace(text, '[^0-9]', '', 'g')) END AS DOUBLE) AS value FROM m""")
def encode_distinct(spark, sf):
    rows = d.lang_rows(spark, sf)
    # half of the languages are in a store already, the rest is encoded now
    known = rows.filter(F.col("label").isin("en", "fr")).groupBy(ve.text_id().alias("text_id"))
    store = persist_table(_measure(known.agg(F.first("text").alias("text"))), "vector_store")
    out = ve.layer_explode(ve.encode_distinct(rows, _measure, "doc_id", store=store))
    return out.select("doc_id", "label", "layer", F.get("features", F.lit(0)).alias("value"))


# --- metrics ------------------------------------------------------------------

SQL_CLASSES = f"""{d.SQL_PRED},
s AS (SELECT label AS class, count(*) AS support, count(*) FILTER (label = prediction) AS tp FROM pr GROUP BY label),
p AS (SELECT prediction AS class, count(*) AS predicted FROM pr GROUP BY prediction),
sc AS (SELECT class, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted,
   CASE WHEN coalesce(predicted, 0) = 0 THEN 0.0 ELSE coalesce(tp, 0) / predicted END AS precision,
   CASE WHEN coalesce(support, 0) = 0 THEN 0.0 ELSE tp / support END AS recall,
   2.0 * coalesce(tp, 0) / (coalesce(support, 0) + coalesce(predicted, 0)) AS f1
   FROM s FULL JOIN p USING (class))"""

SQL_REPORT = """
SELECT CAST(class AS VARCHAR) AS class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM sc
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM sc
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM sc
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM sc"""


@query("metric_accuracy", f"WITH {d.SQL_PRED} SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pr")
def metric_accuracy(spark, sf):
    return me.accuracy(d.predictions(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query("metric_f1_weighted", f"WITH {SQL_CLASSES} SELECT round(sum(f1 * support) / sum(support), 6) AS f1 FROM sc")
def metric_f1_weighted(spark, sf):
    return me.f1_weighted(d.predictions(spark, sf)).withColumn("f1", F.round("f1", 6))


@query("metric_report", f"""
WITH {SQL_CLASSES}
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({SQL_REPORT})""")
def metric_report(spark, sf):
    report = me.classification_report(d.predictions(spark, sf))
    return report.select("class", "support", *[F.round(n, 6).alias(n) for n in ("precision", "recall", "f1")])


@query("metric_all", f"""
WITH {SQL_CLASSES}
SELECT 'accuracy' AS metric, round(sum(tp) / sum(support), 6) AS value FROM sc
UNION ALL SELECT 'f1', round(sum(f1 * support) / sum(support), 6) FROM sc
UNION ALL SELECT 'report/' || class || '/' || field, round(value, 6)
  FROM (UNPIVOT (SELECT class, precision, recall, f1 FROM ({SQL_REPORT})) ON precision, recall, f1 INTO NAME field VALUE value)""")
def metric_all(spark, sf):
    out = me.compute_metrics(d.predictions(spark, sf), ["accuracy", "f1", "classification_report"])
    return out.withColumn("value", F.round("value", 6))


@query("metric_logloss", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS w FROM embeddings)
SELECT vec_id % 2 AS half, round(avg(-ln(w[label + 1] / list_sum(w))), 6) AS log_loss FROM e GROUP BY half""")
def metric_logloss(spark, sf):
    """Softmax of the numbers of each vector as class probabilities."""
    emb = d.table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 2).alias("half"), "label",
        F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("w"))
    total = F.aggregate("w", F.lit(0.0).cast("double"), lambda a, x: a + x)
    probs = emb.withColumn("total", total).withColumn("probability", F.transform("w", lambda x: x / F.col("total")))
    return me.log_loss(probs, label="label", by=("half",)).withColumn("log_loss", F.round("log_loss", 6))


# --- run results --------------------------------------------------------------

@query("results_aggregate", f"""
WITH {d.SQL_FACTS}
SELECT task_language, task_category, hf_model_name, classifier_name, run_id, control, metric AS metric_names,
  CAST(layer + 1 AS INTEGER) AS layer, run_id || '/log.json' AS log_path, round(avg(value), 6) AS metric_scores
FROM facts WHERE metric = 'f1' GROUP BY ALL""")
def results_aggregate(spark, sf):
    out = rs.aggregate_results(d.run_facts(spark, sf), "f1", "test")
    return out.withColumn("metric_scores", F.round("metric_scores", 6))


@query("results_pivot", f"""
WITH {d.SQL_FACTS}, m AS (SELECT task_category, layer + 1 AS layer, avg(value) AS v FROM facts
  WHERE metric = 'accuracy' AND NOT control GROUP BY task_category, task_language, classifier_name, layer)
SELECT task_category, round(avg(v) FILTER (layer = 1), 6) AS "1", round(avg(v) FILTER (layer = 2), 6) AS "2",
  round(avg(v) FILTER (layer = 3), 6) AS "3", round(avg(v) FILTER (layer = 4), 6) AS "4" FROM m GROUP BY task_category""")
def results_pivot(spark, sf):
    scores = rs.aggregate_results(d.run_facts(spark, sf).filter(~F.col("control")), "accuracy", "test")
    pivot = rs.pivot_results(scores, [1, 2, 3, 4])
    return pivot.select("task_category", *[F.round(F.col(f"`{i}`"), 6).alias(str(i)) for i in (1, 2, 3, 4)])


@query("selectivity", f"""
WITH {d.SQL_FACTS}
SELECT task_language, task_category, hf_model_name, classifier_name, CAST(layer AS INTEGER) AS layer,
  round(avg(value) FILTER (NOT control), 6) AS task_score, round(avg(value) FILTER (control), 6) AS control_score,
  round(avg(value) FILTER (NOT control) - avg(value) FILTER (control), 6) AS selectivity
FROM facts WHERE metric = 'f1' GROUP BY ALL""")
def selectivity(spark, sf):
    out = rs.selectivity(d.run_facts(spark, sf))
    for name in ("task_score", "control_score", "selectivity"):
        out = out.withColumn(name, F.round(name, 6))
    return out
