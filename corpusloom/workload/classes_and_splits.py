"""Queries on class tables, splits and label permutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import wordpunct_tokens
from ..operators import classes as c
from ..operators import split as sp
from ..operators.dims import join_small
from ..operators.vectors import dropped_rows, length_filter, length_truncate
from ..session import persist_table
from . import derive as d
from .registry import query, sql_split

SQL_QUALITY = f"""qr AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label, {d.SQL_WORDPUNCT} AS text
  FROM documents JOIN labels USING (doc_id))"""

SQL_ONCE = "SELECT * FROM {src} WHERE text IN (SELECT text FROM {src} GROUP BY text HAVING count(*) = 1)"


def labelled_split_ratio(spark, sf):
    """Documents with their quality label to a class table of the split task."""
    rows = c.drop_ambiguous(d.quality_rows(spark, sf))
    kept = c.min_class_size(rows)
    return c.class_ratio(sp.stratified_split(kept, "doc_id", (0.8, 0.1, 0.1)))


query("labelled_split_ratio", f"""
WITH {SQL_QUALITY}, src AS ({SQL_ONCE.format(src='qr')}),
{sql_split('src', 'doc_id', (0.8, 0.1, 0.1), sp.FILTER_SEED)}
SELECT stage, label, count(*) AS n FROM split_out GROUP BY ALL""")(labelled_split_ratio)


@query("drop_ambiguous", f"""
WITH {d.SQL_LANG} SELECT doc_id, label, md5(text) AS text_md5 FROM ({SQL_ONCE.format(src='lr')})""")
def drop_ambiguous(spark, sf):
    return c.drop_ambiguous(d.lang_rows(spark, sf)).select("doc_id", "label", F.md5("text").alias("text_md5"))


@query("class_ratio", f"WITH {d.SQL_LANG}, {d.SQL_STAGED} SELECT stage, label, count(*) AS n FROM st GROUP BY ALL")
def class_ratio(spark, sf):
    return c.class_ratio(d.staged_rows(spark, sf))


@query("unique_labels", f"WITH {d.SQL_LANG} SELECT DISTINCT label FROM lr")
def unique_labels(spark, sf):
    return c.unique_labels(d.lang_rows(spark, sf))


# classes of very different size: source, language and length of a document
SQL_MANY = "mr AS (SELECT doc_id, lang || '-' || source || '-' || CAST(n_chars // 400 AS VARCHAR) AS label FROM documents)"


def many_classes(spark, sf):
    docs = d.table(spark, sf, "documents")
    size = F.floor(F.col("n_chars") / 400).cast("string")
    return docs.select("doc_id", F.concat_ws("-", "lang", "source", size).alias("label"))


@query("labels_min_count", f"""
WITH {SQL_MANY} SELECT doc_id, label FROM mr WHERE label IN (SELECT label FROM mr GROUP BY label HAVING count(*) > 1)""")
def labels_min_count(spark, sf):
    return c.labels_min_count(many_classes(spark, sf))


@query("min_class_size", """
WITH sr AS (SELECT doc_id, lang, source AS label FROM documents),
c AS (SELECT lang, label, count(*) AS n FROM sr GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY lang) AS k FROM c)
SELECT doc_id, lang, label FROM sr JOIN k USING (lang, label) WHERE n > k""")
def min_class_size(spark, sf):
    rows = d.table(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("label"))
    return c.min_class_size(rows, ("lang",))


@query("label_map", f"""
WITH {d.SQL_LANG}, {d.SQL_STAGED}
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx
FROM (SELECT DISTINCT label FROM st WHERE stage = 'tr')""")
def label_map(spark, sf):
    return c.label_map(d.staged_rows(spark, sf))


@query("label_encode", f"""
WITH {d.SQL_LANG}, {d.SQL_STAGED},
m AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx
      FROM (SELECT DISTINCT label FROM st WHERE stage = 'tr'))
SELECT doc_id, stage, label_idx FROM st JOIN m USING (label)""")
def label_encode(spark, sf):
    rows = d.staged_rows(spark, sf).select("doc_id", "stage", "label")
    return c.label_encode(rows, c.label_map(rows)).select("doc_id", "stage", "label_idx")


@query("class_weights", f"""
WITH {d.SQL_LANG}, {d.SQL_STAGED}, n AS (SELECT label, count(*) AS n FROM st WHERE stage = 'tr' GROUP BY label)
SELECT label, n, round((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n), 6) AS weight FROM n""")
def class_weights(spark, sf):
    return c.class_weights(d.staged_rows(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("stratified_split", f"""
WITH {d.SQL_LANG}, src AS ({SQL_ONCE.format(src='lr')}),
{sql_split('src', 'doc_id', (0.8, 0.1, 0.1), sp.FILTER_SEED, large=False)}
SELECT doc_id, label, stage FROM split_out""")
def stratified_split(spark, sf):
    rows = persist_table(c.drop_ambiguous(d.lang_rows(spark, sf)), "split")
    return sp.stratified_split(rows, "doc_id", (0.8, 0.1, 0.1)).select("doc_id", "label", "stage")


@query("stratified_split_two", f"""
WITH src AS (SELECT doc_id, lang, source AS label FROM documents),
{sql_split('src', 'doc_id', (0.7, 0.3), sp.MORPHOLOGY_SEED, by=('lang',))}
SELECT doc_id, lang, label, stage FROM split_out""")
def stratified_split_two(spark, sf):
    rows = d.table(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("label"))
    kept = c.min_class_size(rows, ("lang",))
    return sp.stratified_split(kept, "doc_id", (0.7, 0.3), sp.MORPHOLOGY_SEED, ("lang",))


@query("shuffle_rows", f"""
WITH {d.SQL_LANG}, {d.SQL_STAGED} SELECT doc_id, stage, md5('{sp.MORPHOLOGY_SEED}:' || doc_id) AS shuffle_key FROM st""")
def shuffle_rows(spark, sf):
    return sp.shuffle_rows(d.staged_rows(spark, sf).select("doc_id", "stage"), "doc_id")


@query("control_labels", f"""
WITH {d.SQL_LANG}, {d.SQL_STAGED},
a AS (SELECT doc_id, stage, label, row_number() OVER (PARTITION BY stage
        ORDER BY md5('{sp.MORPHOLOGY_SEED}:' || doc_id), CAST(doc_id AS VARCHAR)) AS rn FROM st),
b AS (SELECT stage, label AS control_label, row_number() OVER (PARTITION BY stage ORDER BY label) AS rn FROM st)
SELECT doc_id, stage, label, control_label FROM a JOIN b USING (stage, rn)""")
def control_labels(spark, sf):
    return sp.control_labels(d.staged_rows(spark, sf).select("doc_id", "stage", "label"), "doc_id")


MAX_TOKENS = 256


def _token_rows(spark, sf):
    return d.staged_rows(spark, sf).select("doc_id", "stage", wordpunct_tokens(F.col("text")).alias("tokens"))


SQL_TOKENS = f"""tk AS (SELECT doc_id, stage, regexp_extract_all(text, '{d.WORDPUNCT}') AS tokens FROM st)"""


@query("length_filter", f"""
WITH {d.SQL_LANG}, {d.SQL_STAGED}, {SQL_TOKENS}
SELECT doc_id, stage, len(tokens) AS n_tokens,
       count(*) FILTER (len(tokens) > {MAX_TOKENS}) OVER (PARTITION BY stage) AS dropped
FROM tk QUALIFY len(tokens) <= {MAX_TOKENS}""")
def length_filter_query(spark, sf):
    rows = _token_rows(spark, sf)
    kept = length_filter(rows, MAX_TOKENS).select("doc_id", "stage", F.size("tokens").cast("bigint").alias("n_tokens"))
    return join_small(kept, dropped_rows(rows, MAX_TOKENS).select("stage", "dropped"), ["stage"])


@query("length_truncate", f"""
WITH {d.SQL_LANG}, {d.SQL_STAGED}, {SQL_TOKENS}
SELECT doc_id, least(len(tokens), {MAX_TOKENS}) AS n_tokens,
       md5(array_to_string(list_slice(tokens, 1, {MAX_TOKENS}), ' ')) AS text_md5 FROM tk""")
def length_truncate_query(spark, sf):
    rows = length_truncate(_token_rows(spark, sf), MAX_TOKENS)
    return rows.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                       F.md5(F.array_join("tokens", " ")).alias("text_md5"))
