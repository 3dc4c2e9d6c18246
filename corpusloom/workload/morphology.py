"""Queries on trees, grammatical categories and the morphological builder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import morph
from ..operators import morphology as mo
from ..operators.classes import class_counts
from ..operators.dims import settle
from ..plans import build
from . import derive as d
from .registry import query


def treebanks(spark, sf):
    """Sentences with the treebank file that they belong to."""
    return d.sentences(spark, sf).withColumn("role", d.role(F.col("doc_id"), F.col("lang")))


# first token of each category in preorder, and the labels by sorting
SQL_FIRST = f"""fst AS (SELECT sent_key, category, any_value(doc_id) AS doc_id, any_value(lang) AS lang,
    arg_min({{'id': id, 'form': form, 'upos': upos, 'deprel': deprel, 'value': value}}, path) AS t
  FROM (SELECT *, {d.SQL_PATH} AS path FROM feat WHERE value IS NOT NULL) GROUP BY sent_key, category),
firsts AS (SELECT sent_key, doc_id, lang, category, t.id AS id, t.form AS form, t.upos AS upos,
    t.deprel AS deprel, t.value AS value FROM fst)"""


@query("token_tree_paths", f"""
WITH {d.SQL_TOK}, p AS (SELECT sent_key, id, {d.SQL_PATH} AS path FROM tok)
SELECT sent_key, max(len(path)) AS depth, count(*) AS n_words,
       md5(string_agg(array_to_string(path, '.'), ' ' ORDER BY id)) AS paths_md5,
       md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY path)) AS preorder_md5
FROM p GROUP BY sent_key""")
def token_tree_paths(spark, sf):
    rows = d.sentences(spark, sf).select("sent_key", morph.token_paths(F.col("words")).alias("paths"))
    text = F.transform("paths", lambda p: F.array_join(p.cast("array<string>"), "."))
    preorder = F.transform(F.sort_array("paths"), lambda p: F.element_at(p, -1).cast("string"))
    return rows.select(
        "sent_key", F.array_max(F.transform("paths", lambda p: F.size(p))).cast("bigint").alias("depth"),
        F.size("paths").cast("bigint").alias("n_words"),
        F.md5(F.array_join(text, " ")).alias("paths_md5"),
        F.md5(F.array_join(preorder, " ")).alias("preorder_md5"),
    )


@query("token_preorder", f"""
WITH {d.SQL_TOK}, p AS (SELECT sent_key, id, {d.SQL_PATH} AS path FROM tok),
sz AS (SELECT sent_key, id, count(*) AS size FROM (SELECT sent_key, unnest(path) AS id FROM p) GROUP BY ALL),
rk AS (SELECT sent_key, id, row_number() OVER (PARTITION BY sent_key ORDER BY path) AS rank FROM p)
SELECT sent_key, max(size) AS largest, count(*) FILTER (size = 1) AS n_leaves,
       md5(string_agg(rank || ':' || size, ' ' ORDER BY id)) AS ranks_md5
FROM rk JOIN sz USING (sent_key, id) GROUP BY sent_key""")
def token_preorder(spark, sf):
    # annotated and walked in one pass; a table of the annotated sentences would be read a single time
    rows = d.document_lines(spark, sf).select("sent_key", morph.preorder(F.col("forms"), made_by=d.annotated).alias("p"))
    text = F.transform("p", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["size"].cast("string")))
    return rows.select(
        "sent_key", F.array_max(F.col("p.size")).cast("bigint").alias("largest"),
        F.size(F.filter("p", lambda x: x["size"] == 1)).cast("bigint").alias("n_leaves"),
        F.md5(F.array_join(text, " ")).alias("ranks_md5"),
    )


@query("top_category_token", f"""
WITH {d.SQL_TOK}, {SQL_FIRST} SELECT sent_key, category, id, form, upos, deprel, value FROM firsts""")
def top_category_token(spark, sf):
    return mo.top_category_tokens(d.sentences(spark, sf), ("sent_key",)).withColumn("id", F.col("id").cast("bigint"))


def _classify(name: str, sorting: str | None, sub: str, where: str):
    @query(name, f"""
WITH {d.SQL_TOK}, {SQL_FIRST}
SELECT sent_key, {sub} AS subcategory, category, value AS label FROM firsts WHERE {where}""")
    def run(spark, sf):
        return mo.classify(d.sentences(spark, sf), ("sent_key",), sorting)


_classify("classify_no_sorting", None, "'no_sorting'", "true")
_classify("classify_by_pos", "by_pos", "upos", "true")
_classify("classify_by_deprel", "by_deprel", "deprel", "deprel NOT LIKE '%:%'")
_classify("classify_by_pos_deprel", "by_pos_and_deprel", "upos || '_' || deprel", "deprel NOT LIKE '%:%'")


@query("classify_with_filters", f"""
WITH {d.SQL_TOK}, {SQL_FIRST.replace("WHERE value IS NOT NULL", "WHERE value IS NOT NULL AND (upos = 'NOUN' OR deprel = 'amod')")}
SELECT 'any' AS match, sent_key, category, value AS label FROM firsts
UNION ALL
SELECT 'base', sent_key, category, value FROM (
  SELECT sent_key, category, arg_min(value, {d.SQL_PATH}) AS value, arg_min(split_part(deprel, ':', 1), {d.SQL_PATH}) AS base
  FROM feat WHERE value IS NOT NULL GROUP BY ALL) WHERE base = 'nsubj'""")
def classify_with_filters(spark, sf):
    s = d.sentences(spark, sf)
    either = mo.classify(s, ("sent_key",), upos="NOUN", deprel="amod")
    base = mo.classify(s, ("sent_key",), "by_deprel", base_deprel=True).filter("subcategory = 'nsubj'")
    return either.withColumn("match", F.lit("any")).unionByName(base.withColumn("match", F.lit("base"))).drop("subcategory")


@query("category_inventory", f"""
WITH {d.SQL_TOK}, f AS (SELECT *, split_part(deprel, ':', 1) AS base FROM feat WHERE value IS NOT NULL)
SELECT lang, subcategory, string_agg(category, ',' ORDER BY category) AS categories FROM (
  SELECT DISTINCT lang, 'no_sorting' AS subcategory, category FROM f
  UNION SELECT lang, upos, category FROM f UNION SELECT lang, base, category FROM f
  UNION SELECT lang, upos || '_' || base, category FROM f) GROUP BY ALL""")
def category_inventory(spark, sf):
    s = d.sentences(spark, sf)
    out = None
    for sorting in mo.SORTINGS:
        part = mo.category_inventory(s, sorting, ("lang",))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("categories", F.array_join("categories", ","))


@query("category_count", f"""
WITH {d.SQL_TOK}, f AS (SELECT * FROM feat WHERE value IS NOT NULL)
SELECT 'no_sorting' AS sorting, lang, count(DISTINCT category) AS n_categories FROM f GROUP BY lang
UNION ALL SELECT 'by_pos_and_deprel', lang, count(DISTINCT (upos, split_part(deprel, ':', 1), category)) FROM f GROUP BY lang""")
def category_count(spark, sf):
    s = d.sentences(spark, sf)
    one = mo.category_count(s, None, ("lang",)).withColumn("sorting", F.lit("no_sorting"))
    two = mo.category_count(s, "by_pos_and_deprel", ("lang",)).withColumn("sorting", F.lit("by_pos_and_deprel"))
    return one.unionByName(two)


SQL_TASKS = f"""
lab AS (SELECT *, {d.SQL_ROLE} AS role, value AS label FROM firsts),
corp AS (SELECT lang, role, count(*) OVER (PARTITION BY lang) AS n_files
         FROM (SELECT DISTINCT lang, {d.SQL_ROLE} AS role FROM sent)),
cn AS (SELECT lang, role, category, label, count(*) AS n FROM lab GROUP BY ALL),
ck AS (SELECT *, count(*) OVER (PARTITION BY lang, role, category) AS k FROM cn JOIN corp USING (lang, role)),
inv AS (SELECT DISTINCT lang, category FROM feat WHERE value IS NOT NULL)"""


@query("task_status", f"""
WITH {d.SQL_TOK}, {SQL_FIRST}, {SQL_TASKS}
SELECT lang, role, category, coalesce(n_classes, 0) AS n_classes,
       CASE WHEN n_classes IS NULL THEN 'no_examples' WHEN n_classes = 1 THEN 'one_class' ELSE 'ok' END AS status
FROM inv JOIN corp USING (lang)
LEFT JOIN (SELECT lang, role, category, count(*) AS n_classes FROM cn GROUP BY ALL) USING (lang, role, category)""")
def task_status(spark, sf):
    s = treebanks(spark, sf)
    by = ("lang", "role")
    counts = class_counts(mo.classify(s, (*by, "sent_key")), (*by, "subcategory", "category"))
    pairs = mo.category_pairs(s, None, ("lang",)).join(build.corpora_of(s, ("lang",)).select(*by), "lang")
    return mo.task_status(counts, pairs, by).drop("subcategory")


def _quota_sql(name: str, src: str, p: tuple[float, float], out: str) -> str:
    """Largest-remainder shares of a two-way split of each task of ``src``."""
    return f"""
{name}1 AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS nn, count(*) OVER w AS kk, min(n) OVER w AS lo,
    CAST(floor(CAST({p[0]!r} AS DOUBLE) * sum(n) OVER w) AS BIGINT) AS draw
  FROM {src} WINDOW w AS (PARTITION BY lang, role, category)),
{name} AS (SELECT lang, role, category, label, n, (n * draw) // nn + CASE WHEN row_number() OVER (
      PARTITION BY lang, role, category ORDER BY (n * draw) % nn DESC, label)
      <= draw - sum((n * draw) // nn) OVER (PARTITION BY lang, role, category) THEN 1 ELSE 0 END AS {out}
  FROM {name}1 WHERE draw >= kk AND nn - draw >= kk AND lo >= 2)"""


SQL_QUOTAS = f"""
big AS (SELECT * EXCLUDE (k) FROM ck WHERE n > k AND k >= 2),
one AS (SELECT lang, role, category, label, n FROM big WHERE n_files = 1),
two AS (SELECT lang, role, category, label, n FROM big WHERE n_files = 2 AND role <> 'train'),
{_quota_sql('q1', 'one', (0.8, 0.2), 'n_tr')},
one2 AS (SELECT lang, role, category, label, n_tr, n AS n0, n - n_tr AS n FROM q1 WHERE n - n_tr > 1),
{_quota_sql('q2', 'one2', (0.5, 0.5), 'n_te')},
q2k AS (SELECT *, count(*) OVER (PARTITION BY lang, role, category) AS k2 FROM q2),
{_quota_sql('q3', 'two', (0.5, 0.5), 'n_va')},
quo AS (
  SELECT lang, role, category, label, n_tr, q2k.n - n_te AS n_va, n_te
    FROM q2k JOIN one2 USING (lang, role, category, label) WHERE k2 >= 2
  UNION ALL SELECT lang, role, category, label, 0, n_va, n - n_va FROM q3
  UNION ALL SELECT lang, role, category, label, CASE WHEN role = 'train' THEN n ELSE 0 END,
      CASE WHEN role = 'dev' THEN n ELSE 0 END, CASE WHEN role = 'test' THEN n ELSE 0 END
    FROM ck WHERE k >= 2 AND (n_files = 3 OR (n_files = 2 AND role = 'train'))),
done AS (SELECT lang, category FROM (SELECT lang, category, count(DISTINCT role) AS r FROM quo GROUP BY ALL)
         JOIN (SELECT DISTINCT lang, n_files FROM corp) USING (lang) WHERE r = n_files),
rk AS (SELECT sent_key, lang, role, category, label, row_number() OVER (PARTITION BY lang, role, category, label
         ORDER BY md5('42:' || sent_key), sent_key) AS rn FROM lab),
placed AS (SELECT sent_key, lang, role, category, label,
    CASE WHEN rn <= n_tr THEN 'tr' WHEN rn <= n_tr + n_va THEN 'va' ELSE 'te' END AS stage
  FROM rk JOIN quo USING (lang, role, category, label))"""


def _counts(spark, sf):
    s = treebanks(spark, sf)
    corpora = settle(build.corpora_of(s, ("lang",)))
    rows = mo.classify(s, ("lang", "role", "sent_key"))
    return settle(class_counts(rows, ("lang", "role", "subcategory", "category"))), corpora, s


@query("file_role_split", f"""
WITH {d.SQL_TOK}, {SQL_FIRST}, {SQL_TASKS}, {SQL_QUOTAS}
SELECT lang, role, category, label, CAST(n_tr AS BIGINT) AS n_tr, CAST(n_va AS BIGINT) AS n_va,
       CAST(n_te AS BIGINT) AS n_te FROM quo""")
def file_role_split(spark, sf):
    counts, corpora, _ = _counts(spark, sf)
    return build.file_quotas(counts, corpora, ("lang",)).drop("subcategory", "n")


@query("task_complete", f"""
WITH {d.SQL_TOK}, {SQL_FIRST}, {SQL_TASKS}, {SQL_QUOTAS} SELECT lang, category FROM done""")
def task_complete(spark, sf):
    counts, corpora, _ = _counts(spark, sf)
    return build.task_complete(build.file_quotas(counts, corpora, ("lang",)), corpora, ("lang",)).drop("subcategory")


@query("build_ud_tasks", f"""
WITH {d.SQL_TOK}, {SQL_FIRST}, {SQL_TASKS}, {SQL_QUOTAS}
SELECT sent_key, lang, 'no_sorting_' || category AS task, label, stage FROM placed JOIN done USING (lang, category)""")
def build_ud_tasks(spark, sf):
    return build.build_ud_tasks(treebanks(spark, sf)).rows.select("sent_key", "lang", "task", "label", "stage")


SQL_SETS = """sets AS (SELECT lang, category,
  list_sort(list(DISTINCT label) FILTER (stage = 'tr')) AS tr, list_sort(list(DISTINCT label) FILTER (stage = 'va')) AS va,
  list_sort(list(DISTINCT label) FILTER (stage = 'te')) AS te FROM placed GROUP BY ALL)"""


@query("ud_task_report", f"""
WITH {d.SQL_TOK}, {SQL_FIRST}, {SQL_TASKS}, {SQL_QUOTAS}, {SQL_SETS}
SELECT lang, category, role, coalesce(k, 0) AS n_classes,
  CASE WHEN k IS NULL THEN 'no_examples' WHEN k = 1 THEN 'one_class'
       WHEN g.category IS NULL THEN 'not_enough_data' WHEN f.category IS NULL THEN 'incomplete' ELSE 'ok' END AS status,
  CASE WHEN f.category IS NULL THEN NULL WHEN coalesce(tr, []) <> coalesce(va, []) THEN 'train_validation_differ'
       WHEN coalesce(va, []) <> coalesce(te, []) THEN 'train_test_differ' ELSE 'same' END AS "check"
FROM inv JOIN corp USING (lang)
LEFT JOIN sets USING (lang, category)
LEFT JOIN (SELECT DISTINCT lang, role, category, k FROM ck) USING (lang, role, category)
LEFT JOIN (SELECT DISTINCT lang, role, category FROM quo) g USING (lang, role, category)
LEFT JOIN done f USING (lang, category)""")
def ud_task_report(spark, sf):
    return build.build_ud_tasks(treebanks(spark, sf)).status.drop("subcategory")


@query("corpus_outcomes", f"""
WITH {d.SQL_TOK}, t AS (SELECT sent_key, min(head) AS low, count(*) FILTER (head = 0) AS roots FROM tok GROUP BY sent_key)
SELECT lang, {d.SQL_ROLE} AS role, CASE WHEN roots IS NULL THEN 'empty' WHEN low > 0 THEN 'no_root'
  WHEN roots > 1 THEN 'many_roots' ELSE 'ok' END AS outcome, count(*) AS n
FROM sent LEFT JOIN t USING (sent_key) GROUP BY ALL""")
def corpus_outcomes(spark, sf):
    return mo.sentence_outcomes(treebanks(spark, sf), ("lang", "role"))


@query("split_label_check", f"""
WITH {d.SQL_TOK}, {SQL_FIRST}, {SQL_TASKS}, {SQL_QUOTAS}, {SQL_SETS}
SELECT lang, category, CASE WHEN coalesce(tr, []) <> coalesce(va, []) THEN 'train_validation_differ'
  WHEN coalesce(va, []) <> coalesce(te, []) THEN 'train_test_differ' ELSE 'same' END AS "check" FROM sets""")
def split_label_check(spark, sf):
    counts, corpora, _ = _counts(spark, sf)
    quotas = build.file_quotas(counts, corpora, ("lang",))
    return build.label_checks(quotas, ("lang",)).drop("subcategory")
