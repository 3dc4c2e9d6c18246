"""Queries on text expressions, token predicates, pairs and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import morph, text as tx
from ..plans import build
from ..plans.pattern import Pattern
from . import derive as d
from .registry import query, sql_split


def words():
    return F.col("words")


def _ids(column):
    return F.array_join(F.transform(column, lambda t: t["id"].cast("string")), ",")


# --- text expressions ---------------------------------------------------------

@query("wordpunct", f"""
SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS key, md5({d.SQL_WORDPUNCT}) AS text_md5 FROM documents
UNION ALL SELECT 'conversations', conv_id || ':' || turn, md5({d.SQL_WORDPUNCT}) FROM conversations
UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), md5({d.SQL_WORDPUNCT}) FROM benchmark""")
def wordpunct(spark, sf):
    parts = [
        ("documents", F.col("doc_id").cast("string")),
        ("conversations", F.concat_ws(":", "conv_id", "turn")),
        ("benchmark", F.col("item_id").cast("string")),
    ]
    frames = [
        d.table(spark, sf, name).select(
            F.lit(name).alias("source"), key.alias("key"),
            F.md5(tx.wordpunct(F.col("text"))).alias("text_md5"),
        )
        for name, key in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("deprel_base", f"""
WITH {d.SQL_TOK}
SELECT lang, deprel, split_part(deprel, ':', 1) AS base, count(*) AS n FROM tok GROUP BY ALL""")
def deprel_base(spark, sf):
    rows = d.sentences(spark, sf).select("lang", F.explode(words()["deprel"]).alias("deprel"))
    return rows.groupBy("lang", "deprel", tx.deprel_base(F.col("deprel")).alias("base")).agg(
        F.count(F.lit(1)).alias("n"))


@query("feat_value", f"""
WITH {d.SQL_TOK}
SELECT lang, upos, f_number AS number, f_psor AS psor, count(*) AS n FROM tok GROUP BY ALL""")
def feat_value(spark, sf):
    rows = d.sentences(spark, sf).select("lang", F.explode("words").alias("t"))
    return rows.groupBy(
        "lang", F.col("t.upos").alias("upos"), morph.feat(F.col("t.feats"), "Number").alias("number"),
        morph.feat(F.col("t.feats"), "Gender[psor]").alias("psor"),
    ).agg(F.count(F.lit(1)).alias("n"))


# --- token predicates ---------------------------------------------------------

def _node_query(name: str, nodes: dict, where: str):
    pattern = Pattern({"N": nodes})

    @query(name, f"""
WITH {d.SQL_TOK}
SELECT sent_key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM tok
WHERE {where} GROUP BY sent_key""")
    def run(spark, sf):
        rows = morph.once(d.sentences(spark, sf), "found", pattern.candidates("N", words()))
        return rows.filter(F.size("found") > 0).select("sent_key", _ids(F.col("found")).alias("ids"))


_node_query("match_field_regex", {"form": ".*ing|TH.*", "upos": "NOUN|VERB"},
            "regexp_full_match(form, '.*ing|TH.*', 'i') AND upos IN ('NOUN', 'VERB')")
_node_query("match_feat_regex", {"Number": "plur", "Tense": "P(ast|re.*)"},
            "f_number = 'Plur' AND f_tense IS NOT NULL")
_node_query("match_feat_negation", {"upos": "^(?!NOUN|VERB$).*$", "Number": "Sing", "xpos": ".*"},
            "NOT (upos LIKE 'NOUN%' OR upos = 'VERB') AND f_number = 'Sing' AND xpos IS NOT NULL")
_node_query("match_exclude", {"exclude": ["Number", "PronType"]},
            "f_number IS NULL AND f_prontype IS NULL AND f_numtype IS NOT NULL")
_node_query("node_candidates", {"lemma": "[a-e].*", "exclude": ["Tense"], "Number": "Sing"},
            "regexp_full_match(lemma, '[a-e].*', 'i') AND f_tense IS NULL AND f_number = 'Sing'")


@query("sentence_has_nodes", f"""
WITH {d.SQL_TOK}
SELECT sent_key FROM tok GROUP BY sent_key
HAVING bool_or(upos = 'NUM') AND bool_or(upos = 'PROPN' AND f_psor = 'Fem')""")
def sentence_has_nodes(spark, sf):
    p = Pattern({"A": {"upos": "NUM"}, "B": {"upos": "PROPN", "Gender[psor]": "Fem"}},
                extra_categories=("Gender[psor]",))
    return d.sentences(spark, sf).filter(p.has_nodes(words())).select("sent_key")


@query("relation_regex", f"""
WITH {d.SQL_TOK}
SELECT DISTINCT sent_key, deprel AS relation FROM tok WHERE regexp_full_match(deprel, 'obl|a(dv)?cl(:.+)?', 'i')""")
def relation_regex(spark, sf):
    names = F.array_distinct(F.filter(words()["deprel"], lambda r: tx.full_match(r, "obl|a(dv)?cl(:.+)?")))
    return d.sentences(spark, sf).select("sent_key", F.explode(names).alias("relation"))


# --- pairs --------------------------------------------------------------------

@query("pair_candidates", f"""
WITH {d.SQL_TOK}
SELECT sent_key, a AS n_first, b AS n_second, a * b AS n_pairs FROM (
  SELECT sent_key, count(*) FILTER (upos = 'VERB') AS a, count(*) FILTER (f_number = 'Sing') AS b
  FROM tok GROUP BY sent_key) WHERE a * b > 0""")
def pair_candidates(spark, sf):
    """Size of the product of two nodes' candidates; the pairs themselves are never made."""
    p = Pattern({"V": {"upos": "VERB"}, "S": {"Number": "Sing"}})
    sizes = F.struct(*[
        F.size(p.candidates(node, words())).cast("bigint").alias(name) for node, name in (("V", "n_first"), ("S", "n_second"))])
    rows = morph.once(d.sentences(spark, sf), "sizes", sizes).select("sent_key", "sizes.*")
    return rows.withColumn("n_pairs", F.col("n_first") * F.col("n_second")).filter("n_pairs > 0")


def _pair_query(name: str, pattern: Pattern, condition: str):
    first, second = pattern.bound

    @query(name, f"""
WITH {d.SQL_TOK}
SELECT a.sent_key, a.id AS first_id, b.id AS second_id
FROM tok a JOIN tok b ON a.sent_key = b.sent_key AND {condition}""")
    def run(spark, sf):
        return d.sentences(spark, sf).select("sent_key", F.explode(pattern.matches(words())).alias("m")).select(
            "sent_key", F.col(f"m.{first}").cast("bigint").alias("first_id"),
            F.col(f"m.{second}").cast("bigint").alias("second_id"),
        )


_pair_query("pair_deprel", Pattern({"Top": {}, "Low": {}}, {("Top", "Low"): {"deprels": "acl(:.+)?|advcl"}}),
            "b.head = a.id AND b.deprel IN ('acl:relcl', 'advcl')")
_pair_query("pair_lindist", Pattern({"N": {"upos": "NOUN"}, "V": {"upos": "VERB"}}, {("N", "V"): {"lindist": (-1, 2)}}),
            "a.upos = 'NOUN' AND b.upos = 'VERB' AND b.id - a.id BETWEEN -1 AND 2")
_pair_query("pair_feat_agree",
            Pattern({"H": {}, "D": {}}, {("H", "D"): {"deprels": ".*", "fconstraint": {"intersec": ["Gender", "Number"]}}}),
            "b.head = a.id AND a.f_gender = b.f_gender AND a.f_number = b.f_number")
_pair_query("pair_feat_disagree",
            Pattern({"H": {}, "D": {}}, {("H", "D"): {"deprels": ".*", "fconstraint": {"intersec": ["Number"], "disjoint": ["Tense"]}}}),
            "b.head = a.id AND a.f_number = b.f_number AND a.f_tense <> b.f_tense")


# --- patterns -----------------------------------------------------------------

# Two neighbours below one noun or adjective, a modifier and an owner that differ in number.
SIBLINGS = Pattern(
    {"Top": {"upos": "NOUN|ADJ"}, "Mod": {}, "Owner": {}},
    {("Top", "Mod"): {"deprels": "amod"}, ("Top", "Owner"): {"deprels": "nmod(:.+)?"},
     ("Mod", "Owner"): {"lindist": (-1, 1), "fconstraint": {"disjoint": ["Number"]}}},
)
SQL_SIBLINGS = """sib AS (SELECT t.sent_key, t.id AS t, m.id AS m, o.id AS o
  FROM tok t JOIN tok m ON m.sent_key = t.sent_key AND m.head = t.id AND m.deprel = 'amod'
  JOIN tok o ON o.sent_key = t.sent_key AND o.head = t.id AND o.deprel = 'nmod:poss'
  WHERE t.upos IN ('NOUN', 'ADJ') AND m.f_number <> o.f_number AND abs(o.id - m.id) = 1)"""

# A chain of four arcs whose first word has no tense, in a sentence with a pronominal determiner.
CHAIN = Pattern(
    {"W1": {"exclude": ["Tense"]}, "W2": {}, "W3": {"Number": "Sing"}, "W4": {}, "W5": {}, "Det": {"PronType": ".*"}},
    {("W1", "W2"): {"deprels": "n(sub|m).*|amod"}, ("W2", "W3"): {"deprels": "[^p].*"},
     ("W3", "W4"): {"deprels": "a.+"}, ("W4", "W5"): {"deprels": "case|det|obl", "lindist": (3, 60)}},
)
SQL_CHAIN = """chn AS (SELECT a.sent_key, a.id AS w1, b.id AS w2, c.id AS w3, e.id AS w4, f.id AS w5, x.x
  FROM tok a JOIN tok b ON b.sent_key = a.sent_key AND b.head = a.id
    AND b.deprel IN ('nsubj', 'nsubj:pass', 'nmod:poss', 'amod')
  JOIN tok c ON c.sent_key = a.sent_key AND c.head = b.id AND c.deprel <> 'punct' AND c.f_number = 'Sing'
  JOIN tok e ON e.sent_key = a.sent_key AND e.head = c.id AND e.deprel IN ('amod', 'advcl', 'aux:pass', 'acl:relcl')
  JOIN tok f ON f.sent_key = a.sent_key AND f.head = e.id AND f.deprel IN ('case', 'det', 'obl')
    AND f.id - e.id BETWEEN 3 AND 60
  JOIN (SELECT sent_key, min(id) AS x FROM tok WHERE f_prontype IS NOT NULL GROUP BY sent_key) x ON x.sent_key = a.sent_key
  WHERE a.f_tense IS NULL AND coalesce(a.f_number, a.f_gender, a.f_degree, a.f_verbform, a.f_prontype, a.f_numtype, a.f_psor) IS NOT NULL)"""


@query("pattern_triangle", f"WITH {d.SQL_TOK}, {SQL_SIBLINGS} SELECT sent_key, t, m, o FROM sib")
def pattern_triangle(spark, sf):
    return d.sentences(spark, sf).select("sent_key", F.explode(SIBLINGS.matches(words())).alias("x")).select(
        "sent_key", *[F.col(f"x.{n}").cast("bigint").alias(n[0].lower()) for n in ("Top", "Mod", "Owner")])


CHAIN_NAMES = ("W1", "W2", "W3", "W4", "W5")


@query("pattern_path", f"WITH {d.SQL_TOK}, {SQL_CHAIN} SELECT sent_key, w1, w2, w3, w4, w5 FROM chn")
def pattern_path(spark, sf):
    return d.sentences(spark, sf).select("sent_key", F.explode(CHAIN.matches(words())).alias("x")).select(
        "sent_key", *[F.col(f"x.{n}").cast("bigint").alias(n.lower()) for n in CHAIN_NAMES])


@query("pattern_bindings", f"""
WITH {d.SQL_TOK}, {SQL_CHAIN}
SELECT sent_key, w1, w2, w3, w4, w5, x AS det FROM (
  SELECT *, row_number() OVER (PARTITION BY sent_key ORDER BY w1, w2, w3, w4, w5) AS rn FROM chn) WHERE rn = 1""")
def pattern_bindings(spark, sf):
    rows = d.sentences(spark, sf).select("sent_key", CHAIN.first_match(words()).alias("m")).filter("m IS NOT NULL")
    return rows.select("sent_key", *[F.col(f"m.{n}").cast("bigint").alias(n.lower()) for n in (*CHAIN_NAMES, "Det")])


@query("filter_sentences", f"""
WITH {d.SQL_TOK}, {SQL_SIBLINGS}, {SQL_CHAIN}
SELECT DISTINCT 'siblings' AS pattern, sent_key FROM sib
UNION ALL SELECT DISTINCT 'chain', sent_key FROM chn""")
def filter_sentences(spark, sf):
    s = d.sentences(spark, sf)
    one = lambda name, p: build.filter_sentences(s, p).select(F.lit(name).alias("pattern"), "sent_key")
    return one("siblings", SIBLINGS).unionByName(one("chain", CHAIN))


@query("filter_not_matching", f"""
WITH {d.SQL_TOK}, {SQL_SIBLINGS}
SELECT sent_key, md5(text) AS text_md5 FROM stext WHERE sent_key NOT IN (SELECT sent_key FROM sib)""")
def filter_not_matching(spark, sf):
    return build.filter_not_matching(d.sentences(spark, sf), SIBLINGS).select("sent_key", F.md5("text").alias("text_md5"))


# Where an owned thing stands early, or a described one later.
TWO_CLASSES = {
    "OWNED": ({"Thing": {}, "Owner": {}}, {("Thing", "Owner"): {"deprels": "nmod:poss", "lindist": (1, 4)}}),
    "DESCRIBED": ({"Thing": {}, "Word": {"Degree": "Pos"}}, {("Thing", "Word"): {"deprels": ".mod", "lindist": (5, 7)}}),
}
SQL_TWO = """mc AS (
  SELECT DISTINCT sent_key, 'OWNED' AS label FROM tok WHERE deprel = 'nmod:poss' AND head > 0 AND id - head BETWEEN 1 AND 4
  UNION ALL SELECT DISTINCT sent_key, 'DESCRIBED' FROM tok WHERE deprel = 'amod' AND head > 0 AND id - head BETWEEN 5 AND 7)"""


@query("multi_class_task", f"""
WITH {d.SQL_TOK}, {SQL_TWO}, {SQL_SIBLINGS}
SELECT 'two' AS task, sent_key, label FROM mc
UNION ALL SELECT 'one', sent_key, CASE WHEN sent_key IN (SELECT sent_key FROM sib) THEN 'SIB' ELSE 'not_SIB' END FROM stext""")
def multi_class_task(spark, sf):
    s = d.sentences(spark, sf)
    two = build.multi_class_rows(s, TWO_CLASSES, ("sent_key",)).withColumn("task", F.lit("two"))
    one = build.multi_class_rows(s, {"SIB": SIBLINGS}, ("sent_key",)).withColumn("task", F.lit("one"))
    return two.unionByName(one)


@query("build_filter_task", f"""
WITH {d.SQL_TOK}, {SQL_TWO},
mt AS (SELECT mc.sent_key, label, text FROM mc JOIN stext USING (sent_key)),
src AS (SELECT sent_key, label, text FROM mt WHERE text IN (SELECT text FROM mt GROUP BY text HAVING count(*) = 1)),
{sql_split('src', 'sent_key', (0.8, 0.1, 0.1), 3, n_classes=2)}
SELECT sent_key, label, stage FROM split_out""")
def build_filter_task(spark, sf):
    return build.build_filter_task(d.sentences(spark, sf), TWO_CLASSES).select("sent_key", "label", "stage")
