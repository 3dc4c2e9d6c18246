"""Sentences, words, trees, layers and runs derived from the given tables.

The given tables hold plain text and vectors, so the annotation comes from fixed
rules on each word and its place. Every row and the whole of every text is used.
``SQL_*`` are the same rules for the DuckDB checks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flat import lists_of, pieces, sizes, starts
from ..functions.morph import TOKEN_TYPE
from ..functions.text import WORDPUNCT as WORDPUNCT_REGEX, wordpunct, wordpunct_tokens
from ..operators.dims import spread
from ..operators.metrics import compute_metrics
from ..session import persist_table

LAYERS = 4
LAYER_WIDTH = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPOS = ("PUNCT", "NUM", "ADP", "DET", "PROPN", "NOUN", "VERB", "ADJ")
PERIOD = 60  # features and relations hang on remainders of a word's place by 2, 3, 4 and 5


def _upos_codes(words: pa.StringArray, length: np.ndarray) -> np.ndarray:
    """Place of each word's part of speech in ``UPOS``."""
    first = pc.utf8_slice_codeunits(words, 0, 1).dictionary_encode()
    kinds = [(c == "_" or unicodedata.category(c)[0] in "LN", c in "0123456789", c != c.lower()) if c else (False,) * 3
             for c in first.dictionary.to_pylist()]
    word, digit, upper = np.array(kinds, bool).reshape(-1, 3)[first.indices.to_numpy()].T
    number = np.zeros(len(words), bool)
    number[digit] = pc.match_substring_regex(words.filter(pa.array(digit)), "^[0-9]+$").to_numpy(zero_copy_only=False)
    return np.select([~word, number, length <= 2, length == 3, upper], [0, 1, 2, 3, 4], 5 + length % 3)


def _lower(words: pa.StringArray, length: np.ndarray) -> pa.Array:
    """Words in lower case; those beyond ASCII with all that Unicode says on it, as Spark has it."""
    plain = pc.ascii_lower(words)
    beyond = pa.array(pc.binary_length(words).to_numpy() != length)
    return pc.replace_with_mask(plain, beyond, pa.array([w.lower() for w in words.filter(beyond).to_pylist()], pa.string()))


def _feats(upos: str, parity: int, i: int) -> dict[str, str]:
    """Features by part of speech, parity of the word's length, and place; empty for words that have none."""
    number = {"Number": "Plur" if parity else "Sing"}
    gender = {"Gender": ("Masc", "Fem", "Neut")[i % 3]}
    return {
        "NOUN": number | gender,
        "VERB": number | {"Tense": "Pres" if i % 2 else "Past", "VerbForm": "Fin" if i % 5 else "Inf"},
        "ADJ": number | gender | {"Degree": "Pos"},
        "DET": {"PronType": "Art" if i % 4 else "Dem"},
        "PROPN": number | {"Gender[psor]": "Fem" if i % 2 else "Masc"},
        "NUM": {"NumType": "Card"},
    }.get(upos, {})


def _deprel(upos: str, i: int) -> str:
    """Relation of a word that is not the first."""
    return {
        "NOUN": ("nsubj", "obj", "nsubj:pass", "obl")[i % 4],
        "VERB": ("advcl", "aux:pass", "acl:relcl")[i % 3],
        "ADJ": "amod", "PUNCT": "punct", "ADP": "case", "DET": "det", "NUM": "nummod", "PROPN": "nmod:poss",
    }[upos]


@cache
def _tables() -> tuple[list[tuple], np.ndarray, list[str]]:
    """Features that occur, and which of them, and which relation, a word has by part of speech, parity and place; behind the last case a root's."""
    cases = [(u, parity, i) for u in UPOS for parity in range(2) for i in range(PERIOD)]
    found = [tuple(_feats(*case).items()) for case in cases]
    kinds = list(dict.fromkeys(found))
    return kinds, np.array([kinds.index(f) for f in found]), [*(_deprel(u, i) for u, _, i in cases), "root"]


def _feats_array(kinds: list) -> pa.Array:
    return pa.array([list(kind) or None for kind in kinds], pa.map_(pa.string(), pa.string()))


def annotate(words: Column) -> Column:
    """Array of words to array of annotated tokens; word i hangs on word i div 2.

    Features and relation follow from part of speech, parity of the length, and place by ``PERIOD``: a task takes its
    sentences in Arrow batches, and looks up all words of many sentences at once in constant arrays.
    """
    # one constant that the plan shows, and each sentence brings along
    written = ";".join("|".join(f"{k}={v}" for k, v in kind) for kind in _tables()[0])

    def annotated(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        feats = None
        for forms, given in batches:
            if not len(given):
                continue
            if feats is None:
                feats = _feats_array([[tuple(x.split("=")) for x in kind.split("|")] if kind else [] for kind in given[0].as_py().split(";")])
            for part in pieces(forms):
                yield _tokens(forms[part], feats)

    return F.arrow_udf(annotated, f"array<{TOKEN_TYPE}>")(words, F.lit(written))


def annotated(forms: pa.Array) -> pa.Array:
    """``annotate`` of a piece, for a pass that goes on with its words."""
    return _tokens(forms, _feats_array(_tables()[0]))


def _tokens(forms: pa.Array, feats: pa.Array) -> pa.Array:
    _, feats_at, deprels = _tables()
    xpos = [None if u == "PUNCT" else f"{u}{odd}" for u in UPOS for odd in range(2)]
    start = starts(sizes(forms))
    flat = forms.flatten()
    length = pc.utf8_length(flat).to_numpy().astype(np.int64)
    place = np.arange(1, len(flat) + 1) - np.repeat(start[:-1], np.diff(start))
    code = _upos_codes(flat, length)
    at = (code * 2 + length % 2) * PERIOD + place % PERIOD

    def pick(values, index) -> pa.Array:
        return pa.array(values, pa.string()).take(pa.array(index))

    none = pa.nulls(len(flat), pa.string())
    columns = {
        "id": pa.array(place, pa.int32()),
        "id_kind": pa.repeat("word", len(flat)),
        "form": flat,
        "lemma": _lower(flat, length),
        "upos": pick(UPOS, code),
        "xpos": pick(xpos, code * 2 + place % 2),
        "feats": feats.take(pa.array(feats_at[at])),
        "head": pa.array(place >> 1, pa.int32()),
        "deprel": pick(deprels, np.where(place == 1, len(feats_at), at)),
        "deps": none,
        "misc": none,
    }
    return lists_of(start, pa.StructArray.from_arrays(list(columns.values()), list(columns)), forms)


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A derived table, written once per session to the shared folder and read from there.

    Queries read their input several times; parsing it anew each time, or below
    a join, would repeat the work.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = persist_table(make(spark, sf_dir), name, compression="zstd")
    return _STORED[key]


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated sentences of all documents."""
    return stored(spark, sf_dir, "sentences", annotated_lines)


def lang_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a labelled text whose class is its language."""
    return stored(spark, sf_dir, "lang_rows", tokenized_documents)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-blank line of every document, with its words as ``forms``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    lines = docs.select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).filter(F.col("line").rlike(WORDPUNCT_REGEX))  # ends at the first token; a filter on the tokens would find all twice
    return lines.select(
        F.concat_ws(":", "doc_id", "line_no").alias("sent_key"),
        "doc_id", "line_no", "lang", F.col("line").alias("raw_text"),
        wordpunct_tokens(F.col("line")).alias("forms"),
    )


def annotated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_lines`` with their annotated words."""
    return document_lines(spark, sf_dir).select(
        "sent_key", "doc_id", "line_no", "lang", "raw_text",
        F.array_join("forms", " ").alias("text"),
        annotate(F.col("forms")).alias("words"),
    )


def role(doc_id: Column, lang: Column) -> Column:
    """Treebank file of a document: en has three files, fr two, the others one."""
    tenth = doc_id % 10
    return (
        F.when(lang == "en", F.when(tenth < 8, "train").when(tenth == 8, "dev").otherwise("test"))
        .when(lang == "fr", F.when(tenth < 8, "train").otherwise("test"))
        .otherwise("train")
    )


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts: documents with their quality label, tokenized."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return docs.join(labels, "doc_id").select("doc_id", "label", wordpunct(F.col("text")).alias("text"))


def tokenized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    return docs.select("doc_id", F.col("lang").alias("label"), wordpunct(F.col("text")).alias("text"))


def staged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lang_rows`` with eight, one and one tenths in the stages."""
    tenth = F.col("doc_id") % 10
    stage = F.when(tenth < 8, "tr").when(tenth == 8, "va").otherwise("te")
    return lang_rows(spark, sf_dir).withColumn("stage", stage)


def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in layer-major form: each embedding read as LAYERS slices."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        "vec_id", "label",
        F.transform(
            F.sequence(F.lit(0), F.lit(LAYERS - 1)),
            lambda i: F.slice("embedding", i * LAYER_WIDTH + 1, F.lit(LAYER_WIDTH)),
        ).alias("layers"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and true labels: every fifth vector is taken for the next class."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label",
        F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 10)
        .otherwise(F.col("label")).alias("prediction"),
    )


def run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of several runs on the vectors: 2 classifiers x task and control x layers."""
    variants = F.array(*[
        F.struct(F.lit(c).alias("classifier_name"), F.lit(ctl).alias("control"), F.lit(l).alias("layer"))
        for c in ("logreg", "mlp") for ctl in (False, True) for l in range(LAYERS)
    ])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(variants).alias("v")).select(
        "vec_id", "label", "v.*"
    )
    every = F.col("layer") + F.when(F.col("classifier_name") == "mlp", 3).otherwise(2)
    wrong = F.when(F.col("control"), F.col("vec_id") % 3 != 0).otherwise(F.col("vec_id") % every == 0)
    return rows.select(
        F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("vec_id") % 4 + 1).cast("int")).alias("task_language"),
        F.when(F.col("vec_id") % 2 == 0, "Number").otherwise("Case").alias("task_category"),
        "classifier_name", "control", "layer", "label",
        F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("prediction"),
    )


RUN_KEYS = ("task_language", "task_category", "classifier_name", "control", "layer")


def run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of those runs as the long fact table."""
    scores = compute_metrics(run_predictions(spark, sf_dir), ["f1", "accuracy"], RUN_KEYS)
    run = F.concat_ws("-", "task_language", "task_category", "classifier_name",
                      F.when(F.col("control"), "control").otherwise("task"))
    return scores.select(
        run.alias("run_id"), "task_language", "task_category", F.lit("slices").alias("hf_model_name"),
        "classifier_name", "control", "layer", F.lit(0).alias("epoch"), F.lit("test").alias("stage"),
        "metric", "value", F.concat(run, F.lit("/log.json")).alias("log_path"),
    )


# --- the same rules for DuckDB ----------------------------------------------

# every white space character by its code point
WORDPUNCT = (r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
             r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")

SQL_SENT = f"""
ln AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
              unnest(range(len(string_split(text, chr(10))))) AS line_no
       FROM documents),
sent AS (SELECT doc_id || ':' || line_no AS sent_key, doc_id, line_no, lang, line AS raw_text,
                regexp_extract_all(line, '{WORDPUNCT}') AS forms
         FROM ln WHERE len(regexp_extract_all(line, '{WORDPUNCT}')) > 0),
stext AS (SELECT sent_key, doc_id, lang, raw_text, array_to_string(forms, ' ') AS text,
                 len(forms) AS n_words FROM sent)"""

SQL_TOK = SQL_SENT + r""",
t0 AS (SELECT sent_key, doc_id, lang, unnest(forms) AS form,
              unnest(range(1, len(forms) + 1)) AS id FROM sent),
t1 AS (SELECT *, length(form) AS n,
  CASE WHEN NOT regexp_matches(form, '^[\p{L}\p{N}_]') THEN 'PUNCT'
       WHEN regexp_matches(form, '^[0-9]+$') THEN 'NUM'
       WHEN length(form) <= 2 THEN 'ADP'
       WHEN length(form) = 3 THEN 'DET'
       WHEN substr(form, 1, 1) <> lower(substr(form, 1, 1)) THEN 'PROPN'
       WHEN length(form) % 3 = 0 THEN 'NOUN'
       WHEN length(form) % 3 = 1 THEN 'VERB'
       ELSE 'ADJ' END AS upos FROM t0),
tok AS (SELECT sent_key, doc_id, lang, id, form, lower(form) AS lemma, upos,
  CASE WHEN upos <> 'PUNCT' THEN upos || (id % 2) END AS xpos,
  id // 2 AS head,
  CASE WHEN id = 1 THEN 'root' WHEN upos = 'PUNCT' THEN 'punct' WHEN upos = 'ADP' THEN 'case'
       WHEN upos = 'DET' THEN 'det' WHEN upos = 'NUM' THEN 'nummod'
       WHEN upos = 'PROPN' THEN 'nmod:poss' WHEN upos = 'ADJ' THEN 'amod'
       WHEN upos = 'NOUN' AND id % 4 = 0 THEN 'nsubj' WHEN upos = 'NOUN' AND id % 4 = 1 THEN 'obj'
       WHEN upos = 'NOUN' AND id % 4 = 2 THEN 'nsubj:pass' WHEN upos = 'NOUN' THEN 'obl'
       WHEN id % 3 = 0 THEN 'advcl' WHEN id % 3 = 1 THEN 'aux:pass' ELSE 'acl:relcl' END AS deprel,
  CASE WHEN upos IN ('NOUN','VERB','ADJ','PROPN')
       THEN CASE WHEN n % 2 = 0 THEN 'Sing' ELSE 'Plur' END END AS f_number,
  CASE WHEN upos IN ('NOUN','ADJ')
       THEN CASE id % 3 WHEN 0 THEN 'Masc' WHEN 1 THEN 'Fem' ELSE 'Neut' END END AS f_gender,
  CASE WHEN upos = 'VERB' THEN CASE WHEN id % 2 = 0 THEN 'Past' ELSE 'Pres' END END AS f_tense,
  CASE WHEN upos = 'VERB' THEN CASE WHEN id % 5 = 0 THEN 'Inf' ELSE 'Fin' END END AS f_verbform,
  CASE WHEN upos = 'ADJ' THEN 'Pos' END AS f_degree,
  CASE WHEN upos = 'DET' THEN CASE WHEN id % 4 = 0 THEN 'Dem' ELSE 'Art' END END AS f_prontype,
  CASE WHEN upos = 'NUM' THEN 'Card' END AS f_numtype,
  CASE WHEN upos = 'PROPN' THEN CASE WHEN id % 2 = 0 THEN 'Masc' ELSE 'Fem' END END AS f_psor
  FROM t1),
feat AS (SELECT sent_key, doc_id, lang, id, form, upos, deprel, unnest([
    {'category': 'Number', 'value': f_number}, {'category': 'Gender', 'value': f_gender},
    {'category': 'Tense', 'value': f_tense}, {'category': 'VerbForm', 'value': f_verbform},
    {'category': 'Degree', 'value': f_degree}, {'category': 'PronType', 'value': f_prontype},
    {'category': 'NumType', 'value': f_numtype}, {'category': 'Gender[psor]', 'value': f_psor}],
    recursive := true) FROM tok)"""

# Path of word ids from the root, for trees where word i hangs on word i div 2.
SQL_PATH = "list_transform(range(CAST(floor(log2(id)) AS BIGINT), -1, -1), lambda k: id >> k)"

SQL_ROLE = """CASE lang WHEN 'en' THEN CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'dev' ELSE 'test' END
     WHEN 'fr' THEN CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END ELSE 'train' END"""

SQL_WORDPUNCT = f"array_to_string(regexp_extract_all(text, '{WORDPUNCT}'), ' ')"

SQL_LANG = f"lr AS (SELECT doc_id, lang AS label, {SQL_WORDPUNCT} AS text FROM documents)"

SQL_STAGED = """st AS (SELECT doc_id, label, text,
  CASE WHEN doc_id % 10 < 8 THEN 'tr' WHEN doc_id % 10 = 8 THEN 'va' ELSE 'te' END AS stage FROM lr)"""

SQL_PRED = """pr AS (SELECT vec_id, label,
  CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS prediction FROM embeddings)"""

SQL_LAYERS = f"""ly AS (SELECT vec_id, label, l AS layer,
  list_slice(embedding, l * {LAYER_WIDTH} + 1, l * {LAYER_WIDTH} + {LAYER_WIDTH}) AS features
  FROM embeddings, range({LAYERS}) AS r(l))"""

SQL_FACTS = """rp AS (SELECT ['en','fr','de','es'][vec_id % 4 + 1] AS task_language,
    CASE WHEN vec_id % 2 = 0 THEN 'Number' ELSE 'Case' END AS task_category,
    classifier_name, control, layer, label,
    CASE WHEN CASE WHEN control THEN vec_id % 3 <> 0
              ELSE vec_id % (layer + CASE WHEN classifier_name = 'mlp' THEN 3 ELSE 2 END) = 0 END
         THEN (label + 1) % 10 ELSE label END AS prediction
  FROM embeddings, (VALUES ('logreg'), ('mlp')) c(classifier_name), (VALUES (false), (true)) k(control),
       range(4) AS r(layer)),
cls AS (SELECT task_language, task_category, classifier_name, control, layer, label,
    count(*) AS support, count(*) FILTER (label = prediction) AS tp FROM rp GROUP BY ALL),
prd AS (SELECT task_language, task_category, classifier_name, control, layer, prediction AS label,
    count(*) AS predicted FROM rp GROUP BY ALL),
f1s AS (SELECT task_language, task_category, classifier_name, control, layer,
    sum(support * 2.0 * tp / (support + coalesce(predicted, 0))) / sum(support) AS f1,
    sum(tp) * 1.0 / sum(support) AS accuracy
  FROM cls LEFT JOIN prd USING (task_language, task_category, classifier_name, control, layer, label)
  GROUP BY ALL),
facts AS (SELECT task_language || '-' || task_category || '-' || classifier_name || '-' ||
      CASE WHEN control THEN 'control' ELSE 'task' END AS run_id, task_language, task_category,
    'slices' AS hf_model_name, classifier_name, control, layer, 0 AS epoch, 'test' AS stage, metric,
    CASE metric WHEN 'f1' THEN f1 ELSE accuracy END AS value
  FROM f1s, (VALUES ('f1'), ('accuracy')) m(metric))"""
