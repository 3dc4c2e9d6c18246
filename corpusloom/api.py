"""The jobs from files to files: convert, filter, probe a task or a folder of tasks, collect results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import task_category, task_language
from .operators import results as rs
from .plans import build, probe
from .session import fresh_path, persist_table
from .sources import conllu, runlog, taskfile
from .sources.ledger import Ledger


def convert_treebanks(spark: SparkSession, path: str | None = None, tr_path: str | None = None,
                      va_path: str | None = None, te_path: str | None = None,
                      language: str | None = None, save_to: str | None = None,
                      **options) -> build.MorphologyTasks:
    """CoNLL-U treebanks to one split task per language, subcategory and category.

    Give a folder, where names tell the roles of the files, or single files. All
    languages of a folder are built in one job. ``options`` go to ``build_ud_tasks``.
    """
    if path:
        sentences = conllu.read_conllu(spark, path, language).filter(F.col("role").isNotNull())
    else:
        given = [(r, p) for r, p in (("train", tr_path), ("dev", va_path), ("test", te_path)) if p]
        if not given or not tr_path:
            raise ValueError("give a folder, or at least the path of the training data")
        if language is None:
            first = conllu.read_conllu(spark, given[0][1]).select("lang").first()
            language = first["lang"] if first else None
        frames = [
            conllu.read_conllu(spark, p, language).withColumn("role", F.lit(r)) for r, p in given
        ]
        sentences = reduce(DataFrame.unionByName, frames)
    # parsed once; later passes read only the columns they need
    sentences = persist_table(
        sentences.select("lang", "role", "sent_key", "text", "metadata", "words"), "sentences")
    tasks = build.build_ud_tasks(sentences, ("lang",), **options)
    if save_to:
        taskfile.write_tasks(tasks.rows, save_to)
    return tasks


def filter_treebanks(spark: SparkSession, paths, queries: dict, task_name: str = "CustomTask",
                     language: str | None = None, partition=build.DEFAULT_PARTITION,
                     save_to: str | None = None) -> DataFrame:
    """Sentences classed by patterns to a split task; all files count as one corpus."""
    sentences = persist_table(
        conllu.read_conllu(spark, paths, language).select("sent_key", "text", "words"), "sentences")
    rows = build.build_filter_task(sentences, queries, partition)
    if language is None:
        name = conllu.corpus_files_any(spark, paths).agg(F.min("lang").alias("lang")).first()
        language = name["lang"]
    rows = rows.select(F.lit(language).alias("lang"), F.lit(task_name).alias("task"),
                       "stage", "label", "text", "sent_key")
    if save_to:
        taskfile.write_tasks(rows, save_to)
    return rows


def probe_task(spark: SparkSession, path: str, log_to: str | None = None, run_id: str = "run",
               sep: str = "\t", **options) -> DataFrame:
    """A task file to run facts. Language and category come from the file name."""
    rows = taskfile.read_task(spark, path, sep)
    name = spark.range(1).select(task_language(F.lit(path)).alias("lang"), task_category(F.lit(path)).alias("cat")).first()
    keyed = persist_table(taskfile.with_keys(rows), "task")
    return probe.run_probe(keyed, "key", name["lang"], name["cat"], run_id=run_id, log_to=log_to, file_path=path,
                           **options)


def probe_folder(spark: SparkSession, path: str, sep: str = "\t", layers: int = 4, width: int = 32,
                 make_predict_fn=None, ledger: str | None = None, **options) -> DataFrame:
    """All tasks of a folder written by ``write_tasks``: (lang, task, layer, stage, metric, value, status).

    The texts of all tasks go through the model in one pass, each different text once. A task that cannot
    be probed is a row with the reason as its status. ``options`` go to ``probe.sweep``. With ``ledger``, a folder of this
    job alone, a run that was stopped goes on: texts that were encoded and fits that were scored are read there.
    """
    ledger = ledger or fresh_path(spark, "sweep")
    book = Ledger(spark, ledger).settle_on("vectors", {"path": path, "sep": sep, "layers": layers, "width": width})

    def named() -> DataFrame:
        rows = taskfile.with_keys(taskfile.read_tasks(spark, path, sep))
        return rows.select(F.concat_ws("/", "lang", "task").alias("name"), "key", "stage", "label", "text")

    vectors = book.table("vectors", lambda: probe.encode_layers(
        book.table("tasks", named), "key", layers=layers, width=width, make_predict_fn=make_predict_fn))
    scores = probe.sweep_tasks(vectors, "key", "name", ledger, **options)
    return scores.select(
        F.substring_index("name", "/", 1).alias("lang"), F.regexp_replace("name", "^[^/]*/", "").alias("task"),
        "layer", "stage", "metric", "value", "status")


def collect_logs(spark: SparkSession, paths, metric: str = "f1", stage: str = "test") -> DataFrame:
    """Mean score per log and layer, from JSON logs."""
    scores = runlog.log_scores(runlog.read_logs(spark, paths))
    return rs.aggregate_results(scores, metric, stage)
