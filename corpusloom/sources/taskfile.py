"""Task files: headerless tab-separated text of stage, label and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import clustered

SCHEMA = "stage string, label string, text string"

# Names of the ready-made tasks.
TASK_NAMES = (
    "conj_type", "gapping", "impersonal_sent", "ngram_shift", "obj_gender", "obj_number",
    "predicate_aspect", "predicate_voice", "sent_len", "subj_gender", "subj_number",
    "tree_depth", "word_content",
)


def read_task(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """All columns as text; labels such as NA stay text."""
    return (
        spark.read.schema(SCHEMA).option("sep", sep).option("quote", '"').option("escape", '"')
        .option("nullValue", "\u0000").option("emptyValue", "").option("encoding", "UTF-8")
        .csv(path)
    )


def read_tasks(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """All tasks of a folder written by ``write_tasks``, with ``lang`` and ``task``."""
    fields = f"{SCHEMA}, lang string, task string"
    return (
        spark.read.schema(fields).option("sep", sep).option("quote", '"').option("escape", '"')
        .option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    )


def with_keys(rows: DataFrame, block: int = 100_000) -> DataFrame:
    """The rows with ``key``: the hash of a row's content and its number among equal rows.

    It hangs on no path, file order or cluster. Equal rows collapse before the shuffle, and are dealt out
    again in blocks, so a row with very many copies is no task's alone.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__h", F.sha2(F.to_json(F.struct(*names)), 256))
    blocks = counted.withColumn("__b", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / block))))
    first = F.col("__b") * block
    numbers = F.sequence(first, F.least(first + block, F.col("__n")) - 1)
    dealt = blocks.repartition("__h", "__b").withColumn("__i", F.explode(numbers))
    return dealt.select(*names, F.concat_ws(":", "__h", F.col("__i").cast("string")).alias("key"))


def task_path(name: str, folder: str) -> str:
    """Path pattern of a ready-made task in a folder."""
    if name not in TASK_NAMES:
        raise ValueError(f"no data for the task {name}; pass a path")
    return f"{folder.rstrip('/')}/{name}*"


def write_tasks(rows: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """One folder per language and task below ``path``; ``rows`` has lang, task, stage, label, text.

    Rows of a task come together first, so a small task is one file and a large one is written by several tasks.
    """
    rows = clustered(rows.select("lang", "task", "stage", "label", "text"), "lang", "task")
    writer = rows.write.mode(mode).partitionBy("lang", "task")
    if fmt == "csv":
        # values are quoted only where they must be, quotes inside doubled
        writer = (
            writer.option("sep", "\t").option("quote", '"').option("escape", '"')
            .option("nullValue", "\u0000").option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        )
        writer.csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("fmt is 'csv' or 'parquet'")
