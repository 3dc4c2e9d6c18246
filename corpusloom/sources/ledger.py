"""Steps of a long job in a shared folder, so that a restart goes on where it was stopped.

A step is a table. It counts as done once its mark, a file written after the table, is there; what a stopped job left
without a mark is written anew. Marks are single files, which appear whole or not at all.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "name string, content string"


def clustered(rows: DataFrame, *by: str) -> DataFrame:
    """The rows laid out for a write by these columns: few files for a small value, several tasks for a large one.

    Adaptive execution splits large groups and joins small ones by the bytes it has seen, so the number of files follows
    the data and not write tasks x values.
    """
    return rows.hint("rebalance", *[F.col(c) for c in by])


class Ledger:
    """The steps in ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def settle_on(self, what: str, settings: dict) -> "Ledger":
        """Settings that belong to the folder: one that was begun with others is refused."""
        wanted = json.dumps(settings, sort_keys=True)
        found = self._mark(f"{what} settings")
        if found is None:
            self._write_mark(f"{what} settings", wanted)
        elif found != wanted:
            raise ValueError(f"{self.path} was begun with {found}, not {wanted}")
        return self

    def table(self, name: str, make: Callable[[], DataFrame], *by: str) -> DataFrame:
        """The table of a step: read where it is done, else made and written, in folders of ``by``."""
        schema = self._mark(name)
        if schema is None:
            rows = make()
            writer = (clustered(rows, *by) if by else rows).write.mode("overwrite")
            (writer.partitionBy(*by) if by else writer).parquet(self.at(name))
            schema = rows.schema.json()
            self._write_mark(name, schema)
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(self.at(name))

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def done(self, start: str = "") -> list[str]:
        """Names of the finished tables that begin so."""
        marks = self.appended("marks", MARK).filter(F.col("name").startswith(start))
        return sorted(r["name"] for r in marks.select("name").collect())

    def append(self, name: str, step: str, rows: DataFrame) -> None:
        """A few rows of one step of many, in place of those of an earlier try; steps may be written side by side."""
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.at(name)}/{_folder(step)}")

    def appended(self, name: str, schema: str) -> DataFrame:
        """The rows of all steps that ``append`` has written so far."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.at(name)}/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _mark(self, name: str) -> str | None:
        row = self.appended("marks", MARK).filter(F.col("name") == name).first()
        return row and row["content"]

    def _write_mark(self, name: str, content: str) -> None:
        self.append("marks", name, self.spark.createDataFrame([(name, content)], MARK))


def _folder(step: str) -> str:
    return "step-" + hashlib.md5(step.encode()).hexdigest()
