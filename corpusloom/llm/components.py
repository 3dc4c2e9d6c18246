"""Connected components of a link table, by hooking to the smallest neighbour and pointer jumping.

Links and labels stay tables; the driver sees counts only. Every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_table


def jump(parents: DataFrame) -> DataFrame:
    """(node, label) where a label is a node too: labels followed to their ends. Labels are never larger."""
    while True:
        up = parents.filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("__up"))
        moved = persist_table(parents.join(up, "label", "left").select(
            "node", F.coalesce("__up", "label").alias("label"), F.col("__up").isNotNull().alias("__moved")), "labels")
        parents = moved.select("node", "label")
        if moved.filter("__moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): label is the smallest node that it reaches.

    A node with very many links costs no more than others: its links are aggregated before they move, and
    relabelling joins are ordinary joins that adaptive execution splits.
    """
    spark = links.sparkSession
    edges = persist_table(links.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        parents = jump(persist_table(near.select("node", F.least("node", "m").alias("label")), "labels"))
        if labels is None:
            labels = parents
        else:
            step = parents.select(F.col("node").alias("label"), F.col("label").alias("__up"))
            labels = persist_table(labels.join(step, "label", "left").select(
                "node", F.coalesce("__up", "label").alias("label")), "labels")
        a = parents.select(F.col("node").alias("a"), F.col("label").alias("__a"))
        b = parents.select(F.col("node").alias("b"), F.col("label").alias("__b"))
        edges = persist_table(edges.join(a, "a").join(b, "b").filter("__a <> __b").select(
            F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct(), "links")
    if labels is None:
        return spark.createDataFrame([], "node long, label long")
    return labels
