"""Targets of small sources in a corpus of many shards."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.mixing import BLOCK_WORDS, mix

from . import brute


@pytest.mark.parametrize("words", [10, 20])
def test_small_source_meets_its_target(spark, tmp_path, words):
    """300 documents whose target is three times their words, beside others that make 60 shards of the corpus."""
    rows = [(i, f"{i} " * words, "b") for i in range(300)] + [(1000 + i, f"{i} " * 40, "a") for i in range(6000)]
    rows += [(10_000 + i, None, "b") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "t"))
    out = mix(spark.read.parquet(str(tmp_path / "t")), shard_rows=106)
    got = out.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == len(rows)
    small = min(got, key=lambda r: r.source_size)
    assert small.target == 3 * 300 * words
    for r in got:
        assert abs(r.taken - r.target) <= BLOCK_WORDS
    assert out.filter("taken > 3 * size").isEmpty()


def test_shard_words_are_exact():
    from corpusloom.llm.mixing import shard_words

    draw = random.Random(3)
    for _ in range(500):
        sizes = [draw.choice([0, 1, 5, 64, draw.randint(0, 3000)]) for _ in range(draw.randint(1, 40))]
        blocks = draw.randint(0, 1 + 3 * sum(sizes) // 64)
        out = shard_words(sizes, blocks, 3, 64)
        assert all(0 <= w <= 3 * n for w, n in zip(out, sizes))
        assert sum(out) == min(64 * blocks, 3 * sum(sizes))
