"""The share of rows kept, and the weights of resampling."""

import random

import numpy as np
import pytest

from corpusloom.llm.resampling import resample

from .conftest import table


@pytest.fixture
def docs(spark, tmp_path):
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choices(["sun", "moon", "x#", "y%"], k=draw.randint(1, 60)))) for i in range(200)]
    table(spark, rows).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


@pytest.mark.parametrize("most", [1, 7, 100])
def test_share_of_all_labels(spark, docs, most):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "doc_id long, quality int")
    assert resample(docs, labels, max_labels=most).filter("kept").count() == 50


def test_weight_is_the_log_ratio_of_the_text(spark, tmp_path):
    """A text repeated has each n-gram's part as often; the mean does not grow."""
    from corpusloom.llm.resampling import scores

    ratios = np.linspace(-1, 2, 64)
    table(spark, [(n, "sun " * n) for n in (1, 2, 10, 500)]).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    got = {r["__id"]: r for r in scores(docs, ratios).collect()}
    one = got[1].log_weight
    pair = got[2].log_weight - 2 * one
    for n, r in got.items():
        assert r.n_grams == 2 * n - 1
        assert abs(r.log_weight - (n * one + (n - 1) * pair)) < 1e-6
