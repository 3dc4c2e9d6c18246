"""Whitening against numpy on whole tables, with exact sums by Python's numbers."""

import os

import numpy as np
import pytest

from corpusloom.llm.queries import QUERIES
from corpusloom.llm.whitening import deviations, fit, solve_right, squares, whiten

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)


def flat(out):
    """Rows of the operator with the id beside the others."""
    return out.select("row.vec_id", *[c for c in out.columns if c != "row"]).collect()


def check(rows, table, components=32):
    """``rows`` of the operator against the eigenvectors of the covariance of ``table`` (id, vector)."""
    whole = [(i, v) for i, v in table if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([v for _, v in whole], dtype=float)).astype(np.int64).astype(object) + 1_000_000
    n, d = x.shape
    apart = n * x - x.sum(axis=0)
    y = (apart / n).astype(float)
    value, vector = np.linalg.eigh(y.T @ y / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(components, d)
    got = sorted(((r.vec_id, r.component, r) for r in rows), key=lambda t: t[:2])
    assert [(i, c) for i, c, _ in got] == [(i, c) for i in sorted(i for i, _ in whole) for c in range(1, k + 1)]
    order = np.argsort([i for i, _ in whole], kind="stable")
    assert [int(v) for v in (apart[order] ** 2).sum(axis=1) for _ in range(k)] == [r.deviation for _, _, r in got]
    w = np.array([t[2].whitened for t in got], dtype=float).reshape(n, k)
    kept = value[:k] > 1e-9 * value[0]
    mine = y[order] @ (vector[:, :k][:, kept] / np.sqrt(value[:k][kept]))
    sign = np.sign((mine * w[:, kept]).sum(axis=0))
    np.testing.assert_allclose(w[:, kept], mine * sign, atol=1e-6)
    np.testing.assert_allclose([t[2].explained for t in got[:k]], value[:k] / value.sum(), rtol=1e-6, atol=1e-10)
    assert {t[2].n for t in got} == {n}
    error = {t[2].identity_error for t in got}
    assert len(error) == 1 and error.pop() < 1e-9


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_small_table(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(QUERIES["op11_cholesky_whitening"](spark, SF).collect(), table)


def test_odd_vectors(spark):
    draw = np.random.default_rng(5)
    good = [(i, (draw.normal(size=5) * [1, 3, 10, 30, 100]).tolist()) for i in range(60)]
    odd = [(70, None), (71, []), (72, [1.0, None, 2.0, 3.0, 4.0]), (73, [1.0, float("nan"), 2.0, 3.0, 4.0]),
           (74, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (75, [1.0, 2.0])]
    check(flat(whiten(frame(spark, good + odd))), good)
    named = frame(spark, good).selectExpr("*", "'clash' AS row", "'clash' AS vector", "1 AS component")
    out = whiten(named, keep=("vec_id", "row", "component"), components=2)
    assert out.select("row.row").distinct().collect()[0][0] == "clash" and out.count() == 120
    ids = [(None, v) for _, v in good[:30]] + good[30:]
    assert whiten(frame(spark, ids)).filter("row.vec_id IS NULL").count() == 150


def test_far_from_zero_and_badly_scaled(spark):
    """A mean of a million times the spread, and columns whose variances differ by 11 digits."""
    draw = np.random.default_rng(6)
    rows = [(i, (1e6 + draw.normal(size=4) * [2e4, 600, 8, 0.05]).tolist()) for i in range(400)]
    check(flat(whiten(frame(spark, rows))), rows)
    model = fit(frame(spark, rows).selectExpr("embedding AS vector"))
    assert model.values[0] / model.values[-1] > 1e8 and model.passes >= 2


def test_directions_without_variance(spark):
    draw = np.random.default_rng(7)
    base = draw.normal(size=(50, 3)) * 8
    rows = [(i, [*map(float, np.round(b)), 4.0, float(2 * np.round(b[0]))]) for i, b in enumerate(base)]
    out = flat(whiten(frame(spark, rows)))
    assert {r.component for r in out if r.whitened is None} == {4, 5}
    assert all(r.explained == 0 for r in out if r.component > 3)
    check(out, rows)
    same = whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect()
    assert len(same) == 18 and all(r.whitened is None and r.deviation == 0 and r.identity_error == 0 for r in same)
    single = whiten(frame(spark, [(1, [1.0, 2.0])], 1)).collect()
    assert len(single) == 2 and all(r.deviation == 0 for r in single)


def test_no_rows(spark):
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [(1, None), (2, [float("nan")])])).count() == 0


def test_exact_where_64_bits_are_short():
    x = np.array([[2 ** 40, 5], [-2 ** 40, 7]], dtype=np.int64)
    apart = deviations(x, 2 ** 30, np.array([3, 11], dtype=np.int64))
    assert apart.tolist() == [[2 ** 70 - 3, 5 * 2 ** 30 - 11], [-2 ** 70 - 3, 7 * 2 ** 30 - 11]]
    assert squares(apart).to_pylist() == [None, None]
    assert squares(np.array([[3, 4]], dtype=object)).to_pylist() == [25]


def test_triangular_solve():
    draw = np.random.default_rng(8)
    r = np.triu(draw.normal(size=(6, 6))) + 4 * np.eye(6)
    y = draw.normal(size=(10, 6))
    np.testing.assert_allclose(solve_right(y, r) @ r, y)
