"""Whitening of embeddings by shifted Cholesky QR.

The rows, taken as whole numbers and centred exactly, are a tall matrix Y. A pass over it gives the Gram matrix of
Y R1^-1 ... Rk^-1, where each R is the Cholesky factor of the Gram matrix before and is applied by triangular solves. The
first Gram matrix gets a shift, so that its factor exists however badly scaled the columns are; each further pass brings
the rows nearer to orthogonal ones, until the Gram matrix is so near to the identity that its factor is exact to
rounding. Then Y = Q R with R the product of all factors, and the singular values and right vectors of R, which has as many
rows as columns, are those of Y: the components, without ever squaring the condition of Y.

A pass sums one small matrix per task and shuffles its entries; the driver sees d x d numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000   # an entry c is counted as floor(64 c) + 1,000,000
LIMIT = 2.0 ** 40               # scaled entries beyond it count as it, so that sums stay within 64 bits
COMPONENTS = 32
DIMENSIONS = 4096               # the driver holds a few matrices of that size squared
ROWS = 2000
PASSES = 6
NEAR = 100.0                    # condition of a Gram matrix whose factor is exact to rounding
EPS = float(np.finfo(float).eps)


class Fit(NamedTuple):
    """What the rows have in common; all of it is small."""

    n: int
    sums: np.ndarray        # whole numbers, one per dimension
    components: np.ndarray  # unit vectors in columns, by falling eigenvalue
    values: np.ndarray      # eigenvalues of the covariance
    explained: np.ndarray
    passes: int

    @property
    def scale(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; 0 for those without variance."""
        kept = self.proper
        return self.components * np.where(kept, 1 / np.sqrt(np.where(kept, self.values, 1)), 0)

    @property
    def proper(self) -> np.ndarray:
        """Components with variance, beyond rounding."""
        d = len(self.sums)
        return self.values > (self.values[0] if len(self.values) else 0) * (d * EPS) ** 2


def _finite(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Rows that are whole (not null, no null or non-finite entry): their numbers, lengths, and entries as one array."""
    number = np.arange(len(column))
    if column.null_count:
        known = pc.is_valid(column)
        number, column = number[known.to_numpy(zero_copy_only=False)], column.filter(known)
    flat = column.flatten()
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become not-a-number
    bad = ~np.isfinite(entries)
    if bad.any():
        row = np.repeat(np.arange(len(length)), length)
        good = np.ones(len(length), dtype=bool)
        good[row[bad]] = False
        return number[good], length[good], entries[good[row]]
    return number, length, entries


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(entries * SCALE), -LIMIT, LIMIT).astype(np.int64) + OFFSET


def _rows_of(batch: pa.RecordBatch, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the rows with ``d`` whole entries, and these as whole numbers."""
    for at in range(0, batch.num_rows, ROWS):
        number, length, entries = _finite(batch.column("vector").slice(at, ROWS))
        if not (length == d).all():
            entries = entries[np.repeat(length == d, length)]
            number = number[length == d]
        yield number + at, whole_numbers(entries).reshape(-1, d)


def exact_sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Rows of the most common length, and their sums per dimension as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            _, length, entries = _finite(batch.column("vector"))
            for d in np.unique(length[length > 0]).tolist():
                x = whole_numbers(entries[np.repeat(length == d, length)]).reshape(-1, d)
                n, total = held.get(d, (0, 0))
                held[d] = n + len(x), total + x.sum(axis=0)
        for d, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                 pa.array(total, pa.int64())], ["length", "dim", "n", "total"])

    parts = vectors.mapInArrow(run, "length int, dim int, n long, total long")
    sums = parts.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    common = F.struct("n", "length")
    best = sums.filter("dim = 0").agg(F.max(common).alias("m")).first()["m"]
    if best is None:
        return 0, np.zeros(0, dtype=np.int64)
    if best["length"] > DIMENSIONS:
        raise ValueError(f"vectors of more than {DIMENSIONS} entries are not supported")
    rows = sums.filter(F.col("length") == best["length"]).collect()  # one per dimension
    out = np.zeros(best["length"], dtype=np.int64)
    for r in rows:
        out[r["dim"]] = r["total"]
    return best["n"], out


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - sums, exactly: 64-bit numbers, or Python's where these are too short."""
    middle = sums // n
    rest = sums - n * middle
    apart = x - middle
    widest = int(np.abs(apart).max(initial=0)) + 1
    if widest * n < 2 ** 62:
        return n * apart - rest
    return n * apart.astype(object) - rest.astype(object)


def squares(apart: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exactly; null where it is more than 64 bits hold."""
    widest = max(abs(int(apart.max(initial=0))), abs(int(apart.min(initial=0))))
    if widest ** 2 * apart.shape[1] < 2 ** 63:
        whole = apart.astype(np.int64)
        return pa.array((whole * whole).sum(axis=1), pa.int64())
    sums = [sum(int(v) ** 2 for v in row) for row in apart]
    return pa.array([s if s < 2 ** 63 else None for s in sums], pa.int64())


def solve_right(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows r^-1 for an upper triangular ``r``, column by column."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(vectors: DataFrame, n: int, sums: np.ndarray, transform: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Z'Z summed over all rows, where Z is ``transform`` of the centred rows."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for _, x in _rows_of(batch, d):
                z = transform(deviations(x, n, sums).astype(np.float64) / n)
                total = total + z.T @ z
        if isinstance(total, np.ndarray):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    parts = vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (parts.column(c).to_numpy() for c in "ijv")
    out = np.zeros((int(j.max()) + 1,) * 2)
    out[i, j] = v
    out[j, i] = v
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit:
    """Components of the rows of ``vectors`` (a column ``vector``)."""
    n, sums = exact_sums(vectors)
    d = len(sums)
    if not n:
        return Fit(0, sums, np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0)
    factors: list[np.ndarray] = []
    r, passes = np.eye(d), 0
    shift_by = 11 * (n * d + d * (d + 1)) * EPS / 2
    while True:
        passes += 1
        applied = list(factors)

        def orthogonalised(y: np.ndarray) -> np.ndarray:
            for factor in applied:
                y = solve_right(y, factor)
            return y

        g = gram(vectors, n, sums, orthogonalised)
        size = float(np.trace(g))
        if size == 0:  # all rows are alike
            break
        low, high = np.linalg.eigvalsh(g)[[0, -1]]
        if factors and low > 0 and high / low <= NEAR:
            r = np.linalg.cholesky(g).T @ r
            break
        if passes == PASSES:  # directions without variance never come near: their part of the root is 0
            value, vector = np.linalg.eigh(g)
            r = (vector * np.sqrt(np.maximum(value, 0))).T @ r
            break
        factor = np.linalg.cholesky(g + min(shift_by, 0.01) * size * np.eye(d)).T
        factors.append(factor)
        r = factor @ r
    if size == 0:
        r = np.zeros((d, d))
    _, sigma, right = np.linalg.svd(r)
    values = sigma ** 2 / n
    part = values / values.sum() if values.sum() else values
    vectors_ = right.T * np.where(right[np.arange(d), np.abs(right).argmax(axis=1)] < 0, -1.0, 1.0)
    k = min(components, d)
    return Fit(n, sums, vectors_[:, :k], values[:k], part[:k], passes)


def identity_error(vectors: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on the rows."""
    if not model.n or not model.proper.any():
        return 0.0
    scale = model.scale[:, model.proper]
    moments = gram(vectors, model.n, model.sums, lambda y: np.column_stack([y @ scale, np.ones(len(y))])) / model.n
    mean = moments[:-1, -1]
    return float(np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())


def whiten(table: DataFrame, vector_col: str = "embedding", keep: tuple[str, ...] = ("vec_id",),
           components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``row`` (a struct of the columns ``keep``), ``component`` from 1, ``n``,
    ``deviation`` (the squared distance from the mean, times n squared, exact), ``whitened``, ``explained`` (share of the
    variance) and ``identity_error`` (how far the covariance of the whitened rows is from the identity).

    Vectors that are null, or hold a null or non-finite entry, are left out, and so are those of another length than
    the most common one (of equally common ones the longest) and empty ones. Entries beyond 2^34 count as
    2^34. A component without variance, as repeated rows or constant dimensions give, has null ``whitened`` and
    ``explained`` 0, and takes no part in ``identity_error``. A ``deviation`` that 64 bits do not hold is null. Components are
    told apart up to their sign and, where eigenvalues are equal, up to a rotation. An empty table gives an empty
    result. Nulls in other columns, repeated rows and further columns make no difference. The table is read some
    five times and has to give the same rows each time.
    """
    vectors = table.select(F.col(f"`{vector_col}`").alias("vector"))
    model = fit(vectors, components)
    error = identity_error(vectors, model)
    rows = table.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{vector_col}`").alias("vector"))
    kind = rows.schema["row"].dataType.simpleString()
    d, k, n, sums = len(model.sums), len(model.values), model.n, model.sums
    scale, proper, explained = model.scale, model.proper, np.where(model.proper, model.explained, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if k else ():
            for number, x in _rows_of(batch, d):
                apart = deviations(x, n, sums)
                each = np.repeat(np.arange(len(x)), k)
                whitened = (apart.astype(np.float64) / n) @ scale
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(number[each])), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                     squares(apart).take(pa.array(each)),
                     pa.array(whitened.ravel(), pa.float64(), mask=~np.tile(proper, len(x))),
                     pa.array(np.tile(explained, len(x)), pa.float64())],
                    ["row", "component", "deviation", "whitened", "explained"])

    out = rows.mapInArrow(run, f"row {kind}, component int, deviation long, whitened double, explained double")
    return out.select("row", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
                      F.lit(error).alias("identity_error"))
