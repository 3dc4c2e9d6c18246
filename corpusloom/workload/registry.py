"""Queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def sql_split(src: str, key: str, partition, seed: int, by: tuple[str, ...] = (),
              large: bool = True, n_classes: int | None = None) -> str:
    """CTEs that end in ``split_out`` (by, label, key, stage) over the rows of ``src``."""
    b = "".join(f"{c}, " for c in by)
    part = ", ".join(by) or "0"
    if not large:
        keep = "SELECT * FROM cnt0"
    elif n_classes is not None:
        keep = f"SELECT * FROM cnt0 WHERE n > {n_classes}"
    else:
        keep = f"SELECT * EXCLUDE kk FROM (SELECT *, count(*) OVER (PARTITION BY {part}) AS kk FROM cnt0) WHERE n > kk"
    p0 = partition[0]
    head = f"""
cnt0 AS (SELECT {b}label, count(*) AS n FROM {src} GROUP BY ALL),
cnt AS ({keep}),
q1 AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS nn, count(*) OVER w AS k, min(n) OVER w AS lo,
         CAST(floor(CAST({p0} AS DOUBLE) * sum(n) OVER w) AS BIGINT) AS draw
       FROM cnt WINDOW w AS (PARTITION BY {part})),
q2 AS (SELECT *, (n * draw) // nn AS whole, (n * draw) % nn AS rest FROM q1
       WHERE draw >= k AND nn - draw >= k AND lo >= 2),
q3 AS (SELECT *, whole + CASE WHEN row_number() OVER (PARTITION BY {part} ORDER BY rest DESC, label)
                   <= draw - sum(whole) OVER (PARTITION BY {part}) THEN 1 ELSE 0 END AS n_tr FROM q2),"""
    if len(partition) == 2:
        tail = f"""
quo AS (SELECT {b}label, n, n_tr, 0 AS n_va, n - n_tr AS n_te FROM q3),"""
        stages = "CASE WHEN rn <= n_tr THEN 'tr' ELSE 'te' END"
    else:
        te = partition[2] / (partition[1] + partition[2])
        tail = f"""
q4 AS (SELECT {b}label, n, n_tr, n - n_tr AS c2 FROM q3 WHERE n - n_tr > 1),
q5 AS (SELECT *, CAST(sum(c2) OVER w AS BIGINT) AS n2, count(*) OVER w AS k2,
         CAST(floor(CAST({te!r} AS DOUBLE) * sum(c2) OVER w) AS BIGINT) AS draw2
       FROM q4 WINDOW w AS (PARTITION BY {part})),
q6 AS (SELECT *, (c2 * draw2) // n2 AS whole2, (c2 * draw2) % n2 AS rest2 FROM q5
       WHERE k2 >= 2 AND draw2 >= k2 AND n2 - draw2 >= k2),
quo AS (SELECT {b}label, n, n_tr, c2 - n_te AS n_va, n_te FROM (
  SELECT *, whole2 + CASE WHEN row_number() OVER (PARTITION BY {part} ORDER BY rest2 DESC, label)
              <= draw2 - sum(whole2) OVER (PARTITION BY {part}) THEN 1 ELSE 0 END AS n_te FROM q6)),"""
        stages = "CASE WHEN rn <= n_tr THEN 'tr' WHEN rn <= n_tr + n_va THEN 'va' ELSE 'te' END"
    return head + tail + f"""
rk AS (SELECT {b}label, {key}, row_number() OVER (PARTITION BY {b}label
         ORDER BY md5('{seed}:' || {key}), CAST({key} AS VARCHAR)) AS rn FROM {src}),
split_out AS (SELECT {b}label, {key}, {stages} AS stage FROM rk JOIN quo USING ({b}label))"""
