"""Compare a Spark result with a DuckDB result as unordered rows."""

from __future__ import annotations

import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return bool(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return round(float(value), 6) + 0.0
    return value


def rows_of(arrow) -> list[tuple]:
    names = sorted(arrow.column_names)
    cols = [[_plain(v) for v in arrow.column(n).to_pylist()] for n in names]
    return sorted(zip(*cols), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    ours = spark_df.toArrow()
    theirs = con.execute(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} / {sorted(theirs.column_names)}"
    a, b = rows_of(ours), rows_of(theirs)
    if len(a) != len(b):
        only_a = sorted(set(a) - set(b), key=repr)[:3]
        only_b = sorted(set(b) - set(a), key=repr)[:3]
        return f"rows {len(a)} / {len(b)}; only ours {only_a}; only SQL {only_b}"
    for x, y in zip(a, b):
        if x != y:
            return f"first difference {x} / {y}"
    kinds = {n: (str(ours.schema.field(n).type), str(theirs.schema.field(n).type)) for n in ours.column_names}
    odd = {n: k for n, k in kinds.items() if k[0].replace("large_", "") != k[1].replace("large_", "")}
    return f"types {odd}" if odd else None
