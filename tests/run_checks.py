"""Run registered queries against their SQL: python tests/run_checks.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.session import get_session  # noqa: E402
from corpusloom.workload import load  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    queries, oracles = load()
    names = argv[1:] or list(queries)
    spark = get_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    folder = f"/root/testdata/sf{sf}"
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                result = compare(df, con, oracles[name]) or "ok"
            else:
                n = len(df.collect())
                result = f"rows only: {n}"
        except Exception as error:  # report and go on to the next query
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not result.startswith(("ok", "rows only"))
        print(f"{name:26s} {time.time() - start:6.1f}s  {result}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
