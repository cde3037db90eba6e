"""Time every oracle SQL in DuckDB (single process, all cores) at one scale factor.

Usage: python scripts/duckdb_timing.py [sf_dir] -> one JSON line, median of 3 runs per query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tabulant.plans.oracle import ORACLE_SQL  # noqa: E402
from tabulant.sources.tables import TABLES, table_path  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(sf, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    out = {}
    for name, sql in ORACLE_SQL.items():
        runs = []
        for i in range(4):
            t0 = time.perf_counter()
            con.execute(sql).fetchall()
            if i:
                runs.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(runs), 3)
    print(json.dumps({"engine": "duckdb", "value": round(sum(out.values()), 3), "queries": out, "sf": sf}))


if __name__ == "__main__":
    main()
