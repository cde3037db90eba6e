
from __future__ import annotations

import json
import sys

HEAD = """# BASELINE

## The reference

No published performance numbers exist in the reference: all of its files were read, and none states
a timing, hardware, scale factor or rate. It is a set of analytical queries run on two external
database servers, over small tables (a 77-row menu, a 62-year country panel, a 5-country seasonal
panel).

| metric | value | config |
|---|---|---|
| query latency / throughput | none published | – |
| standard benchmark (TPC-H, TPC-DS, SSB) | not used | – |
| menu table size | 77 rows, 73 distinct items | – |
| country panel span | 1961–2022 | – |
| seasonal panel size | 5 countries | – |

## Our own baseline

Machine: one container with 8 cores and 32 GB. The data is `/root/testdata/sf0.1` (600 000
`lineitem`, 150 000 `orders`, 15 000 `customer`, 10 000 `documents` rows; every table is one
parquet file with a single row group, so every scan is one task).

- **Spark:** `python bench.py` on `local[8]`, 16 shuffle partitions with AQE coalescing. Each query
  runs to completion on the `noop` sink; the figure is the median of 3 runs after one warm-up.
- **DuckDB:** `python scripts/duckdb_timing.py` runs the oracle SQL for the same questions
  (single process, all cores, results fetched to Python). The figure is the median of 3 runs after
  one warm-up. DuckDB is not the reference engine; it is here as a same-machine, single-node point
  of comparison.

Repeated runs of the Spark benchmark vary on this machine: by about ±20% a query within a session, and by up to
a factor of two between sessions, as other work shares the host.

| | Spark `tabulant` | DuckDB oracle SQL |
|---|---|---|
| total, {n} analytical queries (sec) | {spark_total:.1f} | {duck_total:.1f} |
| total, {m} training-data queries (sec) | {other:.1f} | – |

At this size, Spark's fixed cost of about 0.1–0.3 s per job (scheduling, stage setup, task launch)
dominates: `count_by` over 15 000 rows takes {count_by:.2f} s. Building a query runs no job, so a
figure is the query's own plan and nothing else. The training-data operators (`op…`, `pipeline`) stage
their intermediate tables in the shared folder; a query whose first run takes over 5 s is timed once
after that.  SQL expresses three of the training-data queries.

Shuffle columns come from `python scripts/stage_report.py` (Spark's event log in a scratch folder,
partition coalescing off so the 16 shuffle partitions stay apart): bytes written to shuffle per
query, and the most shuffle records any single task read; they are round 2's for queries whose code is
unchanged since, and "–" where none were taken.

| query | Spark sec | DuckDB sec | shuffle MB written | max records read by one task |
|---|---|---|---|---|
"""

SKEW = """
## Hot key

The same report runs three operators on `orders` with a third of all rows ({hot} rows) moved to one
customer. No task reads anywhere near the hot key's rows, because aggregates combine map-side and
per-group top-k applies a partial limit before the shuffle:

| operator on skewed orders | shuffle MB written | max records read by one task |
|---|---|---|
{rows}
"""


def main() -> None:
    spark = json.load(open(sys.argv[1]))
    duck = json.load(open(sys.argv[2]))
    stages = json.load(open(sys.argv[3])) if len(sys.argv) > 3 else {"queries": {}, "hot_key_rows": 0}
    q, d, st = spark["queries"], duck["queries"], stages["queries"]
    core = [v for k, v in q.items() if k in d]
    out = HEAD.format(n=len(core), spark_total=sum(core), duck_total=duck["value"], m=len(q) - len(core),
                      other=spark["value"] - sum(core), count_by=q.get("count_by", 0))

    def num(v):
        return "–" if v is None else f"{v:.3f}"

    def shuffle(k):
        m = st.get(k)
        return ("–", "–") if m is None else (f"{m['shuffle_bytes_written'] / 1e6:.2f}", str(m["max_task_records_read"]))

    out += "\n".join(f"| `{k}` | {v:.3f} | {num(d.get(k))} | {shuffle(k)[0]} | {shuffle(k)[1]} |"
                     for k, v in q.items())
    skew = [k for k in st if k.startswith("skew:")]
    if skew:
        out += "\n" + SKEW.format(hot=stages["hot_key_rows"], rows="\n".join(
            f"| `{k[5:]}` | {shuffle(k)[0]} | {shuffle(k)[1]} |" for k in skew))
    out += "\n\nRaw output of the Spark run:\n\n```\n" + json.dumps(spark) + "\n```\n"
    sys.stdout.write(out)


if __name__ == "__main__":
    main()
