"""Shuffle volume and hot-key evidence from Spark's event log.

Usage: python scripts/stage_report.py [sf_dir] > report.json

Runs every registered query once with the event log written to a fresh
scratch folder, then reads the log: per query, the shuffle bytes written and
the most shuffle records any single task read.  It also runs three
operators on a skewed copy of ``orders`` (a third of all rows moved to one
customer) and reports the same figures next to the hot key's row count --
if map-side combining works, no task reads anywhere near that many rows.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tabulant.operators import agg, panel, rank  # noqa: E402
from tabulant.session import build_session  # noqa: E402
from tabulant.sources.tables import load  # noqa: E402


def read_log(log_dir: str) -> dict[str, dict[str, int]]:
    stage_group: dict[int, str] = {}
    out: dict[str, dict[str, int]] = {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        for line in open(path, encoding="utf-8"):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                group = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e.get("Stage IDs", []):
                    stage_group[sid] = group
            elif ev == "SparkListenerTaskEnd":
                group = stage_group.get(e.get("Stage ID"))
                m = e.get("Task Metrics") or {}
                if not group or not m:
                    continue
                w = (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                r = (m.get("Shuffle Read Metrics") or {})
                recs = r.get("Total Records Read", 0)
                acc = out.setdefault(group, {"shuffle_bytes_written": 0, "max_task_records_read": 0})
                acc["shuffle_bytes_written"] += w
                acc["max_task_records_read"] = max(acc["max_task_records_read"], recs)
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="tabulant-eventlog-")
    spark = build_session("local[8]", app_name="tabulant-stages", shuffle_partitions=16,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}",
                                 "spark.eventLog.compress": "false",
                                 # keep the 16 shuffle partitions apart, so per-task reads show the spread
                                 "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    sc = spark.sparkContext
    from tabulant.plans.catalog import QUERIES

    for name, fn in QUERIES.items():
        sc.setJobGroup(name, name)
        fn(spark, sf).write.format("noop").mode("overwrite").save()

    orders = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    hot = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("o_custkey")))
    hot_rows = hot.filter(F.col("o_custkey") == 7).count()
    skew_runs = {
        "skew:first_last_delta": panel.first_last_delta(hot, "o_custkey", "o_orderdate", "o_totalprice",
                                                        tiebreak="o_orderkey"),
        "skew:mean_by": agg.mean_by(hot, ["o_custkey"], ["o_totalprice"], fixed=2),
        "skew:top_k_per_group": rank.top_k_per_group(hot, ["o_custkey"], [F.col("o_totalprice").desc(),
                                                                           F.col("o_orderkey")], 3),
    }
    for name, df in skew_runs.items():
        sc.setJobGroup(name, name)
        df.write.format("noop").mode("overwrite").save()
    spark.stop()
    report = read_log(log_dir)
    print(json.dumps({"sf": sf, "hot_key_rows": hot_rows, "queries": report}))


if __name__ == "__main__":
    main()
