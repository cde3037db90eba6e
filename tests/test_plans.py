"""Plan assertions: no Python UDF in any query, pruned scans, the intended physical operators."""

import re

import pytest

from tabulant.plans.catalog import EAGER, QUERIES

SF = "/root/testdata/sf0.01"


def plan_of(spark, name):
    df = QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf_and_no_cartesian(spark, name):
    plan = plan_of(spark, name)
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in plan, f"{name} plans {node}"
    assert not unpartitioned_window(plan), f"{name} plans an unpartitioned window"


def unpartitioned_window(plan: str) -> bool:
    """A window without PARTITION BY sits on an ``Exchange SinglePartition`` (all rows in one task)."""
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            for below in lines[i + 1:]:
                if "Exchange" in below:
                    if "SinglePartition" in below:
                        return True
                    break
    return False


def test_unpartitioned_window_is_detected(spark):
    from pyspark.sql import Window, functions as F
    bad = spark.range(10).withColumn("s", F.sum("id").over(Window.orderBy("id")))
    good = spark.range(10).withColumn("s", F.sum("id").over(Window.partitionBy(F.col("id") % 2).orderBy("id")))
    assert unpartitioned_window(bad._jdf.queryExecution().executedPlan().toString())
    assert not unpartitioned_window(good._jdf.queryExecution().executedPlan().toString())


def test_top_k_per_group_limits_before_shuffle(spark):
    plan = plan_of(spark, "top_k_per_group")
    assert plan.count("WindowGroupLimit") >= 2  # partial (map side) and final


def test_last_n_rows_limits_before_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(spark, "last_n_periods_avg_rows")


def test_duplicate_rows_use_semi_join(spark):
    assert "LeftSemi" in plan_of(spark, "rows_of_duplicate_keys")


def test_duplicate_texts_are_shuffled_once(spark):
    """Without any broadcast, one exchange carries texts (the join's) besides the final sort."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        from tabulant.operators.shape import rows_of_duplicate_keys
        df = spark.read.parquet(f"{SF}/documents.parquet")
        plan = rows_of_duplicate_keys(df, "text", digest=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    exchanges = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    with_text = [i for i in exchanges if "text#" in lines[i + 1].split("functions=")[0] and "keys=" not in lines[i + 1]]
    assert len(with_text) == 1 and len(exchanges) <= 3


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_building_runs_no_job(spark, name):
    """Builders are lazy: the plan is made, and no Spark job runs, until rows are asked for."""
    sc = spark.sparkContext
    sc.setJobGroup(f"build-{name}", name)
    try:
        QUERIES[name](spark, SF)
        assert not sc.statusTracker().getJobIdsForGroup(f"build-{name}")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_limit_feeds_a_single_partition(spark, name):
    """No size probe: a limit over a whole side would send it to one task."""
    lines = plan_of(spark, name).split("\n")
    for above, below in zip(lines, lines[1:]):
        assert not ("Exchange SinglePartition" in above and "LocalLimit" in below)


def test_row_total_filter_reaches_the_scan(spark):
    assert "EqualTo(l_suppkey,7)" in plan_of(spark, "row_total")


def test_facts_are_summed_before_they_meet_attributes(spark):
    """The wide shuffles of the flagship carry keys and sums, no strings."""
    plan = plan_of(spark, "top_k_per_group")
    agg = [x for x in plan.split("\n") if "partial_sum" in x]
    assert agg and all("s_name" not in x and "c_mktsegment" not in x for x in agg)


def test_top_k_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "top_k")


def test_scenarios_scan_input_once(spark):
    plan = plan_of(spark, "scenario_risk")
    assert plan.count("FileScan parquet") == 1 or plan.count("Scan parquet") == 1


def test_mean_by_scan_is_pruned(spark):
    plan = plan_of(spark, "mean_by")
    assert "l_returnflag" not in plan and "l_orderkey" not in plan


def test_aggregates_are_partial_then_final(spark):
    plan = plan_of(spark, "mean_by")
    assert "partial_sum" in plan and plan.count("HashAggregate") >= 2
