"""Mergeable distinct sketches, and lookups in interval tables."""

import random

import pytest
from pyspark.sql import functions as F

from tabulant.operators import ranges, sketch
from tabulant.sources.tables import write_table
from tests.conftest import rows


def test_stored_states_merge_to_the_whole_and_keep_the_bound(spark, scratch):
    """States a day, written to storage, read again and merged: a third of all rows on one day, and a NULL value."""
    df = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 28).alias("day"),
                                     F.when(F.col("id") % 10 != 1, F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("v"))
    write_table(sketch.sketch_by(df.repartition(13), ["day"], "v"), f"{scratch}/states")
    states = spark.read.parquet(f"{scratch}/states")
    assert states.count() == 28
    weeks = (F.col("day") / 7).cast("int").alias("week")
    merged = {r.week: (r.e, r.c) for r in sketch.merge_sketches(states, [weeks]).select("week", sketch.estimate().alias("e"), F.crc32("sketch").alias("c")).collect()}
    whole = {r.week: (r.e, r.c) for r in sketch.sketch_by(df, [weeks], "v").select("week", sketch.estimate().alias("e"), F.crc32("sketch").alias("c")).collect()}
    assert merged == whole   # the states themselves are equal, not only what they say
    exact = dict(rows(df.groupBy(weeks).agg(F.count_distinct("v"))))
    for week, n in exact.items():
        assert abs(merged[week][0] - n) <= n * 4 * 1.04 / 64 + 1
    total = sketch.merge_sketches(states, []).select(sketch.estimate()).first()[0]
    n = df.agg(F.count_distinct("v")).first()[0]
    assert abs(total - n) <= n * 4 * 1.04 / 64 + 1


def test_small_and_empty_groups_are_exact(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None)], "k string, v long")
    assert rows(sketch.sketch_by(df, ["k"], "v").select("k", sketch.estimate())) == [("a", 2), ("b", 0)]
    assert sketch.sketch_by(df.limit(0), ["k"], "v").count() == 0


def test_hot_group_is_combined_before_the_shuffle(spark):
    plan = sketch.sketch_by(spark.range(10).select("id", F.lit(1).alias("k")), ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan


INSIDE = {"left": lambda a, v, b: a <= v < b, "right": lambda a, v, b: a < v <= b, "both": lambda a, v, b: a <= v <= b,
          "none": lambda a, v, b: a < v < b}


def brute(values, tiers, closed):
    inf = float("inf")
    return sorted((v, n) for v in values if v is not None and v == v for a, b, n in tiers
                  if INSIDE[closed](-inf if a is None else a, v, inf if b is None else b))


def found(spark, values, tiers, **kw):
    facts = spark.createDataFrame([(v,) for v in values], "v double")
    table = spark.createDataFrame(tiers, "lo double, hi double, name string")
    return ranges.range_lookup(facts, "v", table, "lo", "hi", ["name"], **kw)


EDGES = [-1e9, -10.0, -5.0, -0.5, 0.0, 0.1, 0.5, 1.0, 2.0, 9.999999, 10.0, 10.5, 19.99, 20.0, 99.0, 100.0, 100.5, 1e9,
         None, float("nan"), float("inf"), float("-inf"), 10.0]


@pytest.mark.parametrize("closed", sorted(INSIDE))
@pytest.mark.parametrize("levels", [1, 4])
def test_bounds_overlaps_open_and_empty_intervals(spark, closed, levels):
    tiers = [(0.0, 10.0, "low"), (10.0, 20.0, "mid"), (20.0, None, "high"), (None, 0.0, "below"), (5.0, 5.0, "point"), (9.0, 2.0, "turned"),
             (-3.0, 100.0, "wide"), (0.1, 0.5, "tiny"), (None, None, "all")]
    got = sorted((r.v, r.name) for r in found(spark, EDGES, tiers, width=7.0, levels=levels, closed=closed).collect())
    assert got == brute(EDGES, tiers, closed)


@pytest.mark.parametrize("levels", [1, 3, 6])
def test_thousands_of_intervals(spark, levels):
    rng = random.Random(4)
    tiers = [(lo, lo + rng.choice([1.0, 5.0, 40.0, 300.0]), f"t{i}") for i in range(2000) for lo in [rng.randint(-500, 5000) * 0.5]]
    values = [rng.randint(-600, 6000) * 0.25 for _ in range(800)]
    df = found(spark, values, tiers, width=5.0, levels=levels)
    assert sorted((r.v, r.name) for r in df.collect()) == brute(values, tiers, "left")
    for threshold in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            plan = found(spark, values, tiers, width=5.0, levels=levels)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_left_keeps_facts_without_an_interval(spark):
    df = found(spark, [1.0, 50.0, None, 1.0], [(0.0, 10.0, "low")], width=10.0, how="left")
    assert rows(df) == [(None, None), (1.0, "low"), (1.0, "low"), (50.0, None)]
    assert rows(found(spark, [1.0], [], width=10.0, how="left")) == [(1.0, None)]
    assert found(spark, [1.0], [], width=10.0).count() == 0
    for bad in ({"how": "left", "levels": 2}, {"closed": "open"}, {"how": "outer"}):
        with pytest.raises(ValueError):
            found(spark, [1.0], [], width=1.0, **bad)


def test_hot_value(spark):
    facts = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.0).alias("v"))
    tiers = spark.range(900).select((F.col("id") * 10.0).alias("lo"), (F.col("id") * 10.0 + 10.0).alias("hi"), F.col("id").alias("name"))
    got = ranges.range_lookup(facts, "v", tiers, "lo", "hi", ["name"], width=10.0)
    assert got.count() == 9000 and got.filter("name = 0").count() == 3000 + 6 + 0 * 1
