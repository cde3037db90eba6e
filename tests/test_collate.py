"""Caseless keys: results against lower(), and the plans that decide which form is used."""

import random

from pyspark.sql import functions as F

from tabulant.functions import collate
from tests.conftest import rows

WORDS = ["Straße", "STRASSE", "straße", "Éclair", "éclair", "ECLAIR", "a", "A", "b", "", " ", None, "Ωmega", "ωMEGA", "Ж", "ж", "x1", "X1"]


def table(spark, n=300):
    rng = random.Random(6)
    return spark.createDataFrame([(i, rng.choice(WORDS), float(i)) for i in range(n)], "i long, k string, v double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_collation_and_lower_agree_on_these_words(spark):
    pairs = spark.createDataFrame([(a, b) for a in WORDS for b in WORDS if a is not None and b is not None], "a string, b string")
    wrong = pairs.filter((collate.collated("a") == collate.collated("b")) != (F.lower("a") == F.lower("b")))
    assert wrong.count() == 0


def test_group_caseless(spark):
    df = table(spark)
    got = rows(collate.group_caseless(df, "k", {"n": F.count(F.lit(1)), "s": F.sum("v")}))
    assert got == rows(df.groupBy(F.lower("k").alias("f")).agg(F.min("k"), F.count(F.lit(1)), F.sum("v")).drop("f"))
    assert got[0][0] is None and sum(n for _, n, _ in got) == 300


def test_distinct_caseless_keeps_a_spelling_that_occurs(spark):
    df = spark.createDataFrame([("B", "a"), ("b", "A"), ("b", "A"), (None, "x"), (None, "X"), ("c", None)], "p string, q string")
    assert rows(collate.distinct_caseless(df, ["p", "q"])) == [(None, "X"), ("B", "a"), ("c", None)]


def test_sort_caseless(spark):
    got = [tuple(r) for r in collate.sort_caseless(table(spark).select("k", "i"), "k", "i").collect()]
    assert got == sorted(got, key=lambda t: (t[0] is not None, (t[0] or "").lower(), t[1]))


def test_join_caseless(spark):
    left = table(spark)
    right = spark.createDataFrame([("ÉCLAIR", 1), ("A", 2), ("zz", 3), (None, 4)], "name string, m int")
    got = rows(collate.join_caseless(left, right, "k", "name"), "i", "k", "name", "m")
    want = left.join(right, F.lower(left["k"]) == F.lower(right["name"])).select("i", "k", "name", "m")
    assert got == rows(want) and got
    assert collate.join_caseless(left, right, "k", "name", "left").count() == left.count()


def test_the_cheaper_plan_is_chosen(spark):
    """A collated grouping is sort-based on both sides of its shuffle, one by lower() is a hash aggregate; joins are equal."""
    df = spark.range(1000).select(F.concat(F.lit("K"), F.col("id") % 7).alias("k"), "id")
    by_collation = plan(df.groupBy(collate.collated("k")).agg(F.sum("id")))
    by_lower = plan(df.groupBy(F.lower("k")).agg(F.sum("id")))
    assert by_collation.count("SortAggregate") == 2 and by_collation.count("Sort [") == 2
    assert by_lower.count("HashAggregate") == 2 and "Sort [" not in by_lower
    other = df.select(F.col("k").alias("name"), F.col("id").alias("j"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = plan(collate.join_caseless(df, other, "k", "name"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [collat" in joined and "NestedLoop" not in joined and "Cartesian" not in joined
