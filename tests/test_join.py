from pyspark.sql import functions as F

from conftest import rows
from tabulant.operators import join


def test_enrich_case_insensitive_and_outer(spark):
    fact = spark.createDataFrame([("united states", 10.0), ("Peru", 3.0)], "entity string, fat double")
    dim = spark.createDataFrame([("United States", 7.1)], "country string, score double")
    inner = rows(join.enrich(fact, dim, "entity", "country", case_insensitive=True))
    assert inner == [("united states", 10.0, 7.1)]
    left = rows(join.enrich(fact, dim, "entity", "country", how="left", case_insensitive=True))
    assert left == [("Peru", 3.0, None), ("united states", 10.0, 7.1)]
    assert join.enrich(fact, dim, "entity", "country").count() == 0  # case-sensitive misses


def test_enrich_fans_out_on_repeated_dimension_key(spark):
    fact = spark.createDataFrame([(1, 5.0)], "cid int, money double")
    dim = spark.createDataFrame([(1, "s1"), (1, "s2")], "cid int, store string")
    assert join.enrich(fact, dim, "cid").count() == 2


def test_fanout_sum_equals_the_join(spark):
    fact = spark.createDataFrame([(1, 5), (1, 7), (2, 11), (3, 13), (None, 17)], "k int, units long")
    dim = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (9, "c"), (None, "d")], "k int, label string")
    out = rows(join.fanout_sum(fact, dim, "k", ["units"], ["label"]))
    plain = (fact.join(dim, "k").groupBy("label").agg(F.count(F.lit(1)), F.sum("units")))
    assert [(a, n, int(u)) for a, n, u in out] == rows(plain) == [("a", 4, 24), ("b", 3, 23)]


def test_distinct_union(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "v string, k int")
    assert rows(join.distinct_union(a, b)) == [(1, None), (2, "x"), (3, "y")]


def test_bucket_scaffold_keeps_empty_buckets(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.9, 3.0), (2.2, 5.0), (9.0, 100.0)], "ph double, liking double")
    out = rows(join.bucket_scaffold(df, "ph", ["liking"], 0, 4, label="Ph", prefix="avg"))
    assert out == [("0 to 1", 2.0), ("1 to 2", None), ("2 to 3", 5.0), ("3 to 4", None)]


def test_semi_match(spark):
    fact = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    dim = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    assert rows(join.semi_match(fact, dim, "k")) == [(1,), (3,)]
