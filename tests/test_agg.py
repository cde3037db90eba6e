from pyspark.sql import functions as F

from conftest import rows
from tabulant.operators import agg
from tabulant.operators.score import classify


def test_mean_by_with_total_skips_rows_with_null_parts(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, None), (2, 5.0, 5.0)], "m int, a double, b double")
    out = rows(agg.mean_by(df, ["m"], ["a", "b"], total_name="avg_total"))
    assert out == [(1, 3.0, 2.0, 2.0), (2, 10.0, 5.0, 5.0)]
    glob = agg.mean_by(df, [], ["a"]).collect()[0]
    assert glob[0] == 3.0


def test_count_levels_two_granularities(spark):
    df = spark.createDataFrame([("F", "Y", "Y"), ("F", "Y", "N"), ("F", "Y", "N"), ("M", "N", "N")],
                               "g string, loyal string, rep string")
    out = rows(agg.count_levels(df, ["g", "loyal"], ["rep"]))
    assert out == [("F", "Y", 3, "N", 2), ("F", "Y", 3, "Y", 1), ("M", "N", 1, "N", 1)]


def test_sum_by_each_rounded_vs_exact(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", 2.5), ("a", 0.4)], "k string, amt double")
    assert rows(agg.sum_by(df, ["k"], "amt", rounding="each_half_up")) == [("a", 5)]
    assert rows(agg.sum_by(df, ["k"], "amt", scale=2)) == [("a", 4.4)]


def test_cohort_compare_case_insensitive(spark):
    df = spark.createDataFrame([("United States", 11.0), ("canada", 13.0), ("Italy", 60.0), ("Peru", 1.0)],
                               "country string, rank double")
    out = rows(agg.cohort_compare(df, "country", {"high": ["united states", "Canada"], "low": ["ITALY"]}, ["rank"]))
    assert out == [("high", 12.0), ("low", 60.0)]


def test_tier_summary_threshold_boundaries(spark):
    df = spark.createDataFrame([("a", 599.99, 5.0), ("b", 600.0, 6.0), ("c", 800.0, 7.0), ("d", 800.01, 8.0)],
                               "c string, fat double, score double")
    tier = classify([(F.col("fat") < 600, "low fat"), (F.col("fat").between(600, 800), "medium fat")], "high fat")
    out = rows(agg.tier_summary(df, tier, {"avg_score": "score"}, minmax="fat"))
    assert out == [("high fat", 1, 8.0, 800.01, 800.01), ("low fat", 1, 5.0, 599.99, 599.99),
                   ("medium fat", 2, 6.5, 600.0, 800.0)]


def test_tier_summary_distinct_count_on_fanout(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 5.0)], "c string, v double")
    out = agg.tier_summary(df, F.lit("t"), {"avg_v": "v"}, distinct_key="c").collect()[0]
    assert tuple(out) == ("t", 2, 3.0)


def test_share_of_total(spark):
    df = spark.createDataFrame([("b", 0), ("b", 1), ("b", 1), ("m", 2)], "s string, r int")
    out = rows(agg.share_of_total(df, ["s"], ["r"]))
    assert out == [("b", 0, 1, 33.33), ("b", 1, 2, 66.67), ("m", 2, 1, 100.0)]


def test_mean_of_means_rounds_group_means_first(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 4.0)], "g string, v double")
    b = spark.createDataFrame([("z", 10.0)], "h string, w double")
    out = agg.mean_of_means([(a, ["g"], {"m": "v"}), (b, ["h"], {"m": "w"})]).collect()[0]
    assert out["m"] == round((1.5 + 4.0 + 10.0) / 3, 2)


def test_profile_measure_conditional_count(spark):
    a = spark.createDataFrame([(10.0,), (60.0,), (None,), (0.0,)], "sugar double")
    b = spark.createDataFrame([(51.0,)], "sugars double")
    out = {r["source"]: r for r in agg.profile_measure([("mc", a, "sugar"), ("bk", b, "sugars")], high=50).collect()}
    assert out["mc"]["total_items"] == 2 and out["mc"]["high_items"] == 1
    assert out["mc"]["stddev_value"] == 25.0  # population std-dev
    assert out["bk"]["stddev_value"] == 0.0


def test_count_by_and_distinct(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert rows(agg.count_by(df, ["c"])) == [(None, 1), ("a", 2), ("b", 1)]
    assert agg.count_distinct_of(df, "c", "n").collect()[0][0] == 2
