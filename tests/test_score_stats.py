import math

from pyspark.sql import functions as F

from conftest import rows
from tabulant.operators import rank, score, stats
from tabulant.operators.score import ScenarioSpec


def test_safe_ratio_zero_denominator(spark):
    df = spark.createDataFrame([("a", 10.0, 4.0), ("b", 1.0, 0.0), ("c", 1.0, None)], "item string, fat double, p double")
    assert rows(score.safe_ratio(df, "fat", "p", ["item"])) == [("a", 2.5), ("b", None), ("c", None)]


def test_flag_any_null_is_not_flagged(spark):
    df = spark.createDataFrame([("a", 31.0, 10.0), ("b", 30.0, None), ("c", None, None)], "i string, fat double, na double")
    out = rows(score.flag_any(df, [F.col("fat") > 30, F.col("na") > 1000], ["i"]))
    assert out == [("a", "High Risk"), ("b", "Moderate"), ("c", "Moderate")]


def test_clean_zero_filter_junk_is_not_zero(spark):
    df = spark.createDataFrame([("beverage", "0"), ("beverage", " 0Â "), ("beverage", "junk"), ("beverage", ""),
                                ("regular", "0"), ("cafe", "1,0")], "menu string, sugar string")
    out = score.clean_zero_filter(df, "menu", ["beverage", "cafe"], "sugar")
    assert out.count() == 2


def test_multi_threshold_filter(spark):
    df = spark.createDataFrame([("Egg Muffin", 300.0, 17.0), ("Chicken Nuggets", 380.0, 20.0),
                                ("Big Fries", 350.0, 16.0), ("Salad", None, 20.0), ("Wrap", 410.0, 25.0)],
                               "item string, cal double, protein double")
    out = score.multi_threshold_filter(df, [F.col("cal") <= 400, F.col("protein") > 15], "item", ["nugget", "fries"])
    assert [r["item"] for r in out.collect()] == ["Egg Muffin"]


def test_priority_class_first_rule_wins(spark):
    df = spark.createDataFrame([(850.0, 4.0), (850.0, 5.5), (720.0, 5.5), (650.0, 3.0)], "fat double, happy double")
    rules = [((F.col("fat") > 800) & (F.col("happy") < 5.0), "priority"),
             ((F.col("fat") > 700) & (F.col("happy") < 6.0), "consider")]
    out = [r["p"] for r in score.priority_class(df, rules, "monitor", name="p").collect()]
    assert out == ["priority", "consider", "consider", "monitor"]


def _menu(spark):
    # sodium, fat per 100 kcal: exactly on thresholds, above, below, zero calories
    return spark.createDataFrame([(100.0, 180.0, 6.0), (100.0, 400.0, 10.0), (100.0, 100.0, 1.0), (0.0, 50.0, 1.0)],
                                 "cal double, na double, fat double")


def test_scenario_risk_sql_rule(spark):
    spec = ScenarioSpec(measures={"na": 180.0, "fat": 6.0}, factors={"na": 0.9, "fat": 0.9}, base="cal")
    out = [tuple(r) for r in score.scenario_risk(_menu(spark), spec).collect()]
    assert out == [("baseline", 2, 2, 50.0), ("baseline", 0, 2, 50.0),
                   ("mitigated", 2, 1, 25.0), ("mitigated", 0, 3, 75.0)]


def test_scenario_risk_pipeline_rule(spark):
    spec = ScenarioSpec(measures={"na": 180.0, "fat": 6.0}, factors={"na": 0.8, "fat": 0.85}, base="cal",
                        inclusive=False, reduce_only_flagged=False, positive_base_only=True, ratio_first=True)
    out = [tuple(r) for r in score.scenario_risk(_menu(spark), spec).collect()]
    assert out == [("baseline", 2, 1, 25.0), ("baseline", 0, 3, 75.0),
                   ("mitigated", 2, 1, 25.0), ("mitigated", 0, 3, 75.0)]


def test_group_deviation_and_zscore(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("c", "y", 8.0)], "item string, t string, carb double")
    dev = rows(stats.group_deviation(df, "t", "carb", ["item"], scale=2))
    assert dev == [("a", "x", 2.0, 1.0), ("b", "x", 2.0, 1.0), ("c", "y", 8.0, 0.0)]
    mean, sd = 4.0, math.sqrt(((1 - 4) ** 2 + (3 - 4) ** 2 + (8 - 4) ** 2) / 3)
    z = rows(stats.group_zscore(df, "t", "carb", ["item"]))
    assert z == [("a", "x", round((2 - mean) / sd, 3)), ("b", "x", round((2 - mean) / sd, 3)),
                 ("c", "y", round((8 - mean) / sd, 3))]


def test_corr_matrix_symmetric_unit_diagonal(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 3.0), (3.0, 6.2, 4.0), (4.0, 7.9, 1.0)],
                               "a double, b double, c double")
    cells = {(r.x, r.y): r.r for r in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert len(cells) == 9 and cells[("a", "a")] == 1.0
    assert cells[("a", "b")] == cells[("b", "a")]
    pair = stats.corr_pair(df, "a", "b").collect()[0][0]
    assert pair == cells[("a", "b")]


def test_top_k_and_per_group(spark):
    df = spark.createDataFrame([("jan", "s1", 5.0), ("jan", "s2", 5.0), ("jan", "s3", 1.0), ("feb", "s1", 2.0)],
                               "m string, shop string, money double")
    top = [r["shop"] for r in rank.top_k(df, [F.col("money").desc(), F.col("shop")], 2).collect()]
    assert top == ["s1", "s2"]
    per = rows(rank.top_k_per_group(df, ["m"], [F.col("money").desc(), F.col("shop")], 1), "m", "shop", "rank_no")
    assert per == [("feb", "s1", 1), ("jan", "s1", 1)]
