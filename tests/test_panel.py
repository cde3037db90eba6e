from pyspark.sql import functions as F

from conftest import rows
from tabulant.functions.clean import to_number
from tabulant.operators import panel

# Entity x year panel: gap years for B, a single year for C, text years '9' and '10'.
PANEL = [("A", "9", "10"), ("A", "10", "30"), ("A", "11", "25"),
         ("B", "1", "5"), ("B", "2", "7"), ("B", "6", "9"), ("B", "7", "11"),
         ("C", "5", "1,000")]


def typed(spark):
    df = spark.createDataFrame(PANEL, "entity string, year string, carbs string")
    return df.select("entity", to_number("year", "int").alias("year"), to_number("carbs").alias("carbs"))


def test_first_last_delta_uses_numeric_period(spark):
    out = rows(panel.first_last_delta(typed(spark), "entity", "year", "carbs"))
    # text order would make '10' the first year of A; numeric order makes it 9
    assert out == [("A", 10.0, 25.0, 15.0), ("B", 5.0, 11.0, 6.0), ("C", 1000.0, 1000.0, 0.0)]


def test_first_last_delta_ties_resolve_by_tiebreak(spark):
    df = spark.createDataFrame([("x", 1, 1, 10.0), ("x", 1, 2, 20.0), ("x", 3, 5, 7.0), ("x", 3, 4, 9.0)],
                               "e string, p int, k int, v double")
    out = rows(panel.first_last_delta(df, "e", "p", "v", tiebreak="k"))
    assert out == [("x", 10.0, 7.0, -3.0)]


def test_last_n_rows_vs_period_differ_on_gaps(spark):
    df = typed(spark)
    by_rows = rows(panel.last_n_periods_avg(df, "entity", "year", ["carbs"], n=3, by="rows"))
    by_period = rows(panel.last_n_periods_avg(df, "entity", "year", ["carbs"], n=3, by="period"))
    assert rows(panel.last_n_periods_avg(df, "entity", "year", ["carbs"], n=3, by="period",
                                         bounded_groups=True)) == by_period
    assert ("B", 3, 9.0) in by_rows          # years 2, 6, 7
    assert ("B", 2, 10.0) in by_period       # years 5..7 -> 6, 7
    assert ("A", 3, 21.67) in by_rows and ("A", 3, 21.67) in by_period
    assert ("C", 1, 1000.0) in by_rows and ("C", 1, 1000.0) in by_period


def test_peak_period_ties_take_smallest_period(spark):
    df = spark.createDataFrame([("US", 1, 5.0, 1.0), ("US", 2, 9.0, 3.0), ("US", 3, 9.0, 2.0),
                                ("BR", 7, None, 4.0), ("BR", 8, 1.0, None)],
                               "entity string, month int, fat double, carbs double")
    out = rows(panel.peak_period(df, "entity", "month", ["fat", "carbs"]))
    assert out == [("BR", 8, 7), ("US", 2, 2)]
    out_late = rows(panel.peak_period(df, "entity", "month", ["fat"], ties="largest"))
    assert ("US", 3) in out_late


def test_pivot_measure_lists_values(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("a", 2, 1.0), ("b", 2, 5.0)],
                               "k string, m int, v double")
    out = rows(panel.pivot_measure(df, "k", "m", [1, 2, 3], "v", prefix="m"))
    assert out == [("a", 3.0, 1.0, None), ("b", None, 5.0, None)]


def test_seasonal_mean_by_hemisphere(spark):
    df = spark.createDataFrame([("Brazil", 7, 10.0), ("Brazil", 1, 99.0), ("Japan", 1, 4.0), ("Japan", 12, 6.0),
                                ("Japan", 7, 99.0)], "entity string, month int, fat double")
    out = rows(panel.seasonal_mean(df, "entity", "month", ["fat"], southern=F.col("entity") == "Brazil"))
    assert out == [("Brazil", 10.0), ("Japan", 5.0)]


def test_time_split_sum_drops_invalid_hours(spark):
    df = spark.createDataFrame([(9, 1.5), (12, 2.0), (23, 1.0), (24, 100.0), (25, 100.0), (None, 7.0)],
                               "h int, money double")
    out = rows(panel.time_split_sum(df, "h", "money"))
    assert out == [("After 12", 3.0), ("Before 12", 1.5)]


def test_variation_index_single_row_entity(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 6.0), ("b", 5.0, 5.0)], "e string, x double, y double")
    strict = dict((r[0], r[3]) for r in panel.variation_index(df, "e", ["x", "y"]).collect())
    skip = dict((r[0], r[3]) for r in panel.variation_index(df, "e", ["x", "y"], skip_null=True).collect())
    assert strict["b"] is None and skip["b"] is None
    assert round(strict["a"], 4) == round((2 ** 0.5 + 8 ** 0.5) / 2, 4)


def test_period_mean_enrich_requires_present_score(spark):
    attrs = spark.createDataFrame([("A", "7.1"), ("B", ""), ("C", None), ("D", "5.0")], "country string, score string")
    facts = spark.createDataFrame([("A", 2009, 1.0), ("A", 2010, 2.0), ("A", 2020, 4.0), ("B", 2015, 3.0),
                                   ("D", 2021, 9.0)], "entity string, year int, fat double")
    out = rows(panel.period_mean_enrich(attrs, facts, "country", "entity", "year", 2010, 2020, ["fat"], ["score"],
                                        require=["score"]))
    assert out == [("A", "7.1", 3.0)]


def test_period_range_lexical_vs_numeric(spark):
    attrs = spark.createDataFrame([("A", "x")], "country string, score string")
    facts = spark.createDataFrame([("A", "2015", 1.0), ("A", "20100", 9.0), ("A", "999", 5.0)],
                                  "entity string, year string, fat double")
    lex = rows(panel.period_mean_enrich(attrs, facts, "country", "entity", "year", 2010, 2020, ["fat"], ["score"],
                                        lexical=True))
    num = rows(panel.period_mean_enrich(attrs, facts.withColumn("year", F.col("year").cast("int")), "country",
                                        "entity", "year", 2010, 2020, ["fat"], ["score"]))
    assert lex == [("A", "x", 5.0)]   # '20100' sorts between '2010' and '2020' as text
    assert num == [("A", "x", 1.0)]
