from pyspark.sql import functions as F

from tabulant.functions.numeric import (floor_half_up, format_fixed, mean_of_parts, percent_of, round_half_even,
                                        round_half_up, safe_divide)
from tabulant.functions.predicates import contains_text, exclude_both, matches, ordinal_position


def test_two_rounding_modes(spark):
    df = spark.createDataFrame([(2.5, 0.125), (3.5, 0.375), (-2.5, 1.005)], "a double, b double")
    up = df.select(round_half_up("a"), round_half_up("b", 2)).collect()
    even = df.select(round_half_even("a"), round_half_even("b", 2)).collect()
    assert [tuple(r) for r in up] == [(3.0, 0.13), (4.0, 0.38), (-3.0, 1.01)]
    assert [tuple(r) for r in even] == [(2.0, 0.12), (4.0, 0.38), (-2.0, 1.0)]


def test_floor_half_up_and_safe_divide(spark):
    df = spark.createDataFrame([(2.5, 0.0), (-2.5, 2.0), (0.49, None)], "x double, d double")
    got = df.select(floor_half_up("x"), safe_divide("x", "d"), percent_of(F.lit(1), F.lit(3))).collect()
    assert [r[0] for r in got] == [3, -2, 0]
    assert [r[1] for r in got] == [None, -1.25, None]
    assert got[0][2] == 33.33


def test_mean_of_parts_null_modes(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, 5.0), (None, None, None, None)], "a double, b double, c double, d double")
    strict = [r[0] for r in df.select(mean_of_parts(["a", "b", "c", "d"])).collect()]
    skip = [r[0] for r in df.select(mean_of_parts(["a", "b", "c", "d"], skip_null=True)).collect()]
    assert strict == [None, None]
    assert skip[0] == 8.0 / 3 and skip[1] is None


def test_format_fixed_rounds_half_up_first(spark):
    df = spark.createDataFrame([(1234.5678,), (2.665,), (0.125,)], "x double")
    got = [r[0] for r in df.select(format_fixed("x", 2)).collect()]
    assert got == ["1,234.57", "2.67", "0.13"]


def test_predicates(spark):
    df = spark.createDataFrame([("Chicken Nuggets 4pc", "Burgers"), ("chicken nuggets", "Chicken"), (None, "Burgers"),
                                ("Fries_50%", "Sides")], "item string, cat string")
    ci = [r[0] for r in df.select(contains_text("item", "chicken nuggets")).collect()]
    cs = [r[0] for r in df.select(contains_text("item", "chicken nuggets", case_sensitive=True)).collect()]
    assert ci == [True, True, None, False] and cs == [False, True, None, False]
    assert [r[0] for r in df.select(contains_text("item", "_50%")).collect()][3] is True
    assert [r[0] for r in df.select(matches("item", "^Chicken")).collect()][:2] == [True, False]
    both = contains_text("item", "nuggets") & (df.cat == "Burgers")
    nor = df.filter(exclude_both(contains_text("item", "nuggets"), df.cat == "Burgers", keep_null=True)).count()
    sql_not = df.filter(exclude_both(contains_text("item", "nuggets"), df.cat == "Burgers", keep_null=False)).count()
    assert nor == 3 and sql_not == 2  # the row with an unknown item is kept only by the $nor form
    assert both is not None


def test_ordinal_position_is_field(spark):
    df = spark.createDataFrame([("afternoon",), ("morning",), ("night",)], "t string")
    got = [r[0] for r in df.select(ordinal_position("t", ["morning", "afternoon", "evening"])).collect()]
    assert got == [2, 1, 0]


def test_fixed_point_units_sum_and_mean(spark):
    from tabulant.functions.numeric import fixed_mean, fixed_sum, to_units
    df = spark.createDataFrame([(1.005,), (-2.675,), (0.1,), (None,), (-0.0,)], "x double")
    units = [r[0] for r in df.select(to_units("x")).collect()]
    assert units == [100, -268, 10, None, 0]   # half away from zero on the stored double
    row = df.agg(fixed_sum("x").alias("s"), fixed_mean("x").alias("m")).collect()[0]
    assert str(row["s"]) == "-1.58" and str(row["m"]) == "-0.395000"
    assert df.filter("x is null").agg(fixed_mean("x")).collect()[0][0] is None


def test_unit_sums_beyond_a_long(spark):
    """Totals past 2**63 units are exact, for few huge values and with negatives."""
    from decimal import Decimal

    from tabulant.functions.numeric import units_mean, units_to_fixed, units_total
    big = [2 ** 62 + 1, 2 ** 62 + 3, 2 ** 61, -7, None]
    df = spark.createDataFrame([(x,) for x in big], "u long")
    total = sum(x for x in big if x is not None)
    r = df.agg(units_total("u").alias("t"), F.count("u").alias("n")).select("t", units_to_fixed("t").alias("m"),
                                                                           units_mean("t", "n").alias("a")).first()
    assert int(r.t) == total and r.m == Decimal(total) / 100 and abs(r.a - Decimal(total) / 400) < Decimal("0.000001")
    assert df.limit(0).agg(units_total("u")).first()[0] is None
