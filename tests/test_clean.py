import datetime

from pyspark.sql import functions as F

from tabulant.functions.clean import (blank_to_null, coalesce_existing, id_from_prefixed, onehot_label, parse_dmy,
                                      parse_hour, split_pair, strip_prefix, to_number)


def test_to_number_handles_blank_junk_marks(spark):
    df = spark.createDataFrame([("",), (None,), ("n/a",), ("1,234",), (" 12Â ",), ("3.5",), ("-0",), ("12 000",)],
                               "v string")
    got = [r[0] for r in df.select(to_number("v")).collect()]
    assert got[:6] == [None, None, None, 1234.0, 12.0, 3.5]
    assert got[6] == 0.0 and got[7] == 12000.0


def test_to_number_decimal_and_int(spark):
    df = spark.createDataFrame([("1,234.565",), ("x",)], "v string")
    got = df.select(to_number("v", "decimal(10,2)").alias("d"), to_number("v", "int").alias("i")).collect()
    assert str(got[0]["d"]) == "1234.57" and got[0]["i"] is None
    assert got[1]["d"] is None


def test_blank_to_null(spark):
    df = spark.createDataFrame([("  ",), ("a ",), (None,)], "v string")
    assert [r[0] for r in df.select(blank_to_null("v")).collect()] == [None, "a", None]


def test_parse_hour_allows_24_and_above(spark):
    df = spark.createDataFrame([("24:10",), ("7:05",), ("25:00",), ("x",), ("09:59",)], "t string")
    assert [r[0] for r in df.select(parse_hour("t")).collect()] == [24, 7, 25, None, 9]


def test_parse_dmy_one_and_two_digit_fields(spark):
    df = spark.createDataFrame([("1/2/2024",), ("15/12/2023",), ("31/02/2023",), ("junk",)], "d string")
    got = [r[0] for r in df.select(parse_dmy("d")).collect()]
    assert got == [datetime.date(2024, 2, 1), datetime.date(2023, 12, 15), None, None]


def test_split_pair_and_prefix(spark):
    df = spark.createDataFrame([("40/50", "CUST_17"), ("7", "CUST_x")], "a string, c string")
    a, b = split_pair("a")
    got = df.select(a, b, strip_prefix("c", 5), id_from_prefixed("c", 5)).collect()
    assert tuple(got[0]) == ("40", "50", "17", 17)
    assert tuple(got[1]) == ("7", "7", "x", None)


def test_onehot_label_first_true_wins(spark):
    df = spark.createDataFrame([("True", "True"), ("False", "True"), ("False", "no"), (None, None)],
                               "m string, a string")
    lab = onehot_label([("m", "morning"), ("a", "afternoon")], "evening")
    assert [r[0] for r in df.select(lab).collect()] == ["morning", "afternoon", "evening", "evening"]


def test_coalesce_existing_handles_key_case_drift(spark):
    df = spark.createDataFrame([(None, "A"), ("b", None)], "entity string, Entity2 string")
    got = [r[0] for r in df.select(coalesce_existing(df, ["Entity", "entity", "Entity2"])).collect()]
    assert got == ["A", "b"]


def test_strict_number_raises_on_junk_under_ansi(spark):
    import pytest
    from pyspark.errors import PySparkException
    from tabulant.functions.clean import strict_number
    df = spark.createDataFrame([("12",), ("x",)], "v string")
    with pytest.raises(PySparkException):
        df.select(strict_number("v")).collect()
