from pyspark.sql import functions as F

from conftest import rows
from tabulant.functions.predicates import contains_text
from tabulant.operators import shape

MENU = [("Hamburger", "Burgers", "290"), ("Hamburger", "Burgers", "290"), ("Cheeseburger", "Burgers", "330"),
        ("Chicken Nuggets (4pc)", "Chicken", "190"), ("Chicken Nuggets (4pc)", "Burgers", "190"),
        ("Veggie Burger", "Burgers", "660"), (None, "Sides", "100")]


def menu(spark):
    return spark.createDataFrame(MENU, "item string, category string, calories string")


def test_profile_dupes(spark):
    assert tuple(shape.profile_dupes(menu(spark), "item").collect()[0]) == (7, 4, 3)


def test_profile_dupes_by_digest(spark):
    df = menu(spark)
    assert tuple(shape.profile_dupes(df, "item", digest=True).collect()[0]) == (7, 4, 3)
    assert tuple(shape.profile_dupes(df.filter(F.lit(False)), "item", digest=True).collect()[0]) == (0, 0, 0)


def test_rows_of_duplicate_keys(spark):
    out = rows(shape.rows_of_duplicate_keys(menu(spark), "item"), "item", "category")
    assert out == [("Chicken Nuggets (4pc)", "Burgers"), ("Chicken Nuggets (4pc)", "Chicken"),
                   ("Hamburger", "Burgers"), ("Hamburger", "Burgers")]


def test_rows_of_duplicate_keys_by_digest(spark):
    plain = rows(shape.rows_of_duplicate_keys(menu(spark), "item"))
    assert plain == rows(shape.rows_of_duplicate_keys(menu(spark), "item", digest=True)) and len(plain) == 4
    pairs = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("a", "bc"), (None, "c"), (None, "c")], "x string, y string")
    for digest in (False, True):  # parts do not run together, and a NULL key equals nothing
        assert rows(shape.rows_of_duplicate_keys(pairs, ["x", "y"], digest=digest)) == [("a", "bc"), ("a", "bc")]


def test_dedupe_clean_whole_row_and_exclusion(spark):
    excl = contains_text("item", "chicken nuggets") & (F.col("category") == "Burgers")
    out = rows(shape.dedupe_clean(menu(spark), exclude=excl), "item", "category")
    assert out == [(None, "Sides"), ("Cheeseburger", "Burgers"), ("Chicken Nuggets (4pc)", "Chicken"),
                   ("Hamburger", "Burgers"), ("Veggie Burger", "Burgers")]
    by_key = shape.dedupe_clean(menu(spark), keys=["item"])
    assert by_key.count() == 5


def test_dedupe_project(spark):
    assert shape.dedupe_project(menu(spark), ["category"]).count() == 3


def test_row_total(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in shape.row_total(df, ["a", "b"]).select("row_total").collect()] == [3.0, None]
