"""Exports with a manifest, pivots on unknown values, and de-duplication by digest."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tabulant.operators import panel, shape
from tabulant.sources import export
from tests.conftest import rows

ODD = ["plain", "", None, " lead and trail ", 'quo"te', "a,b", "line\nbreak", "cr\r\nlf", "tab\t", "\\slash\\", '"', "'", "ünï 漢字 🎉", "null", "#x"]


def odd_table(spark, n=60):
    return spark.createDataFrame([(i, ODD[i % len(ODD)], i / 7, i % 2 == 0) for i in range(n)], "id long, text string, x double, b boolean")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_roundtrip_of_odd_texts(spark, scratch, fmt):
    df = odd_table(spark)
    export.export_files(df, f"{scratch}/out", "id", rows_per_file=7, fmt=fmt)
    assert rows(export.read_verified(spark, f"{scratch}/out", df.schema, "id", fmt)) == rows(df)
    manifest = export.read_manifest(spark, f"{scratch}/out").collect()
    assert sum(r.n_rows for r in manifest) == 60 and max(r.n_rows for r in manifest) <= 7
    assert {r.file for r in manifest} == {os.path.basename(f) for f in glob.glob(f"{scratch}/out/part-*")}


def test_files_are_key_ranges(spark, scratch):
    df = spark.range(1000).select(F.format_string("%05d", "id").alias("key"))
    export.export_files(df.orderBy(F.rand(1)), f"{scratch}/out", "key", rows_per_file=100, fmt="parquet")
    spans = sorted((r.first_key, r.last_key) for r in export.read_manifest(spark, f"{scratch}/out").collect())
    assert len(spans) >= 10 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_hot_key_is_many_bounded_files(spark, scratch):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"), F.lit("same").alias("text"))
    export.export_files(df, f"{scratch}/out", "key", rows_per_file=150)
    manifest = export.read_manifest(spark, f"{scratch}/out").collect()
    assert max(r.n_rows for r in manifest) <= 150 and sum(r.n_rows for r in manifest) == 3000
    assert export.read_verified(spark, f"{scratch}/out", df.schema, "key").filter("key = 7").count() == 1001


def test_damage_is_noticed(spark, scratch):
    df = odd_table(spark, 40).filter("text is not null and text <> 'line\nbreak'")
    for kind in ("checksum", "rows", "missing", "added"):
        path = f"{scratch}/{kind}"
        export.export_files(df, path, "id", rows_per_file=10)
        files = sorted(glob.glob(f"{path}/part-*.csv"))
        text = open(files[0], encoding="utf-8").read()
        crc = os.path.join(path, "." + os.path.basename(files[0]) + ".crc")
        if kind == "missing":
            open(files[0], "w").write("")
        elif kind == "added":
            open(f"{path}/part-99999-extra.csv", "w").write(text)
        elif kind == "rows":
            open(files[0], "w").write(text + text.split("\n")[1] + "\n")
        else:
            open(files[0], "w").write(text.replace("plain", "plaim"))
        if os.path.exists(crc) and kind != "added":
            os.remove(crc)   # else Spark's own check speaks first
        assert {r.fault for r in export.faults(spark, path, df.schema, "id").collect()} == {kind}
        with pytest.raises(ValueError, match=kind):
            export.read_verified(spark, path, df.schema, "id")


def test_empty_table_and_bad_format(spark, scratch):
    df = odd_table(spark).limit(0)
    export.export_files(df, f"{scratch}/out", "id")
    assert export.read_verified(spark, f"{scratch}/out", df.schema, "id").count() == 0
    with pytest.raises(ValueError):
        export.export_files(df, f"{scratch}/x", "id", fmt="xml")


def pivoted(spark, data, **kw):
    df = spark.createDataFrame(data, "k string, p string, v long")
    out = panel.pivot_open(df, "k", "p", F.sum("v"), **kw)
    heavy = [c for c in out.columns if c not in ("k", "part", "rest")]
    return heavy, [r.asDict() for r in out.collect()]


def test_pivot_keeps_every_value(spark):
    rng = random.Random(8)
    data = [(rng.choice(["a", "b", None]), rng.choice(["x"] * 20 + ["y"] * 10 + [None] * 3 + [f"v{i}" for i in range(40)]), rng.randint(-5, 5))
            for _ in range(2000)]
    heavy, got = pivoted(spark, data, max_columns=2, map_rows=10)
    assert heavy == ["x", "y"] and len(got[0]) == 5
    want, have = {}, {}
    for k, p, v in data:
        want[k, p or "(null)"] = want.get((k, p or "(null)"), 0) + v
    for r in got:
        cells = {**{h: r[h] for h in heavy if r[h] is not None}, **r["rest"]}
        assert len(r["rest"]) < 30 and (r["part"] == 0 or all(r[h] is None for h in heavy))
        for p, v in cells.items():
            assert (r["k"], p) not in have
            have[r["k"], p] = v
    assert have == want and len({(r["k"], r["part"]) for r in got}) == len(got) > 3


def test_pivot_few_values_ties_and_empty(spark):
    heavy, got = pivoted(spark, [("a", "q", 1), ("a", "p", 2), ("b", "q", 3)], max_columns=5)
    assert heavy == ["q", "p"] and sorted((r["k"], r["q"], r["p"], r["rest"]) for r in got) == [("a", 1, 2, {}), ("b", 3, None, {})]
    heavy, got = pivoted(spark, [("a", "q", 1), ("a", "p", 2)], max_columns=1)
    assert heavy == ["p"] and got[0]["rest"] == {"q": 1}
    assert pivoted(spark, []) == ([], [])


def test_pivot_several_keys_and_null_keys(spark):
    df = spark.createDataFrame([(1, None, "x", 1), (1, None, "z", 4), (2, "k", "x", 2)], "a int, b string, p string, v long")
    got = rows(panel.pivot_open(df, ["a", "b"], "p", F.sum("v"), max_columns=1).select("a", "b", "x", F.to_json("rest")))
    assert got == [(1, None, 1, '{"z":4}'), (2, "k", 2, "{}")]


def test_distinct_wide_equals_distinct(spark):
    rng = random.Random(9)
    texts = ["t" * 5000, "", None, "1:a", "a", "ab", "b"]
    data = [(rng.choice(texts), rng.choice(texts), rng.choice([0.0, -0.0, 1.5, float("nan"), None]), rng.choice([1, None])) for _ in range(400)]
    df = spark.createDataFrame(data, "a string, b string, x double, `i.d` int")
    got, want = shape.distinct_wide(df), df.distinct()
    key = lambda r: tuple(repr(x) if x != 0 else "0" for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.columns == df.columns
    assert shape.distinct_wide(df.limit(0)).count() == 0


def test_distinct_wide_does_not_rest_on_the_digest(spark, monkeypatch):
    monkeypatch.setattr(shape, "row_digest", lambda df: F.lit(b"all rows collide"))
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 2)], "t string, n int")
    assert rows(shape.distinct_wide(df)) == [(None, 2), ("a", 1), ("b", 1)]


def test_hot_duplicate_and_narrow_shuffles(spark):
    """A third of all rows are one text: only rows that repeat are shuffled with their text, one for each task."""
    text = F.concat(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")), F.repeat(F.lit("x"), 2000))
    df = spark.range(0, 9000, 1, 8).select(text.alias("text"), (F.col("id") % 3 == 0).alias("h"))
    out = shape.distinct_wide(df)
    assert out.count() == 6001 and out.filter("h").count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    shuffles = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "HashAggregate(keys=[text" in lines[shuffles[0] + 1]   # summed up by task before
    assert "LeftAnti" in plan and "LeftSemi" in plan and "SortMergeJoin" not in plan


def test_many_repeated_rows_are_compared_at_once(spark):
    """More repeated digests than may be broadcast: the same rows, no join."""
    df = spark.range(0, 600, 1, 4).select((F.col("id") % 200).cast("string").alias("t"), F.lit(1).alias("n"))
    out = shape.distinct_wide(df, most_repeated=50)
    assert out.count() == 200 and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert shape.distinct_wide(df, most_repeated=200).count() == 200


def test_dedupe_clean_with_digest(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3), ("c", 3)], "t string, n int")
    assert rows(shape.dedupe_clean(df, exclude=F.col("t") == "b", digest=True)) == [("a", 1), ("c", 3)]
    assert rows(shape.dedupe_clean(df, exclude=F.col("t") == "b")) == [("a", 1), ("c", 3)]


def test_a_session_can_still_ship_models_after_an_export(spark, scratch):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    export.export_files(odd_table(spark), f"{scratch}/out", "id", fmt="parquet")
    rows_ = VectorAssembler(inputCols=["x"], outputCol="f").transform(spark.range(40).selectExpr("cast(id as double) x", "cast(id > 20 as double) y"))
    model = RandomForestClassifier(featuresCol="f", labelCol="y", numTrees=2).fit(rows_)
    assert model.transform(rows_).select("probability").count() == 40 and len(model.transform(rows_).select("probability").collect()) == 40
