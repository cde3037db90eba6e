"""Facets from one scan, and tiled correlation."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulant.operators import gram
from tabulant.operators.facets import facets
from tests.conftest import rows

def aggs():
    return {"n": F.count(F.lit(1)), "s": F.sum("v")}



def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facets_equal_separate_groupings(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.randint(0, 9)) for _ in range(500)]
    df = spark.createDataFrame(data, "x string, y int, v int")
    got = rows(facets(df, {"by_x": ["x"], "by_xy": ["y", "x"], "all": []}, aggs()))
    parts = [df.groupBy("x").agg(*[c.alias(n) for n, c in aggs().items()]).select(F.lit("by_x"), "x", F.lit(None).cast("int"), "n", "s"),
             df.groupBy("x", "y").agg(*[c.alias(n) for n, c in aggs().items()]).select(F.lit("by_xy"), "x", "y", "n", "s"),
             df.agg(*[c.alias(n) for n, c in aggs().items()]).select(F.lit("all"), F.lit(None).cast("string"), F.lit(None).cast("int"), "n", "s")]
    expected = rows(parts[0].union(parts[1]).union(parts[2]))
    assert got == expected   # a NULL key is a group of its facet, not the total


def test_facets_one_scan_one_expand_one_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = facets(df, {"flag": ["l_returnflag"], "line": ["l_linenumber"], "status": ["l_linestatus"], "all": []},
                 {"n": F.count(F.lit(1)), "q": F.sum("l_quantity")})
    text = plan(out)
    assert text.count("FileScan parquet") == 1 and text.count("Expand [") == 1 and len(re.findall(r"Exchange ", text)) == 1
    assert "partial_count" in text   # rows are summed up before the shuffle


def test_facets_hot_key_and_empty_input(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("x"), F.lit(1).alias("v"))
    got = facets(df, {"by_x": ["x"], "all": []}, aggs())
    assert got.filter("x = 'hot'").first().n == 3000 and got.filter("facet = 'all'").first().n == 9000
    empty = facets(df.filter("v = 2"), {"by_x": ["x"], "all": []}, aggs())
    assert empty.collect() == []


def test_facets_on_equal_keys_are_refused(spark):
    with pytest.raises(ValueError):
        facets(spark.range(1).selectExpr("id x", "id y"), {"a": ["x", "y"], "b": ["y", "x"]}, {"n": F.count(F.lit(1))})


def matrix(spark, data, tile):
    cols = [f"c{i}" for i in range(data.shape[1])]
    df = spark.createDataFrame([[None if np.isnan(x) else float(x) for x in r] for r in data], ", ".join(f"{c} double" for c in cols)).repartition(5)
    return {(r.x, r.y): r.r for r in gram.corr_tiles(df, cols, tile=tile).collect()}, cols


@pytest.mark.parametrize("tile", [3, 64])
def test_corr_tiles_against_numpy(spark, tile):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(400, 10)) @ rng.normal(size=(10, 10)) + 1e6   # a common offset that would cost digits
    data[rng.random(data.shape) < 0.1] = np.nan
    got, cols = matrix(spark, data, tile)
    assert len(got) == 100
    for i, x in enumerate(cols):
        for j, y in enumerate(cols):
            both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            assert got[x, y] == pytest.approx(np.corrcoef(data[both, i], data[both, j])[0, 1], abs=2e-6)
            assert got[x, y] == got[y, x]


def test_corr_tiles_constant_missing_and_single_rows(spark):
    nan = float("nan")
    got, _ = matrix(spark, np.array([[1, 5, nan, 1], [2, 5, nan, 3], [4, 5, 7, nan]], float), 2)
    assert got["c0", "c0"] == 1.0 and got["c0", "c3"] == 1.0
    assert {got[k] for k in (("c0", "c1"), ("c1", "c1"), ("c2", "c2"), ("c0", "c2"))} == {None}
    df = spark.createDataFrame([], "a double, b double")
    assert gram.corr_tiles(df, ["a", "b"]).collect() == []


def test_merge_is_the_whole(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(5, 2, size=(60, 4))
    whole, parts = gram.PairSums(4), [gram.PairSums(4) for _ in range(3)]
    whole.add(data)
    for n, p in enumerate(parts[:2]):
        p.add(data[n * 30:(n + 1) * 30])
    parts[2].add(np.full((2, 4), np.nan))
    every = slice(0, 4)
    state = gram.merge(gram.merge(parts[2].tile(every, every), parts[0].tile(every, every)), parts[1].tile(every, every))
    assert np.allclose(state, whole.tile(every, every)) and np.allclose(gram.correlate(state), np.corrcoef(data.T))


def test_corr_tiles_reads_once_and_has_no_wide_aggregate(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    text = plan(gram.corr_tiles(df.select(*[(F.col("o_custkey") % (k + 2)).alias(f"c{k}") for k in range(40)]), [f"c{k}" for k in range(40)], tile=8))
    assert text.count("FileScan parquet") == 1 and "HashAggregate" not in text and "MapInArrow" in text
