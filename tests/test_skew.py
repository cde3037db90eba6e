"""Hot keys: one customer holds a third of all orders.

The operators must give exact results on such input, and their plans must
combine before the shuffle (partial aggregates, partial WindowGroupLimit), so
the hot key never arrives whole in one task.
"""


import duckdb
import pytest
from pyspark.sql import functions as F

from tabulant.operators import agg, panel, rank, shape
from tabulant.plans.oracle import _avg
from tabulant.sources.tables import load

SF = "/root/testdata/sf0.01"
HOT = 7


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    orders = load(spark, SF, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    hot = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(HOT)).otherwise(F.col("o_custkey")))
    path = str(tmp_path_factory.mktemp("skew") / "orders.parquet")
    hot.write.parquet(path)
    df = spark.read.parquet(path)
    share = df.filter(F.col("o_custkey") == HOT).count() / df.count()
    assert share > 0.33
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return df, con


def _same(df, con, sql):
    got = sorted(tuple(r) for r in df.collect())
    want = sorted(tuple(r) for r in con.execute(sql).fetchall())
    assert got == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_last_delta_hot_key(skewed):
    df, con = skewed
    out = panel.first_last_delta(df, "o_custkey", "o_orderdate", "o_totalprice", tiebreak="o_orderkey")
    _same(out, con, """
        SELECT o_custkey,
               round(arg_min(o_totalprice, (o_orderdate, o_orderkey)), 2),
               round(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 2),
               round(arg_max(o_totalprice, (o_orderdate, o_orderkey)) - arg_min(o_totalprice, (o_orderdate, o_orderkey)), 2)
        FROM orders GROUP BY o_custkey""")
    assert "partial_min_by" in _plan(out)


def test_mean_by_hot_key(skewed):
    df, con = skewed
    out = agg.mean_by(df, ["o_custkey"], ["o_totalprice"], scale=2, fixed=2).select(
        "o_custkey", F.col("avg_o_totalprice").cast("double"))
    # DuckDB's avg(DECIMAL) goes through a double; the exact fixed-point form is the oracle's.
    _same(out, con, f"SELECT o_custkey, {_avg('o_totalprice', 2)} FROM orders GROUP BY o_custkey")
    assert "partial_sum" in _plan(out)


def test_top_k_per_group_hot_key(skewed):
    df, con = skewed
    out = rank.top_k_per_group(df, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    _same(out.select("o_custkey", "o_orderkey", "rank_no"), con, """
        SELECT o_custkey, o_orderkey, rn FROM (
          SELECT o_custkey, o_orderkey,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
          FROM orders) WHERE rn <= 3""")
    assert _plan(out).count("WindowGroupLimit") >= 2


def test_last_n_rows_hot_key(skewed):
    df, con = skewed
    yearly = df.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    out = panel.last_n_periods_avg(yearly, "o_custkey", "y", ["n"], n=2, by="rows")
    _same(out, con, """
        WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC) AS rn FROM y)
        SELECT o_custkey, count(*), round(avg(n), 2) FROM r WHERE rn <= 2 GROUP BY o_custkey""")


def test_duplicate_keys_hot_key(skewed):
    df, con = skewed
    out = shape.rows_of_duplicate_keys(df.select("o_orderkey", "o_custkey"), "o_custkey")
    assert out.count() == con.execute("""
        SELECT count(*) FROM orders
        WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)""").fetchone()[0]


def test_hot_text_is_split(spark, tmp_path):
    """A third of all rows share one text: the duplicate join splits that key over tasks and stays exact."""
    import random
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(300))
    hot = text()
    data = [(i, hot if i % 3 == 0 else text(), text()) for i in range(9000)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(data, "doc_id long, text string, other string").repartition(12).write.parquet(path)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = shape.rows_of_duplicate_keys(spark.read.parquet(path), "text", digest=True)
        got = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(r.doc_id for r in got) == list(range(0, 9000, 3))
    assert "skew=true" in plan
