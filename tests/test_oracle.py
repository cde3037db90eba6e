"""Every registered query against its DuckDB oracle SQL (the driver's correctness gate), at sf0.01."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tabulant.plans.catalog import QUERIES
from tabulant.plans.oracle import ORACLE_SQL
from tabulant.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = table_path(SF, t)
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _canon(v):
    if v is None:
        return (0, "")
    if isinstance(v, float) and math.isnan(v):
        return (1, "nan")
    return (1, repr(v))


def _norm(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_canon(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "trans_month" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _norm(df.columns, s_rows) == _norm(d_cols, d_rows)


# What a query must notice: one cleaning rule broken at a time, as (module, function, broken version).
BREAKS = {
    "clean_zero_filter": [("score", "to_number", lambda f, F: lambda c: F.coalesce(f(c), F.lit(0.0))),
                          ("score", "to_number", lambda f, F: lambda c: F.col(c).try_cast("double")),
                          ("score", "to_number", lambda f, F: lambda c: F.translate(c, "Â ", "").try_cast("double"))],
    "multi_threshold_filter": [("catalog", "to_number", lambda f, F: lambda c: F.coalesce(f(c), F.lit(0.0))),
                               ("catalog", "to_number", lambda f, F: lambda c: F.translate(c, "Â ", "").try_cast("double")),
                               ("catalog", "to_number", lambda f, F: lambda c: F.split_part(F.col(c), F.lit(","), F.lit(1)).try_cast("double"))],
    "multi_threshold_regex": [("catalog", "to_number", lambda f, F: lambda c: F.coalesce(f(c), F.lit(0.0)))],
    "time_split_sum": [("catalog", "parse_hour", lambda f, F: lambda c: F.coalesce(f(c), F.lit(0))),
                       ("catalog", "parse_hour", lambda f, F: lambda c: F.pmod(f(c), F.lit(24))),
                       ("catalog", "parse_hour", lambda f, F: lambda c: F.abs(f(c)))],
    "filter_nor": [("catalog", "exclude_both", lambda f, F: lambda a, b, keep_null: f(a, b, keep_null=False))],
}


@pytest.mark.parametrize("name,at", [(n, i) for n, b in BREAKS.items() for i in range(len(b))])
def test_a_broken_cleaning_rule_is_noticed(spark, con, monkeypatch, name, at):
    import importlib

    from pyspark.sql import functions as F
    module, function, broken = BREAKS[name][at]
    home = importlib.import_module("tabulant.operators.score" if module == "score" else "tabulant.plans.catalog")
    monkeypatch.setattr(home, function, broken(getattr(home, function), F))
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLE_SQL[name])
    assert _norm(df.columns, [tuple(r) for r in df.collect()]) != _norm([d[0] for d in res.description], res.fetchall())
