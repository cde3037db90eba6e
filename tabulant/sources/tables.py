"""Schema'd readers for the driver tables and for text-typed source files.

Parquet reads name their columns so Catalyst prunes the scan to what a query
uses; text files (CSV dumps where every column is a string) are read with an
explicit all-string schema and typed afterwards by ``functions.clean``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# The declared schemas of the driver tables (names and types as
# stored).  Reading with a declared schema skips the footer-inference job and
# lets a narrowed schema drive column pruning directly.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def declared_schema(name: str, columns: list[str] | None = None) -> T.StructType | None:
    """The declared schema of a driver table, optionally narrowed to ``columns`` (in that order)."""
    ddl = SCHEMAS.get(name)
    if ddl is None:
        return None
    full = T.StructType.fromDDL(ddl)
    if not columns:
        return full
    by_name = {f.name: f for f in full.fields}
    return T.StructType([by_name[c] for c in columns])


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one driver table with its declared schema; ``columns`` narrows the parquet ReadSchema."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    schema = declared_schema(name, columns)
    if schema is None:
        df = spark.read.parquet(table_path(sf_dir, name))
        return df.select(*columns) if columns else df
    return spark.read.schema(schema).parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Expose the driver tables to ``spark.sql`` under their own names; a missing table is Spark's error."""
    for name in names:
        spark.read.parquet(table_path(sf_dir, name)).createOrReplaceTempView(name)


def text_schema(columns: list[str]) -> T.StructType:
    """All-string schema, the way the source dumps store every column."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def read_text_table(spark: SparkSession, path: str, columns: list[str], fmt: str = "csv",
                    header: bool = True) -> DataFrame:
    """Read a dump whose columns are all text, without schema inference.

    Column names are given up front (an unnamed source column simply gets the
    name the caller chooses); hyphenated names stay usable through back-ticks.
    """
    reader = spark.read.schema(text_schema(columns))
    if fmt == "csv":
        return reader.option("header", header).option("mode", "PERMISSIVE").csv(path)
    if fmt == "json":
        return reader.json(path)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a result; CSV carries a header so outside tools can plot it."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, mode: str = "overwrite",
                   sort: bool = True) -> None:
    """Save ``df`` as a catalog table bucketed (and sorted) by ``keys``.

    Two tables bucketed by the same join key into the same number of
    buckets join without shuffling either side; at 100 TB this is how the
    repeatedly joined facts (line items and orders on the order key) are
    meant to be stored.  The table lives under ``spark.sql.warehouse.dir``.
    """
    writer = df.write.mode(mode).format("parquet").bucketBy(buckets, *keys)
    if sort:
        writer = writer.sortBy(*keys)
    writer.saveAsTable(table)
