"""Exports of bounded files in key order, with a manifest that readers check.

The manifest has one row for each file: its number of rows, first and last
key, and a checksum of the rows that does not depend on their order.  It is
made from the files as they were written and compared, in total, with what
went into the write, so a damaged, missing or added file is noticed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "_manifest"   # below the export; names that start with _ are not data to Spark's readers
# NULL is written as \\N, so that it differs from empty text; a text that is just that would not come back, and is noticed.
CSV = {"header": "true", "nullValue": "\\N", "multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _sum_of_hashes(columns: list[str]) -> Column:
    """Aggregate: the sum of 64-bit hashes of the rows; the order of rows does not matter, copies do."""
    return F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(20,0)")), F.lit(0)).cast("string")


def _open(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema).format(fmt)
    return reader.options(**CSV).load(path) if fmt == "csv" else reader.load(path)


def _profile(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each file that has rows."""
    return rows.select("*", F.col("_metadata.file_name").alias("__file")).groupBy(F.col("__file").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.col(key).cast("string")).alias("first_key"),
        F.max(F.col(key).cast("string")).alias("last_key"), _sum_of_hashes(columns).alias("checksum"))


def export_files(df: DataFrame, path: str, key: str, rows_per_file: int = 1_000_000, fmt: str = "csv") -> None:
    """Write ``df`` in ranges of ``key`` as files of at most ``rows_per_file`` rows, and their manifest.

    Rows are dealt into key ranges by a sample; rows of one key are told apart
    by where they were read, so a hot key is many files by many tasks.  Rows
    and their checksum are counted before the write, and again from the files
    once written; ``ValueError`` if they differ.  A path that exists is an error.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported format {fmt!r}")
    spark, columns = df.sparkSession, df.columns
    # A pass of its own: metrics observed during a write leave the session with state that Spark's ML models cannot ship.
    given = df.agg(F.count(F.lit(1)).alias("n"), _sum_of_hashes(columns).alias("s")).first()
    ordered = df.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(key, "__read").sortWithinPartitions(key, "__read")
    writer = ordered.select(*[F.col(f"`{c}`") for c in columns]).write.format(fmt).option("maxRecordsPerFile", rows_per_file)
    (writer.options(**CSV) if fmt == "csv" else writer).save(path)
    files = _profile(_open(spark, path, df.schema, fmt), key, columns)
    files.write.parquet(f"{path}/{MANIFEST}")
    total = read_manifest(spark, path).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"),
                                           F.coalesce(F.sum(F.col("checksum").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    if (total.n, int(total.s)) != (given.n, int(given.s)):
        raise ValueError(f"{path}: files hold {total.n} rows (sum {total.s}), given were {given.n} (sum {given.s})")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_rows, first_key, last_key, checksum) of an export."""
    return spark.read.schema("file string, n_rows long, first_key string, last_key string, checksum string").parquet(f"{path}/{MANIFEST}")


def faults(spark: SparkSession, path: str, schema: T.StructType, key: str, fmt: str = "csv") -> DataFrame:
    """Files that differ from the manifest: (file, fault), fault being missing, added, rows or checksum."""
    found = _profile(_open(spark, path, schema, fmt), key, schema.names)
    want = read_manifest(spark, path).select("file", F.col("n_rows").alias("__n"), F.col("checksum").alias("__c"))
    both = found.join(want, "file", "full_outer")
    fault = (F.when(F.col("n_rows").isNull(), "missing").when(F.col("__n").isNull(), "added")
             .when(F.col("n_rows") != F.col("__n"), "rows").when(F.col("checksum") != F.col("__c"), "checksum"))
    return both.select("file", fault.alias("fault")).filter("fault is not null")


def read_verified(spark: SparkSession, path: str, schema: T.StructType, key: str, fmt: str = "csv") -> DataFrame:
    """The rows of an export, once every file agrees with the manifest; ``ValueError`` names up to 20 that do not."""
    wrong = faults(spark, path, schema, key, fmt).orderBy("file").limit(20).collect()
    if wrong:
        raise ValueError(f"{path} differs from its manifest: " + ", ".join(f"{r.file} ({r.fault})" for r in wrong))
    return _open(spark, path, schema, fmt)
