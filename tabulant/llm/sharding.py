"""Sharding by sampled splitters.

A size-weighted sample of record keys is drawn, its quantiles become the
boundaries of key ranges, records go to their range, and ranges that turn out
overfull are subdivided.  The exact bytes of the resulting cells (a table whose
length is a parameter) then fix where each shard begins, so shard sizes are
near equal whatever the sample missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import range_of, stage, uniform


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                  overhead: int = 16, sample_rows: int = 20_000, ranges_per_shard: int = 64,
                  whole_share: float = 0.05, seed: int = 42) -> DataFrame:
    """Put every record into one of ``shards`` shards of near equal bytes.

    The key of a record is the hash of its text, so equal texts are
    neighbours.  Steps: (1) one scan stages (id, size, crc32, key);
    (2) ``sample_rows`` expected draws, each record with a chance in
    proportion to its size, give ``shards * ranges_per_shard`` quantile
    boundaries, and a key that fills several quantiles becomes a range of its
    own; (3) a range with over twice its due bytes is subdivided on the hash
    of the id; (4) records are ordered within their cell and the cells' exact
    byte and row totals place each record.  A group of equal texts of at most
    ``whole_share`` of a shard stays in one shard; larger groups are spread.

    Returns id, ``size`` (UTF-8 bytes plus ``overhead``), ``text_crc32``,
    ``shard`` and ``slot`` (0, 1, ... without gaps within a shard).  NULL and
    empty texts have no bytes; repeated rows are placed one by one; NULL ids are
    allowed; an empty table gives an empty result.  Sizes are never cut: a
    record larger than a shard fills one alone.
    """
    text = F.col(text_col)
    records = stage(docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.shiftright(F.xxhash64(text), 11).alias("key"),  # 53 bits: exact as a double, which percentile() returns
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("id_key")), "shard-records")
    total = records.agg(F.sum("size")).first()[0] or 1
    n_ranges = shards * ranges_per_shard
    due = total / n_ranges

    draws = F.col("size") * F.lit(sample_rows / total)
    drawn = records.withColumn("draws", (F.floor(draws) + F.when(
        uniform(F.lit(seed), F.col("id"), F.col("key")) < draws - F.floor(draws), 1).otherwise(0)).cast("long"))
    cuts = drawn.filter("draws > 0").agg(
        F.percentile("key", [i / n_ranges for i in range(1, n_ranges)], F.col("draws"))).first()[0] or []
    cuts = [int(c) for c in cuts]
    hot = {a for a, b in zip(cuts, cuts[1:]) if a == b}
    bounds = sorted(set(cuts) | {k + 1 for k in hot})

    ranged = records.withColumn("range", range_of(F.col("key"), bounds).cast("int"))
    parts = F.when(F.sum("size") > 2 * due, F.ceil(F.sum("size") / F.lit(due))).otherwise(1).cast("int")
    per_range = ranged.groupBy("range").agg(parts.alias("parts"), (F.min("key") == F.max("key")).alias("one_key"))
    # At most as many rows as there are ranges, a parameter: broadcast is safe.
    ranged = ranged.join(F.broadcast(per_range), "range")
    # A range of one key is subdivided by the id, a range of several by the key, which keeps equal texts together.
    by = F.when(F.col("one_key"), F.col("id_key")).otherwise(F.xxhash64(F.lit(seed), F.col("key")))
    ranged = stage(ranged.select("id", "size", "crc", "key", "id_key", "range", F.floor(
        uniform(by) * F.col("parts")).cast("int").alias("part")), "shard-ranges")

    # Cells: at most 2 * n_ranges rows, so one sorted window over them is bounded.
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = ranged.groupBy("range", "part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    cells = cells.select("range", "part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("cell_bytes"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_rows"))
    cell = Window.partitionBy("range", "part")
    order = cell.orderBy("key", "id_key", "id", "size")
    group = Window.partitionBy("range", "part", "key")
    placed = (ranged.join(F.broadcast(cells), ["range", "part"])
              .withColumn("at", F.col("cell_bytes") + F.sum("size").over(
                  order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
              .withColumn("rank", F.col("cell_rows") + F.row_number().over(order) - 1)
              .withColumn("group_bytes", F.sum("size").over(group))
              .withColumn("group_at", F.min("at").over(group)))
    small = F.col("group_bytes") <= F.lit(whole_share * total / shards)
    middle = (F.when(small, F.col("group_at") * 2 + F.col("group_bytes")).otherwise(F.col("at") * 2 + F.col("size")))
    shard = F.least(F.floor(middle * F.lit(shards) / F.lit(2 * total)), F.lit(shards - 1)).cast("int")
    placed = stage(placed.select("id", "size", "crc", "rank", shard.alias("shard")), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("rank") - F.col("first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` (unique ids) as Parquet, one folder ``shard=<n>`` for each shard, in slot order."""
    at = assigned.select(F.col(id_col), F.col("shard"), F.col("slot").alias("__slot"))
    cols = [c for c in docs.columns if c != "shard"]
    (docs.select(*cols).join(at, id_col).repartition("shard", F.floor(F.col("__slot") / 100_000))
     .sortWithinPartitions("shard", "__slot").drop("__slot").write.partitionBy("shard").parquet(path))
