"""Helpers shared by the training-data operators.

Every operator selects the columns it needs under private names first, so
extra columns of the input, whatever they are called, cannot clash.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# White space of the word rule used by every contract here (fixed values): space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark, name: str) -> str:
    """A fresh path below the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabulant-{name}-{uuid.uuid4().hex}"


_OPEN: list[list[str]] = []   # folders staged under each owner that is open, the innermost last


@contextmanager
def owner(spark) -> Iterator[list[str]]:
    """Whoever opens this owns the folders that are staged meanwhile: the list it gets grows with them.

    ``release`` removes them, once nothing that reads them is needed any more.
    Without an owner staged folders stay until the checkpoint folder is cleared.
    """
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        done = _OPEN.pop()
        if _OPEN:
            _OPEN[-1].extend(done)


def release(spark, folders: list[str]) -> None:
    """Remove staged folders from the shared file system; one that is gone already is passed over."""
    for path in list(folders):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        for held in (folders, *_OPEN):
            if path in held:
                held.remove(path)


def save(spark, make: Callable[[], DataFrame], path: str) -> None:
    """Write what ``make`` returns as Parquet to ``path``, and remove everything that was staged on the way, also if it fails."""
    with owner(spark) as folders:
        try:
            make().write.parquet(path)
        finally:
            release(spark, folders)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint (the files outlive any
    executor), and gives the planner the true size of the rows, so that it can
    choose a broadcast by its own threshold.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches in lots of about ``rows`` rows that never cut a run of equal first columns.

    What is held at once is a lot and a batch, or the longest run if it is longer.
    """
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        held.append(cols)
        size += len(cols[0])
        if size >= rows:
            whole = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))   # the last run may go on in the next batch
            if cut:
                yield [c[:cut] for c in whole]
                whole = [c[cut:].copy() for c in whole]
            held, size = [whole], len(whole[0])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def range_of(value: Column, bounds: list) -> Column:
    """Number of ``bounds`` (ascending) that are at most ``value``: the range the value falls in, 0 for NULL.

    A two-level search over literal arrays: about 2 * sqrt(len(bounds))
    comparisons a row, no join and no shuffle.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    at = F.size(F.filter(lits([b[0] for b in blocks]), lambda x: x <= value))
    inside = F.element_at(F.array(*[lits(b) for b in blocks]), F.greatest(at, F.lit(1)))
    return F.when(at == 0, 0).otherwise((at - 1) * step + F.size(F.filter(inside, lambda x: x <= value)))


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends only on the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


BLOCK_BYTES, MOST_BLOCKS = 1 << 18, 1 << 16   # text of a block aimed at, and blocks at most


def successor_blocks(docs: DataFrame, id_col: str, text_col: str, out: str, blocks: int | None = None) -> DataFrame:
    """Deal rows into blocks of neighbouring ids and add ``out``: the text of the row with the next larger id.

    Blocks are ranges of ids by approximate quantiles, as many as ``BLOCK_BYTES``
    of text each ask for (64 to ``MOST_BLOCKS``; ``blocks`` fixes their number).  An id
    that fills several quantiles, and the rows without an id, are subdivided
    by the hash of the text, so no block gets a hot id whole; only copies of one
    text under one id stay together.  The head of each block is copied to the
    end of the block before it (``__tail`` = 1; the first to the last), so that a
    window within blocks sees every row's successor, and ``lead`` over ``__row``
    within ``__block`` sees what else is derived of it.  The result is partitioned
    by ``__block``: grouping or windows by it shuffle nothing more.  Rows with
    equal ids follow each other in the order of their texts' hashes, NULL ids
    come first, and the last row is followed by the smallest non-NULL id.
    """
    spark, columns = docs.sparkSession, [F.col(f"`{c}`") for c in docs.columns]
    i, text = F.col("__i"), F.col(f"`{text_col}`")
    rows = docs.withColumn("__i", F.col(id_col).cast("long"))
    size = rows.agg(F.sum(F.octet_length(text)).alias("b"), F.count(F.lit(1)).alias("n"), F.count(i).alias("known")).first()
    blocks = blocks or min(MOST_BLOCKS, max(64, -(-(size.b or 0) // BLOCK_BYTES)))
    cuts = rows.agg(F.percentile_approx(i, [k / blocks for k in range(1, blocks)], 10 * blocks)).first()[0] if blocks > 1 else None
    times = Counter(cuts or [])
    hot = {c: n + 1 for c, n in times.items() if n > 1}
    bounds = sorted(set(times) | {c + 1 for c in hot if c + 1 < 1 << 63})
    unknown = -(-(size.n - size.known) * blocks // max(size.n, 1))
    # The hash is needed before the shuffle only where some id is subdivided.
    parts = F.when(i.isNull(), F.lit(max(unknown, 1))).otherwise(F.coalesce(F.col("__m"), F.lit(1)))
    rows = rows.withColumn("__h", F.xxhash64(text) if hot or unknown > 1 else F.lit(0).cast("long"))
    if hot:
        # At most as many rows as there are blocks, a parameter.
        table = spark.createDataFrame(list(hot.items()), "__c long, __m int")
        rows = rows.join(F.broadcast(table), i == F.col("__c"), "left")
    else:
        rows = rows.withColumn("__m", F.lit(None).cast("int"))
    place = F.least(F.floor((F.col("__h").cast("double") / F.lit(2.0 ** 64) + 0.5) * parts), parts - 1).cast("long")
    number = F.when(i.isNull(), F.lit(-1)).otherwise(range_of(i, bounds)).cast("long")
    rows = rows.withColumn("__block", F.shiftleft(number, 20) + F.when(parts > 1, place).otherwise(0))
    # At most as many rows as there are blocks: the window and the broadcast are bounded.
    heads = rows.groupBy("__block").agg(F.min(F.struct("__i", "__h")).alias("__head"), F.min("__i").alias("__id"))
    every, first = Window.orderBy("__block"), Window.orderBy(F.col("__id").isNull(), "__block")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumns({"__before": F.lag("__block").over(every), "__last": F.last("__block").over(whole),
                               "__n": F.row_number().over(first)})
    wraps = F.when(F.col("__id").isNotNull() & (F.col("__n") == 1), F.col("__last"))
    heads = heads.select(F.col("__head.__i").alias("__hi"), F.col("__head.__h").alias("__hh"),
                         F.explode(F.filter(F.array_distinct(F.array("__before", wraps)), lambda b: b.isNotNull())).alias("__to"))
    ends = rows.join(F.broadcast(heads), i.eqNullSafe(F.col("__hi")) & (F.col("__h") == F.col("__hh")))
    ends = ends.groupBy("__to").agg(F.min_by(F.struct(*columns, "__i"), F.struct(F.xxhash64(text), text)).alias("__end"))
    ends = ends.select("__end.*", F.col("__to").alias("__block"), F.lit(1).alias("__tail"))
    dealt = rows.select(*columns, "__i", "__block", F.lit(0).alias("__tail")).unionByName(ends)
    order = Window.partitionBy("__block").orderBy("__tail", "__i", F.xxhash64(text), text)
    return dealt.select(*columns, "__block", "__tail", F.row_number().over(order).alias("__row"), F.lead(text).over(order).alias(out))
