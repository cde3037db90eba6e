"""Running the library's operators on streams.

The source questions are batch-only; nothing here adds an operator.  Row
operators (cleaning, ratios, flags, screening filters) are stateless and
apply to a streaming DataFrame unchanged.  Grouped means hold state, so on a
stream they are computed per event-time window with a watermark, which lets
Spark drop a window's state once the watermark passes it.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numeric import mean
from ..session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1, single_file: bool = False) -> DataFrame:
    """Stream parquet with the schema of the data already there.

    ``path`` is a folder (new files arriving there are picked up).  A file
    source streams folders, so with ``single_file`` a path to one file is read
    as its folder filtered to that name.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if not single_file:
        return reader.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder or "/")


def windowed_mean(stream: DataFrame, ts: str, window: str, watermark: str, keys: list[str],
                  measures: list[str], scale: int = 4, fixed: int | None = None) -> DataFrame:
    """Mean of measures per (event-time window, keys), with a watermark bounding the state.

    Event time must be a zoned ``TIMESTAMP`` for a watermark; a
    ``TIMESTAMP_NTZ`` column is read as UTC wall-clock time.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.round(mean(m, fixed), scale).alias(f"avg_{m}") for m in measures]
    timed = stream.withColumn("__event_time", F.col(ts).cast("timestamp"))
    out = (timed.withWatermark("__event_time", watermark)
           .groupBy(F.window("__event_time", window).alias("w"), *keys).agg(*aggs))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                      "n", *[f"avg_{m}" for m in measures])


def run_available(df: DataFrame, sink: str | None = None, mode: str = "append", fmt: str = "parquet",
                  query_name: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Process everything available now, then stop (``availableNow`` trigger).

    Pass ``checkpoint`` (a folder on shared storage) to make the stream
    resumable: a restarted job continues from the offsets recorded there.
    Without it, each run gets a fresh folder under the session's shared
    checkpoint folder, so an old run's offsets are never picked up by
    mistake.  ``fmt='memory'`` with ``query_name`` keeps the result in an
    in-process table (tests).
    """
    base = ensure_checkpoint_dir(df.sparkSession)
    cp = checkpoint or os.path.join(base, "streams", f"{query_name or 'stream'}-{uuid.uuid4().hex}")
    writer = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", cp).trigger(availableNow=True)
    if query_name:
        writer = writer.queryName(query_name)
    q = writer.start(sink) if sink else writer.start()
    q.awaitTermination()
    return q
