"""Structured Streaming ingest (STR1-STR4).

* STR1 -- landed NDJSON items -> posts Parquet through ``foreachBatch``, run to
  completion with ``trigger(availableNow=True)``; the checkpoint keeps which
  files are done.
* STR2 -- replayed ids are removed against the sink itself: a micro-batch keeps
  one row per id and drops ids that the sink already holds.  No watermark and
  no streaming state: nothing is ever too late, and a replay is caught however
  long after the original it comes.  The sink is read by id only, and only
  where its files' id ranges meet the batch's.  A micro-batch that is run again
  after a failure finds what it had written and adds the rest.
* STR3 -- bounded micro-batches (``maxFilesPerTrigger``).
* STR4 -- the same column operators on a stream: blocklist flags per
  micro-batch, and weekday x hour counts as streaming state (at most 336 rows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.timefn import epoch_to_utc
from linkloom.operators.blocklist import flag_posts
from linkloom.operators.profiles import with_time_features
from linkloom.schemas import ITEM_SCHEMA, POST_COLUMNS
from linkloom.sources.tables import post_from_item


def item_stream(spark: SparkSession, landing: str, max_files_per_trigger: int = 1) -> DataFrame:
    """STR1/STR3 source: items as they land (files), bounded per micro-batch."""
    return (spark.readStream.schema(ITEM_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .json(landing).filter(F.col("time").isNotNull() & F.col("id").isNotNull()))


def stories(items: DataFrame) -> DataFrame:
    """Story posts of a stream or a batch of items."""
    return post_from_item(items.filter(F.col("type") == "story"))


def sink_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``; None if nothing has been written there, any other error is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(batch: DataFrame, sink: str) -> None:
    """Append the rows whose id the sink doesn't hold, one row per id."""
    batch = batch.dropDuplicates(["id"])
    held = sink_or_none(batch.sparkSession, sink)
    if held is not None:
        low, high = batch.agg(F.min("id"), F.max("id")).first()
        if low is None:
            return
        batch = batch.join(held.filter(F.col("id").between(low, high)).select("id"), "id", "left_anti")
    batch.select(*POST_COLUMNS).write.mode("append").parquet(sink)


def _drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame], None]) -> dict:
    q = (stream.writeStream.foreachBatch(lambda batch, _: each(batch)).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q.lastProgress or {}


def run_ingest(spark: SparkSession, landing: str, sink: str, checkpoint: str, max_files_per_trigger: int = 1) -> dict:
    """Run the ingest stream until everything landed so far is in the sink, each id once.

    Restarting with the same ``checkpoint`` continues where it stopped.
    Returns the last progress (rows/s = the ingest meter, SRC16).
    """
    posts = stories(item_stream(spark, landing, max_files_per_trigger))
    return _drain(posts, checkpoint, lambda batch: append_new(batch, sink))


def run_flags(posts: DataFrame, blocklist: DataFrame, sink: str, checkpoint: str) -> dict:
    """STR4: append every post of a stream with its host and blocklist flag.

    Each micro-batch goes through the batch operator -- parent domains of its
    distinct hosts against the static list -- so nothing is kept between batches.
    """
    return _drain(posts, checkpoint, lambda batch: flag_posts(batch, blocklist).write.mode("append").parquet(sink))


def time_cell_counts_stream(posts: DataFrame) -> DataFrame:
    """STR4: running (weekday, hour, high_score) counts; at most 7 x 24 x 2 rows of state."""
    p = posts.withColumn("ts", epoch_to_utc(F.col("time_unix")))
    return (with_time_features(p, "ts", "score")
            .groupBy("weekday", "hour", "high_score").agg(F.count(F.lit(1)).alias("count")))


def run_time_cells(posts: DataFrame, sink: str, checkpoint: str) -> dict:
    """Keep the Parquet table ``sink`` at the counts so far: complete mode, replaced by each micro-batch."""
    q = (time_cell_counts_stream(posts).writeStream.outputMode("complete")
         .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(sink))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q.lastProgress or {}
