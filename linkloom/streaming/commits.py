"""Committed ingest: batch folders, a commit list, a quarantine and a meter (STR1, STR2, SRC2, SRC5, SRC16).

A sink is a folder with ``data/batch=<batch>/`` and ``commits/<batch>``.  A
micro-batch writes its folder -- accepted rows and rejected lines side by side,
in one pass -- and then its commit; both are named after the stream and the batch's number, so
a batch that failed half-way writes the same folder again, and a folder without
a commit is not read.  Nothing that the sink holds is read while a batch is
written: the work of a batch doesn't grow with the sink.  Ids that come again
in later batches are told apart when the sink is read, where the earliest
batch's row counts, or once and for all by ``compact``.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from linkloom.schemas import ITEM_SCHEMA, POST_COLUMNS, POST_SCHEMA
from linkloom.sources.tables import post_from_item

_BAD = "_corrupt_record"
#: Why a line is rejected, in the order in which they are looked for.
REASONS = ("not json", "no id", "no time")
LANDED_SCHEMA = T.StructType([*POST_SCHEMA.fields, T.StructField("line", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("batch", T.StringType()), T.StructField("kind", T.StringType())])


# -- sink ----------------------------------------------------------------------------

def _files(spark: SparkSession, path: str):
    """(file system, path object) of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def committed(spark: SparkSession, sink: str) -> list[str]:
    """Names of the committed batches, in the order in which their rows count."""
    fs, at = _files(spark, f"{sink}/commits")
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def commit(spark: SparkSession, sink: str, batch: str) -> None:
    fs, at = _files(spark, f"{sink}/commits/{batch}")
    fs.create(at, True).close()


def write_batch(rows: DataFrame, sink: str, batch: str) -> None:
    """Write a batch's folder, whatever an earlier attempt left there, and commit it."""
    rows.write.mode("overwrite").partitionBy("kind").parquet(f"{sink}/data/batch={batch}")
    commit(rows.sparkSession, sink, batch)


def read_landed(spark: SparkSession, sink: str) -> DataFrame:
    """All committed rows with their batch: accepted ones (kind 'item') and rejected lines (kind 'rejected')."""
    batches = committed(spark, sink)
    if not batches:
        return spark.createDataFrame([], LANDED_SCHEMA)
    return spark.read.schema(LANDED_SCHEMA).option("basePath", f"{sink}/data").parquet(*[f"{sink}/data/batch={b}" for b in batches])


def read_posts(spark: SparkSession, sink: str, story_type: str = "story") -> DataFrame:
    """The story posts that the sink holds, each id once: the row of the earliest batch."""
    rows = read_landed(spark, sink).filter((F.col("kind") == "item") & (F.col("type") == story_type))
    first = rows.groupBy("id").agg(F.min_by(F.struct(*POST_COLUMNS), F.struct("batch", *[c for c in POST_COLUMNS if c != "id"])).alias("p"))
    return first.select(*[F.col(f"p.{c}").alias(c) for c in POST_COLUMNS])


def read_rejected(spark: SparkSession, sink: str) -> DataFrame:
    """(batch, line, reason) of the lines that are no items."""
    return read_landed(spark, sink).filter(F.col("kind") == "rejected").select("batch", "line", "reason")


def compact(spark: SparkSession, sink: str) -> str | None:
    """Put all committed batches into one, in which each id stands once; the others go once it is committed.

    Cut short before that, the sink is as it was; cut short later, ids stand in
    two batches and still count once when read.
    """
    old = committed(spark, sink)
    if len(old) < 2:
        return None
    rows = read_landed(spark, sink)
    columns = [c for c in LANDED_SCHEMA.fieldNames() if c != "batch"]
    order = F.struct("batch", *[c for c in POST_COLUMNS if c != "id"])
    kept = rows.filter("kind = 'item'").groupBy("id").agg(F.min_by(F.struct(*columns), order).alias("p")).select("p.*")
    batch = f"{old[0]}-{uuid.uuid4().hex[:8]}"  # stands right behind its first batch, so its rows keep their rank
    write_batch(kept.unionByName(rows.filter("kind = 'rejected'").select(*columns)), sink, batch)
    fs, _ = _files(spark, sink)
    for folder, deep in (("commits/", False), ("data/batch=", True)):
        for name in old:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/{folder}{name}"), deep)
    return batch


# -- lines into items and rejected lines -------------------------------------------------

def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Posts of the lines that are items (kind 'item'), and the lines that aren't with the reason (kind 'rejected')."""
    schema = T.StructType([*ITEM_SCHEMA.fields, T.StructField(_BAD, T.StringType())])
    item = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    rows = lines.filter(F.trim(column) != "").select(F.col(column).alias("line"), item.alias("i"))
    faults = (F.col("i").isNull() | F.col(f"i.{_BAD}").isNotNull(), F.col("i.id").isNull(), F.col("i.time").isNull())
    reason = F.lit(None).cast("string")
    for name, fault in reversed(list(zip(REASONS, faults, strict=True))):
        reason = F.when(fault, F.lit(name)).otherwise(reason)
    rows = rows.select("line", "i.*", reason.alias("reason")).drop(_BAD)
    good = F.col("reason").isNull()
    posts = post_from_item(rows).columns
    columns = [F.when(good, c).alias(n) for n, c in zip(posts, _post_columns(rows), strict=True)]
    return rows.select(*columns, F.when(~good, F.col("line")).alias("line"), "reason", F.when(good, "item").otherwise("rejected").alias("kind"))


def _post_columns(rows: DataFrame) -> list:
    """The expressions of a post's columns over item columns."""
    from linkloom.functions.timefn import epoch_to_iso

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    return [F.col("id").cast("long"), F.col("type"), F.col("by"), F.col("time").cast("long"), epoch_to_iso(F.col("time")), text("title"), number("score"),
            number("descendants"), text("url"), text("text")]


# -- meter ------------------------------------------------------------------------------

class Meter(StreamingQueryListener):
    """What was observed in every micro-batch of the streams that ran while it listened; the last progress alone shows one."""

    def __init__(self, name: str = "ingest"):
        self.name, self.batches, self.ended = name, {}, set()

    def onQueryStarted(self, event) -> None:  # noqa: N802 - the listener's interface
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is not None and p.numInputRows:
            self.batches[str(p.id), p.batchId] = {**seen.asDict(), "rows_per_sec": p.processedRowsPerSecond}  # a batch that runs again counts once

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.runId))

    def totals(self) -> dict[str, int]:
        names = sorted({k for b in self.batches.values() for k in b} - {"rows_per_sec"})
        return {"batches": len(self.batches), **{n: sum(b[n] for b in self.batches.values()) for n in names}}


def run_landing(spark: SparkSession, landing: str, sink: str, checkpoint: str, max_files_per_trigger: int = 1, meter: Meter | None = None, before_commit=None) -> None:
    """Ingest every line landed so far; ``before_commit`` (for tests) runs between a batch's folder and its commit."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(landing)
    rows = parse_lines(lines).observe(meter.name if meter else "ingest", F.count(F.lit(1)).alias("lines"), F.count_if(F.col("kind") == "item").alias("items"),
                                      F.count_if(F.col("kind") == "rejected").alias("rejected"))

    def land(batch: DataFrame, number: int) -> None:
        name = f"{stream}-{number:012d}"
        if before_commit is None:
            write_batch(batch, sink, name)
            return
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{sink}/data/batch={name}")
        before_commit(number)
        commit(spark, sink, name)

    if meter is not None:
        spark.streams.addListener(meter)
    try:
        q = rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        finally:
            deadline = time.time() + 30
            while meter is not None and str(q.runId) not in meter.ended and time.time() < deadline:
                time.sleep(0.05)  # events arrive behind the query's end
    finally:
        if meter is not None:
            spark.streams.removeListener(meter)
