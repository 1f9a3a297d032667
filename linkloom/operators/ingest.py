"""Batch ingest of items into posts (SRC1, SRC3-SRC8, FLT1, FLT2, FLT6, WIN6, WIN10, STR2 batch form).

Scale notes
-----------
* The cut-off prefix rule (FLT1) is one scalar aggregate -- the largest id
  older than the cut-off -- read back and applied as ``id > bound``, which
  Parquet can use for row-group skipping.
* De-duplication keeps one row per id with ``dropDuplicates`` (hash
  aggregate with map-side partial aggregation: a replayed hot id is one row
  per task before the shuffle).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.vectors import vec_from_json
from linkloom.schemas import ITEM_SCHEMA, POST_COLUMNS, POST_SCHEMA, POST_TEXT_SCHEMA
from linkloom.session import scratch_dir
from linkloom.sources.tables import post_from_item

BATCH_SIZE = 200           # ids per harvest batch
_LINES_AT_ONCE = 512


def id_batches(spark: SparkSession, start_id: int, batch_size: int = BATCH_SIZE) -> DataFrame:
    """SRC1 + WIN6: ids ``start_id .. 1`` with ``batch = (start - id) div batch_size`` and ``position``, the id's
    place in its batch when ids are walked downwards; ``partition_fetch`` deals them out by batch."""
    ids = spark.range(1, start_id + 1).select(F.col("id"))
    down = F.lit(start_id) - F.col("id")
    return ids.withColumn("batch", F.floor(down / batch_size).cast("long")).withColumn("position", (down % batch_size).cast("int"))


def partition_fetch(ids: DataFrame, fetch: Callable[[list[int]], list[dict | None]],
                    partitions: int | None = None, batch_size: int = BATCH_SIZE, failed=None) -> DataFrame:
    """SRC3: fetch items for ``ids`` with a caller-supplied function, at most
    ``batch_size`` ids a call, batches whole and walked downwards.  A call that
    raises is repeated id by id, so one failing id loses only itself; ``failed``
    (an accumulator) counts those.  Missing items (None) and items without
    ``time`` (SRC2) are dropped.  Parallelism = number of partitions."""
    src = (ids.repartition(partitions, "batch") if partitions else ids.repartition("batch")).sortWithinPartitions("batch", F.desc("id"))

    def one_by_one(wanted: list[int]) -> Iterator[dict | None]:
        for i in wanted:
            try:
                yield from fetch([i])
            except Exception:  # noqa: BLE001 - whatever the caller's function raises costs this id only
                if failed is not None:
                    failed.add(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items = []
            for at in range(0, len(pdf), batch_size):
                wanted = [int(i) for i in pdf["id"].iloc[at:at + batch_size]]
                try:
                    found = list(fetch(wanted))
                except Exception:  # noqa: BLE001
                    found = list(one_by_one(wanted))
                items += [it for it in found if it and it.get("time") is not None]
            out = pd.DataFrame([{f.name: it.get(f.name) for f in ITEM_SCHEMA.fields} for it in items],
                               columns=[f.name for f in ITEM_SCHEMA.fields])
            yield out

    return src.select("id").mapInPandas(run, ITEM_SCHEMA)


def cutoff_bound(items: DataFrame, cutoff_epoch: int) -> int:
    """FLT1 scalar: the largest id whose item is older than the cut-off (-1 if none)."""
    v = items.filter(F.col("time") < cutoff_epoch).agg(F.max("id")).first()[0]
    return -1 if v is None else int(v)


def stories_until_cutoff(items: DataFrame, cutoff_epoch: int) -> DataFrame:
    """FLT1 + FLT2 + SRC4: stories above the cut-off prefix, as posts.

    Walking ids downwards the harvest stops at the first item (of any type)
    older than the cut-off; so the kept ids are those above the largest such id.
    """
    bound = cutoff_bound(items, cutoff_epoch)
    return post_from_item(items.filter((F.col("id") > bound) & (F.col("type") == "story")))


def dedupe_ids(posts: DataFrame, id_col: str = "id") -> DataFrame:
    """STR2 batch form: one row per id."""
    return posts.dropDuplicates([id_col])


def write_posts(posts: DataFrame, path: str, mode: str = "append") -> None:
    """SRC4: the 10 post columns, appended to a Parquet table."""
    posts.select(*POST_COLUMNS).write.mode(mode).parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV export with one header line per file, RFC-4180 quoting."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: post CSV with header, quoted multi-line fields."""
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .schema(POST_SCHEMA).csv(path))


def read_posts_csv_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: all-string, permissive read; typed columns are derived afterwards
    with tolerant casts.  Bytes that are not UTF-8 are left out, so a replacement
    character in the result stood in the file.  Files are read as lines of bytes, any number of
    tasks to a file, and a cleaned copy of each, its lines in their order, goes to the shared scratch
    folder for the CSV reader; like any CSV with line breaks in fields, a copy is one
    task's work, record by record."""
    def clean(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _LINES_AT_ONCE):
                part = batch.slice(at, _LINES_AT_ONCE)
                text = pa.array([b.decode("utf-8", "ignore") for b in part.column(3).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], text], part.schema.names)

    copy = scratch_dir(spark, "utf8-csv")
    lines = spark.read.option("lineSep", "\n").text(path)  # a line's bytes stay as they are
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                         F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary"))
    lines = lines.mapInArrow(clean, "file long, start long, line long, value string")
    lines = lines.repartition("file").sortWithinPartitions("file", "start", "line").select("file", "value")
    lines.write.partitionBy("file").text(copy)  # one file for each, header and all
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("mode", "PERMISSIVE").schema(POST_TEXT_SCHEMA).csv(copy))
    return back.select(*POST_TEXT_SCHEMA.names)


def read_embedded_posts(df: DataFrame, dim: int | None = None, id_col: str = "id",
                        title_col: str = "title", emb_col: str = "embedding") -> DataFrame:
    """SRC8 + FLT6: (id, title, embedding) rows with a text title, a parsable
    vector (JSON text or array) and an integer id; others skipped."""
    emb = F.col(emb_col)
    if dict(df.dtypes)[emb_col] == "string":
        emb = vec_from_json(emb, dim)
    elif dim is not None:
        emb = F.when(F.size(emb) == dim, emb)
    out = df.select(F.col(id_col).cast("string").try_cast("bigint").alias("id"),
                    F.col(title_col).alias("title"), emb.alias("embedding"))
    return out.filter(F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("embedding").isNotNull())


def resume_bound(spark: SparkSession, sink: str) -> int | None:
    """SRC5 batch form: the smallest id already in the post sink (harvest
    continues strictly below it); None when the sink is empty or absent."""
    from linkloom.streaming.ingest import sink_or_none

    held = sink_or_none(spark, sink)
    v = None if held is None else held.agg(F.min("id")).first()[0]
    return None if v is None else int(v)


def write_embedded(df: DataFrame, path: str, csv: bool = False, emb_col: str = "embedding") -> None:
    """SRC10 / SRC11: embedded (or tagged) posts -> Parquet (overwrite, never a
    half-appended file); ``csv=True`` exports with the vector as JSON text."""
    if csv:
        export_csv(df.withColumn(emb_col, F.to_json(F.col(emb_col))), path)
    else:
        df.write.mode("overwrite").parquet(path)


def export_keywords(top: DataFrame, path: str) -> None:
    """SRC12: the (k-row) keyword ranking as one CSV file with a header."""
    export_csv(top.coalesce(1), path)
