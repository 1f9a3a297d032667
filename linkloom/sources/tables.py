"""Driver tables mapped onto the reference data model (FIXTURES section 2).

Only column expressions: Catalyst prunes the Parquet scan to the columns a
query uses and pushes filters down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.timefn import epoch_to_iso, utc_to_epoch


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a *narrow* projection when the scan yields fewer partitions
    than the cluster has cores (e.g. a single-row-group file), so per-row
    regex work runs in parallel.  Large inputs already have enough splits and
    are returned untouched -- no shuffle is added at scale."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session): leave as is
        return df
    return df.repartition(target) if parts < target else df


def page_score(page_id: Column) -> Column:
    """Stand-in score of a page: (page_id * 37) mod 500."""
    return F.pmod(page_id * 37, F.lit(500)).cast("long")


def pages_as_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a URL: id = page_id, score = (page_id*37) % 500."""
    p = read_table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("id"), F.col("url"), page_score(F.col("page_id")).alias("score"))


def documents_as_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titled posts: id = doc_id, title = the whole text, score = n_chars, cluster = lang."""
    d = read_table(spark, sf_dir, "documents")
    return spread(d.select(F.col("doc_id").alias("id"), F.col("text").alias("title"),
                           F.col("n_chars").alias("score"), F.col("lang")))


def events_as_items(spark: SparkSession, sf_dir: str, story_type: str = "view") -> DataFrame:
    """Items: id = event_id, time = epoch(ts), score = value, type = event_type
    (``story_type`` plays ``'story'``), by = user_id as text."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == story_type, F.lit("story")).otherwise(F.col("event_type")).alias("type"),
        F.col("user_id").cast("string").alias("by"),
        utc_to_epoch(F.col("ts")).alias("time"),
        F.lit(None).cast("string").alias("title"),
        F.col("value").alias("score_value"),
        F.lit(None).cast("long").alias("descendants"),
        F.lit(None).cast("string").alias("url"),
        F.col("props").alias("text"),
    )


def events_as_timed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed posts for the weekday x hour profile: ts (UTC), score = value."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts"), F.col("value").alias("score"),
                    F.col("event_type"))


def embeddings_as_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart points: x, y = embedding dims 1 and 2, cluster = label with 0 -> -1."""
    v = read_table(spark, sf_dir, "embeddings")
    return v.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("title"),
        F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).cast("int").alias("cluster"),
        F.element_at("embedding", 1).cast("double").alias("x"),
        F.element_at("embedding", 2).cast("double").alias("y"),
    )


def post_from_item(items: DataFrame) -> DataFrame:
    """SRC4 projection with the harvest defaults (SCL4): title/url/text -> '',
    score/descendants -> 0; time_iso derived (SCL1)."""
    score = F.col("score") if "score" in items.columns else F.col("score_value")
    return items.select(
        F.col("id").cast("long").alias("id"),
        F.col("type"),
        F.col("by"),
        F.col("time").cast("long").alias("time_unix"),
        epoch_to_iso(F.col("time")).alias("time_iso"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(score.cast("long"), F.lit(0).cast("long")).alias("score"),
        F.coalesce(F.col("descendants").cast("long"), F.lit(0).cast("long")).alias("descendants"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
