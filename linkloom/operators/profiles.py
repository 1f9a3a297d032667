"""Site, time and score profiles (AGG1-AGG3, AGG10-AGG11, FLT3-FLT5, WIN1).

Scale notes
-----------
* Counting by host / label is a hash aggregation with map-side partial
  aggregation, so a host holding a third of all posts costs one partial row
  per task, not a hot reducer.
* The registrable label is computed on *distinct* hosts after a first count,
  so the suffix-candidate explosion is paid per host, not per post.
* Top-k uses ``orderBy(...).limit(k)`` which plans as TakeOrderedAndProject
  (per-task top-k, then a k-row merge) -- no global sort.
* Exact quartiles count rows per (group, value) and find the ranks on running
  counts over value ranges, so no task holds a group's values.  ``approx=True``
  switches to ``percentile_approx`` (bounded sketch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import na_to_null
from linkloom.functions.timefn import hour_of, weekday_of
from linkloom.functions.urls import registrable_labels, suffix_host, url_host
from linkloom.operators.common import sized_broadcast
from linkloom.session import materialize

HIGH_SCORE_BAR = 200  # fixed value: a post with >= 200 points is "high score"
TOP_K = 50


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    """FLT3: drop rows whose columns in ``subset`` are null, empty or an NA token."""
    cond = None
    for c in subset:
        dt = dict(df.dtypes)[c]
        ok = na_to_null(F.col(c)).isNotNull() if dt == "string" else F.col(c).isNotNull()
        cond = ok if cond is None else cond & ok
    return df.filter(cond) if cond is not None else df


def top_k(df: DataFrame, count_col: str, key_col: str, k: int = TOP_K) -> DataFrame:
    """WIN1/WIN2: k largest by ``count_col``, ties broken by ``key_col`` ascending."""
    return df.orderBy(F.col(count_col).desc(), F.col(key_col).asc()).limit(k)


def host_ranking(posts: DataFrame, bar: int = 0, k: int = TOP_K) -> DataFrame:
    """Top-k hosts (url_host) among posts with score >= bar.

    Columns: domain, high_score_posts.
    """
    p = drop_missing(posts, ["url", "score"]).filter(F.col("score") >= bar)
    counts = (p.select(url_host(F.col("url")).alias("domain"))
              .groupBy("domain").agg(F.count(F.lit(1)).alias("high_score_posts")))
    return top_k(counts, "high_score_posts", "domain", k)


def domain_ranking(posts: DataFrame, rules: DataFrame, bar: int = 0, k: int = TOP_K) -> DataFrame:
    """Top-k registrable labels (SCL8) among posts with score >= bar (DR analysis).

    Columns: domain, high_score_posts.
    """
    p = drop_missing(posts, ["url", "score"]).filter(F.col("score") >= bar)
    per_host = (p.select(suffix_host(F.col("url")).alias("host"))
                .groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    labelled = registrable_labels(per_host, rules, "host")
    counts = labelled.groupBy(F.col("label").alias("domain")).agg(
        F.sum("n").cast("long").alias("high_score_posts"))
    return top_k(counts, "high_score_posts", "domain", k)


def with_time_features(posts: DataFrame, ts_col: str = "ts", score_col: str = "score",
                       bar: int = HIGH_SCORE_BAR) -> DataFrame:
    """SCL3 + SCL5: weekday (Mon=0), hour, high_score flag."""
    p = posts.filter(F.col(score_col).isNotNull() & F.col(ts_col).isNotNull())
    return p.select(
        weekday_of(F.col(ts_col)).cast("int").alias("weekday"),
        hour_of(F.col(ts_col)).cast("int").alias("hour"),
        (F.col(score_col) >= bar).cast("int").alias("high_score"),
    )


def time_cells(posts: DataFrame, ts_col: str = "ts", score_col: str = "score",
               bar: int = HIGH_SCORE_BAR) -> DataFrame:
    """AGG2: posts per (weekday, hour, high_score)."""
    return (with_time_features(posts, ts_col, score_col, bar)
            .groupBy("weekday", "hour", "high_score").agg(F.count(F.lit(1)).alias("count")))


def time_pivot(posts: DataFrame, high: bool, ts_col: str = "ts", score_col: str = "score",
               bar: int = HIGH_SCORE_BAR, dense: bool = True) -> DataFrame:
    """AGG3 + FLT5: hour x weekday matrix of one class, missing -> 0.

    One row per hour, columns ``wd_0`` .. ``wd_6``.  ``dense`` keeps all 24
    hours (the 24-row hour axis is a fixed domain, not data-dependent).
    Explicit pivot values skip Spark's extra distinct-values job.
    """
    flag = 1 if high else 0
    f = with_time_features(posts, ts_col, score_col, bar).filter(F.col("high_score") == flag)
    piv = f.groupBy("hour").pivot("weekday", list(range(7))).agg(F.count(F.lit(1)))
    piv = piv.select("hour", *[F.col(str(d)).alias(f"wd_{d}") for d in range(7)])
    if dense:
        spark = posts.sparkSession
        hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
        piv = hours.join(piv, "hour", "left")
    return piv.select("hour", *[F.coalesce(F.col(f"wd_{d}"), F.lit(0)).cast("long").alias(f"wd_{d}")
                                for d in range(7)])


def five_number_summary(df: DataFrame, value_col: str, by: list[str] | None = None,
                        approx: bool = False, accuracy: int = 10_000) -> DataFrame:
    """AGG11: n, min, q1, median, q3, max per group (nulls excluded; a group of nulls has n 0).

    Quartiles are linearly interpolated and exact: rows are counted per (group,
    value), the counts are range-partitioned by value, running counts go over
    partitions first and within them next, and each quartile picks the two
    values its rank falls between.  No buffer ever holds a group's values.
    """
    by = by or []
    v = F.col(value_col)
    if approx:
        aggs = [F.count(v).alias("n"), F.min(v).alias("min"), F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("_q"), F.max(v).alias("max")]
        g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
        return g.select(*by, "n", "min", *[F.col("_q")[i].cast("double").alias(q) for i, q in enumerate(("q1", "median", "q3"))], "max")
    # a null value is a row of weight 0: it holds no rank but keeps its group
    counts = df.groupBy(*[F.col(c) for c in by], v.alias("_v")).agg(F.count(v).alias("_c"))
    counts = materialize(counts.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()), "value-counts")
    parts = counts.groupBy(*by, "_p").agg(F.sum("_c").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"), F.sum("_s").over(Window.partitionBy(*by)).alias("_n"))
    within = Window.partitionBy(*by, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    x = counts.withColumn("_run", F.sum("_c").over(within))
    same = [x[c].eqNullSafe(parts[c]) for c in [*by, "_p"]]
    x = x.join(sized_broadcast(parts), same).select(*[x[c] for c in by], "_v", "_c", (F.col("_base") + F.col("_run")).alias("_to"), "_n")
    picks = []
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        rank = F.lit(q) * (F.col("_n") - 1)
        holds = lambda r: (r >= F.col("_to") - F.col("_c")) & (r < F.col("_to"))
        low, high = (F.max(F.when(holds(r), F.col("_v"))).cast("double") for r in (F.floor(rank), F.ceil(rank)))
        picks.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    out = x.groupBy(*by).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), *picks)
    return out.select(*by, "n", "min", "q1", "median", "q3", "max")
