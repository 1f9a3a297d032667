"""Blocklist membership (SRC9, SET1, SCL11, JN1, JN2, AGG10, AGG11, SCL24).

Plan shape
----------
posts --(url_host)--> per-host partial counts            [hash agg, map-side combine]
distinct hosts --explode parents--> semi join blocklist   [broadcast, size-checked]
flags (one row per flagged host) joined to per-host rows  [small x small]
-> per-class totals / weighted exact percentiles.

Counts and quartiles pre-aggregate to (host[, score]) first, so a host holding
a third of all posts is one row; per-post flags join posts only with the
listed hosts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import parent_domains, url_host
from linkloom.operators.common import pct, sized_broadcast, tolerant_int

def clean_blocklist_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """SRC9 + SET1: strip blanks, lower-case, drop blank and ``#`` lines, distinct."""
    v = F.lower(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""))
    return (lines.select(v.alias("domain"))
            .filter((F.col("domain") != "") & ~F.col("domain").startswith("#"))
            .distinct())


def load_blocklists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union-distinct of the domain lists in ``paths`` (text, one entry per line)."""
    return clean_blocklist_lines(spark.read.text(paths))


def blocklist_from_values(spark: SparkSession, values: list[str]) -> DataFrame:
    return clean_blocklist_lines(spark.createDataFrame([(v,) for v in values], "value string"))


def flag_hosts(hosts: DataFrame, blocklist: DataFrame, host_col: str = "host") -> DataFrame:
    """JN1 on distinct hosts: ``host_col`` + ``blacklisted`` (host or a parent listed)."""
    bl = sized_broadcast(blocklist.select("domain"))
    d = hosts.select(host_col).distinct()
    cand = d.select(host_col, F.explode(parent_domains(F.col(host_col))).alias("domain"))
    hit = cand.join(bl, "domain", "left_semi").select(host_col).distinct()
    return (d.join(hit.withColumn("blacklisted", F.lit(True)), host_col, "left")
            .select(host_col, F.coalesce("blacklisted", F.lit(False)).alias("blacklisted")))


def flag_posts(posts: DataFrame, blocklist: DataFrame, url_col: str = "url") -> DataFrame:
    """Per-post flag (JN1) and its complement (JN2 = ``blacklisted = false``)."""
    p = posts.withColumn("host", url_host(F.col(url_col)))
    # posts without a host are never listed and stay out of the join, where they would be one key;
    # only the listed hosts -- a checked broadcast -- meet the posts, so a hot host needs no shuffle
    some = p.filter(F.col("host").isNotNull())
    listed = flag_hosts(some, blocklist, "host").filter("blacklisted")
    flagged = some.join(sized_broadcast(listed), "host", "left").withColumn("blacklisted", F.coalesce("blacklisted", F.lit(False)))
    none = p.filter(F.col("host").isNull()).withColumn("blacklisted", F.lit(False))
    return flagged.unionByName(none)


def _host_counts(posts: DataFrame, url_col: str, extra: list[str]) -> DataFrame:
    return (posts.select(url_host(F.col(url_col)).alias("host"), *extra)
            .groupBy("host", *extra).agg(F.count(F.lit(1)).alias("n")))


def _with_flags(per_host: DataFrame, blocklist: DataFrame) -> DataFrame:
    flags = flag_hosts(per_host.filter(F.col("host").isNotNull() & (F.col("host") != "")),
                       blocklist, "host")
    return (per_host.join(flags, "host", "left")
            .withColumn("blacklisted", F.coalesce("blacklisted", F.lit(False))))


def blocklist_counts(posts: DataFrame, blocklist: DataFrame, url_col: str = "url") -> DataFrame:
    """AGG10 + SCL24: one row of totals and shares (posts without a URL count as clean)."""
    per_host = _with_flags(_host_counts(posts, url_col, []), blocklist)
    t = per_host.agg(F.sum("n").cast("long").alias("total_posts"),
                     F.sum(F.when(F.col("blacklisted"), F.col("n")).otherwise(0)).cast("long")
                     .alias("blacklisted_posts"))
    t = t.select(F.coalesce("total_posts", F.lit(0).cast("long")).alias("total_posts"),
                 F.coalesce("blacklisted_posts", F.lit(0).cast("long")).alias("blacklisted_posts"))
    return t.select(
        "total_posts", "blacklisted_posts",
        (F.col("total_posts") - F.col("blacklisted_posts")).alias("non_blacklisted_posts"),
        pct(F.col("blacklisted_posts"), F.col("total_posts")).alias("pct_blacklisted"),
        (F.lit(100.0) - pct(F.col("blacklisted_posts"), F.col("total_posts"))).alias("pct_non_blacklisted"),
    )


def blocklist_score_summary(posts: DataFrame, blocklist: DataFrame, url_col: str = "url",
                            score_col: str = "score") -> DataFrame:
    """AGG11 per class: blacklisted, n, min, q1, median, q3, max.

    Scores go through the tolerant cast (SCL10); posts without a usable score
    are left out of the summary.  Percentiles are exact and weighted by the
    per-(host, score) counts, so rows are aggregated before any join.
    """
    p = posts.select(F.col(url_col), tolerant_int(F.col(score_col).cast("string")).alias("score"))
    per = _with_flags(_host_counts(p.filter(F.col("score").isNotNull()), url_col, ["score"]),
                      blocklist)
    g = per.groupBy("blacklisted").agg(
        F.sum("n").cast("long").alias("n"),
        F.min("score").alias("min"),
        F.percentile(F.col("score"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("_q"),
        F.max("score").alias("max"))
    return g.select("blacklisted", "n", "min",
                    F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                    F.col("_q")[2].alias("q3"), "max")
