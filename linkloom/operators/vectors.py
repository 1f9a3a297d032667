"""Vector operators: normalisation, pooling, z-score, tagging (SCL14-SCL17,
AGG14, AGG17, ML2, ML3, JN3).

Per-dimension statistics use ``posexplode`` + ``groupBy(dim)`` -- map-side
partial aggregation keeps the shuffle at (#groups x dims) rows per task.
Tagging multiplies each Arrow batch of posts with a size-checked, broadcast
prototype matrix (no join, no row blow-up).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.vectors import l2_normalize

PROTOTYPE_ROWS = 65_536  # rows of a broadcast block of prototypes


def unit_vectors(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """SCL14 on every row."""
    return df.withColumn(vec_col, l2_normalize(F.col(vec_col)))


def long_form(df: DataFrame, key_cols: list[str], vec_col: str) -> DataFrame:
    """(keys..., dim, x) with 1-based dims."""
    return (df.select(*key_cols, F.posexplode(F.col(vec_col).cast("array<double>")).alias("dim", "x"))
            .withColumn("dim", (F.col("dim") + 1).cast("int")))


def masked_mean_pool(tokens: DataFrame, key_col: str = "doc", pos_col: str = "token_pos",
                     mask_col: str = "mask", vec_col: str = "vec", eps: float = 1e-9) -> DataFrame:
    """AGG17: sum(token * mask) / max(sum(mask), eps) per key, as an ordered array.

    Input is long form (key, token_pos, mask, vec).  The per-(key, dim) sums are
    partially aggregated; the final ``array`` is rebuilt from at most ``d`` values
    per key (bounded by the model dimension, not by the token count).
    """
    lf = tokens.select(key_col, F.col(mask_col).cast("double").alias("m"),
                       F.posexplode(F.col(vec_col).cast("array<double>")).alias("dim", "x"))
    per_dim = (lf.groupBy(key_col, "dim")
               .agg((F.sum(F.col("x") * F.col("m")) / F.greatest(F.sum("m"), F.lit(eps))).alias("v")))
    return (per_dim.groupBy(key_col)
            .agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("s"))
            .select(key_col, F.transform("s", lambda e: e["v"]).alias("pooled")))


def group_centroids(df: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """AGG17 with mask 1 per group, then L2-normalised: (group, dim, x) long form."""
    lf = long_form(df, [group_col], vec_col)
    means = lf.groupBy(group_col, "dim").agg(F.avg("x").alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(group_col)))
    return means.select(group_col, "dim", (F.col("m") / F.greatest(norm, F.lit(1e-12))).alias("x"))


def wide_form(long: DataFrame, key_col: str, out_col: str = "embedding") -> DataFrame:
    """(key, dim, x) long form -> (key, vector) with dims in order; one group per
    key holds ``d`` entries (the model dimension), never a row count."""
    return long.groupBy(key_col).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("_p")).select(
        key_col, F.transform("_p", lambda e: e["x"]).alias(out_col))


def zscore_stats(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """AGG14: per-dimension mean and population std; ``scale`` = std or 1 when 0."""
    lf = long_form(df, [], vec_col)
    st = lf.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return st.withColumn("scale", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def zscore(df: DataFrame, vec_col: str = "embedding", out_col: str = "scaled") -> DataFrame:
    """ML3: (x - mean) / scale per dimension.

    The statistics are ``d`` rows (model dimension): they are collected once
    and applied as literal arrays, so no join touches the vectors.
    """
    st = zscore_stats(df, vec_col).orderBy("dim").collect()
    means = F.array(*[F.lit(float(r["mean"])) for r in st])
    scales = F.array(*[F.lit(float(r["scale"])) for r in st])
    v = F.col(vec_col).cast("array<double>")
    return df.withColumn(out_col, F.zip_with(F.zip_with(v, means, lambda x, m: x - m), scales,
                                             lambda y, s: y / s))


def assign_labels(df: DataFrame, protos: DataFrame, vec_col: str = "embedding",
                  idx_col: str = "tag_idx", block_rows: int = PROTOTYPE_ROWS) -> DataFrame:
    """ML2 = JN3 + SCL15 + SCL16: nearest prototype by dot product, first max wins.

    Adds ``tag_idx`` (prototype index) and ``sim``.  Prototypes are broadcast in
    blocks of ``block_rows`` in index order; each block is one pass of matrix
    products over the vectors that keeps the best so far, so any number of
    prototypes works in bounded memory and the vectors are never shuffled.
    """
    out = df.withColumn("_t", F.lit(None).cast(T.StructType([T.StructField("tag_idx", T.LongType()), T.StructField("sim", T.DoubleType())])))
    block: list = []
    for row in protos.select(idx_col, vec_col).orderBy(idx_col).toLocalIterator():
        block.append(row)
        if len(block) == block_rows:
            out, block = _nearest_so_far(out, block, vec_col), []
    if block:
        out = _nearest_so_far(out, block, vec_col)
    return out.withColumn("tag_idx", F.col("_t.tag_idx")).withColumn("sim", F.col("_t.sim")).drop("_t")


def _nearest_so_far(df: DataFrame, block: list, vec_col: str) -> DataFrame:
    given = df.sparkSession.sparkContext.broadcast((np.array([r[0] for r in block], dtype=np.int64), np.array([r[1] for r in block], dtype=np.float64)))

    @F.pandas_udf(df.schema["_t"].dataType)
    def nearest(vecs: pd.Series, so_far: pd.DataFrame) -> pd.DataFrame:
        ids, m = given.value
        if not len(vecs):
            return pd.DataFrame({"tag_idx": pd.Series([], dtype="int64"), "sim": pd.Series([], dtype="float64")})
        sims = np.stack([np.asarray(v, dtype=np.float64) for v in vecs]) @ m.T
        best = np.argmax(sims, axis=1)  # first maximum wins
        out = pd.DataFrame({"tag_idx": ids[best], "sim": sims[np.arange(len(best)), best]})
        old = so_far["sim"].to_numpy(dtype=np.float64) >= out["sim"].to_numpy()
        out.loc[old, ["tag_idx", "sim"]] = so_far.loc[old, ["tag_idx", "sim"]].to_numpy()
        return out.astype({"tag_idx": "int64"})

    return df.withColumn("_t", nearest(F.col(vec_col), F.col("_t")))


def tag_ranking(tagged: DataFrame, tag_col: str = "tag") -> DataFrame:
    """AGG8 + WIN3: tag counts, descending, ties by tag."""
    return (tagged.groupBy(tag_col).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col(tag_col)))))
