"""Cluster naming (WIN4, WIN5, SCL18, SCL19, SCL29, ML9).

The default namer is the fallback path of the analysis -- first four words of
the longest title of the cluster, cleaned -- expressed natively as a
``max_by`` aggregate (partially aggregated, so a huge cluster is no hot spot).
A caller may plug a model-backed namer: it receives the bounded title sample
(<= 50 per cluster) through ``applyInPandas`` and its failures fall back to
the native name.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import cleanup_name, first_words

SAMPLE_K = 50
SEED = 42
NOISE_NAME = "Noise"
PROMPT_HEAD = "Below are headlines that belong together. Answer with a topic label of two to five plain words.\n\n"
PROMPT_TAIL = "\n\nTopic label:"


def title_sample(df: DataFrame, cluster_col: str = "cluster", id_col: str = "id",
                 k: int = SAMPLE_K, seed: int = SEED) -> DataFrame:
    """WIN4: up to ``k`` rows per cluster in a seeded hash order (deterministic).

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so at most ``k`` rows per cluster leave each task.
    """
    w = Window.partitionBy(cluster_col).orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string"))), F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def longest_title_names(df: DataFrame, cluster_col: str = "cluster", title_col: str = "title",
                        id_col: str = "id", n_words: int = 4) -> DataFrame:
    """WIN5 + SCL19 + SCL18: (cluster, name, count); the longest title wins,
    equal lengths -> highest id (rows arrive in descending id order)."""
    g = df.filter(F.col(title_col).isNotNull()).groupBy(cluster_col).agg(
        F.max_by(F.col(title_col), F.struct(F.length(title_col), F.col(id_col))).alias("_t"),
        F.count(F.lit(1)).alias("count"))
    return g.select(cluster_col, cleanup_name(first_words(F.col("_t"), n_words)).alias("name"), "count")


def prompt_text(sample: DataFrame, cluster_col: str = "cluster", title_col: str = "title") -> DataFrame:
    """SCL29: prompt per cluster from its (bounded) title sample."""
    return sample.groupBy(cluster_col).agg(
        F.concat(F.lit(PROMPT_HEAD), F.array_join(F.sort_array(F.collect_list(title_col)), "\n"),
                 F.lit(PROMPT_TAIL)).alias("prompt"))


def name_clusters(df: DataFrame, namer: Callable[[str, list[str]], str] | None = None,
                  cluster_col: str = "cluster", title_col: str = "title", id_col: str = "id",
                  noise: int = -1) -> DataFrame:
    """ML9: (cluster, name, count) for every cluster; noise is named ``Noise``.

    ``namer(prompt, titles) -> name`` is called once per cluster on the
    sample; exceptions or empty answers fall back to the longest-title name.
    """
    fallback = longest_title_names(df, cluster_col, title_col, id_col)
    if namer is not None:
        sample = title_sample(df.filter(F.col(cluster_col) != noise), cluster_col, id_col)

        def call(pdf: pd.DataFrame) -> pd.DataFrame:
            titles = [t for t in pdf[title_col].tolist() if isinstance(t, str)]
            prompt = PROMPT_HEAD + "\n".join(sorted(titles)) + PROMPT_TAIL  # as prompt_text
            try:
                name = namer(prompt, titles) or None
            except Exception:  # noqa: BLE001 - any model failure falls back
                name = None
            return pd.DataFrame({cluster_col: [pdf[cluster_col].iloc[0]], "model_name": [name]})

        schema = f"{cluster_col} {dict(df.dtypes)[cluster_col]}, model_name string"
        named = sample.select(cluster_col, title_col).groupBy(cluster_col).applyInPandas(call, schema)
        fallback = (fallback.join(named, cluster_col, "left")
                    .select(cluster_col, F.coalesce(cleanup_name(F.col("model_name")), F.col("name"))
                            .alias("name"), "count"))
    return fallback.select(cluster_col, F.when(F.col(cluster_col) == noise, F.lit(NOISE_NAME))
                           .otherwise(F.col("name")).alias("name"), "count")
