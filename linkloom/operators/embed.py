"""Batch text embedding (ML1, SCL17) with a pluggable model.

``embed_texts`` runs ``mapInPandas``: each Python worker builds the model once
(``model_factory()``, cached per process), encodes its partition in batches of
``batch_size`` texts and returns unit vectors.  Parallelism is the number of
partitions; nothing passes through the driver.

``hashed_vectors`` is the offline, deterministic default model: signed feature
hashing of all word tokens into ``dim`` buckets on Arrow batches, summed per id by
Spark and L2 normalised.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.text import text_or_empty

BATCH_SIZE = 128
DEFAULT_DIM = 64
_ROWS_AT_ONCE = 1024

_MODELS: dict = {}


def _hashed(word: str, dim: int) -> tuple[int, int]:
    """(bucket, sign) of a token."""
    h = hashlib.md5(word.encode()).digest()
    return int.from_bytes(h[:4], "big") % dim, (-1 if h[4] >> 4 & 1 else 1) if word else 0


def _bucket_sums(dim: int):
    """(id, cleaned text) batches -> (id, sums of signs per bucket); a distinct token of a slice is hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                words = pc.split_pattern(part.column(1), " ")
                coded = pc.list_flatten(words).dictionary_encode()
                bucket, sign = np.array([_hashed(w, dim) for w in coded.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2).T
                row, code = pc.list_parent_indices(words).to_numpy(), coded.indices.to_numpy()
                sums = np.bincount(row * dim + bucket[code], weights=sign[code], minlength=part.num_rows * dim).astype(np.int64)
                ends = pa.array(np.arange(0, len(sums) + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(sums))], ["id", "s"])

    return run


def _unit_rows(dim: int):
    """(id, n, sums) batches -> n times (id, dim, x) of the unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, s = batch.column(0), batch.column(2).flatten().to_numpy().reshape(-1, dim).astype(np.float64)
            s[ids.is_null().to_numpy(zero_copy_only=False)] = 0.0
            v = s / np.maximum(np.sqrt((s * s).sum(1)), 1e-12)[:, None]
            upto = np.cumsum(batch.column(1).to_numpy())
            for at in range(0, int(upto[-1]) if len(upto) else 0, _ROWS_AT_ONCE):
                rows = np.searchsorted(upto, np.arange(at, min(at + _ROWS_AT_ONCE, upto[-1])), side="right")
                axis = np.tile(np.arange(1, dim + 1, dtype=np.int32), len(rows))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(rows, dim))), pa.array(axis), pa.array(v[rows].reshape(-1))], ["id", "dim", "x"])

    return run


def hashed_vectors(df: DataFrame, text_col: str = "title", id_col: str = "id", dim: int = DEFAULT_DIM) -> DataFrame:
    """The offline default model: (id, dim, x) with 1-based dims, unit length per id.

    Signed feature hashing: a token's md5 gives its bucket (first eight hex
    digits) and its sign (ninth).  A text of any length leaves its task as one row of
    ``dim`` sums; rows of one id count as one text, and each gets its vector.  A text without
    tokens is the zero vector, as is a row without an id.
    """
    text = F.regexp_replace(F.lower(text_or_empty(F.col(text_col))), r"[^\p{L}\p{N}]+", " ")
    src = df.select(F.col(id_col).alias("id"), text.alias("t"))
    schema = T.StructType([src.schema["id"], T.StructField("s", T.ArrayType(T.LongType()))])
    sums = src.mapInArrow(_bucket_sums(dim), schema).groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(dim)])
    out = T.StructType([src.schema["id"], T.StructField("dim", T.IntegerType()), T.StructField("x", T.DoubleType())])
    return sums.select("id", "n", F.array(*[F.col(f"s{k}") for k in range(dim)]).alias("s")).mapInArrow(_unit_rows(dim), out)


def _model(factory: Callable[[], object], key: str):
    """Model instance of this Python worker (workers are reused across tasks)."""
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def embed_texts(df: DataFrame, text_col: str = "title", id_col: str = "id",
                model_factory: Callable[[], object] | None = None, batch_size: int = BATCH_SIZE,
                out_col: str = "embedding", model_key: str = "model") -> DataFrame:
    """(id, text) -> (id, embedding ARRAY<FLOAT>); null text is embedded as ``''``.

    Without a ``model_factory`` the vectors are ``hashed_vectors``.
    """
    if model_factory is None:
        parts = hashed_vectors(df, text_col, id_col).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("p"))
        return parts.select(F.col("id").alias(id_col), F.transform("p", lambda e: e["x"]).cast("array<float>").alias(out_col))
    factory = model_factory
    src = df.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("_text"))
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType),
                           T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(factory, model_key)
        for pdf in batches:
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s:s + batch_size]
                vecs = model.encode(part["_text"].tolist())
                yield pd.DataFrame({"_id": part["_id"].to_numpy(), out_col: list(vecs)})

    return src.mapInPandas(run, schema).withColumnRenamed("_id", id_col)
