"""Vector column functions on ``ARRAY<FLOAT|DOUBLE>`` (SCL12-SCL16).

Accumulation is in double; storage may stay float32.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """SCL15: sum(a_i * b_i) in double."""
    return F.aggregate(F.zip_with(to_double(a), to_double(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(to_double(v), F.lit(0.0).cast("double"), lambda s, x: s + x * x))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """SCL14: v / max(||v||, eps)."""
    norm = F.greatest(l2_norm(v), F.lit(eps))
    return F.transform(to_double(v), lambda x: x / norm)


def argmax_first(values: Column) -> Column:
    """SCL16: 1-based position of the first maximum."""
    return F.array_position(values, F.array_max(values))


def vec_to_json(v: Column) -> Column:
    """SCL12: vector -> JSON text."""
    return F.to_json(v)


def vec_from_json(text: Column, dim: int | None = None) -> Column:
    """SCL13: JSON text -> ``ARRAY<FLOAT>``; malformed, non-numeric or (when
    ``dim`` is given) wrong-length input -> null."""
    v = F.from_json(text, "array<float>")
    ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull())
    if dim is not None:
        ok = ok & (F.size(v) == dim)
    return F.when(ok, v)
