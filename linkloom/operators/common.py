"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest reference table that is broadcast, in bytes of its values.
MAX_BROADCAST_BYTES = 64 << 20
_FIXED_BYTES = 16


def sized_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after checking that its values take at most ``max_bytes``.

    Strings, bytes and arrays count by their length, other columns 16 bytes each.
    Above the bound the plain DataFrame is returned and Spark plans a shuffle
    join (AQE may still switch to broadcast from runtime sizes).
    """
    row = F.lit(_FIXED_BYTES)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        row = row + (F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 16 if kind.startswith("array") else F.lit(_FIXED_BYTES))
    size = df.agg(F.coalesce(F.sum(F.coalesce(row, F.lit(_FIXED_BYTES)).cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= max_bytes else df


def tolerant_int(text: Column) -> Column:
    """SCL10: text -> BIGINT like Python ``int(str)``: surrounding blanks and
    ``_`` digit separators allowed, ``12.0`` / ``x`` / empty -> null."""
    t = F.trim(text)
    ok = t.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    return F.when(ok, F.regexp_replace(t, "_", "").try_cast("bigint"))


def pct(part: Column, whole: Column) -> Column:
    """SCL24: 100 * part / whole, 0 when whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / whole)
