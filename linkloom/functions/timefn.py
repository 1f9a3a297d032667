"""Time column functions (SCL1-SCL3).

Computed on TIMESTAMP_NTZ with zone-free arithmetic, so results do not depend
on the session time zone (the stored text of the posts is UTC).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def epoch_to_utc(seconds: Column) -> Column:
    """SCL2: epoch seconds -> UTC wall-clock TIMESTAMP_NTZ."""
    return F.timestamp_add("SECOND", seconds.cast("long"), F.expr(EPOCH_NTZ))


def utc_to_epoch(ts: Column) -> Column:
    """UTC TIMESTAMP_NTZ -> whole epoch seconds (floor)."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH_NTZ), ts.cast("timestamp_ntz"))


def epoch_to_iso(seconds: Column) -> Column:
    """SCL1: epoch seconds -> ``YYYY-MM-DDTHH:MM:SS`` (UTC, no zone suffix)."""
    return F.date_format(epoch_to_utc(seconds), ISO_FORMAT)


def hour_of(ts: Column) -> Column:
    """SCL3: hour 0-23."""
    return F.hour(ts)


def weekday_of(ts: Column) -> Column:
    """SCL3: weekday with Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)
