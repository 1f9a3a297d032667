"""Columns that operators add beside a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many ``_`` behind it as it takes to differ from all columns of the table."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)
