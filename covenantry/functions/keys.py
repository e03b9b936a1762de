"""One row per key in tables of changes, so that a repeated change never multiplies what it meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Columns that tell which of several changes came last; the first one present counts.
ORDER = ("answer_no", "change_no", "decided_at", "created_at")


def order_of(df: DataFrame, columns: list[str]) -> Column:
    """The order of changes: by an order column where there is one, then by value."""
    known = [c for c in ORDER if c in df.columns][:1]
    return F.struct(*known, *(c for c in columns if c not in known))


def last_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order_of(df, rest)).alias("_row")).select(
        *keys, *(F.col("_row")[c].alias(c) for c in rest))
