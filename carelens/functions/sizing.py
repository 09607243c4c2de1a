"""Broadcast only what is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def broadcast_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint ``df`` for broadcast only when it has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows, so it stays cheap however
    large ``df`` turns out to be; beyond the bound the join is left to the
    planner (sort-merge, or AQE's runtime broadcast under its byte threshold).
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
