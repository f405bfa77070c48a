"""Sliding windows in batch: state at a clock, and replay at every event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_time_window(df: DataFrame, ts: str, n_ms: int, clock: int) -> DataFrame:
    """Members of a time window at ``clock``: younger than ``n_ms``; later events count."""
    return df.where(F.col(ts) + n_ms > clock)


def replay_time_window(df: DataFrame, keys: list[str], ts: str, n_ms: int, agg: Column, out: str) -> DataFrame:
    """The window's aggregate at the time of each event (all events of that time included)."""
    w = Window.partitionBy(*keys).orderBy(ts).rangeBetween(-(n_ms - 1), 0)
    return df.withColumn(out, agg.over(w))


def in_length_window(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    if not keys:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def live_at(df: DataFrame, ts: str, expires_ms: int, clock: int, dur: str | None = None) -> DataFrame:
    """Events that have not expired: gone once the clock reaches ts + duration + expires + 1; a negative span never ends."""
    if expires_ms < 0:
        return df
    end = F.col(ts) + (F.col(dur) if dur else F.lit(0)) + expires_ms + 1
    return df.where(end > clock)
