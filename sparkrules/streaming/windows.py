"""Windows, expiry and closing pairs over streams: a small state for each key, Arrow batches in and out.

Streams only add events.  A key's rows of a batch are taken in time order, all
at once; a late event is judged against the key's latest time, as in batch by
the clock.  State holds what a window can still need and nothing else.  With
``idle_ms``, a key that has been silent for so long in event time, behind the
latest event of all keys, is forgotten; events that late are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "clock long, times array<long>, values array<double>"
_TIME = "_event_time"


def _stateful(df: DataFrame, key: str, ts: str, value: str, out: str, step: Callable, kind: str = "double", idle_ms: int | None = None) -> DataFrame:
    """``step(clock, times, values, t, v)``: from the state and a sorted batch to the new lists and the outputs."""
    key_type = dict(df.dtypes)[key]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        clock, times, values = state.get if state.exists else (-(2**62), [], [])
        rows = pd.concat(list(batches)).sort_values([ts], kind="stable")
        t, v = rows[ts].to_numpy(np.int64), rows[value].to_numpy(float)
        clocks = np.maximum(np.maximum.accumulate(t), clock)
        times, values, got = step(clocks, np.array(times, np.int64), np.array(values, float), t, v)
        last = int(clocks[-1])
        state.update((last, [int(x) for x in times], [float(x) for x in values]))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(rows), ts: t, value: v, out: got})

    schema = f"`{key}` {key_type}, `{ts}` long, `{value}` double, `{out}` {kind}"
    df, timeout = df.select(key, ts, value), GroupStateTimeout.NoTimeout
    if idle_ms is not None:
        df, timeout = df.withColumn(_TIME, F.timestamp_millis(F.col(ts))).withWatermark(_TIME, f"{idle_ms} milliseconds"), GroupStateTimeout.EventTimeTimeout
    return df.groupBy(key).applyInPandasWithState(run, schema, _STATE, "append", timeout)


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... values."""
    return np.concatenate([[0], np.cumsum(values, dtype=np.longdouble)])


def time_window_sum(df: DataFrame, key: str, ts: str, value: str, n_ms: int, out: str, idle_ms: int | None = None) -> DataFrame:
    """Sum of a key's events younger than ``n_ms`` at each event."""

    def step(clocks, times, values, t, v):
        old, new = _sums(values), _sums(v)  # the state is in order of time, as is the batch
        before = old[-1] - old[np.searchsorted(times, clocks - n_ms, side="right")]
        upto = np.arange(1, len(t) + 1)
        first = np.minimum(np.searchsorted(t, clocks - n_ms, side="right"), upto)
        got = (before + new[upto] - new[first]).astype(float)
        all_t, all_v = np.concatenate([times, t]), np.concatenate([values, v])
        live = all_t + n_ms > clocks[-1]
        order = np.argsort(all_t[live], kind="stable")
        return all_t[live][order], all_v[live][order], got

    return _stateful(df, key, ts, value, out, step, idle_ms=idle_ms)


def length_window_sum(df: DataFrame, key: str, ts: str, value: str, n: int, out: str, idle_ms: int | None = None) -> DataFrame:
    """Sum of a key's last ``n`` events at each event."""

    def step(clocks, times, values, t, v):
        all_t, all_v = np.concatenate([times, t]), np.concatenate([values, v])
        sums, ends = _sums(all_v), np.arange(len(values) + 1, len(all_v) + 1)
        return all_t[-n:], all_v[-n:], (sums[ends] - sums[np.maximum(ends - n, 0)]).astype(float)

    return _stateful(df, key, ts, value, out, step, idle_ms=idle_ms)


def closing(df: DataFrame, key: str, ts: str, dist: str, ttl_ms: int, out: str, idle_ms: int | None = None) -> DataFrame:
    """Whether a key's distance fell since its last event, if that is no older than ``ttl_ms``."""

    def step(clocks, times, values, t, v):
        all_t, all_v = np.concatenate([times, t]), np.concatenate([values, v])
        got = np.concatenate([[False], (all_t[:-1] >= all_t[1:] - ttl_ms) & (all_v[1:] < all_v[:-1])])
        return t[-1:], v[-1:], got[len(times) :]

    return _stateful(df, key, ts, dist, out, step, "boolean", idle_ms)


def live(df: DataFrame, key: str, ts: str, value: str, expires_ms: int, idle_ms: int | None = None) -> DataFrame:
    """A key's events that have not expired when they come, by the key's latest time; a negative span never ends."""

    def step(clocks, times, values, t, v):
        return times, values, np.full(len(t), True) if expires_ms < 0 else t + expires_ms + 1 > clocks

    return _stateful(df, key, ts, value, "#live", step, "boolean", idle_ms).where(F.col("`#live`")).drop("#live")


def temporal_join(left: DataFrame, right: DataFrame, key: str, ts: str, lo_ms: int, hi_ms: int) -> DataFrame:
    """Pairs of a key with right.ts - left.ts in [lo, hi]; both sides are kept no longer than the distance needs.

    Times are positive: a stream's watermark starts at 0.
    """
    side = lambda d, n: d.select(*(F.col(c).alias(f"{n}_{c}") for c in d.columns)).withColumn(f"{n}_time", F.timestamp_millis(F.col(f"{n}_{ts}"))).withWatermark(f"{n}_time", f"{max(abs(lo_ms), abs(hi_ms), 1)} milliseconds")
    a, b = side(left, "a"), side(right, "b")
    gap = lambda ms: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ms / 1000).cast("decimal(18,6)"))
    on = (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col("b_time") >= F.col("a_time") + gap(lo_ms)) & (F.col("b_time") <= F.col("a_time") + gap(hi_ms))
    return a.join(b, on).drop("a_time", "b_time")
