"""Kernels over positions: great-circle distance, candidate pairs, closing pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrules.operators.spread import spread

RADIUS_M = 6_371_000.0
_EPS = 1e-12


def _finite(c: Column, name: str) -> Column:
    bad = F.isnan(c) | (F.abs(c) == math.inf)
    return F.when(bad, F.raise_error(F.lit(f"{name} is not finite")).cast("double")).otherwise(c)


def haversine(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, out: str) -> DataFrame:
    """Metres between two positions in degrees, rounded half away from zero to a long."""
    if out in df.columns:
        raise ValueError(f"the column name {out} is taken")
    a1, o1, a2, o2 = (F.radians(_finite(F.col(c).cast("double"), c)) for c in (lat1, lon1, lat2, lon2))
    s, t = F.sin((a2 - a1) / 2), F.sin((o2 - o1) / 2)
    h = F.least(F.lit(1.0), s * s + F.cos(a1) * F.cos(a2) * t * t)
    return df.withColumn(out, F.round(2 * RADIUS_M * F.asin(F.sqrt(h))).cast("bigint"))


def pair_candidates(df: DataFrame, id: str, lat: str, lon: str, radius_m: float, distance: str | None = None) -> DataFrame:
    """Pairs a < b that can lie within the radius: a sound prune by latitude, then by longitude.

    Positions are compared, each once however many rows stand there, and then
    replaced by their rows; ``distance`` names a column for the metres between
    them, found once for two positions too.  Positions meet by cells: latitude
    bands, and in each band cells of a longitude that is wide enough for it.
    One side stands in its own cell, the other in the nine around it, so the
    comparison is an equi-join with an exact residual.  Bands that the radius
    joins to a pole have one cell.
    """
    theta = radius_m / RADIUS_M
    band = max(theta + _EPS, 1e-6)
    at_lat, at_lon = F.col(lat).cast("double"), F.col(lon).cast("double")
    places = df.select(at_lat.alias("lat"), at_lon.alias("lon")).distinct()
    side = lambda n: places.select(
        F.col("lat").alias(f"y_{n}"), F.col("lon").alias(f"x_{n}"), F.radians(_finite(F.col("lat"), lat)).alias(f"p_{n}"), F.radians(_finite(F.col("lon"), lon)).alias(f"l_{n}")
    )
    rows = lambda n: df.select(F.col(id).alias(f"id_{n}"), at_lat.alias(f"lat_{n}"), at_lon.alias(f"lon_{n}"))
    # cells of a band by the band's number, so that both sides agree: the widest longitude that the radius spans there
    def cells(k: Column) -> Column:
        top_ = F.greatest(F.abs(k * band), F.abs((k + 1) * band)) + theta  # furthest from the equator that a partner in this band can be
        width = F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(theta, math.pi / 2))) / F.greatest(F.cos(top_), F.lit(1e-9)))) + 2 * _EPS
        n = F.floor(2 * math.pi / width)
        return F.when((top_ >= math.pi / 2 - _EPS) | (F.lit(theta) >= math.pi / 2) | (n < 3), F.lit(1)).otherwise(F.least(n, F.lit(2**31)).cast("bigint")).cast("bigint")

    turn = lambda l: F.pmod(l, F.lit(2 * math.pi)) / (2 * math.pi)
    cell = lambda l, n: F.least(F.floor(turn(l) * n), n - 1)
    a = side("a").withColumn("k", F.floor(F.col("p_a") / band)).withColumn("c", cell(F.col("l_a"), cells(F.col("k"))))
    b = side("b").withColumn("k", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("p_b") / band) + d)))
    n = cells(F.col("k"))
    b = b.withColumn("c", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(cell(F.col("l_b"), n) + d, n)))))
    dlat = F.abs(F.col("p_a") - F.col("p_b"))
    top = F.greatest(F.abs(F.col("p_a")), F.abs(F.col("p_b")))
    raw = F.pmod(F.abs(F.col("l_a") - F.col("l_b")), F.lit(2 * math.pi))
    dlon = F.least(raw, 2 * math.pi - raw)
    ratio = F.lit(math.sin(min(theta, math.pi / 2))) / F.cos(top)
    over_pole = (top + theta >= math.pi / 2 - _EPS) | (ratio >= 1) | (F.lit(theta) >= math.pi / 2)
    keep = (dlat <= theta + _EPS) & (over_pole | (dlon <= F.asin(F.least(F.lit(1.0), ratio)) + _EPS))
    # each two positions once, as what follows is the same both ways round
    once = (F.col("y_a") < F.col("y_b")) | ((F.col("y_a") == F.col("y_b")) & (F.col("x_a") <= F.col("x_b")))
    near = a.join(b, ["k", "c"]).where(keep & once).select("y_a", "x_a", "y_b", "x_b")
    if distance:
        near = haversine(near, "y_a", "x_a", "y_b", "x_b", distance)
    near = near.join(rows("a"), (F.col("y_a") == F.col("lat_a")) & (F.col("x_a") == F.col("lon_a")))
    near, other, group = spread(near, rows("b"), [F.col("y_b"), F.col("x_b")], [F.col("lat_b"), F.col("lon_b")])
    same = (F.col("y_a") == F.col("y_b")) & (F.col("x_a") == F.col("x_b"))
    first = F.col("id_a") < F.col("id_b")
    pairs = near.join(other, (F.col("y_b") == F.col("lat_b")) & (F.col("x_b") == F.col("lon_b")) & group & (first | (~same & (F.col("id_a") > F.col("id_b")))))
    ordered = {f"{x}_{n}": F.when(first, F.col(f"{x}_{n}")).otherwise(F.col(f"{x}_{m}")) for n, m in ("ab", "ba") for x in ("id", "lat", "lon")}
    key = F.concat_ws("|", ordered["id_a"].cast("string"), ordered["id_b"].cast("string"))
    return pairs.select(*(c.alias(n) for n, c in ordered.items()), key.alias("key"), *([distance] if distance else []))


def closing(df: DataFrame, ts: str, key: str, dist: str, ttl_ms: int, out: str, order: str | None = None, arrival: str | None = None) -> DataFrame:
    """Whether a key's distance fell since its last row, if that is no older than ``ttl_ms``.

    Rows of a key are in order of time, then of ``order``.  With ``arrival``,
    the column that numbers rows as they came, a time that falls within a key
    is an error.
    """
    w = Window.partitionBy(key).orderBy(ts, *([order] if order else []))
    if arrival:
        w = Window.partitionBy(key).orderBy(arrival)
        back = F.lag(ts).over(w) > F.col(ts)
        df = df.withColumn(ts, F.when(back, F.raise_error(F.concat(F.lit(f"{ts} falls at "), F.col(ts).cast("string")))).otherwise(F.col(ts)).cast(df.schema[ts].dataType))
    fresh = F.lag(ts).over(w) >= F.col(ts) - ttl_ms
    return df.withColumn(out, F.coalesce(fresh & (F.col(dist) < F.lag(dist).over(w)), F.lit(False)))
