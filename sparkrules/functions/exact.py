"""Exact decimal aggregates: sums without widening surprises, averages rounded once."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("up", "down", "ceiling", "floor", "half_up", "half_down", "half_even")


def exact_sum(x: Column, scale: int) -> Column:
    """Sum as decimal(38, scale); of no values, zero."""
    return F.coalesce(F.sum(x.cast(f"decimal(38,{scale})")), F.lit(0).cast(f"decimal(38,{scale})"))


def average_exact(x: Column, scale_in: int, scale: int, mode: str) -> Column:
    """sum / count of a decimal of ``scale_in`` places, rounded once to ``scale`` places; null of no values."""
    if mode not in MODES:
        raise ValueError(f"rounding mode {mode}")
    wide = "decimal(38,0)"
    unscaled = F.sum((x.cast(f"decimal(38,{scale_in})") * F.lit(Decimal(10**scale_in)).cast(wide)).cast(wide))
    n = F.count(x).cast("decimal(20,0)")
    u = (unscaled * F.lit(Decimal(10 ** max(scale - scale_in, 0))).cast(wide)).cast(wide)
    d = F.when(n > 0, (n * F.lit(Decimal(10 ** max(scale_in - scale, 0))).cast(wide)).cast(wide))
    rest = (u % d).cast(wide)
    # whole, as u - rest is a multiple of d
    q = ((u - rest) / d).cast(wide)
    sign = F.when(u < 0, -1).otherwise(1)
    twice, odd = F.abs(rest) * 2, (q % 2) != 0
    away = {
        "up": rest != 0,
        "down": F.lit(False),
        "ceiling": (rest != 0) & (u > 0),
        "floor": (rest != 0) & (u < 0),
        "half_up": twice >= d,
        "half_down": twice > d,
        "half_even": (twice > d) | ((twice == d) & odd),
    }[mode]
    whole = (q + F.when(away, sign).otherwise(0)).cast(wide)
    return (whole / F.lit(Decimal(10**scale)).cast(wide)).cast(f"decimal(38,{scale})")
