"""The thirteen interval relations of an event B ("this") to an anchor A, as Columns.

Starts and ends are milliseconds; an event without duration has equal ones.
Bounds are inclusive.  A relation with bounds keeps its strict ordering and
adds the distance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: numbers of bounds that each relation takes
ARITY = {
    "after": (2,), "before": (2,), "coincides": (0, 1, 2), "meets": (0, 1), "metby": (0, 1), "overlaps": (0, 1, 2), "overlappedby": (0, 1, 2),
    "during": (0, 1, 2, 4), "includes": (0, 1, 2, 4), "starts": (0, 1), "startedby": (0, 1), "finishes": (0, 1), "finishedby": (0, 1),
}


def _near(x: Column, y: Column, p: tuple) -> Column:
    return x == y if not p else F.abs(x - y) <= p[0]


def _gaps(first: Column, second: Column, p: tuple) -> Column:
    """Distance bounds of the nested relations: none, a maximum, a range, or a range for each end."""
    if not p:
        return F.lit(True)
    if len(p) == 1:
        return (first <= p[0]) & (second <= p[0])
    if len(p) == 2:
        return first.between(p[0], p[1]) & second.between(p[0], p[1])
    return first.between(p[0], p[1]) & second.between(p[2], p[3])


def relation(name: str, bs: Column, be: Column, as_: Column, ae: Column, p: tuple = ()) -> Column:
    if len(p) not in ARITY[name]:
        raise ValueError(f"{name} takes {ARITY[name]} bounds, not {len(p)}")
    if name == "after":
        return (bs - ae).between(*p)
    if name == "before":
        return (as_ - be).between(*p)
    if name == "coincides":
        return _near(bs, as_, p[:1]) & _near(be, ae, p[-1:])
    if name == "meets":
        return _near(be, as_, p)
    if name == "metby":
        return _near(bs, ae, p)
    if name in ("overlaps", "overlappedby"):
        (s1, e1, s2, e2) = (bs, be, as_, ae) if name == "overlaps" else (as_, ae, bs, be)
        inside = (s1 < s2) & (s2 < e1) & (e1 < e2)
        gap = e1 - s2
        return inside if not p else inside & (gap <= p[0]) if len(p) == 1 else inside & gap.between(*p)
    if name == "during":
        return (as_ < bs) & (be < ae) & _gaps(bs - as_, ae - be, p)
    if name == "includes":
        return (bs < as_) & (ae < be) & _gaps(as_ - bs, be - ae, p)
    if name == "starts":
        return _near(bs, as_, p) & (be < ae)
    if name == "startedby":
        return _near(bs, as_, p) & (be > ae)
    if name == "finishes":
        return _near(be, ae, p) & (bs > as_)
    return _near(be, ae, p) & (bs < as_)


#: least and most distance from the start of an anchor to that of the event, whatever the bounds (None: any)
_SPANS = {
    "coincides": (0, 0), "meets": (0, None), "metby": (None, 0), "overlaps": (None, 0), "overlappedby": (0, None), "during": (1, None),
    "includes": (None, 0), "starts": (0, 0), "startedby": (0, 0), "finishes": (0, None), "finishedby": (None, 0),
}


def span(name: str, p: tuple = ()) -> tuple[int | None, int | None]:
    """The least and most distance of the event from its anchor that the relation allows, as far as expiry goes by it."""
    if name == "after":
        return p[0], p[1]
    if name == "before":
        return -p[1], -p[0]
    return _SPANS[name]
