"""Conditions to DataFrames.

Every pattern, negation or aggregate becomes a join or aggregation of the
fact frames; nothing runs here.  All column names are unique in a compilation,
so conditions can be placed wherever both sides meet, and Catalyst pushes them
to where they belong.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrules.functions import allen
from sparkrules.functions.exact import average_exact, exact_sum
from sparkrules.operators.numbering import ensure_checkpoint_dir
from sparkrules.operators.spread import spread
from sparkrules.plans.ir import (
    Accumulate, Call, Collect, Contains, Group, GroupBy, In, Lit, Matches, Op, Pattern, QueryDef, Ref, RuleError, Temporal, refs, walk,
)
from sparkrules.sources.facts import FactType

LONG, DOUBLE, STRING, BOOLEAN = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
MOST_STEPS = 1_000_000
_MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass
class World:
    """Fact frames by type: fields, and maybe handle, ep (entry point), ts0 (time at insertion)."""

    spark: SparkSession
    types: dict[str, FactType]
    frames: dict[str, DataFrame]
    queries: dict[str, QueryDef] = field(default_factory=dict)
    clock: int | None = None
    rings: dict[tuple, DataFrame] = field(default_factory=dict)  # members of length windows by (source, window), where they are kept
    strict: bool = False  # whether queries keep to the narrow language of ``check_query``


@dataclass(frozen=True)
class Bound:
    """A variable: a value column, or a fact (``type``) whose columns share a prefix."""

    column: str
    kind: T.DataType | None = None
    type: FactType | None = None


def is_number(k: T.DataType) -> bool:
    return isinstance(k, (T.LongType, T.DoubleType, T.DecimalType))


def literal(value) -> tuple[Column, T.DataType]:
    if isinstance(value, bool):
        return F.lit(value), BOOLEAN
    if isinstance(value, int):
        return F.lit(value).cast("bigint"), LONG
    if isinstance(value, float):
        return F.lit(value), DOUBLE
    if value is None:
        return F.lit(None), T.NullType()
    return F.lit(value), STRING


def wrapped(op: str, a: Column, b: Column) -> Column:
    """64-bit arithmetic that wraps around; the exact path runs on overflow only."""
    quick = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    wide = "decimal(38,0)"
    x, y = a.cast(wide), b.cast(wide)
    two64, two63 = F.lit(Decimal(2**64)).cast(wide), F.lit(Decimal(2**63)).cast(wide)
    if op == "*":  # by halves, as the product of two longs has up to 39 digits
        low = F.pmod(y, F.lit(2**32).cast(wide))
        high = ((y - low) / F.lit(2**32).cast(wide)).cast(wide)
        part = F.pmod((F.pmod((x * high).cast(wide), two64) * F.lit(2**32).cast("decimal(11,0)")).cast(wide), two64)
        full = (part + F.pmod((x * low).cast(wide), two64)).cast(wide)
    else:
        full = (x + y if op == "+" else x - y).cast(wide)
    exact = (F.pmod((full + two63).cast(wide), two64) - two63).cast("bigint")
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(quick, exact))


def arithmetic(op: str, a: tuple, b: tuple) -> tuple[Column, T.DataType]:
    (x, k), (y, m) = a, b
    if not (is_number(k) and is_number(m)):
        raise RuleError(f"{op} takes numbers")
    decimal = isinstance(k, T.DecimalType) or isinstance(m, T.DecimalType)
    if decimal:
        if isinstance(k, T.DoubleType) or isinstance(m, T.DoubleType) or op in "/%":
            raise RuleError("decimals take + - * with decimals and integers")
        to = lambda c, t: c if isinstance(t, T.DecimalType) else c.cast("decimal(19,0)")
        x, y = to(x, k), to(y, m)
        s, t = (q.scale if isinstance(q, T.DecimalType) else 0 for q in (k, m))
        scale = s + t if op == "*" else max(s, t)
        kind = T.DecimalType(38, min(scale, 38))
        return (x + y if op == "+" else x - y if op == "-" else x * y).cast(kind), kind
    if isinstance(k, T.DoubleType) or isinstance(m, T.DoubleType):
        x, y = x.cast("double"), y.cast("double")
        if op == "/":
            nan, inf = F.lit(math.nan), F.lit(math.inf)
            return F.when(y == 0, F.when((x == 0) | F.isnan(x), nan).when(x > 0, inf).when(x < 0, -inf)).otherwise(F.try_divide(x, y)), DOUBLE
        if op == "%":
            return F.when((y == 0) & x.isNotNull(), F.lit(math.nan)).otherwise(F.try_mod(x, y)), DOUBLE
        return (x + y if op == "+" else x - y if op == "-" else x * y), DOUBLE
    if op == "/":
        least = F.lit(-(2**63)).cast("bigint")
        return F.when((y == -1) & (x == least), least).otherwise(F.call_function("div", x, y)), LONG
    if op == "%":
        return F.when(y == -1, F.when(x.isNotNull(), F.lit(0).cast("bigint"))).otherwise(x % y), LONG
    return wrapped(op, x, y), LONG


_REGEX = re.compile(r"(?:\\[.dwsDWS\\*+?()\[\]{}|^$/\-]|[^\\{}^$])*", re.S)


def full_match(pattern: str) -> str:
    """The allowed pattern language: literals, ., classes, groups, |, * + ?."""
    plain = re.sub(r"\[\^", "[", pattern)
    if not _REGEX.fullmatch(plain) or "(?" in plain or re.search(r"[*+?][*+?]", plain):
        raise RuleError(f"the pattern {pattern!r} uses more than literals, ., classes, groups, | and * + ?")
    try:
        re.compile(pattern)
    except re.error as e:
        raise RuleError(f"{pattern!r}: {e}") from None
    return rf"\A(?:{pattern})\z"


class Compilation:
    def __init__(self, world: World, strict: bool = True, given: dict[str, DataFrame] | None = None, first: int = 0):
        self.world, self.strict, self.n, self.given = world, strict, itertools.count(first), given or {}

    # --- values

    def value(self, e, own: dict, env: dict) -> tuple[Column, T.DataType]:
        if isinstance(e, Lit):
            return literal(e.value)
        if isinstance(e, Ref):
            if e.part is None and e.name in own:
                return own[e.name]
            if e.name in env:
                b = env[e.name]
                if e.part is not None:
                    if b.type is None or e.part not in b.type.names:
                        raise RuleError(f"{e.name} has no field {e.part}")
                    return F.col(f"{b.column}{e.part}"), b.type.kind(e.part)
                if b.type is not None:
                    return F.col(f"{b.column}handle"), LONG
                return F.col(b.column), b.kind
            raise RuleError(f"unknown name {e.name}")
        if isinstance(e, Op) and e.op in "+-*/%":
            return arithmetic(e.op, *(self.value(a, own, env) for a in e.args))
        if isinstance(e, Op) and e.op == "neg":
            return arithmetic("-", literal(0), self.value(e.args[0], own, env))
        return self.test(e, own, env), BOOLEAN

    def compare(self, op: str, a: tuple, b: tuple) -> Column:
        (x, k), (y, m) = a, b
        if type(k) is not type(m):
            if not (is_number(k) and is_number(m)):
                raise RuleError(f"{op}: {k.simpleString()} and {m.simpleString()} do not compare")
            kinds = {type(k), type(m)}
            if kinds == {T.DecimalType, T.DoubleType}:
                raise RuleError("a decimal and a double do not compare")
            if kinds == {T.LongType, T.DoubleType}:
                x, y, k, m = x.cast("double"), y.cast("double"), DOUBLE, DOUBLE
        if isinstance(k, T.BooleanType) and op not in ("==", "!="):
            raise RuleError("booleans have no order")
        plain = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if not isinstance(k, T.DoubleType):
            return plain
        if op == "!=":
            return plain | F.isnan(x) | F.isnan(y)
        return plain & ~F.isnan(x) & ~F.isnan(y)

    def test(self, e, own: dict, env: dict) -> Column:
        if isinstance(e, Lit) and isinstance(e.value, bool):
            return F.lit(e.value)
        if isinstance(e, Op):
            if e.op in ("and", "or"):
                a, b = (self.test(x, own, env) for x in e.args)
                return a & b if e.op == "and" else a | b
            if e.op == "not":
                return ~self.test(e.args[0], own, env)
            if e.op in ("is_null", "is_not_null"):
                x = e.args[0]
                if self.strict and isinstance(x, Ref) and x.part is None and x.name in own and not own["#type"].nullable(x.name):
                    raise RuleError(f"{x.name} is never null")
                c = self.value(x, own, env)[0]
                return c.isNull() if e.op == "is_null" else c.isNotNull()
            sides = [self.value(a, own, env) for a in e.args]
            for side, (_, other) in zip(e.args, sides[::-1]):
                self.whole_division(side, other, own, env)
            return self.compare(e.op, *sides)
        if isinstance(e, In):
            x, k = self.value(e.arg, own, env)
            values = [v.value for v in e.values]
            if isinstance(k, T.DoubleType):
                values = [float(v) if isinstance(v, int) else v for v in values]
            got = x.isin(*[F.lit(v) for v in values])
            return ~got if e.negated else got
        if isinstance(e, Matches):
            return self.value(e.arg, own, env)[0].rlike(full_match(e.pattern))
        if isinstance(e, Contains):
            return F.contains(self.value(e.arg, own, env)[0], F.lit(e.needle))
        if isinstance(e, Temporal):
            got = allen.relation(e.relation, *own["#span"], *self.span(e.anchor, env), e.bounds)
            return ~got if e.negated else got
        if isinstance(e, Ref):
            return self.value(e, own, env)[0]
        raise RuleError(f"no condition {e}")

    def whole_division(self, e, other, own: dict, env: dict) -> None:
        """Integers are divided by a literal other than 0, as a whole side compared with an integer."""
        divisions = [x for x in walk(e) if isinstance(x, Op) and x.op in ("/", "%")]
        for x in divisions:
            a, b = (self.value(y, own, env)[1] for y in x.args)
            if not (isinstance(a, T.LongType) and isinstance(b, T.LongType)):
                continue
            if not (isinstance(x.args[1], Lit) and x.args[1].value):
                raise RuleError(f"{x.op} of integers takes a literal divisor other than 0")
            if x.op == "/" and (x is not e or not isinstance(other, T.LongType)):
                raise RuleError("a division of integers stands alone and compares with an integer")

    def span(self, var: str, env: dict) -> tuple[Column, Column]:
        b = env.get(var)
        if b is None or b.type is None or b.type.timestamp is None:
            raise RuleError(f"{var} is no event")
        start = F.col(f"{b.column}ts0")
        return start, start + F.col(f"{b.column}{b.type.duration}") if b.type.duration else start

    # --- patterns

    def source(self, p: Pattern, env: dict) -> tuple[DataFrame, dict, dict, list[Column], list]:
        """The frame under new names, its fields, the pattern's variables, its tests, and those that are temporal."""
        if p.type not in self.world.types:
            raise RuleError(f"no fact type {p.type}")
        kind, prefix = self.world.types[p.type], f"r{next(self.n)}__"
        frame = self.world.frames[p.type]
        if "ep" in frame.columns:
            where = F.col("ep") == p.entry_point if p.entry_point else F.col("ep").isNull()
            frame = frame.where(where)
        extra = [F.col("handle").alias(f"{prefix}handle")] if "handle" in frame.columns else []
        if kind.timestamp:
            ts = F.col("ts0") if "ts0" in frame.columns else F.col(kind.timestamp)
            extra.append(ts.alias(f"{prefix}ts0"))
        frame = frame.select(*(F.col(f"`{n}`").alias(f"{prefix}{n}") for n in kind.names), *extra)
        own = {n: (F.col(f"{prefix}{n}"), kind.kind(n)) for n in kind.names}
        own["#type"] = kind
        own["#prefix"] = prefix
        if kind.timestamp:
            start = F.col(f"{prefix}ts0")
            own["#span"] = (start, start + own[kind.duration][0] if kind.duration else start)
        new: dict[str, Bound] = {}
        if p.var:
            new[p.var] = Bound(prefix, None, kind)
        tests, later = [], []
        for var, name in p.bindings:
            if name not in own:
                raise RuleError(f"{p.type} has no field {name}")
            if var in env or var in new:
                tests.append(self.compare("==", own[name], self.value(Ref(var), {}, env | new)))
            else:
                new[var] = Bound(f"{prefix}{name}", kind.kind(name))
        for c in p.conditions:
            if isinstance(c, Op) and c.op == "positional":
                k, v = c.args
                if k.value >= len(kind.names):
                    raise RuleError(f"{p.type} has {len(kind.names)} fields")
                c = Op("==", (Ref(kind.names[k.value]), v))
            if isinstance(c, Op) and c.op == "==":
                a, b = c.args
                free = [(x, y) for x, y in ((a, b), (b, a)) if isinstance(x, Ref) and x.name.startswith("$") and x.name not in env and x.name not in new and x.part is None]
                if free and isinstance(free[0][1], Ref) and free[0][1].name in own:
                    if self.strict:
                        raise RuleError(f"unknown variable {free[0][0].name}")
                    name = free[0][1].name
                    new[free[0][0].name] = Bound(f"{prefix}{name}", kind.kind(name))
                    continue
            if isinstance(c, Temporal):
                later.append(c)
            tests.append(self.test(c, own, env | new))
        return frame, own, new, tests, later

    def bucketed(self, df: DataFrame, frame: DataFrame, own: dict, env: dict, p: Pattern, temporal: list) -> tuple[DataFrame, DataFrame, list[Column]]:
        """A distance to an anchor as an equality of time buckets, where no other equality joins the sides."""
        equal = any(isinstance(c, Op) and c.op == "==" and any(r.name in env for r in refs(c)) for c in p.conditions)
        near = [t for t in temporal if t.relation in ("after", "before") and not t.negated]
        if equal or not near or df is None:
            return df, frame, []
        t = near[0]
        lo, hi = t.bounds
        width, name = max(1, hi - lo + 1), f"b{next(self.n)}"
        (a_start, a_end), (b_start, b_end) = self.span(t.anchor, env), own["#span"]
        left = a_end if t.relation == "after" else a_start
        first, last = (b_start - hi, b_start - lo) if t.relation == "after" else (b_end + lo, b_end + hi)
        df = df.withColumn(f"{name}l", F.floor(left / width))
        buckets = F.sequence(F.floor(first / width), F.floor(last / width))
        return df, frame.withColumn(f"{name}r", F.explode(buckets)), [F.col(f"{name}l") == F.col(f"{name}r")]

    def all_of(self, tests: list[Column]) -> Column:
        out = F.lit(True)
        for k, t in enumerate(tests):
            out = t if k == 0 else out & t
        return out

    def seed(self, df: DataFrame | None) -> DataFrame:
        return df if df is not None else self.world.spark.range(1).select(F.lit(0).cast("bigint").alias(f"seed{next(self.n)}"))

    def pattern(self, df: DataFrame | None, env: dict, p: Pattern) -> tuple[DataFrame, dict]:
        frame, own, new, tests, temporal = self.source(p, env)
        if df is None:
            return frame.where(self.all_of(tests)) if tests else frame, env | new
        columns = [*df.columns, *frame.columns]
        df, frame, more = self.bucketed(df, frame, own, env, p, temporal)
        if not more:
            df, frame, more = self.dealt(df, frame, own, env, p, tests)
            if more:
                return df.join(frame, self.all_of([*more, *tests])).select(*(F.col(f"`{c}`") for c in columns)), env | new
        tests = more + tests
        return (df.join(frame, self.all_of(tests)) if tests else df.crossJoin(frame)), env | new

    def dealt(self, df: DataFrame, frame: DataFrame, own: dict, env: dict, p: Pattern, tests: list[Column]) -> tuple[DataFrame, DataFrame, list[Column]]:
        """An order between the sides beside equal keys means many partners: they are dealt over tasks, whatever the number of keys."""
        mine = lambda e: bool(refs(e)) and all(r.name in own and r.part is None for r in refs(e))
        outer = lambda e: bool(refs(e)) and all(r.name in env for r in refs(e))
        ties = [c for c in p.conditions if isinstance(c, Op) and any(r.name in env for r in refs(c))]
        if not any(c.op in _MIRROR for c in ties):
            return df, frame, []
        left_on, right_on = [], []
        for a, b in (x.args[::d] for x in ties if x.op == "==" for d in (1, -1)):
            if mine(a) and outer(b):
                (x, k), (y, m) = self.value(a, own, env), self.value(b, own, env)
                if type(k) is not type(m):
                    x, y = x.cast("double"), y.cast("double")
                left_on.append(y)
                right_on.append(x)
        for var, name in p.bindings:
            if var in env:
                (x, k), (y, m) = own[name], self.value(Ref(var), {}, env)
                if type(k) is not type(m):
                    x, y = x.cast("double"), y.cast("double")
                left_on.append(y)
                right_on.append(x)
        if not left_on:
            return df, frame, []
        bound = sum(1 for var, _ in p.bindings if var in env)
        own_only = lambda c: not any(isinstance(x, Temporal) or isinstance(x, Ref) and x.name in env for x in walk(c))
        alone = [t for t, c in zip(tests[bound:], p.conditions) if own_only(c)] if len(tests) == bound + len(p.conditions) else []
        df, frame, group = spread(df, frame.where(self.all_of(alone)) if alone else frame, left_on, right_on)
        return df, frame, [group]

    def exists(self, df: DataFrame | None, env: dict, parts: tuple, negated: bool) -> DataFrame:
        df, how = self.seed(df), "left_anti" if negated else "left_semi"
        if not all(isinstance(p, Pattern) for p in parts):
            columns = df.columns
            found = df
            inner = dict(env)
            for p in parts:
                found, inner = self.step(found, inner, p)
            keys = found.select(*(F.col(f"`{c}`").alias(f"k__{c}") for c in columns)).distinct()
            return df.join(keys, self.all_of([F.col(f"`{c}`").eqNullSafe(F.col(f"`k__{c}`")) for c in columns]), how)
        outer = self.outer_columns(parts, env)
        if not outer:  # one row tells
            inner, inner_env = None, {}
            for p in parts:
                inner, inner_env = self.pattern(inner, inner_env, p)
            return df.join(F.broadcast(inner.select(F.lit(1).alias(f"x{next(self.n)}")).limit(1)), F.lit(True), how)
        if len(parts) > 1:  # members are joined one after another to the values they depend on
            keys = inner = df.select(*(F.col(f"`{c}`") for c in outer)).distinct()
            inner_env = dict(env)
            for p in parts:
                inner, inner_env = self.pattern(inner, inner_env, p)
            found = inner.select(*(F.col(f"`{c}`").alias(f"k__{c}") for c in keys.columns)).distinct()
            return df.join(found, self.all_of([F.col(f"`{c}`").eqNullSafe(F.col(f"`k__{c}`")) for c in outer]), how)
        (p,) = parts
        frame, own, new, tests, temporal = self.source(p, env)
        bound = self.extreme(frame, own, env, p, tests)
        if bound is not None:
            frame, column, hit = bound
            df = df.crossJoin(F.broadcast(frame))  # one row
            return df.where(~F.coalesce(hit, F.lit(False)) if negated else hit).drop(column)
        columns = df.columns
        df, frame, more = self.bucketed(df, frame, own, env, p, temporal)
        if negated and self.world.clock is not None:
            for c in temporal:
                df = self.released(df, env, c)
        return df.join(frame, self.all_of([*more, *tests]), how).select(*(F.col(f"`{c}`") for c in columns))

    def outer_columns(self, parts: tuple, env: dict) -> list[str]:
        """Columns of variables bound before that the patterns depend on."""
        out = []
        for x in walk(parts):
            if isinstance(x, Ref) and x.name in env:
                b = env[x.name]
                out.append(b.column if b.type is None else f"{b.column}{x.part or 'handle'}")
            elif isinstance(x, Temporal) and x.anchor in env:
                b = env[x.anchor]
                out += [f"{b.column}ts0", *([f"{b.column}{b.type.duration}"] if b.type and b.type.duration else [])]
            elif isinstance(x, Pattern):
                out += [env[v].column for v, _ in x.bindings if v in env]
        return list(dict.fromkeys(out))

    def extreme(self, frame: DataFrame, own: dict, env: dict, p: Pattern, tests: list[Column]):
        """Whether a fact lies beyond an outer value: the largest or smallest one tells.  (One row, its column, the test), or None."""
        tied = [c for c in p.conditions if any(r.name in env for r in refs(c))]
        if len(tied) != 1 or len(tests) != len(p.conditions) or not isinstance(tied[0], Op) or tied[0].op not in _MIRROR:
            return None
        (c,) = tied
        for op, (a, b) in ((c.op, c.args), (_MIRROR[c.op], c.args[::-1])):
            if isinstance(a, Ref) and a.part is None and a.name in own and not any(r.name in own and r.part is None for r in refs(b)):
                x, kind = own[a.name]
                rest = [t for d, t in zip(p.conditions, tests) if d is not c]
                if isinstance(kind, T.DoubleType):
                    rest.append(~F.isnan(x))
                name = f"x{next(self.n)}"
                one = (frame.where(self.all_of(rest)) if rest else frame).agg((F.max if op[0] == ">" else F.min)(x).alias(name))
                return one, name, self.compare(op, (F.col(name), kind), self.value(b, {}, env))
        return None

    def released(self, df: DataFrame, env: dict, c: Temporal) -> DataFrame:
        """A negated distance is decided once its window has closed."""
        start, end = self.span(c.anchor, env)
        if c.relation == "after":
            return df.where(end + c.bounds[1] <= self.world.clock)
        if c.relation == "before":
            return df.where(start - min(0, c.bounds[0]) <= self.world.clock)
        return df

    # --- aggregates

    def aggregate(self, fn: str, x: Column | None, kind, order: Column | None, params: tuple, hit: Column) -> tuple[Column, T.DataType, Column | None, bool]:
        """The aggregate, its type, its value of no rows, and whether no value means no row."""
        if fn == "sum":
            if isinstance(kind, T.DecimalType):
                return exact_sum(x, kind.scale), T.DecimalType(38, kind.scale), F.lit(0).cast(f"decimal(38,{kind.scale})"), False
            zero = F.lit(0).cast(kind)
            return F.coalesce(F.sum(x), zero), kind, zero, False
        if fn == "count":
            return F.count(x if x is not None else hit), LONG, F.lit(0).cast("bigint"), False
        if fn == "average":
            if isinstance(kind, T.DecimalType):
                raise RuleError("average of decimals is averageExact")
            return F.avg(x.cast("double")), DOUBLE, None, True
        if fn in ("min", "max"):
            return (F.min if fn == "min" else F.max)(x), kind, None, True
        if fn == "averageExact":
            if not isinstance(kind, T.DecimalType):
                raise RuleError("averageExact takes decimals")
            return average_exact(x, kind.scale, *params), T.DecimalType(38, params[0]), None, True
        empty = F.array().cast(T.ArrayType(kind))
        if fn == "collectSet":
            return F.sort_array(F.collect_set(x)), T.ArrayType(kind), empty, False
        pairs = F.sort_array(F.collect_list(F.when(hit.isNotNull() & x.isNotNull(), F.struct((order if order is not None else x).alias("o"), x.alias("x")))), False)
        return F.transform(pairs, lambda s: s["x"]), T.ArrayType(kind), empty, False

    def windowed(self, frame: DataFrame, own: dict, window: tuple | None, ring: DataFrame | None = None) -> DataFrame:
        if window is None:
            return frame
        prefix = own["#prefix"]
        if window[0] == "time":
            if self.world.clock is None:
                raise RuleError("a time window needs a clock")
            return frame.where(F.col(f"{prefix}ts0") + window[1] > self.world.clock)
        if f"{prefix}handle" not in frame.columns:
            raise RuleError("a length window needs handles")
        if ring is not None:
            return frame.join(ring.select(F.col("handle").alias("#member")), F.col(f"{prefix}handle") == F.col("#member"), "left_semi")
        return frame.orderBy(F.desc(f"{prefix}handle")).limit(window[1])

    def passing(self, p: Pattern) -> DataFrame:
        """Handles of the facts that a pattern without outer variables admits."""
        frame, own, _, tests, _ = self.source(p, {})
        return (frame.where(self.all_of(tests)) if tests else frame).select(F.col(f"{own['#prefix']}handle").alias("handle"))

    def accumulate(self, df: DataFrame | None, env: dict, a: Accumulate | Collect) -> tuple[DataFrame, dict]:
        p = a.source
        ring = self.world.rings.get((p, a.window)) if isinstance(a, Accumulate) else None
        frame, own, new, tests, _ = self.source(p, env)
        prefix = own["#prefix"]
        correlated = [c for c in p.conditions if any(r.name in env for r in refs(c)) or isinstance(c, Temporal)]
        order = F.col(f"{prefix}handle") if f"{prefix}handle" in frame.columns else None
        hit = F.col(f"{prefix}hit")
        frame = frame.withColumn(f"{prefix}hit", F.lit(1))
        if isinstance(a, Collect):
            fields = own["#type"].names
            x = F.struct(*(own[n][0].alias(n) for n in fields))
            fn, kind, params, window = "collectList", T.StructType([T.StructField(n, own[n][1]) for n in fields]), (), None
        else:
            x, kind = self.value(a.arg, own, new) if a.arg is not None else (None, None)
            fn, params, window = a.fn, a.params, a.window
        agg, result, empty, needed = self.aggregate(fn, x, kind, order, params, hit)
        name = f"a{next(self.n)}"
        bound = Bound(name, result)
        if not correlated:
            one = self.windowed(frame.where(self.all_of(tests)) if tests else frame, own, window, ring).agg(agg.alias(name))
            out = one if df is None else df.crossJoin(F.broadcast(one))  # one row
        else:
            df = self.seed(df)
            plain = [t for c, t in zip(self._conditions(p), tests[len(tests) - len(p.conditions) :]) if c not in correlated] + tests[: len(tests) - len(p.conditions)]
            keys = [self._equal_key(c, own, env) for c in correlated]
            frame = self.windowed(frame.where(self.all_of(plain)) if plain else frame, own, window, ring)
            if all(keys):  # aggregate before joining
                grouped = frame.groupBy(*{str(k[0]): F.col(k[0]) for k in keys}.values()).agg(agg.alias(name))
                out = df.join(grouped, self.all_of([self.compare("==", (F.col(k[0]), k[1]), k[2]) for k in keys]), "left").select(*(F.col(f"`{c}`") for c in df.columns), F.col(name))
                if empty is not None:
                    out = out.withColumn(name, F.coalesce(name, empty))
            else:
                # equal left rows are aggregated once, and each of them has the result
                copies, names = f"n{next(self.n)}", [F.col(f"`{c}`") for c in df.columns]
                once = df.groupBy(*names).agg(F.count("*").alias(copies))
                joined = once.join(frame, self.all_of([t for c, t in zip(self._conditions(p), tests[len(tests) - len(p.conditions) :]) if c in correlated]), "left")
                out = joined.groupBy(*names, copies).agg(agg.alias(name))
                out = out.withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).drop(copies)
        if needed:
            out = out.where(F.col(name).isNotNull())
        env = env | {a.result: bound}
        for c in getattr(a, "conditions", ()):
            out = out.where(self.test(c, {}, env))
        return out, env

    @staticmethod
    def _conditions(p: Pattern) -> tuple:
        return p.conditions

    def _equal_key(self, c, own: dict, env: dict):
        """(own column, its type, the outer value) of an equality with an outer value."""
        if isinstance(c, Op) and c.op == "==":
            for a, b in (c.args, c.args[::-1]):
                if isinstance(a, Ref) and a.part is None and a.name in own and all(r.name in env for r in refs(b)):
                    return f"{own['#prefix']}{a.name}", own[a.name][1], self.value(b, {}, env)
        return None

    def groupby(self, df: DataFrame | None, env: dict, g: GroupBy) -> tuple[DataFrame, dict]:
        frame, own, new, tests, _ = self.source(g.source, {})
        prefix = own["#prefix"]
        frame = (frame.where(self.all_of(tests)) if tests else frame).withColumn(f"{prefix}hit", F.lit(1))
        x, kind = self.value(g.arg, own, new) if g.arg is not None else (None, None)
        order = F.col(f"{prefix}handle") if f"{prefix}handle" in frame.columns else None
        agg, result, _, needed = self.aggregate(g.fn, x, kind, order, g.params, F.col(f"{prefix}hit"))
        key, name = new[g.key], f"a{next(self.n)}"
        out = frame.groupBy(F.col(key.column)).agg(agg.alias(name))
        if needed:
            out = out.where(F.col(name).isNotNull())
        out = out if df is None else df.crossJoin(out)
        return out, env | {g.key: Bound(key.column, key.kind), g.result: Bound(name, result)}

    # --- queries

    def call(self, df: DataFrame | None, env: dict, c: Call) -> tuple[DataFrame, dict]:
        if c.query in self.given:
            rows = self.given[c.query]
            params = [(v, rows.schema[v.lstrip("$")].dataType) for _, v in self.world.queries[c.query].params]
        else:
            rows, params = query_rows(self.world, c.query)
        if len(params) != len(c.args):
            raise RuleError(f"{c.query} takes {len(params)} arguments")
        prefix = f"q{next(self.n)}__"
        rows = rows.select(*(F.col(v.lstrip("$")).alias(f"{prefix}{v.lstrip('$')}") for v, _ in params))
        tests, new = [], {}
        for (v, kind), a in zip(params, c.args):
            mine = F.col(f"{prefix}{v.lstrip('$')}")
            if isinstance(a, Ref) and a.part is None and a.name not in env:
                if a.name in new:
                    tests.append(self.compare("==", (mine, kind), (F.col(new[a.name].column), kind)))
                else:
                    new[a.name] = Bound(f"{prefix}{v.lstrip('$')}", kind)
            else:
                tests.append(self.compare("==", (mine, kind), self.value(a, {}, env)))
        if df is None:
            return rows.where(self.all_of(tests)) if tests else rows, env | new
        return (df.join(rows, self.all_of(tests)) if tests else df.crossJoin(rows)), env | new

    # --- conjunctions

    def step(self, df: DataFrame | None, env: dict, ce) -> tuple[DataFrame, dict]:
        if isinstance(ce, Pattern):
            return self.pattern(df, env, ce)
        if isinstance(ce, Group) and ce.kind in ("not", "exists"):
            return self.exists(df, env, ce.parts, ce.kind == "not"), env
        if isinstance(ce, Group) and ce.kind == "exists_any":
            rest, found = self.seed(df), None
            for parts in ce.parts:
                got = self.exists(rest, env, parts, False)
                found = got if found is None else found.unionByName(got)
                rest = self.exists(rest, env, parts, True)
            return found, env
        if isinstance(ce, Group) and ce.kind == "and":
            for p in ce.parts:
                df, env = self.step(df, env, p)
            return df, env
        if isinstance(ce, (Accumulate, Collect)):
            return self.accumulate(df, env, ce)
        if isinstance(ce, GroupBy):
            return self.groupby(df, env, ce)
        if isinstance(ce, Call):
            return self.call(df, env, ce)
        raise RuleError(f"no condition {ce}")

    def lhs(self, parts: tuple, env: dict | None = None) -> tuple[DataFrame, dict]:
        df, env = None, dict(env or {})
        for ce in parts:
            df, env = self.step(df, env, ce)
        return self.seed(df), env


def named(df: DataFrame, env: dict, names: list[str] | None = None) -> DataFrame:
    """The value variables of a match (all, or those named) under their names, facts as their handles."""
    out = []
    for var, b in env.items():
        name = var.lstrip("$")
        if names is not None and name not in names:
            continue
        if b.type is None:
            out.append(F.col(b.column).alias(name))
        elif f"{b.column}handle" in df.columns:
            out.append(F.col(f"{b.column}handle").alias(name))
    return df.select(*out)


def match(world: World, lhs: tuple, names: list[str] | None = None) -> DataFrame:
    """All matches of a conjunction (its alternatives one after another)."""
    from sparkrules.plans.normalize import branches, check_facts

    found = None
    for b in check_facts(branches(lhs), "conditions"):
        got = named(*Compilation(world).lhs(b), names)
        found = got if found is None else found.unionByName(got, allowMissingColumns=True)
    return found


def _calls(parts: tuple, name: str) -> bool:
    return any(isinstance(x, Call) and x.query == name for x in walk(parts))


def _branch(world: World, q: QueryDef, parts: tuple, given=None) -> DataFrame:
    df, env = Compilation(world, strict=False, given=given).lhs(parts)
    out = []
    for kind, var in q.params:
        if var not in env:
            raise RuleError(f"{q.name}: the parameter {var} is not used in every alternative")
    for var, b in env.items():
        name = var.lstrip("$")
        if b.type is None:
            out.append(F.col(b.column).alias(name))
        elif f"{b.column}handle" in df.columns:
            out.append(F.col(f"{b.column}handle").alias(name))
    return df.select(*out)


def check_query(world: World, q: QueryDef) -> None:
    """What a query's body may not hold: types with nulls or decimals, time, arithmetic, grouped conditions, literals of another type."""
    for x in walk(q.branches):
        if not isinstance(x, Pattern) or x.type not in world.types:
            continue
        kind = world.types[x.type]
        if any(nullable for _, _, nullable in kind.fields):
            raise RuleError(f"query {q.name}: {x.type} has nullable fields")
        if any(t.startswith("decimal") for _, t, _ in kind.fields):
            raise RuleError(f"query {q.name}: {x.type} has decimal fields")
        for c in x.conditions:
            if any(isinstance(y, Temporal) for y in walk(c)):
                raise RuleError(f"query {q.name}: a condition of time")
            if isinstance(c, Op) and c.op in ("and", "or", "not"):
                raise RuleError(f"query {q.name}: a group of conditions")
            if any(isinstance(y, Op) and y.op in ("+", "-", "*", "/", "%") for y in walk(c)):
                raise RuleError(f"query {q.name}: arithmetic")
            if isinstance(c, Op) and len(c.args) == 2:
                for f, v in (c.args, c.args[::-1]):
                    if isinstance(f, Ref) and f.part is None and f.name in kind.names and isinstance(v, Lit) and v.value is not None and literal(v.value)[1] != kind.kind(f.name):
                        raise RuleError(f"query {q.name}: {f.name} and its literal are of different types")


def _union(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        keep = [c for c in p.columns if c in rows.columns]
        rows = rows.unionByName(p.select(*keep), allowMissingColumns=True)
    return rows


def _needed(world: World, q: QueryDef, at: int, value) -> DataFrame:
    """Values of parameter ``at`` that the recursion from ``value`` comes to: those that its own call passes on, and so on."""
    before = tuple(x for x in q.branches[1] if not (isinstance(x, Call) and x.query == q.name))
    (call,) = (x for x in q.branches[1] if isinstance(x, Call) and x.query == q.name)
    df, env = Compilation(world, strict=False).lhs(before)
    var, passed = q.params[at][1], call.args[at]
    comp = Compilation(world)
    edges = df.select(F.col(env[var].column).alias("a"), comp.value(passed, {}, env)[0].alias("b")).distinct().checkpoint()
    front = found = world.spark.createDataFrame([(value,)], T.StructType([T.StructField("v", edges.schema["a"].dataType)]))
    for _ in range(MOST_STEPS):
        front = edges.join(front, F.col("a") == F.col("v")).select(F.col("b").alias("v")).distinct().join(found, "v", "left_anti").checkpoint()
        if front.isEmpty():
            return found
        found = found.unionByName(front).checkpoint()
    raise RuleError(f"{q.name}: step limit of {MOST_STEPS} reached")


def _restrictions(world: World, q: QueryDef, bound: dict[int, Any]) -> list[Callable[[DataFrame], DataFrame]]:
    """Filters that keep the rows of a recursion that bound arguments can reach."""
    (call,) = (x for x in q.branches[1] if isinstance(x, Call) and x.query == q.name)
    out = []
    for k, value in bound.items():
        var = q.params[k][1]
        name, passed = var.lstrip("$"), call.args[k]
        if passed == Ref(var):  # the same at every step
            out.append(lambda df, name=name, value=value: df.where(F.col(name) == F.lit(value)))
            continue
        known = {b for x in q.branches[1] if isinstance(x, Pattern) for b in (*(v for v, _ in x.bindings), *(r.name for c in x.conditions for r in refs(c)))}
        if var in known and isinstance(passed, Ref) and passed.name in known:
            needed = _needed(world, q, k, value)
            out.append(lambda df, name=name, needed=needed: df.join(needed, F.col(name) == F.col("v"), "left_semi"))
    return out


def query_rows(world: World, name: str, bound: dict[int, Any] | None = None) -> tuple[DataFrame, list]:
    """All rows of a query (one for each proof), and its parameters with their types.

    ``bound``: values of arguments; a recursion is then kept to what they can reach, its rows may still hold others.
    """
    from sparkrules.plans.normalize import expand_query

    if name not in world.queries:
        raise RuleError(f"no query {name}")
    q = expand_query(world.queries[name])
    if world.strict:
        check_query(world, q)
    own = [_calls(b, name) for b in q.branches]
    if not any(own):
        rows = _union([_branch(world, q, b) for b in q.branches])
    else:
        if own != [False, True]:
            raise RuleError(f"{name}: a recursive query has two alternatives, the base first")
        if isinstance(q.branches[1][0], Call):
            raise RuleError(f"{name}: the recursive call may not come first")
        params = [v.lstrip("$") for _, v in q.params]
        ensure_checkpoint_dir(world.spark)
        limits = _restrictions(world, q, bound or {})

        def limited(df: DataFrame) -> DataFrame:
            df = df.select(*params)
            for f in limits:
                df = f(df)
            return df.checkpoint()

        delta = rows = limited(_branch(world, q, q.branches[0]))
        total, steps = delta.count(), 0
        while True:
            delta = limited(_branch(world, q, q.branches[1], {name: delta}))
            n = delta.count()
            if not n:
                break
            total += n
            steps += 1
            # a proof longer than the number of distinct rows passes through one of them twice
            if steps >= 8 and steps & (steps - 1) == 0 and rows.distinct().count() < steps:
                total = MOST_STEPS + 1
            if total > MOST_STEPS:
                raise RuleError(f"{name}: step limit of {MOST_STEPS} reached; is the data cyclic?")
            rows = rows.unionByName(delta)
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows, [(v, kinds[v.lstrip("$")]) for _, v in q.params]


def run_query(world: World, name: str, *args) -> DataFrame:
    """Rows of a query; an argument of None is unbound, others filter."""
    if name in world.queries and len(args) != len(world.queries[name].params):
        raise RuleError(f"{name} takes {len(world.queries[name].params)} arguments, not {len(args)}")
    rows, params = query_rows(world, name, {k: a for k, a in enumerate(args) if a is not None})
    for (v, kind), a in zip(params, args):
        if a is not None:
            ok = isinstance(a, bool) == isinstance(kind, T.BooleanType) and isinstance(a, {LONG: int, DOUBLE: (int, float), STRING: str, BOOLEAN: bool}.get(kind, object))
            if not ok:
                raise RuleError(f"{name}: {v} takes {kind.simpleString()}")
            rows = rows.where(F.col(v.lstrip("$")) == F.lit(a))
    return rows
