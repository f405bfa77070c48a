"""Row-wise expressions with strict types and loud errors, compiled to Columns.

``col("a") * 2`` builds a tree; ``with_columns`` and ``filter`` check it against
the input's schema before anything runs.  Types: long ("i64"), double ("f64"),
string ("str"), boolean ("bool").  Doubles follow IEEE (NaN differs from itself,
x/0 is infinite), integers raise on overflow, functions raise outside their
domain.  All is built-in Column code, so it stays in whole-stage codegen.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

I64, F64, STR, BOOL = "i64", "f64", "str", "bool"
MOST_DEPTH = 256
_TYPES = {I64: "bigint", F64: "double", STR: "string", BOOL: "boolean"}


class ExprError(TypeError):
    """An expression that does not fit the input's schema."""


@dataclass(frozen=True, eq=False)
class Expr:
    op: str
    args: tuple = ()
    value: Any = None

    def _bin(self, op, other, swap=False):
        other = wrap(other)
        return Expr(op, (other, self) if swap else (self, other))

    def __add__(self, o): return self._bin("+", o)  # noqa: E704
    def __radd__(self, o): return self._bin("+", o, True)  # noqa: E704
    def __sub__(self, o): return self._bin("-", o)  # noqa: E704
    def __rsub__(self, o): return self._bin("-", o, True)  # noqa: E704
    def __mul__(self, o): return self._bin("*", o)  # noqa: E704
    def __rmul__(self, o): return self._bin("*", o, True)  # noqa: E704
    def __truediv__(self, o): return self._bin("/", o)  # noqa: E704
    def __rtruediv__(self, o): return self._bin("/", o, True)  # noqa: E704
    def __floordiv__(self, o): return self._bin("//", o)  # noqa: E704
    def __rfloordiv__(self, o): return self._bin("//", o, True)  # noqa: E704
    def __mod__(self, o): return self._bin("%", o)  # noqa: E704
    def __rmod__(self, o): return self._bin("%", o, True)  # noqa: E704
    def __pow__(self, o): return self._bin("**", o)  # noqa: E704
    def __rpow__(self, o): return self._bin("**", o, True)  # noqa: E704
    def __eq__(self, o): return self._bin("==", o)  # noqa: E704
    def __ne__(self, o): return self._bin("!=", o)  # noqa: E704
    def __lt__(self, o): return self._bin("<", o)  # noqa: E704
    def __le__(self, o): return self._bin("<=", o)  # noqa: E704
    def __gt__(self, o): return self._bin(">", o)  # noqa: E704
    def __ge__(self, o): return self._bin(">=", o)  # noqa: E704
    def __and__(self, o): return self._bin("&", o)  # noqa: E704
    def __or__(self, o): return self._bin("|", o)  # noqa: E704
    def __invert__(self): return Expr("~", (self,))  # noqa: E704
    def __neg__(self): return Expr("neg", (self,))  # noqa: E704
    def __abs__(self): return Expr("abs", (self,))  # noqa: E704
    __hash__ = object.__hash__

    def __bool__(self):
        raise ExprError("use & | ~ on expressions, not and/or/not")

    def _fn(self, op, *args, value=None):
        return Expr(op, (self, *map(wrap, args)), value)

    def is_null(self): return self._fn("is_null")  # noqa: E704
    def is_not_null(self): return self._fn("is_not_null")  # noqa: E704
    def fill_null(self, v): return self._fn("fill_null", v)  # noqa: E704
    def cast(self, to): return self._fn("cast", value=to)  # noqa: E704
    def round(self, n=0): return self._fn("round", value=n)  # noqa: E704
    def str_len(self): return self._fn("str_len")  # noqa: E704
    def str_contains(self, s): return self._fn("str_contains", s)  # noqa: E704
    def str_starts_with(self, s): return self._fn("str_starts_with", s)  # noqa: E704
    def str_ends_with(self, s): return self._fn("str_ends_with", s)  # noqa: E704
    def regexp_matches(self, p): return self._fn("regexp_matches", value=p)  # noqa: E704
    def regexp_full_match(self, p): return self._fn("regexp_full_match", value=p)  # noqa: E704


MATH = ("floor", "ceil", "sqrt", "sin", "cos", "tan", "asin", "acos", "atan", "ln", "log10", "exp", "degrees", "radians")
for _name in MATH:
    setattr(Expr, _name, (lambda n: lambda self: self._fn(n))(_name))


def col(name: str) -> Expr:
    return Expr("col", value=name)


def lit(value) -> Expr:
    if value is None or isinstance(value, float) and not math.isfinite(value):
        raise ExprError(f"{value} is no literal")
    if not isinstance(value, (bool, int, float, str)):
        raise ExprError(f"no literal of type {type(value).__name__}")
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        raise ExprError("an integer literal beyond 64 bits")
    return Expr("lit", value=value)


def wrap(value) -> Expr:
    return value if isinstance(value, Expr) else lit(value)


def if_else(cond, then, other) -> Expr:
    return Expr("if_else", (wrap(cond), wrap(then), wrap(other)))


def concat(*parts) -> Expr:
    return Expr("concat", tuple(map(wrap, parts)))


def _type_of(kind: T.DataType, name: str) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return I64
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F64
    if isinstance(kind, T.StringType):
        return STR
    if isinstance(kind, T.BooleanType):
        return BOOL
    raise ExprError(f"column {name} has the unsupported type {kind.simpleString()}")


def _promote(a: str, b: str, what: str) -> str:
    if a == b:
        return a
    if {a, b} == {I64, F64}:
        return F64
    raise ExprError(f"{what}: {a} and {b} do not mix")


def _raise(text: str, kind: str) -> Column:
    return F.raise_error(F.lit(text)).cast(_TYPES[kind])


def checked_regex(pattern: str) -> str:
    """Reject look-around and back references, whose cost is not linear."""
    if re.search(r"\(\?(=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?}]\+", pattern):
        raise ExprError(f"look-around, back references and possessive repeats are not allowed: {pattern}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ExprError(f"{pattern}: {e}") from None
    return pattern


_DOMAIN = {
    "sqrt": lambda x: x < 0, "sin": lambda x: F.abs(x) == math.inf, "cos": lambda x: F.abs(x) == math.inf, "tan": lambda x: F.abs(x) == math.inf,
    "asin": lambda x: F.abs(x) > 1, "acos": lambda x: F.abs(x) > 1, "ln": lambda x: x <= 0, "log10": lambda x: x <= 0,
}


class Compiler:
    def __init__(self, schema: T.StructType):
        self.kinds = {f.name: f.dataType for f in schema}

    def run(self, e: Expr, depth: int = 0) -> tuple[Column, str]:
        if depth > MOST_DEPTH:
            raise ExprError(f"an expression deeper than {MOST_DEPTH}")
        if e.op == "col":
            if e.value not in self.kinds:
                raise ExprError(f"no input column {e.value}")
            kind = _type_of(self.kinds[e.value], e.value)
            return F.col(f"`{e.value}`").cast(_TYPES[kind]), kind
        if e.op == "lit":
            kind = BOOL if isinstance(e.value, bool) else I64 if isinstance(e.value, int) else F64 if isinstance(e.value, float) else STR
            return F.lit(e.value).cast(_TYPES[kind]), kind
        got = [self.run(a, depth + 1) for a in e.args]
        return self.apply(e, [c for c, _ in got], [k for _, k in got])

    def apply(self, e: Expr, c: list[Column], k: list[str]) -> tuple[Column, str]:
        op = e.op

        def need(*kinds):
            for x in k:
                if x not in kinds:
                    raise ExprError(f"{op} does not take {x}")

        if op in ("+", "-", "*"):
            need(I64, F64)
            kind = _promote(*k, op)
            a, b = (x.cast(_TYPES[kind]) for x in c)
            return (a + b if op == "+" else a - b if op == "-" else a * b), kind
        if op == "/":
            need(I64, F64)
            a, b = (x.cast("double") for x in c)
            nan, inf = F.lit(math.nan), F.lit(math.inf)
            negative = (a < 0) != (b.cast("string") == "-0.0")
            zero = F.when(a.isNull(), F.lit(None).cast("double")).when((a == 0) | F.isnan(a), nan).when(negative, -inf).otherwise(inf)
            return F.when(b == 0, zero).otherwise(F.try_divide(a, b)), F64
        if op == "//":
            need(I64)
            floor = F.call_function("div", c[0], c[1])
            least = F.lit(-(2**63)).cast("bigint")
            return F.when((c[0] == least) & (c[1] == -1), _raise("integer overflow in //", I64)).otherwise(floor), I64
        if op == "%":
            need(I64, F64)
            kind = _promote(*k, op)
            a, b = (x.cast(_TYPES[kind]) for x in c)
            if kind == F64:
                return F.when((b == 0) & a.isNotNull(), F.lit(math.nan)).otherwise(F.try_mod(a, b)), F64
            return F.when(b == -1, F.when(a.isNotNull(), F.lit(0).cast("bigint"))).otherwise(a % b), I64
        if op == "**":
            need(I64, F64)
            return F.pow(c[0].cast("double"), c[1].cast("double")), F64
        if op in ("neg", "abs"):
            need(I64, F64)
            return (-c[0] if op == "neg" else F.abs(c[0])), k[0]
        if op in ("==", "!=", "<", "<=", ">", ">="):
            kind = _promote(*k, op)
            if kind == BOOL and op not in ("==", "!="):
                raise ExprError("booleans have no order")
            a, b = (x.cast(_TYPES[kind]) for x in c)
            plain = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
            if kind != F64:
                return plain, BOOL
            nan = F.isnan(a) | F.isnan(b)
            return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(nan, F.lit(op == "!=")).otherwise(plain), BOOL
        if op in ("&", "|", "~"):
            need(BOOL)
            return (~c[0] if op == "~" else c[0] & c[1] if op == "&" else c[0] | c[1]), BOOL
        if op in ("is_null", "is_not_null"):
            return (c[0].isNull() if op == "is_null" else c[0].isNotNull()), BOOL
        if op == "fill_null":
            kind = _promote(*k, op)
            return F.coalesce(*(x.cast(_TYPES[kind]) for x in c)), kind
        if op == "if_else":
            if k[0] != BOOL:
                raise ExprError("if_else takes a boolean condition")
            kind = _promote(k[1], k[2], op)
            return F.when(c[0], c[1].cast(_TYPES[kind])).otherwise(c[2].cast(_TYPES[kind])), kind
        if op == "cast":
            need(I64, F64)
            if e.value == F64:
                return c[0].cast("double"), F64
            if e.value != I64:
                raise ExprError("cast takes i64 or f64")
            return (F.rint(c[0]).cast("bigint") if k[0] == F64 else c[0]), I64
        if op == "round":
            need(I64, F64)
            if k[0] == I64 and e.value != 0:
                raise ExprError("round of an integer takes 0 places")
            if k[0] == I64:
                return c[0], I64
            special = F.isnan(c[0]) | (F.abs(c[0]) == math.inf)
            return F.when(special, c[0]).otherwise(F.round(c[0], e.value)), F64
        if op in ("floor", "ceil"):
            need(I64, F64)
            if k[0] == I64:
                return c[0], I64
            whole = ~(F.abs(c[0]) < 2.0**52)  # NaN and infinities too
            return F.when(whole, c[0]).otherwise((F.floor(c[0]) if op == "floor" else F.ceil(c[0])).cast("double")), F64
        if op in MATH:
            need(I64, F64)
            x = c[0].cast("double")
            got = getattr(F, op)(x)
            if op in _DOMAIN:
                bad = _DOMAIN[op](x) & ~F.isnan(x)
                got = F.when(bad, _raise(f"{op} outside its domain", F64)).when(F.isnan(x), x).otherwise(got)
            return got, F64
        need(STR)
        if op == "str_len":
            return F.octet_length(c[0]).cast("bigint"), I64
        if op == "concat":
            return F.concat(*c), STR
        if op in ("str_contains", "str_starts_with", "str_ends_with"):
            return {"str_contains": F.contains, "str_starts_with": F.startswith, "str_ends_with": F.endswith}[op](*c), BOOL
        if op in ("regexp_matches", "regexp_full_match"):
            pattern = checked_regex(e.value)
            return c[0].rlike(f"(?U){pattern}" if op == "regexp_matches" else rf"(?U)\A(?:{pattern})\z"), BOOL
        raise ExprError(f"no function {op}")


def with_columns(df: DataFrame, **named: Expr) -> DataFrame:
    """``df`` and the named expressions, which see the input columns only."""
    compiler = Compiler(df.schema)
    out = []
    for name, e in named.items():
        if name == "handle" or name in df.columns:
            raise ExprError(f"the column name {name} is taken")
        out.append(compiler.run(wrap(e))[0].alias(name))
    return df.select("*", *out)


def filter(df: DataFrame, predicate: Expr) -> DataFrame:  # noqa: A001
    """Rows for which the predicate is true."""
    if not isinstance(predicate, Expr):
        raise ExprError("filter takes an expression")
    c, kind = Compiler(df.schema).run(predicate)
    if kind != BOOL:
        raise ExprError("filter takes a boolean expression")
    return df.filter(c)
