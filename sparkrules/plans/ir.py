"""The tree of rules, queries and conditions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class RuleError(ValueError):
    """A rule that cannot be compiled."""


# --- expressions: values over fields of the own pattern and bound variables


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Ref:
    """A field of the own pattern, or a variable ("$x"), maybe a field of a bound fact ("$p", "name")."""

    name: str
    part: str | None = None


@dataclass(frozen=True)
class Op:
    """Arithmetic (+ - * / % neg), comparison (== != < <= > >=), logic (and or not)."""

    op: str
    args: tuple


@dataclass(frozen=True)
class In:
    arg: Any
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class Matches:
    arg: Any
    pattern: str
    negated: bool = False


@dataclass(frozen=True)
class Contains:
    arg: Any
    needle: str


@dataclass(frozen=True)
class Temporal:
    """The own event to a bound anchor event."""

    relation: str
    bounds: tuple
    anchor: str
    negated: bool = False


# --- conditions


@dataclass(frozen=True)
class Pattern:
    type: str
    var: str | None = None
    bindings: tuple[tuple[str, str], ...] = ()  # variable, field
    conditions: tuple = ()
    entry_point: str | None = None


@dataclass(frozen=True)
class Group:
    """and, or, not, exists over conditions."""

    kind: str
    parts: tuple


@dataclass(frozen=True)
class Accumulate:
    """``fn(arg)`` over the facts of a pattern, one value for each left row."""

    source: Pattern
    fn: str
    arg: Any
    result: str
    params: tuple = ()
    window: tuple | None = None  # ("time", ms) or ("length", n)
    conditions: tuple = ()  # on the result


@dataclass(frozen=True)
class GroupBy:
    """One row for each value of the key variable."""

    source: Pattern
    key: str
    fn: str
    arg: Any
    result: str
    params: tuple = ()


@dataclass(frozen=True)
class Collect:
    """The facts of a pattern as a list, newest first."""

    source: Pattern
    result: str


@dataclass(frozen=True)
class Call:
    """A query as a condition; unbound variables are bound by its rows."""

    query: str
    args: tuple


# --- consequences


@dataclass(frozen=True)
class Insert:
    type: str
    args: tuple
    logical: bool = False


@dataclass(frozen=True)
class Modify:
    var: str
    changes: tuple[tuple[str, Any], ...]
    tell: bool = True  # False: values change, no rule is told


@dataclass(frozen=True)
class Delete:
    var: str


@dataclass(frozen=True)
class Focus:
    group: str


@dataclass(frozen=True)
class RuleDef:
    name: str
    lhs: tuple
    actions: tuple = ()
    salience: Any = 0
    no_loop: bool = False
    agenda_group: str = "MAIN"
    parent: str | None = None

    @property
    def origin(self) -> str:
        return self.parent or self.name


@dataclass(frozen=True)
class QueryDef:
    name: str
    params: tuple[tuple[str, str], ...]  # type, variable
    branches: tuple[tuple, ...]


@dataclass
class Program:
    rules: list[RuleDef] = field(default_factory=list)
    queries: dict[str, QueryDef] = field(default_factory=dict)


def walk(x: Any):
    """All nodes of a tree, tuples opened."""
    if isinstance(x, tuple):
        for y in x:
            yield from walk(y)
        return
    yield x
    if hasattr(x, "__dataclass_fields__"):
        for name in x.__dataclass_fields__:
            yield from walk(getattr(x, name))


def refs(x: Any) -> set[Ref]:
    return {y for y in walk(x) if isinstance(y, Ref)}
