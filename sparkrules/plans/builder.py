"""Rules from Python: patterns by keyword and field expressions, rendered to the same tree (and text) as rule files."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Any

from sparkrules.plans.ir import Accumulate, Collect, Contains, Delete, Focus, Group, GroupBy, In, Insert, Lit, Matches, Modify, Op, Pattern, Program, Ref, RuleDef, Temporal
from sparkrules.sources.facts import FactType


def _kind(x) -> FactType:
    return x if isinstance(x, FactType) else x.__fact__


class FieldExpr:
    """A field or an expression over fields; comparisons give conditions."""

    __hash__ = object.__hash__

    def __init__(self, node):
        self.node = node

    def _op(self, op, other, swap=False):
        a, b = self.node, node_of(other)
        return FieldExpr(Op(op, (b, a) if swap else (a, b)))

    def __add__(self, o): return self._op("+", o)  # noqa: E704
    def __radd__(self, o): return self._op("+", o, True)  # noqa: E704
    def __sub__(self, o): return self._op("-", o)  # noqa: E704
    def __rsub__(self, o): return self._op("-", o, True)  # noqa: E704
    def __mul__(self, o): return self._op("*", o)  # noqa: E704
    def __rmul__(self, o): return self._op("*", o, True)  # noqa: E704
    def __truediv__(self, o): return self._op("/", o)  # noqa: E704
    def __rtruediv__(self, o): return self._op("/", o, True)  # noqa: E704
    def __mod__(self, o): return self._op("%", o)  # noqa: E704
    def __rmod__(self, o): return self._op("%", o, True)  # noqa: E704
    def __neg__(self): return FieldExpr(Op("neg", (self.node,)))  # noqa: E704
    def __eq__(self, o): return self.is_null() if o is None else self._op("==", o)  # noqa: E704
    def __ne__(self, o): return self.is_not_null() if o is None else self._op("!=", o)  # noqa: E704
    def __lt__(self, o): return self._op("<", o)  # noqa: E704
    def __le__(self, o): return self._op("<=", o)  # noqa: E704
    def __gt__(self, o): return self._op(">", o)  # noqa: E704
    def __ge__(self, o): return self._op(">=", o)  # noqa: E704
    def __and__(self, o): return self._op("and", o)  # noqa: E704
    def __or__(self, o): return self._op("or", o)  # noqa: E704
    def __invert__(self): return FieldExpr(Op("not", (self.node,)))  # noqa: E704
    def __bool__(self): raise TypeError("use & | ~ on conditions")  # noqa: E704
    def is_null(self): return FieldExpr(Op("is_null", (self.node,)))  # noqa: E704
    def is_not_null(self): return FieldExpr(Op("is_not_null", (self.node,)))  # noqa: E704
    def in_(self, *v): return FieldExpr(In(self.node, tuple(map(Lit, v))))  # noqa: E704
    def not_in(self, *v): return FieldExpr(In(self.node, tuple(map(Lit, v)), True))  # noqa: E704
    def matches(self, p): return FieldExpr(Matches(self.node, p))  # noqa: E704
    def contains(self, s): return FieldExpr(Contains(self.node, s))  # noqa: E704


def node_of(x):
    if isinstance(x, FieldExpr):
        return x.node
    if callable(x):
        raise TypeError("rules take no Python functions")
    return Lit(x)


def this(name: str) -> FieldExpr:
    """A field of the pattern it stands in."""
    return FieldExpr(Ref(name))


@dataclass(frozen=True)
class Bound:
    """A bound fact; its attributes are its fields."""

    var: str
    kind: FactType

    def __getattr__(self, name):
        if name.startswith("_") or name not in self.kind.names:
            raise AttributeError(name)
        return FieldExpr(Ref(self.var, name))


def temporal(relation: str, anchor: Bound, *bounds: int) -> FieldExpr:
    return FieldExpr(Temporal(relation, bounds, anchor.var))


def _relation(name):
    return lambda anchor, *bounds: temporal(name, anchor, *bounds)


this_after, this_before, this_coincides, this_meets, this_metby = map(_relation, ("after", "before", "coincides", "meets", "metby"))
this_overlaps, this_overlappedby, this_during, this_includes = map(_relation, ("overlaps", "overlappedby", "during", "includes"))
this_starts, this_startedby, this_finishes, this_finishedby = map(_relation, ("starts", "startedby", "finishes", "finishedby"))


@dataclass(frozen=True)
class Aggregate:
    fn: str
    arg: Any = None
    params: tuple = ()


def sum_(x): return Aggregate("sum", x)  # noqa: E704
def count(x=None): return Aggregate("count", x)  # noqa: E704
def average(x): return Aggregate("average", x)  # noqa: E704
def average_exact(x, scale, mode): return Aggregate("averageExact", x, (scale, mode))  # noqa: E704
def min_(x): return Aggregate("min", x)  # noqa: E704
def max_(x): return Aggregate("max", x)  # noqa: E704
def collect_list(x): return Aggregate("collectList", x)  # noqa: E704
def collect_set(x): return Aggregate("collectSet", x)  # noqa: E704
def window_time(ms): return ("time", ms)  # noqa: E704
def window_length(n): return ("length", n)  # noqa: E704


@dataclass
class Rule:
    """``Rule("name").when(T, this("a") > 5)...then_insert(Out, ...)``; ``when`` returns the bound fact."""

    name: str
    salience: Any = 0
    no_loop: bool = False
    agenda_group: str = "MAIN"
    lhs: list = field(default_factory=list)
    actions: list = field(default_factory=list)

    def __post_init__(self):
        self._n = itertools.count()

    def _pattern(self, kind, tests, entry_point=None, var=None) -> Pattern:
        return Pattern(_kind(kind).name, var, (), tuple(map(node_of, tests)), entry_point)

    def when(self, kind, *tests, entry_point=None) -> Bound:
        var = f"$f{next(self._n)}"
        self.lhs.append(self._pattern(kind, tests, entry_point, var))
        return Bound(var, _kind(kind))

    def when_not(self, kind, *tests, entry_point=None) -> Rule:
        self.lhs.append(Group("not", (self._pattern(kind, tests, entry_point),)))
        return self

    def when_exists(self, kind, *tests, entry_point=None) -> Rule:
        self.lhs.append(Group("exists", (self._pattern(kind, tests, entry_point),)))
        return self

    def when_any(self, *options) -> Rule:
        """Each option is (type, tests...); every option that matches fires."""
        self.lhs.append(Group("or", tuple(self._pattern(o[0], o[1:]) for o in options)))
        return self

    def accumulate(self, kind, *tests, agg: Aggregate, over=None, entry_point=None) -> FieldExpr:
        var = f"$a{next(self._n)}"
        arg = node_of(agg.arg) if agg.arg is not None else None
        self.lhs.append(Accumulate(self._pattern(kind, tests, entry_point), agg.fn, arg, var, agg.params, over))
        return FieldExpr(Ref(var))

    def group_by(self, kind, *tests, key: str, agg: Aggregate) -> tuple[FieldExpr, FieldExpr]:
        k, var = f"$k{next(self._n)}", f"$a{next(self._n)}"
        source = Pattern(_kind(kind).name, None, ((k, key),), tuple(map(node_of, tests)))
        self.lhs.append(GroupBy(source, k, agg.fn, node_of(agg.arg) if agg.arg is not None else None, var, agg.params))
        return FieldExpr(Ref(k)), FieldExpr(Ref(var))

    def collect(self, kind, *tests) -> FieldExpr:
        var = f"$l{next(self._n)}"
        self.lhs.append(Collect(self._pattern(kind, tests), var))
        return FieldExpr(Ref(var))

    def then_insert(self, kind, *args, logical=False, **named) -> Rule:
        kind = _kind(kind)
        values = [*args, *(named[n] for n in kind.names[len(args) :])] if named else args
        self.actions.append(Insert(kind.name, tuple(map(node_of, values)), logical))
        return self

    def then_insert_logical(self, kind, *args, **named) -> Rule:
        return self.then_insert(kind, *args, logical=True, **named)

    def then_modify(self, fact: Bound, **changes) -> Rule:
        self.actions.append(Modify(fact.var, tuple((k, node_of(v)) for k, v in changes.items())))
        return self

    def then_delete(self, fact: Bound) -> Rule:
        self.actions.append(Delete(fact.var))
        return self

    def then_set_focus(self, group: str) -> Rule:
        self.actions.append(Focus(group))
        return self

    def build(self) -> RuleDef:
        return RuleDef(self.name, tuple(self.lhs), tuple(self.actions), node_of(self.salience) if isinstance(self.salience, FieldExpr) else self.salience, self.no_loop, self.agenda_group)

    def to_drl(self) -> str:
        return render(self.build())


def program(*rules) -> Program:
    return Program([r.build() if isinstance(r, Rule) else r for r in rules])


def _text(e) -> str:
    if isinstance(e, Lit):
        if isinstance(e.value, bool):
            return str(e.value).lower()
        if e.value is None:
            return "null"
        if isinstance(e.value, str):
            return '"' + e.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
        return repr(e.value)
    if isinstance(e, Ref):
        return e.name if e.part is None else f"{e.name}.{e.part}"
    if isinstance(e, Op):
        a = [_text(x) for x in e.args]
        if e.op in ("is_null", "is_not_null"):
            return f"{a[0]} {'==' if e.op == 'is_null' else '!='} null"
        if e.op == "not":
            return f"!({a[0]})"
        if e.op in ("and", "or"):
            return f"({a[0]} {'&&' if e.op == 'and' else '||'} {a[1]})"
        if e.op == "neg":
            return f"-({a[0]})"
        if e.op in "+-*/%":
            return f"({a[0]} {e.op} {a[1]})"
        return f"{a[0]} {e.op} {a[1]}"
    if isinstance(e, In):
        return f"{_text(e.arg)} {'not in' if e.negated else 'in'} ({', '.join(map(_text, e.values))})"
    if isinstance(e, Matches):
        return f"{_text(e.arg)} matches {_text(Lit(e.pattern))}"
    if isinstance(e, Contains):
        return f"{_text(e.arg)} contains {_text(Lit(e.needle))}"
    if isinstance(e, Temporal):
        bounds = f"[{', '.join(f'{b}ms' for b in e.bounds)}]" if e.bounds else ""
        return f"this {'not ' if e.negated else ''}{e.relation}{bounds} {e.anchor}"
    raise TypeError(e)


def _condition(c) -> str:
    if isinstance(c, Pattern):
        inner = [f"{v} : {f}" for v, f in c.bindings] + [_text(x) for x in c.conditions]
        entry = f' from entry-point "{c.entry_point}"' if c.entry_point else ""
        return f"{c.var + ' : ' if c.var else ''}{c.type}({', '.join(inner)}){entry}"
    if isinstance(c, Group):
        if c.kind in ("not", "exists"):
            return f"{c.kind} ({' and '.join(map(_condition, c.parts))})"
        return f"({f' {c.kind} '.join(map(_condition, c.parts))})"
    if isinstance(c, (Accumulate, GroupBy)):
        args = [_text(c.arg)] if c.arg is not None else []
        fn = f"{c.fn}({', '.join([*args, *map(str, c.params)])})"
        if isinstance(c, GroupBy):
            return f"groupby({_condition(c.source)}; {c.key}; {c.result} : {fn})"
        over = f" over window:{c.window[0]}({c.window[1]}{'ms' if c.window[0] == 'time' else ''})" if c.window else ""
        tests = f"; {', '.join(map(_text, c.conditions))}" if c.conditions else ""
        return f"accumulate({_condition(c.source)}{over}; {c.result} : {fn}{tests})"
    if isinstance(c, Collect):
        return f"{c.result} : List() from collect({_condition(c.source)})"
    return f"?{c.query}({', '.join(map(_text, c.args))};)"


def _action(a) -> str:
    if isinstance(a, Insert):
        return f"{'insertLogical' if a.logical else 'insert'}(new {a.type}({', '.join(map(_text, a.args))}));"
    if isinstance(a, Delete):
        return f"delete({a.var});"
    if isinstance(a, Focus):
        return f'drools.setFocus("{a.group}");'
    sets = [f"set{f[0].upper()}{f[1:]}({_text(v)})" for f, v in a.changes]
    if not a.tell:
        return f"{a.var}.{sets[0]};"
    return f"modify({a.var}) {{ {', '.join(sets)} }}" if sets else f"update({a.var});"


def render(r: RuleDef) -> str:
    head = [f'rule "{r.name}"']
    if r.salience != 0:
        head.append(f"salience {r.salience}" if isinstance(r.salience, int) else f"salience ({_text(r.salience)})")
    if r.no_loop:
        head.append("no-loop true")
    if r.agenda_group != "MAIN":
        head.append(f'agenda-group "{r.agenda_group}"')
    return "\n".join([*head, "when", *(f"  {_condition(c)}" for c in r.lhs), "then", *(f"  {_action(a)}" for a in r.actions), "end", ""])
