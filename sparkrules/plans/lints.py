"""Checks of a program before it runs: unstratified negation, logical cycles, self-feeding updates, expiry against windows."""

from __future__ import annotations

from sparkrules.functions.allen import span
from sparkrules.plans.ir import Accumulate, Collect, Delete, Group, GroupBy, In, Insert, Lit, Modify, Op, Pattern, Program, Ref, RuleDef, Temporal, refs, walk


def reads(rule: RuleDef) -> tuple[set[str], set[str]]:
    """Types read positively and negatively (under not, or through an aggregate)."""
    plus, minus = set(), set()

    def visit(x, negative):
        if isinstance(x, tuple):
            for y in x:
                visit(y, negative)
        elif isinstance(x, Pattern):
            (minus if negative else plus).add(x.type)
        elif isinstance(x, Group):
            visit(x.parts, negative or x.kind == "not")
        elif isinstance(x, (Accumulate, Collect, GroupBy)):
            minus.add(x.source.type)

    visit(rule.lhs, False)
    return plus, minus


def writes(rule: RuleDef) -> set[str]:
    out, types = set(), {p.var: p.type for p in walk(rule.lhs) if isinstance(p, Pattern) and p.var}
    for a in rule.actions:
        if isinstance(a, Insert):
            out.add(a.type)
        elif isinstance(a, (Modify, Delete)) and a.var in types:
            out.add(types[a.var])
    return out


def _closure(edges: dict[str, set[str]]) -> dict[str, set[str]]:
    out = {k: set(v) for k, v in edges.items()}
    changed = True
    while changed:
        changed = False
        for k in out:
            more = set().union(*(out.get(x, set()) for x in out[k])) - out[k] if out[k] else set()
            if more:
                out[k] |= more
                changed = True
    return out


def unstratified(program: Program) -> list[str]:
    """Rules that negate a type which another rule of their stratum (group and salience) inserts.

    Which comes first is then a matter of declaration.  Rules whose consequences
    are all logical are corrected afterwards, salience by value cannot be known,
    and a rule that negates what itself inserts means to fire once.
    """
    stratum = lambda r: (r.agenda_group, r.salience) if isinstance(r.salience, int) else None
    inserters: dict[tuple, set[str]] = {}
    for r in program.rules:
        if stratum(r) is not None:
            for a in r.actions:
                if isinstance(a, Insert):
                    inserters.setdefault((stratum(r), a.type), set()).add(r.name)
    out = []
    for r in program.rules:
        if stratum(r) is None or r.actions and all(isinstance(a, Insert) and a.logical for a in r.actions):
            continue
        for g in walk(r.lhs):
            if isinstance(g, Group) and g.kind == "not":
                for p in walk(g.parts):
                    others = inserters.get((stratum(r), p.type), set()) - {r.name} if isinstance(p, Pattern) else ()
                    out += [f"{r.name} negates {p.type}, which {', '.join(sorted(others))} inserts in the same stratum"] if others else []
    return sorted(set(out))


def logical_cycles(program: Program) -> list[str]:
    """Types whose logical facts can support themselves; such facts outlive their cause."""
    edges: dict[str, set[str]] = {}
    for r in program.rules:
        for a in r.actions:
            if isinstance(a, Insert) and a.logical:
                edges.setdefault(a.type, set()).update(reads(r)[0])
    far = _closure(edges)
    return sorted(f"{t} can support itself" for t in far if t in far[t])


def listened(p: Pattern) -> set[str]:
    """Fields that a pattern constrains or binds."""
    out = {f for _, f in p.bindings} | {r.name for c in p.conditions for r in refs(c) if r.part is None and not r.name.startswith("$")}
    return out


_ORDER = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def holds_after(c, written: dict) -> bool | None:
    """Whether a condition that held holds after the fields are written (values, or None where they are computed); None: unknown."""
    if isinstance(c, Temporal):
        return True
    own = {r.name for r in refs(c) if r.part is None}
    if not own & set(written):
        return True  # as before
    if isinstance(c, Op) and c.op in ("and", "or"):
        a, b = (holds_after(x, written) for x in c.args)
        if c.op == "and":
            return False if a is False or b is False else True if a and b else None
        return None if len([x for x in (a, b) if x is False]) < 2 else False
    values = [x.value if isinstance(x, Lit) else written.get(x.name) if isinstance(x, Ref) and x.part is None else None for x in getattr(c, "args", ())]
    if isinstance(c, Op) and c.op in _ORDER and all(isinstance(v, (int, float, str)) for v in values) and len({isinstance(v, str) for v in values}) == 1:
        return _ORDER[c.op](*values)
    if isinstance(c, In) and isinstance(c.arg, Ref) and written.get(c.arg.name) is not None:
        return (written[c.arg.name] in [v.value for v in c.values]) != c.negated
    return None


def self_feeding(program: Program) -> list[str]:
    """Rules whose own update certainly matches again: they write a field that they read, and no condition is known to fail."""
    out = []
    for r in program.rules:
        if r.no_loop:
            continue
        patterns = {p.var: p for p in r.lhs if isinstance(p, Pattern) and p.var}
        for a in r.actions:
            if not isinstance(a, Modify) or not a.tell or a.var not in patterns:
                continue
            p = patterns[a.var]
            used = {x.part for y in (*r.lhs, *r.actions, r.salience) for x in walk(y) if isinstance(x, Ref) and x.name == a.var and x.part}
            hit = (listened(p) | used) & {f for f, _ in a.changes}
            written = {f: v.value if isinstance(v, Lit) else None for f, v in a.changes}
            if hit and all(holds_after(c, written) for c in p.conditions):
                out.append(f"{r.name} writes {', '.join(sorted(hit))} of {p.type}, which it reads")
    return sorted(set(out))


def expiry_closure(program: Program, events: set[str] | None = None) -> dict[str, int | None]:
    """Inferred expiry by type: how long after its end an event can still matter to a rule; None is for ever.

    The distances between the events of a rule bound each other (shortest
    paths); an event is needed as long as the furthest of the others can still
    come.  It never expires where that is unbounded, as for a pattern alone, or
    below zero, as for one that only ever comes later; and never for one rule is
    never for all.  The source of a time window is needed while it is in it.
    """
    out: dict[str, int | None] = {}
    for r in program.rules:
        patterns = [p for p in walk(r.lhs) if isinstance(p, Pattern) and (events is None or p.type in events)]
        windows = {id(x.source): x.window[1] for x in walk(r.lhs) if isinstance(x, Accumulate) and x.window and x.window[0] == "time"}
        names = {p.var: k for k, p in enumerate(patterns) if p.var}
        n, far = len(patterns), float("inf")
        dist = [[0.0 if i == j else far for j in range(n)] for i in range(n)]
        for k, p in enumerate(patterns):
            for c in walk(p.conditions):
                if isinstance(c, Temporal) and c.anchor in names:
                    least, most = span(c.relation, c.bounds)
                    i = names[c.anchor]
                    dist[i][k] = min(dist[i][k], far if most is None else most)
                    dist[k][i] = min(dist[k][i], far if least is None else -least)
        for m in range(n):
            for i in range(n):
                for j in range(n):
                    dist[i][j] = min(dist[i][j], dist[i][m] + dist[m][j])
        for k, p in enumerate(patterns):
            rest = [d for j, d in enumerate(dist[k]) if j != k and d < far]
            most = max(rest, default=-1.0)
            alone = len(rest) < n - 1 or most < 0
            need = windows.get(id(p)) if alone else max(int(most), windows.get(id(p), 0))
            if p.type in out and (out[p.type] is None or need is None):
                out[p.type] = None
            else:
                out[p.type] = need if p.type not in out else max(out[p.type], need)
    return out


def leaving(program: Program) -> tuple[set[str], set[str]]:
    """Types whose facts, as they leave, can bring about matches, and those whose facts can end or change them."""
    begin, end = set(), set()

    def visit(x, absent):
        if isinstance(x, tuple):
            for y in x:
                visit(y, absent)
        elif isinstance(x, Pattern):
            (begin if absent else end).add(x.type)
        elif isinstance(x, Group):
            visit(x.parts, absent != (x.kind == "not"))
        elif isinstance(x, (Accumulate, Collect, GroupBy)):
            begin.add(x.source.type)
            end.add(x.source.type)

    for r in program.rules:
        visit(r.lhs, False)
    for q in program.queries.values():
        visit(q.branches, False)
    return begin, end


def expiry_windows(program: Program, expires: dict[str, int | None]) -> list[str]:
    """Windows and distances longer than the explicit expiry of their events."""
    out = []
    for r in program.rules:
        for x in walk(r.lhs):
            if isinstance(x, Accumulate) and x.window and x.window[0] == "time":
                e = expires.get(x.source.type)
                if e is not None and 0 <= e < x.window[1]:
                    out.append(f"{r.name}: {x.source.type} expires after {e} ms, before its window of {x.window[1]} ms")
            if isinstance(x, Pattern):
                for c in walk(x.conditions):
                    if isinstance(c, Temporal) and c.relation in ("after", "before"):
                        e = expires.get(x.type)
                        if e is not None and 0 <= e < c.bounds[1]:
                            out.append(f"{r.name}: {x.type} expires after {e} ms, before the distance of {c.bounds[1]} ms")
    return sorted(out)


def lint(program: Program, expires: dict[str, int | None] | None = None) -> dict[str, list[str]]:
    return {
        "unstratified": unstratified(program),
        "logical_cycles": logical_cycles(program),
        "self_feeding": self_feeding(program),
        "expiry": expiry_windows(program, expires or {}),
    }


