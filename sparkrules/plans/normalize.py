"""Conditions to plain branches: De Morgan for negated groups, then one rule for each alternative."""

from __future__ import annotations

import dataclasses
from itertools import product

from sparkrules.plans.ir import Group, Pattern, QueryDef, RuleDef, RuleError, walk


def push(ce):
    """not(A or B) is not A and not B; exists(A or B) is not(not A and not B), that is, one of both exists."""
    if not isinstance(ce, Group):
        return ce
    parts = tuple(push(p) for p in ce.parts)
    if ce.kind in ("and", "or"):
        return Group(ce.kind, parts)
    inner = parts[0] if len(parts) == 1 else Group("and", parts)
    if isinstance(inner, Group) and inner.kind == "or":
        if ce.kind == "not":
            return Group("and", tuple(push(Group("not", (p,))) for p in inner.parts))
        return Group("exists_any", tuple(p.parts if isinstance(p, Group) and p.kind == "and" else (p,) for p in inner.parts))
    return Group(ce.kind, inner.parts if isinstance(inner, Group) and inner.kind == "and" else (inner,))


def branches(lhs: tuple) -> list[tuple]:
    """Alternatives of a conjunction, the leftmost choice slowest."""
    options = []
    for ce in map(push, lhs):
        if isinstance(ce, Group) and ce.kind == "or":
            options.append([b for p in ce.parts for b in branches((p,))])
        elif isinstance(ce, Group) and ce.kind == "and":
            options.append(branches(ce.parts))
        else:
            options.append([(ce,)])
    return [tuple(x for part in choice for x in part) for choice in product(*options)]


def check_facts(found: list[tuple], name: str) -> list[tuple]:
    """A variable names one fact in an alternative, and facts of one type in all of them."""
    types: dict[str, str] = {}
    for b in found:
        here = set()
        for x in walk(b):
            if isinstance(x, Pattern) and x.var:
                if x.var in here or types.setdefault(x.var, x.type) != x.type:
                    raise RuleError(f"{name}: the variable {x.var} is declared twice")
                here.add(x.var)
    return found


def expand(rule: RuleDef) -> list[RuleDef]:
    """A rule for each alternative; each fires by itself."""
    found = check_facts(branches(rule.lhs), rule.name)
    if len(found) == 1:
        return [dataclasses.replace(rule, lhs=found[0])]
    return [dataclasses.replace(rule, name=f"{rule.name}[{k}]", lhs=b, parent=rule.name) for k, b in enumerate(found)]


def expand_query(query: QueryDef) -> QueryDef:
    return dataclasses.replace(query, branches=tuple(b for x in query.branches for b in branches(x)))
