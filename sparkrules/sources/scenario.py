"""Scenario documents: types, rules, facts and what is done from outside, step by step.

A document is JSON with ``types`` (name, fields with name, type and maybe
nullable, and for events the names of the timestamp and duration and maybe
``expires_ms``), ``drl``, ``facts`` (type, fields, maybe entry_point), maybe
``epochs`` (actions insert, update, delete, advance and reset, more facts, and
queries) and ``queries`` (name and arguments, null for an unbound one).  Each
list of facts is followed by a fire; targets count facts from 0 in the order in
which they came.  Integers are numbers without a point.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

from pyspark.sql import SparkSession

from sparkrules.operators.session import FIRE_LIMIT, FireResult, RuleSession
from sparkrules.plans.ir import RuleError
from sparkrules.sources.facts import FactType

#: fixed values: names of field types in documents
_KINDS = {"i64": "long", "f64": "double", "String": "string", "bool": "boolean"}


@dataclass
class Replay:
    """The session at the end, the result of each fire, and the rows of each query."""

    session: RuleSession
    fires: list[FireResult] = field(default_factory=list)
    queries: list[list[dict]] = field(default_factory=list)

    def facts(self) -> dict[str, list[dict]]:
        return {name: self.session.facts(name).to_pylist() for name in self.session.types}

    def fired(self) -> list[str]:
        """Names of the rules in the order in which they fired."""
        out = []
        for got in self.fires:
            out += [r["rule"] for r in got.firings.frame.select("seq", "rule").distinct().orderBy("seq").collect()]
        return out


def read_types(entries: list[dict]) -> list[FactType]:
    out = []
    for t in entries:
        event, fields = t.get("event") or {}, []
        for f in t["fields"]:
            kind = f.get("type")
            if kind not in _KINDS and not str(kind).startswith("decimal("):
                raise RuleError(f"{t.get('name')}: no field type {kind!r}")
            fields.append((f["name"], _KINDS.get(kind, kind), bool(f.get("nullable"))))
        out.append(FactType(t["name"], tuple(fields), event.get("timestamp"), event.get("duration"), event.get("expires_ms")))
    return out


def _put(session: RuleSession, facts: list[dict]) -> None:
    """Facts in their order; neighbours of one type and entry point go in together."""
    for (name, entry_point), rows in groupby(facts, lambda f: (f["type"], f.get("entry_point"))):
        session.insert(name, [dict(r["fields"]) for r in rows], entry_point)


def _act(session: RuleSession, action: dict[str, Any]) -> None:
    op = action.get("op")
    if op == "insert":
        _put(session, [action])
    elif op == "update":
        session.update(action["target"] + 1, **action["fields"])
    elif op == "delete":
        session.delete(action["target"] + 1)
    elif op == "advance":
        session.advance(action["ms"])
    elif op == "reset":
        session.reset()
        session.started = True
    else:
        raise RuleError(f"no action {op!r}")


def load(document: str | dict) -> dict:
    """A document from a dict, JSON text or the path of a JSON file."""
    if isinstance(document, dict):
        return document
    if document.lstrip().startswith("{"):
        return json.loads(document)
    with open(document, encoding="utf-8") as f:
        return json.load(f)


def replay(spark: SparkSession, document: str | dict) -> Replay:
    """Run a document from its first fact to its last query."""
    doc = load(document)
    limit = doc.get("fire_limit") or FIRE_LIMIT
    session = RuleSession(spark, doc["drl"], read_types(doc["types"]))
    out = Replay(session)

    def ask(calls: list[dict] | None) -> None:
        for c in calls or []:
            out.queries.append([r.asDict() for r in session.query(c["name"], *c.get("args", [])).collect()])

    _put(session, doc["facts"])
    out.fires.append(session.fire(limit))
    for epoch in doc.get("epochs") or []:
        for action in epoch.get("actions") or []:
            _act(session, action)
        _put(session, epoch.get("facts") or [])
        out.fires.append(session.fire(limit))
        ask(epoch.get("queries"))
    ask(doc.get("queries"))
    return out
