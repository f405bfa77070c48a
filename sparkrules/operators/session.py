"""Stateful sessions: working memory as DataFrames, rules chained to quiescence.

A step takes all pending matches of the rule that is first by (focused group,
salience, declaration) and applies its consequences to the whole set at once;
then rules are looked at afresh.  A match fires once: its key is the handles of
its facts and the values that the rule reads of them, so a change of a field
that a rule does not read never fires it again, and a match that ceased and
came back does.  Facts put in logically are kept while one of their supports
matches; supports are counted, so facts that support each other stay.

Order inside a step is by (salience, handles); it names firings and handles but
does not interleave consequences with matching.

A rule is looked at again only after a type that its conditions read has
changed (or the clock, where they read that); first conditions that several
rules share are matched once for all of them.  External updates are gathered
and applied together, in one pass over each type, before anything reads the
facts; a handle of a fact that is gone is reported then.
"""

from __future__ import annotations

import bisect
import dataclasses
import functools
from collections.abc import Callable, Iterable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrules.operators.numbering import ensure_checkpoint_dir, numbered
from sparkrules.plans import lints
from sparkrules.plans.compile import Compilation, World, run_query
from sparkrules.plans.drl import parse
from sparkrules.plans.ir import Accumulate, Call, Collect, Delete, Focus, GroupBy, Insert, Modify, Pattern, Program, Ref, RuleDef, RuleError, Temporal, walk
from sparkrules.plans.normalize import expand
from sparkrules.sources.facts import FactType, Table, conform, infer, to_frame

#: steps of one call: a rule that wakes itself without end is stopped, and large tables are not
FIRE_LIMIT = 100_000
META = ("handle", "ep", "ts0", "stated")


def about() -> dict:
    return {"name": "sparkrules", "version": "0.1", "modes": ["set"], "order": "salience, declaration, handles"}


class Derived(dict):
    """Tables by type name or by the class of the type."""

    def __missing__(self, key):
        if hasattr(key, "__fact__"):
            return self[key.__fact__.name]
        raise KeyError(key)


class FireResult:
    """What a call of ``fire`` changed.  ``deleted`` has the handles as a frame; ``deleted_handles`` brings them to the driver."""

    def __init__(self, fired: int, derived: dict[str, Table], deleted: DataFrame, firings: Table):
        self.fired, self.derived, self.deleted, self.firings = fired, derived, deleted, firings

    @functools.cached_property
    def deleted_handles(self) -> list[int]:
        return sorted({r[0] for r in self.deleted.collect()})


def _merged(actions: tuple) -> tuple:
    """Setters followed by an update of the same fact are one telling change."""
    out: list = []
    for a in actions:
        if isinstance(a, Modify) and a.tell:
            quiet = [x for x in out if isinstance(x, Modify) and not x.tell and x.var == a.var]
            out = [x for x in out if x not in quiet]
            a = Modify(a.var, tuple(c for x in quiet for c in x.changes) + a.changes, True)
        out.append(a)
    return tuple(out)


class RuleSession:
    def __init__(self, spark: SparkSession, rules: str | Program | list, types: list | None = None, facts: dict[str, Any] | None = None, strict: bool = True):
        """``strict``: queries keep to the narrow language of ``check_query``."""
        self.spark, self.strict = spark, strict
        ensure_checkpoint_dir(spark)
        if isinstance(rules, str):
            rules = parse(rules)
        elif isinstance(rules, list):
            from sparkrules.plans.builder import program

            rules = program(*rules)
        self.program = rules
        self.rules = [dataclasses.replace(b, actions=_merged(b.actions)) for r in rules.rules for b in expand(r)]
        self.types: dict[str, FactType] = {}
        for t in types or []:
            t = t if isinstance(t, FactType) else t.__fact__
            self.types[t.name] = t
        self.lints = lints.lint(rules, {n: t.expires_ms for n, t in self.types.items()})
        self.begins, self.ends = lints.leaving(rules)
        self._clear()
        for name, data in (facts or {}).items():
            self.insert(name, data)

    def _clear(self) -> None:
        for _, df, _ in getattr(self, "prefixes", {}).values():
            df.unpersist()
        self.prefixes: dict[tuple, tuple] = {}
        self.frames: dict[str, DataFrame] = {}
        self.version: dict[str, int] = {}  # changes of each type, and those that wrote fields
        self.modified: dict[str, int] = {}
        self.clock, self.next_handle, self.seq, self.started = 0, 1, 0, False
        self.ranges: list[tuple[int, str]] = []  # first handle of a run of facts, and their type
        self.fired: dict[str, DataFrame] = {}
        self.asked: dict[str, DataFrame] = {}  # rows for which a rule has asked its queries
        self.settled: dict[str, tuple] = {}  # what a rule's conditions read when nothing was pending
        self.kept: dict[str, tuple] = {}  # the same, when all supports by a rule matched
        self.changes: dict[int, dict] = {}
        self.given: list[tuple[int, int]] = []  # handles put in from outside since the last report
        self.rings: dict[tuple, tuple] = {}  # by (source, window): what was seen of the type, the epoch and the places
        self.written: dict[str, list[tuple[set, DataFrame]]] = {}  # fields and handles that were written, by type
        self.depth: dict[str, int] = {}
        self.focus: list[str] = []
        self.support: DataFrame | None = None
        self.log: list[DataFrame] = []
        self.deleted: list[DataFrame] = []
        self.dying: list[DataFrame] = []  # handles that left since supports were last looked through
        self.marks: tuple | None = None  # next handle, firings and log entries since the last report
        self.expires: dict[str, int | None] = {}
        for t in self.types.values():
            self._declare(t)

    def _declare(self, t: FactType) -> None:
        self.types[t.name] = t
        extra = [T.StructField("handle", T.LongType()), T.StructField("ep", T.StringType()), T.StructField("ts0", T.LongType()), T.StructField("stated", T.BooleanType())]
        self._set(t.name, self.spark.createDataFrame([], T.StructType([*extra, *t.schema.fields])))
        inferred = lints.expiry_closure(self.program, {n for n, k in self.types.items() if k.timestamp})
        self.expires = {n: k.expires_ms if k.expires_ms is not None else inferred.get(n) for n, k in self.types.items() if k.timestamp}
        self.expires = {n: e for n, e in self.expires.items() if e is not None and e >= 0}

    def _set(self, name: str, df: DataFrame, modified: bool = False) -> None:
        self.frames[name] = df
        self.version[name] = self.version.get(name, 0) + 1
        if modified:
            self.modified[name] = self.modified.get(name, 0) + 1

    def reset(self) -> None:
        """Forget facts, matches, supports and the clock; keep rules and types."""
        self._clear()

    def _world(self) -> World:
        rings = {key: self._places(*key).where("active") for key in self._windows if key[0].type in self.frames}
        return World(self.spark, self.types, self.frames, self.program.queries, self.clock, rings, self.strict)

    @functools.cached_property
    def _windows(self) -> list[tuple]:
        """(source, window) of the length windows whose sources depend on no other pattern."""
        found = [(x.source, x.window) for r in self.rules for x in walk(r.lhs) if isinstance(x, Accumulate) and x.window and x.window[0] == "length"]
        free = lambda p: {v for v, _ in p.bindings} >= {y.name for y in walk(p.conditions) if isinstance(y, Ref) and y.name.startswith("$")} and not any(isinstance(y, Temporal) for y in walk(p.conditions))
        return list(dict.fromkeys(k for k in found if free(k[0])))

    def _places(self, source: Pattern, window: tuple) -> DataFrame:
        """State of a length window: each fact it has admitted, its place (null: pushed out) and whether it is a member.

        A fact takes the last place when the source first admits it, and the
        oldest place beyond the window's length is given up.  Who leaves the
        source or the session is no member any more and keeps the place; who was
        a member and is admitted still or again becomes one by a write of a bound
        field, outside the places if its own was given up.
        """
        name, n = source.type, window[1]
        seen = self.version[name]
        old = self.rings.get((source, window))
        if old is not None and old[0] == seen:
            return old[2]
        bare = World(self.spark, self.types, self.frames, clock=self.clock)
        passing = Compilation(bare).passing(source)
        epoch = old[1] + 1 if old else 0
        state = old[2] if old else self.spark.createDataFrame([], "handle long, slot decimal(38,0), active boolean")
        slot = (F.lit(epoch).cast("decimal(18,0)") * F.lit(2**62).cast("decimal(19,0)") + F.col("handle")).cast("decimal(38,0)")
        new = passing.join(state.select("handle"), "handle", "left_anti").select("handle", slot.alias("slot"), F.lit(True).alias("active"))
        both = state.unionByName(new).checkpoint()
        last = both.where("slot is not null").orderBy(F.desc("slot")).limit(n).agg(F.count("*"), F.min("slot")).first()
        kept = F.col("slot").isNotNull() & (F.lit(last[0] < n) | (F.col("slot") >= F.lit(last[1])))
        mask, written = {f for _, f in source.bindings}, None
        for fields, handles in self.written.get(name, []):
            if fields & mask:
                written = handles if written is None else written.unionByName(handles)
        flag = lambda df, c: df.select(F.col("handle").alias(c)).distinct()
        both = both.join(flag(passing, "#p"), F.col("handle") == F.col("#p"), "left").join(flag(self.frames[name], "#l"), F.col("handle") == F.col("#l"), "left")
        told = F.lit(False)
        if written is not None:
            both, told = both.join(flag(written, "#w"), F.col("handle") == F.col("#w"), "left"), F.col("#w").isNotNull()
        pushed = F.col("slot").isNotNull() & ~kept
        active = F.col("#p").isNotNull() & ~pushed & (F.col("active") | told)
        now = both.select("handle", F.when(kept, F.col("slot")).alias("slot"), active.alias("active"), F.col("#l").isNotNull().alias("live"))
        now = now.where("live or slot is not null").drop("live").checkpoint()
        self.rings[source, window] = seen, epoch, now
        if all(self.rings.get(k, (None,))[0] == seen for k in self._windows if k[0].type == name):
            self.written.pop(name, None)
        return now

    def _wrote(self, name: str, fields, handles: DataFrame) -> None:
        if any(p.type == name for p, _ in self._windows):
            self.written.setdefault(name, []).append((set(fields), handles.select("handle").checkpoint()))

    def _need_started(self, what: str) -> None:
        if not self.started:
            raise RuleError(f"{what} needs a first fire()")

    # --- external changes

    def insert(self, name, data: Any, entry_point: str | None = None) -> list[int]:
        """Add a batch; its handles, in order of its rows."""
        self._apply()
        name = name if isinstance(name, str) else name.__fact__.name
        df = to_frame(self.spark, data, self.types.get(name))
        if name not in self.types:
            self._declare(infer(name, df))
        df, n = numbered(conform(df, self.types[name]), [], "handle", self.next_handle)
        first = self.next_handle
        self._append(name, df, n, True, entry_point)
        self.given.append((first, first + n))
        return range(first, first + n)

    def insert_row(self, name, entry_point: str | None = None, **fields) -> int:
        return self.insert(name, [fields], entry_point)[0]

    def _append(self, name: str, df: DataFrame, n: int, stated: bool, entry_point: str | None = None) -> None:
        """Add ``n`` rows that have consecutive handles from the next one on."""
        if not n:
            return
        t = self.types[name]
        ts = F.col(t.timestamp) if t.timestamp else F.lit(None)
        rows = df.select(
            F.col("handle").cast("bigint").alias("handle"), F.lit(entry_point).cast("string").alias("ep"), ts.cast("bigint").alias("ts0"), F.lit(stated).alias("stated"), *(F.col(n).cast(t.kind(n)) for n in t.names)
        )
        self.ranges.append((self.next_handle, name))
        self.next_handle += n
        old = self.frames[name]
        # the plan of the numbered rows is short; many of them are made one
        self.depth[name] = self.depth.get(name, 0) + 1
        both = old.unionByName(rows)
        if self.depth[name] % 8 == 0:
            both = both.checkpoint()
        self._set(name, both)

    def update(self, handle, **fields) -> None:
        """New values for a fact, for several (handles), or for each handle of a frame its own (columns named like the fields)."""
        self._need_started("update")
        if isinstance(handle, DataFrame):
            self._apply()
            names, hit = self._types_of(handle), 0
            for name in names:
                self._check_fields(name, set(handle.columns) - {"handle"})
            for name in names:
                hit += self._overwrite(name, handle)
            if hit < handle.count():
                raise RuleError("no fact has one of the handles")
            return
        if not fields:
            raise RuleError("update: no fields given")
        for h in handle if isinstance(handle, Iterable) else [handle]:
            self._check_fields(self._type_of(h), fields)
            self.changes.setdefault(int(h), {}).update(fields)

    def _check_fields(self, name: str, fields) -> None:
        unknown = set(fields) - set(self.types[name].names)
        if unknown:
            raise RuleError(f"{name} has no fields {sorted(unknown)}")

    def _apply(self) -> None:
        """Write the gathered updates: one join for each type and set of fields."""
        if not self.changes:
            return
        groups: dict[tuple, list[tuple]] = {}
        for h, fields in self.changes.items():
            name = self._type_of(h)
            groups.setdefault((name, tuple(sorted(fields))), []).append((h, *(fields[k] for k in sorted(fields))))
        self.changes = {}
        for (name, fields), rows in groups.items():
            kinds = T.StructType([T.StructField("handle", T.LongType()), *(T.StructField(f, self.types[name].kind(f)) for f in fields)])
            if self._overwrite(name, self.spark.createDataFrame(rows, kinds)) < len(rows):
                lost = sorted({r[0] for r in rows} - {r[0] for r in self.frames[name].where(F.col("handle").isin([r[0] for r in rows])).select("handle").collect()})
                raise RuleError(f"no fact has the handle {lost[0]}")

    def _overwrite(self, name: str, values: DataFrame) -> int:
        """Write the new values of a type's facts; how many were hit."""
        frame, t = self.frames[name], self.types[name]
        fields = [c for c in values.columns if c in t.names]
        new = values.select(F.col("handle").alias("#h"), F.struct(*(F.col(c).cast(t.kind(c)).alias(c) for c in fields)).alias("#v"))
        joined = frame.join(new, F.col("handle") == F.col("#h"), "left")
        now = joined.select(*(F.when(F.col("#h").isNotNull(), F.col(f"#v.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in frame.columns), "#h").checkpoint()
        hit = now.where("`#h` is not null").count()
        if hit:
            self._set(name, now.drop("#h"), modified=True)
            self._wrote(name, fields, values)
        return hit

    def delete(self, handle) -> list[int]:
        """Delete a fact, several (handles) or those of a frame; the handles that fell with them."""
        self._need_started("delete")
        self._apply()
        handles = None
        if not isinstance(handle, DataFrame):
            handles = [int(h) for h in (handle if isinstance(handle, Iterable) else [handle])]
            handle = self.spark.createDataFrame([(h,) for h in handles], "handle long")
        mark = len(self.deleted)
        handle = handle.select("handle").distinct()
        for name in self._types_of(handle) if handles is None else dict.fromkeys(map(self._type_of, handles)):
            self._drop(name, handle)
        if len(self.deleted) == mark:
            raise RuleError("no fact has one of the handles")
        first = len(self.deleted)
        self._maintain()
        return sorted({r[0] for d in self.deleted[first:] for r in d.collect()})

    def advance(self, ms: int) -> None:
        """Move the clock; facts that fall due leave in the order of their deadlines.

        Matches that come about on the way, as the last fact of a kind leaves,
        are fired just before the next facts leave; the next ``fire`` reports
        them.  Facts whose leaving can only end matches leave together.
        """
        self._need_started("advance")
        if ms < 0:
            raise RuleError("the clock does not go back")
        self._apply()
        end = self.clock + ms
        while (first := self._first_due(end, set(self.expires))) is not None:
            # facts that can only bring about matches leave before the next one that can end some
            telling = self._first_due(end, {n for n in self.expires if n in self.ends})
            if telling is None or first < telling:
                self.clock = end if telling is None else telling - 1
                self._expire()
                continue
            self.clock = max(self.clock, telling - 1)
            self._quiesce()
            # those that can only end matches leave together, up to the next that can bring about some
            self.clock = telling
            self._expire()
            other = self._first_due(end, {n for n in self.expires if n in self.begins})
            self.clock = end if other is None else max(self.clock, other - 1)
            self._expire()
        self.clock = end

    def _deadline(self, name: str):
        t = self.types[name]
        span = F.col(t.duration) if t.duration else F.lit(0)
        return F.col("ts0") + span + self.expires[name] + 1

    def _first_due(self, end: int, names: set[str]) -> int | None:
        """The first deadline up to ``end`` of facts of these types."""
        found = None
        for name in sorted(names):
            got = self.frames[name].select(self._deadline(name).alias("d")).where(F.col("d") <= end).agg(F.min("d")).first()[0]
            found = got if found is None or got is not None and got < found else found
        return found

    def _expire(self) -> bool:
        changed = False
        for name in self.expires:
            due = self._deadline(name) <= self.clock
            if not self.frames[name].where(due).isEmpty():
                self._leave(name, self.frames[name].where(due), self.frames[name].where(~due).checkpoint())
                changed = True
        if changed:
            self._maintain()
        return changed

    def _leave(self, name: str, out: DataFrame, rest: DataFrame) -> None:
        out = out.checkpoint()
        self.deleted.append(out.select("handle"))
        self.dying.append(out.select("handle"))
        self._set(name, rest)

    def _handles(self) -> DataFrame:
        frames = [f.select("handle") for f in self.frames.values()]
        out = frames[0] if frames else self.spark.createDataFrame([], "handle long")
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _type_of(self, handle: int) -> str:
        at = bisect.bisect_right(self.ranges, (handle, "\U0010ffff")) - 1
        if at < 0 or handle >= self.next_handle:
            raise RuleError(f"no fact has the handle {handle}")
        return self.ranges[at][1]

    def _types_of(self, handles: DataFrame) -> list[str]:
        """Types that can have facts of these handles."""
        starts = [k for k, _ in self.ranges]
        at = F.lit(0)
        for k in starts[1:] if len(starts) <= 64 else []:
            at = at + (F.col("handle") >= k).cast("int")
        if len(starts) <= 64:
            hit = [r[0] for r in handles.select(at.alias("at")).distinct().collect()]
            return list(dict.fromkeys(self.ranges[k][1] for k in sorted(hit) if self.ranges))
        return list(dict.fromkeys(n for _, n in self.ranges))

    def _drop(self, name: str, handles: DataFrame) -> None:
        frame = self.frames[name]
        marked = frame.join(handles.select(F.col("handle").alias("#h")).distinct(), F.col("handle") == F.col("#h"), "left").checkpoint()
        out = marked.where("`#h` is not null").drop("#h")
        if not out.isEmpty():
            self._leave(name, out, marked.where("`#h` is null").drop("#h"))

    # --- matching

    def matches(self, rule: RuleDef, world: World | None = None) -> tuple[DataFrame, dict]:
        """All current matches of a rule: handles, key, salience, and its variables' columns."""
        size = 0 if world else self._shared.get(rule.name, 0)
        if size:  # other rules begin alike
            comp = Compilation(self._world(), first=1000)
            df, env = self._prefix(rule.lhs[:size])
            for ce in rule.lhs[size:]:
                df, env = comp.step(df, env, ce)
        else:
            comp = Compilation(world or self._world())
            df, env = comp.lhs(rule.lhs)
        return self._identified(rule, df, env, comp), env

    def _key(self, rule: RuleDef, df: DataFrame, env: dict):
        """128 bits of the handles and of the values that the rule reads."""
        handles = [c for c in df.columns if c.endswith("__handle")]
        reads = {b.column for b in env.values() if b.type is None} | self._listened(rule, env)
        parts = [F.col(f"`{c}`") for c in [*handles, *sorted(reads & set(df.columns))]]
        parts = [x for c in parts for x in (c, c.isNull())]
        return F.struct(F.xxhash64(F.lit(1), *parts).alias("x"), F.xxhash64(F.lit("2"), *parts).alias("y"))

    def _identified(self, rule: RuleDef, df: DataFrame, env: dict, comp: Compilation) -> DataFrame:
        handles = [c for c in df.columns if c.endswith("__handle")]
        salience = F.lit(rule.salience) if isinstance(rule.salience, int) else comp.value(rule.salience, {}, env)[0]
        tuple_ = F.array(*(F.col(c) for c in handles)) if handles else F.array().cast("array<bigint>")
        return df.select("*", tuple_.alias("_tuple"), self._key(rule, df, env).alias("_key"), salience.cast("double").alias("_salience"))

    @functools.cached_property
    def _shared(self) -> dict[str, int]:
        """By rule: how many of its first conditions, two or more, some other rule has as well."""
        out = {}
        for r in self.rules:
            alike = [k for o in self.rules if o is not r for k in range(len(r.lhs), 1, -1) if o.lhs[:k] == r.lhs[:k]]
            if alike:
                out[r.name] = max(alike)
        return out

    def _prefix(self, parts: tuple) -> tuple[DataFrame, dict]:
        """Matches of first conditions, kept for all rules that begin with them until what they read changes."""
        types = sorted({x.type for x in walk(parts) if isinstance(x, Pattern)} | {t for x in walk(parts) if isinstance(x, Call) for t in self.types})
        state = (*(self.version.get(t, 0) for t in types), self.clock)
        found = self.prefixes.get(parts)
        if found is None or found[0] != state:
            if found is not None:
                found[1].unpersist()
            df, env = Compilation(self._world()).lhs(parts)
            found = self.prefixes[parts] = state, df.persist(StorageLevel.MEMORY_AND_DISK), env
        return found[1], dict(found[2])

    def _listened(self, rule: RuleDef, env: dict) -> set[str]:
        """Columns of fields that patterns bound to a fact constrain."""
        out = set()
        for p in walk(rule.lhs):
            if isinstance(p, Pattern) and p.var in env:
                out |= {f"{env[p.var].column}{f}" for f in lints.listened(p)}
        for x in walk(tuple(rule.actions)) if not isinstance(rule.salience, int) else []:
            if isinstance(x, Ref) and x.part and x.name in env:
                out.add(f"{env[x.name].column}{x.part}")
        for x in walk(rule.lhs):
            if isinstance(x, Ref) and x.part and x.name in env:
                out.add(f"{env[x.name].column}{x.part}")
        return out

    @functools.cached_property
    def _reads(self) -> dict[str, tuple[list[str], bool]]:
        """By rule: the types that its conditions read, and whether they read the clock."""

        def under(parts, seen) -> set:
            out = set()
            for x in walk(parts):
                if isinstance(x, Pattern):
                    out.add(x.type)
                elif isinstance(x, Call) and x.query not in seen and x.query in self.program.queries:
                    out |= under(self.program.queries[x.query].branches, seen | {x.query})
            return out

        def whole(r: RuleDef) -> tuple:
            return r.lhs[: self._pulls(r)] if self._pulls(r) else r.lhs

        clocked = lambda x: isinstance(x, Temporal) or isinstance(x, Accumulate) and x.window is not None
        return {r.name: (sorted(under(whole(r), set())), any(map(clocked, walk(r.lhs)))) for r in self.rules}

    @staticmethod
    def _pulls(rule: RuleDef) -> int:
        """How many conditions come before the queries that end a rule; 0 if none do (or the salience is by value)."""
        before = next((k for k, x in enumerate(rule.lhs) if isinstance(x, Call)), 0)
        return before if isinstance(rule.salience, int) and all(isinstance(x, Call) for x in rule.lhs[before:]) else 0

    def _state(self, rule: RuleDef) -> tuple:
        types, clocked = self._reads[rule.name]
        return (*(self.version.get(t, 0) for t in types), self.clock if clocked else 0)

    def _pending(self, rule: RuleDef) -> tuple[DataFrame, dict] | None:
        """Matches that have not fired; None if nothing they read has changed since there were none."""
        if self.settled.get(rule.name) == self._state(rule):
            return None
        if self._pulls(rule):
            return self._pulled(rule)
        df, env = self.matches(rule)
        done = self.fired.get(rule.name)
        if done is None:
            return df.checkpoint(), env
        # a match that ceased may fire again when it comes back
        flagged = df.join(done.select(F.col("_key").alias("#done")), F.col("_key") == F.col("#done"), "left").checkpoint()
        self.fired[rule.name] = flagged.where("`#done` is not null").select("_key").distinct()
        return flagged.where("`#done` is null").drop("#done"), env

    def _pulled(self, rule: RuleDef) -> tuple[DataFrame, dict]:
        """Matches of rows that are new before the rule's queries: a query is asked once for a row, later facts do not wake it."""
        size = self._pulls(rule)
        comp = Compilation(self._world())
        df, env = comp.lhs(rule.lhs[:size])
        df = df.withColumn("#row", self._key(rule, df, env)).checkpoint()
        seen = self.asked.get(rule.name)
        self.asked[rule.name] = df.select(F.col("#row").alias("#seen")).distinct()
        if seen is not None:
            df = df.join(seen, F.col("#row") == F.col("#seen"), "left_anti")
        df = df.drop("#row")
        for ce in rule.lhs[size:]:
            df, env = comp.step(df, env, ce)
        return self._identified(rule, df, env, comp).checkpoint(), env

    def _mark(self, rule: RuleDef, keys: DataFrame) -> None:
        """Matches of checkpointed frames that have fired."""
        keys = keys.select("_key").distinct()
        done = self.fired.get(rule.name)
        self.fired[rule.name] = keys if done is None else done.unionByName(keys).distinct().checkpoint()

    def _can_match(self, rule: RuleDef) -> bool:
        return all(p.type in self.frames for p in walk(rule.lhs) if isinstance(p, Pattern))

    # --- firing

    def fire(self, fire_limit: int | None = None, on_fire: Callable | None = None) -> FireResult:
        """Run to quiescence; the facts that are new, the handles that are gone and the firings in order, since the last report.

        ``fire_limit``: firings after which the call fails.  Without one, ``FIRE_LIMIT`` steps
        are the bound: a step fires all matches of a rule, so their number does not depend on the size of the tables.
        """
        self.started = True
        self._apply()
        self._quiesce(fire_limit)
        self._expire()
        new, seq, at = self.marks
        fresh = F.col("handle") >= new
        for a, b in self.given:
            if b > new:
                fresh = fresh & ~F.col("handle").between(a, b - 1)
        derived = Derived({n: Table(f.where(fresh).select("handle", *self.types[n].names), ["handle"]) for n, f in self.frames.items()})
        log = self.log[at:]
        frame = self._empty_log() if not log else log[0]
        for x in log[1:]:
            frame = frame.unionByName(x)
        out = self.spark.createDataFrame([], "handle long")
        for d in self.deleted:
            out = out.unionByName(d)
        result = FireResult(self.seq - seq, derived, out.where(F.col("handle") < new).distinct(), Table(frame, ["seq", "pos"]))
        self.deleted, self.given, self.marks = [], [], None
        if on_fire is not None:
            for row in frame.select("seq", "rule").distinct().orderBy("seq").toLocalIterator():
                on_fire(row["rule"])
        return result

    def _quiesce(self, fire_limit: int | None = None) -> None:
        """Fire until nothing is pending."""
        if self.marks is None:
            self.marks = self.next_handle, self.seq, len(self.log)
        first, steps = self.seq, 0
        self._maintain()
        while True:
            left = fire_limit - (self.seq - first) if fire_limit is not None else None if steps < FIRE_LIMIT else 0
            if self._step(left):
                steps += 1
            elif self.focus:
                self.focus.pop()
            else:
                break

    def _empty_log(self) -> DataFrame:
        return self.spark.createDataFrame([], "seq long, rule string, pos int, type string, handle long, values_json string")

    def _step(self, left: int | None) -> bool:
        group = self.focus[-1] if self.focus else "MAIN"
        rules = [r for r in self.rules if r.agenda_group == group and self._can_match(r)]
        dynamic = any(not isinstance(r.salience, int) for r in rules)
        order = sorted(range(len(rules)), key=lambda k: (-rules[k].salience if isinstance(rules[k].salience, int) else float("-inf"), k))
        best = None
        for k in order:
            rule = rules[k]
            if best and isinstance(rule.salience, int) and rule.salience <= best[0]:
                continue
            state = self._state(rule)
            found = self._pending(rule)
            if found is None:
                continue
            df, env = found
            top = df.agg(F.max("_salience"), F.count("*")).first()
            if not top[1]:
                self.settled[rule.name] = state
                continue
            if best is None or top[0] > best[0]:
                best = (top[0], rule, df, env, top[1], state)
            if not dynamic:
                break
        if best is None:
            return False
        salience, rule, df, env, n, state = best
        whole = n
        if dynamic:
            df = df.where(F.col("_salience") == salience)
            n = df.count()
        if left is not None and n > left:
            raise RuleError("fire limit")
        if n == whole:  # all that is pending now
            self.settled[rule.name] = state
        self._run(rule, df, env, n)
        return True

    def _run(self, rule: RuleDef, df: DataFrame, env: dict, n: int) -> None:
        # of equal saliences by value the newest is first
        by = F.col("_tuple") if isinstance(rule.salience, int) else F.desc("_tuple")
        df, _ = numbered(df, [F.desc("_salience"), by, F.col("_key")], "_seq", self.seq)
        self.run_from, self.run_size = self.seq, n
        self.seq += n
        self._mark(rule, df)
        self._record(rule, df, env)
        touched: DataFrame | None = None
        quiet: DataFrame | None = None
        logical = False
        for a in rule.actions:
            if isinstance(a, Focus):
                self.focus = [g for g in self.focus if g != a.group] + [a.group]
            elif isinstance(a, Insert):
                new = self._insert_all(rule, a, df, env)
                logical = logical or a.logical
                touched = new if touched is None else touched.unionByName(new)
            elif isinstance(a, Delete):
                b = env[a.var]
                self._drop(b.type.name, df.select(F.col(f"{b.column}handle").alias("handle")))
            elif isinstance(a, Modify):
                hit = self._modify(a, df, env)
                touched = hit if touched is None else touched.unionByName(hit)
                if not a.tell:
                    quiet = hit if quiet is None else quiet.unionByName(hit)
        self._maintain()
        if quiet is not None:
            for r in self.rules:
                self._mute(r, quiet)
        if rule.no_loop and touched is not None:
            for r in self.rules:
                if r.origin == rule.origin:
                    self._mute(r, touched)

    def _mute(self, rule: RuleDef, handles: DataFrame) -> None:
        """Matches that the handles bring about do not fire."""
        if not self._can_match(rule):
            return
        if self._pulls(rule):
            df, env = Compilation(self._world()).lhs(rule.lhs[: self._pulls(rule)])
            columns = [F.col(c) for c in df.columns if c.endswith("__handle")]
            if columns:
                rows = df.select(self._key(rule, df, env).alias("#seen"), F.explode(F.array(*columns)).alias("handle")).join(handles.distinct(), "handle", "left_semi").select("#seen")
                seen = self.asked.get(rule.name)
                self.asked[rule.name] = (rows if seen is None else seen.unionByName(rows)).distinct().checkpoint()
            return
        found = self._pending(rule)
        if found is None:
            return
        df, _ = found
        hit = df.select("_key", F.explode("_tuple").alias("handle")).join(handles.distinct(), "handle", "left_semi")
        self._mark(rule, hit)

    def _record(self, rule: RuleDef, df: DataFrame, env: dict) -> None:
        facts = [(b.column, b.type) for b in env.values() if b.type is not None]
        rows = None
        parts = [(c, t) for c, t in facts if f"{c}handle" in df.columns]
        values = [
            F.struct(F.lit(k).alias("pos"), F.lit(t.name).alias("type"), F.col(f"{c}handle").alias("handle"), F.to_json(F.struct(*(F.col(f"{c}{n}").alias(n) for n in t.names))).alias("values_json"))
            for k, (c, t) in enumerate(parts)
        ]
        if values:
            rows = df.select(F.col("_seq").alias("seq"), F.lit(rule.origin).alias("rule"), F.explode(F.array(*values)).alias("x")).select("seq", "rule", "x.pos", "x.type", "x.handle", "x.values_json")
        else:
            rows = df.select(F.col("_seq").alias("seq"), F.lit(rule.origin).alias("rule"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("bigint").alias("handle"), F.lit(None).cast("string").alias("values_json"))
        self.log.append(rows)

    def _values(self, kind: FactType, args: tuple, env: dict) -> list:
        if len(args) != len(kind.names):
            raise RuleError(f"new {kind.name} takes {len(kind.names)} values")
        comp = Compilation(self._world())
        return [comp.value(a, {}, env)[0].cast(kind.kind(n)).alias(n) for n, a in zip(kind.names, args)]

    def _insert_all(self, rule: RuleDef, a: Insert, df: DataFrame, env: dict) -> DataFrame:
        if a.type not in self.types:
            raise RuleError(f"no fact type {a.type}")
        kind = self.types[a.type]
        rows = df.select("_seq", "_key", "_tuple", *self._values(kind, a.args, env))
        if not a.logical:  # firings are numbered without gaps already
            first = self.next_handle
            got = rows.withColumn("handle", F.col("_seq") - self.run_from + first)
            self._append(a.type, got, self.run_size, True)
            return got.select("handle")
        names = kind.names
        old = self.frames[a.type].groupBy(*names).agg(F.min("handle").alias("_h")).select(*(F.col(n).alias(f"o_{n}") for n in names), "_h")
        same = [F.col(n).eqNullSafe(F.col(f"o_{n}")) for n in names]
        on = same[0]
        for s in same[1:]:
            on = on & s
        known = rows.join(old, on, "left").drop(*(f"o_{n}" for n in names)).checkpoint()
        fresh = known.where("_h is null").groupBy(*names).agg(F.min("_seq").alias("_first"))
        fresh, n = numbered(fresh, ["_first"], "handle", self.next_handle)
        self._append(a.type, fresh, n, False)
        new = fresh.select(*(F.col(n).alias(f"o_{n}") for n in names), F.col("handle").alias("_n"))
        backed = known.join(new, on, "left").select(
            F.lit(a.type).alias("type"), F.coalesce("_h", "_n").alias("handle"), F.lit(rule.name).alias("rule"), F.col("_key").alias("key"), F.col("_tuple").alias("tuple"), F.col("_seq").alias("seq")
        )
        self.support = (backed if self.support is None else self.support.unionByName(backed)).checkpoint()
        return fresh.select("handle")

    def _modify(self, a: Modify, df: DataFrame, env: dict) -> DataFrame:
        b = env[a.var]
        kind = b.type
        comp = Compilation(self._world())
        for f, _ in a.changes:
            if f not in kind.names:
                raise RuleError(f"{kind.name} has no field {f}")
        values = {f: comp.value(v, {}, env)[0].cast(kind.kind(f)) for f, v in a.changes}
        handle = F.col(f"{b.column}handle").alias("handle")
        if not values:
            return df.select(handle)
        rows = df.select(handle, F.struct("_seq", *(v.alias(f) for f, v in values.items())).alias("c"))
        last = rows.groupBy("handle").agg(F.max("c").alias("c"))  # the last firing's values stand
        frame = self.frames[kind.name]
        joined = frame.join(last, "handle", "left")
        changed = {f: F.when(F.col("c").isNotNull(), F.col(f"c.{f}")).otherwise(F.col(f)) for f in values}
        self._set(kind.name, joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in frame.columns)).checkpoint(), modified=True)
        self._wrote(kind.name, values, last)
        return last.select("handle")

    # --- truth maintenance

    def _maintain(self) -> None:
        """Drop supports whose match has ceased, then logical facts without supports, until nothing falls."""
        if self.support is None:
            return
        logical = [r for r in self.rules if any(isinstance(a, Insert) and a.logical for a in r.actions) and self._can_match(r)]
        while True:
            self._cascade()
            open_ = [r for r in logical if self.kept.get(r.name) != self._supports(r)]
            if not open_:
                return
            states = {r.name: self._supports(r) for r in open_}
            now = None
            for r in open_:
                keys = self.matches(r)[0].select(F.lit(r.name).alias("rule"), F.col("_key").alias("key"))
                now = keys if now is None else now.unionByName(keys)
            now = now.distinct().withColumn("#m", F.lit(True))
            checked = F.col("rule").isin([r.name for r in open_])
            marked = self.support.join(now, ["rule", "key"], "left").withColumn("#keep", ~checked | F.col("#m").isNotNull()).select(*self.support.columns, "#keep").checkpoint()
            self.kept |= states
            out = marked.where("not `#keep`")
            if out.isEmpty():
                return
            self.support = marked.where("`#keep`").drop("#keep")
            self._retract(out.select("type", "handle").distinct().join(self.support.select("handle").distinct(), "handle", "left_anti").checkpoint())

    def _supports(self, rule: RuleDef) -> tuple:
        """What a rule's supports rest on beside their members: matches of patterns alone cease only as a member leaves or is written."""
        if all(isinstance(x, Pattern) and not any(isinstance(c, Temporal) for c in walk(x.conditions)) for x in rule.lhs):
            return tuple(self.modified.get(t, 0) for t in self._reads[rule.name][0])
        return self._state(rule)

    def _retract(self, lost: DataFrame) -> None:
        for row in lost.select("type").distinct().collect():
            fell = lost.where(F.col("type") == row[0]).select("handle")
            stated = self.frames[row[0]].where("not stated").select("handle")
            self._drop(row[0], fell.join(stated, "handle", "left_semi"))

    def _cascade(self) -> None:
        """Supports with a member that is gone fall, and with its last one the fact, until nothing falls.

        What rests on several facts is followed level by level.  A fact with a
        single support that rests on a single logical fact falls with that one,
        so from the third level on chains of such facts are followed by pointer
        jumping, in a number of rounds that is the logarithm of their length.
        """
        level = 0
        while self.dying:
            gone = self.dying[0]
            for d in self.dying[1:]:
                gone = gone.unionByName(d)
            self.dying = []
            members = self.support.select("type", "handle", "rule", "key", F.explode(F.array_distinct("tuple")).alias("member"))
            dead = members.join(gone.withColumnRenamed("handle", "member"), "member", "left_semi").select("rule", "key", "handle").distinct().checkpoint()
            if dead.isEmpty():
                return
            level += 1
            bad = dead if level < 3 else dead.unionByName(self._chained(members, dead)).distinct()
            marked = self.support.join(bad.withColumn("#d", F.lit(True)), ["rule", "key", "handle"], "left").select(*self.support.columns, "#d").checkpoint()
            self.support = marked.where("`#d` is null").drop("#d")
            out = marked.where("`#d` is not null").select("type", "handle").distinct()
            self._retract(out.join(self.support.select("handle").distinct(), "handle", "left_anti").checkpoint())

    def _chained(self, members: DataFrame, dead: DataFrame) -> DataFrame:
        """The single supports of facts further down chains that start at a dead support."""
        logical = members.select("handle").distinct().withColumnRenamed("handle", "member")
        single = self.support.groupBy("handle").agg(F.count("*").alias("n"), F.first("rule").alias("rule"), F.first("key").alias("key")).where("n = 1").drop("n")
        for t in {r[0] for r in self.support.select("type").distinct().collect()}:
            single = single.join(self.frames[t].where("stated").select("handle"), "handle", "left_anti")
        rests = members.join(logical, "member", "left_semi").groupBy("handle", "rule", "key").agg(F.count("*").alias("n"), F.min("member").alias("up")).where("n = 1").drop("n")
        chain = single.join(rests, ["handle", "rule", "key"]).select("handle", "rule", "key", "up")
        fell = dead.join(single, ["handle", "rule", "key"], "left_semi").select(F.col("handle").alias("up"), F.lit(True).alias("falls"))
        # (handle, up): falls with up; falls: an ancestor so far is known to fall
        now = chain.join(fell, "up", "left").select("handle", "up", F.coalesce("falls", F.lit(False)).alias("falls")).checkpoint()
        if now.where("falls").isEmpty():
            return dead.limit(0)
        # facts that keep each other in a ring have no end to jump to, so the rounds are counted
        for _ in range(now.count().bit_length() + 1):
            above = now.select(F.col("handle").alias("up"), F.col("up").alias("next"), F.col("falls").alias("falls_above"))
            far = now.join(above, "up", "left").select("handle", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"), (F.col("falls") | F.coalesce("falls_above", F.lit(False))).alias("falls")).checkpoint()
            now = far.drop("moved")
            if far.where("moved and not falls").isEmpty():
                break
        return chain.join(now.where("falls").select("handle"), "handle", "left_semi").select("rule", "key", "handle")

    def why(self, handle: int) -> list[dict] | None:
        """Supports of a fact; None if it was not put in logically."""
        rows = [] if self.support is None else self.support.where(F.col("handle") == handle).orderBy("seq").collect()
        return [{"rule": r["rule"], "tuple": list(r["tuple"]), "seq": r["seq"]} for r in rows] or None

    def justifications(self) -> DataFrame:
        return self.support if self.support is not None else self.spark.createDataFrame([], "type string, handle long, rule string, key string, tuple array<long>, seq long")

    def acc_sources(self, of: str | int):
        """Source facts and contributions of a rule's aggregate, for each left match (a frame).

        For the handle of a fact that such a rule put in logically: the pairs
        (source, contribution) behind its value, by handle of the source; None
        for any other handle.
        """
        if not isinstance(of, int):
            return self._sources(of)
        folds = {r.name for r in self.rules if any(isinstance(x, (Accumulate, Collect, GroupBy)) for x in walk(r.lhs))}
        if self.support is None or not folds:
            return None
        backed = self.support.where((F.col("handle") == of) & F.col("rule").isin(sorted(folds))).orderBy("seq").first()
        if backed is None:
            return None
        got = self._sources(backed["rule"]).where(F.col("left") == F.lit(list(backed["tuple"])).cast("array<bigint>"))
        return [(r["source"], r["contribution"]) for r in got.orderBy("source").collect()]

    def _sources(self, rule: str) -> DataFrame:
        r = next(x for x in self.rules if x.name == rule)
        acc = next(x for x in walk(r.lhs) if isinstance(x, (Accumulate, Collect, GroupBy)))
        parts = tuple(acc.source if x is acc else x for x in r.lhs)
        comp = Compilation(self._world())
        df, env = comp.lhs(parts)
        value = comp.value(acc.arg, {}, env)[0] if getattr(acc, "arg", None) is not None else F.lit(None)
        if getattr(acc, "arg", None) is not None and isinstance(acc.arg, Ref) and acc.arg.name not in env:
            value = F.col([c for c in df.columns if c.endswith(f"__{acc.arg.name}")][-1])
        handles = [c for c in df.columns if c.endswith("__handle")]
        return df.select(F.array(*(F.col(c) for c in handles[:-1])).cast("array<bigint>").alias("left"), F.col(handles[-1]).alias("source"), value.alias("contribution"))

    # --- reading

    def facts(self, name) -> Table:
        self._apply()
        name = name if isinstance(name, str) else name.__fact__.name
        return Table(self.frames[name].select("handle", *self.types[name].names), ["handle"])

    def query(self, name: str, *args) -> DataFrame:
        self._need_started("query")
        self._apply()
        return run_query(self._world(), name, *args)


def run(spark: SparkSession, rules, facts: dict[str, Any], types: list | None = None, fire_limit: int | None = None, on_fire: Callable | None = None) -> tuple[RuleSession, FireResult]:
    """A session over the facts, fired once."""
    session = RuleSession(spark, rules, types, facts)
    return session, session.fire(fire_limit, on_fire)
