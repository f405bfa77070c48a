from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkrules.functions import allen
from sparkrules.functions.exact import average_exact
from sparkrules.plans import lints
from sparkrules.plans.builder import Rule, average, program, sum_, this, this_after
from sparkrules.plans.compile import World, match
from sparkrules.plans.drl import parse
from sparkrules.plans.ir import RuleError
from sparkrules.sources.facts import IngestError, conform, event, fact, fact_type, to_frame

N = fact_type("T", v="long?", w="long", s="string?")
U = fact_type("U", k="long?")


def count(spark, lhs, t=((1, 1, "a"), (None, 2, "b"), (5, 3, None)), u=((1,), (None,))):
    w = World(spark, {"T": N, "U": U}, {"T": spark.createDataFrame(list(t), N.schema), "U": spark.createDataFrame(list(u), U.schema)})
    return match(w, parse(f'rule "r" when {lhs} then end').rules[0].lhs).count()


@pytest.mark.parametrize("lhs, want", [
    ("T($w : w, v > 2)", 1), ("T($w : w, !(v > 2))", 1), ("T($w : w, v in (1, null))", 1), ("T($w : w, v not in (2, null))", 0), ("T($w : w, v == null)", 1), ("T($w : w, v != null)", 2),
    ("T($v : v, $w : w) U(k == $v)", 1), ("T($w : w, v > 2 || s == \"b\")", 2), ("T($w : w, v + 1 > 5)", 1), ("T($w : w, s matches \"[ab]\")", 2),
])
def test_three_valued_logic(spark, lhs, want):
    assert count(spark, lhs) == want


def test_64_bit_arithmetic_wraps(spark):
    t = fact_type("T", a="long", b="long")
    rows = [(2**63 - 1, 1), (-(2**63), -1), (2**62, 6), (-(2**62) + 5, 7)]
    w = World(spark, {"T": t}, {"T": spark.createDataFrame(rows, t.schema)})
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    for op, f in (("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b)):
        for a, b in rows:
            assert match(w, parse(f'rule "r" when T($a : a, a == {a}, b == {b}, a {op} b == {wrap(f(a, b))}) then end').rules[0].lhs).count() == 1, (op, a, b)


@pytest.mark.parametrize("text, what", [
    ('rule "r" when T(zz > 1) then end', "unknown name"), ('rule "r" when Nope() then end', "no fact type"), ('rule "r" when T(w == null) then end', "never null"),
    ('rule "r" when T(s matches "(?=a)b") then end', "uses more"), ('rule "r" when T(s > 1) then end', "do not compare"),
])
def test_compile_errors(spark, text, what):
    with pytest.raises(RuleError, match=what):
        w = World(spark, {"T": N}, {"T": spark.createDataFrame([], N.schema)})
        match(w, parse(text).rules[0].lhs)


def test_parse_errors_point():
    with pytest.raises(RuleError, match=r"line 2, column \d+"):
        parse('rule "r"\nwhen T(v > ) then end')


@pytest.mark.parametrize("mode, want", [("up", "0.03"), ("down", "0.02"), ("ceiling", "0.03"), ("floor", "0.02"), ("half_up", "0.03"), ("half_down", "0.02"), ("half_even", "0.02")])
def test_average_exact(spark, mode, want):
    df = spark.createDataFrame([(Decimal("0.02"),), (Decimal("0.03"),)], "x decimal(10,2)")
    from pyspark.sql import functions as F

    assert df.agg(average_exact(F.col("x"), 2, 2, mode).alias("a")).first()["a"] == Decimal(want)
    neg = {"ceiling": "-0.02", "floor": "-0.03", "half_up": "-0.03", "half_down": "-0.02", "up": "-0.03", "down": "-0.02", "half_even": "-0.02"}[mode]
    assert df.agg(average_exact(-F.col("x"), 2, 2, mode).alias("a")).first()["a"] == Decimal(neg)
    assert df.where("x > 1").agg(average_exact(F.col("x"), 2, 2, mode).alias("a")).first()["a"] is None


def test_interval_relations(spark):
    """Of all proper intervals on a small line, each stands in exactly one relation to the anchor, and each relation occurs."""
    from pyspark.sql import functions as F

    anchor, ends = (2, 5), range(8)
    df = spark.createDataFrame([(s, e) for s in ends for e in ends if s < e], "s long, e long")
    held = {}
    for name in allen.ARITY:
        bounds = (1, 9) if name in ("after", "before") else ()
        for r in df.where(allen.relation(name, F.col("s"), F.col("e"), *map(F.lit, anchor), bounds)).collect():
            held.setdefault((r["s"], r["e"]), []).append(name)
    assert len(held) == df.count() and all(len(names) == 1 for names in held.values())
    assert {names[0] for names in held.values()} == set(allen.ARITY)
    assert held[2, 5] == ["coincides"] and held[0, 2] == ["meets"] and held[5, 6] == ["metby"] and held[3, 5] == ["finishes"] and held[2, 6] == ["startedby"]
    with pytest.raises(ValueError):
        allen.relation("starts", F.col("s"), F.col("e"), F.lit(1), F.lit(2), (1, 2))


@fact
class Item:
    name: str
    price: float
    tag: str | None


@event(timestamp="ts", expires_ms=10)
class Tick:
    ts: int
    v: int


def test_builder_equals_text():
    r = Rule("r", salience=3)
    i = r.when(Item, this("price") > 5.0, this("name").in_("a", "b"))
    t = r.when(Tick, this("v") == i.price * 2)
    r.when_not(Item, this("name") == "zz")
    total = r.accumulate(Tick, this("v") > 0, agg=sum_(this("v")), over=("time", 500))
    r.then_insert(Item, i.name, i.price + 1.0, "t").then_modify(t, v=total)
    text = r.to_drl()
    again = parse(text).rules[0]
    assert again.name == "r" and again.salience == 3 and len(again.lhs) == 4 and len(again.actions) == 2
    assert again.lhs[2:] == r.build().lhs[2:]
    with pytest.raises(TypeError):
        r.when(Item, this("price") > (lambda x: x))


def test_lints():
    p = parse("""
        rule "neg" when A(a > 1) not B(b == 1) then insert(new C(1)); end
        rule "other" when A(a > 2) then insert(new B(1)); end
        rule "loop" when $a : A(a > 1) then modify($a) { setA(2) } end
        rule "w" when accumulate(E($v : v) over window:time(500ms); $s : sum($v)) then end
        rule "d" when $a : E() $b : E(this after[5ms,20ms] $a) then end
    """)
    got = lints.lint(p, {"E": 10})
    assert got["unstratified"] and got["self_feeding"] and len(got["expiry"]) == 2
    e = parse('rule "d" when $a : P() $b : Q(this after[0ms,20ms] $a) then end')
    assert lints.expiry_closure(e) == {"P": 20, "Q": 0}
    q = Rule("x")
    q.when(Tick, this_after(q.when(Tick), 1, 5))
    assert program(q).rules[0].lhs[1].conditions[0].bounds == (1, 5)
    assert average(this("v")).fn == "average"


@pytest.mark.parametrize("head, body, found", [
    ("", "insert(new C(1));", True), ("salience 5", "insert(new C(1));", False), ('agenda-group "g"', "insert(new C(1));", False), ("", "insertLogical(new C(1));", False), ("salience ($x)", "insert(new C(1));", False),
])
def test_unstratified_negation_is_of_one_stratum(head, body, found):
    p = parse(f'rule "neg" {head} when A($x : a) not B(b == 1) then {body} end rule "ins" when A(a > 2) then insert(new B(1)); end rule "once" when A() not D() then insert(new D()); end')
    assert lints.unstratified(p) == (["neg negates B, which ins inserts in the same stratum"] if found else [])


@pytest.mark.parametrize("lhs, action, found", [
    ("A(a > 1)", "setA(2)", True), ("A(a > 1)", "setA(0)", False), ("A(a < 10)", "setA($f.a + 1)", False), ("A(a > 1, b == 0)", "setB(1)", False), ("A(a > 1)", "setB(1)", False), ("A(b in (1, 2))", "setB(2)", True),
    ("A(b in (1, 2))", "setB(3)", False), ("A(a > 1 || b == 0)", "setA(0)", False), ("A(a > 1 && b == 0)", "setA(0)", False), ("A($v : a)", "setA(7)", True), ('A(s == "x")', 'setS("x")', True),
])
def test_self_feeding_updates_are_proven(lhs, action, found):
    assert bool(lints.self_feeding(parse(f'rule "r" when $f : {lhs} then modify($f) {{ {action} }} end'))) == found
    assert not lints.self_feeding(parse(f'rule "r" no-loop true when $f : {lhs} then modify($f) {{ {action} }} end'))


@pytest.mark.parametrize("text, what", [
    ('rule "r" when ($x : T(w > 1) or $x : U()) then end', "declared twice"), ('rule "r" when $x : T() $x : T() then end', "declared twice"), ('rule "r" when $x : T(w > 1) not ($x : U()) then end', "declared twice"),
    ('rule "r" when T($v : w, w / $v > 0) then end', "literal divisor"), ('rule "r" when T(w / 0 > 1) then end', "literal divisor"), ('rule "r" when T(w / 2 + 1 > 1) then end', "stands alone"), ('rule "r" when T(w / 2 > 1.5) then end', "stands alone"),
])
def test_walls_of_conditions(spark, text, what):
    w = World(spark, {"T": N, "U": U}, {"T": spark.createDataFrame([(1, 5, "a")], N.schema), "U": spark.createDataFrame([], U.schema)})
    with pytest.raises(RuleError, match=what):
        match(w, parse(text).rules[0].lhs)
    assert match(w, parse('rule "r" when ($x : T(w > 1) or $x : T(w / 2 == 2)) then end').rules[0].lhs).count() == 2


@pytest.mark.parametrize("body, what", [
    ("T(w == $x)", "nullable"), ("D(a == $x)", "decimal"), ("P(a == $x, a > 1 && a < 9)", "group"), ("P(a == $x, a + 1 > 2)", "arithmetic"), ("P(a == $x, f > 1)", "different types"), ("P(a == $x, f > 1.0)", None),
])
def test_walls_of_queries(spark, body, what):
    from sparkrules import RuleSession

    types = [N, fact_type("D", a="long", d="decimal(5,1)"), fact_type("P", a="long", f="double")]
    text = f"query q(long $x) {body} end"
    s = RuleSession(spark, text, types, {"P": {"a": [1, 2], "f": [0.5, 2.0]}})
    s.fire()
    if what is None:
        assert [r[0] for r in s.query("q", None).collect()] == [2]
    else:
        with pytest.raises(RuleError, match=what):
            s.query("q", None)
        loose = RuleSession(spark, text, types, strict=False)
        loose.fire()
        assert loose.query("q", None).count() == 0


def test_group_conditions_join_member_by_member(spark):
    a, b, c = fact_type("A", k="long", v="long"), fact_type("B", k="long", z="long"), fact_type("C", v="long", z="long")
    rows = [(k % 4, k % 3) for k in range(24)] + [(None, 1)]
    w = World(spark, {"A": a, "B": b, "C": c}, {"A": spark.createDataFrame(rows, a.schema), "B": spark.createDataFrame([(0, 5), (1, 6), (3, 9)], b.schema), "C": spark.createDataFrame([(0, 5), (2, 5), (1, 9), (1, 7)], c.schema)})
    for kind in ("not", "exists"):
        for group, ok in (("B(k == $k) and C(v == $v)", lambda k, v: k in (0, 1, 3)), ("B(k == $k, $z : z) and C(v == $v, z == $z)", lambda k, v: (k, v) in {(0, 0), (0, 2), (3, 1)}), ("B(z > 8) and C(z == 7)", lambda k, v: True), ("B(z > 9) and C(z == 7)", lambda k, v: False)):
            df = match(w, parse(f'rule "r" when A($k : k, $v : v) {kind} ({group}) then end').rules[0].lhs)
            assert sorted(map(str, df.collect())) == sorted(str(r) for r in w.frames["A"].toDF("k", "v").collect() if ok(r[0], r[1]) == (kind == "exists")), group
            assert "$" not in group or "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
@pytest.mark.parametrize("kind", ["not", "exists"])
def test_one_range_is_decided_by_the_extreme(spark, op, kind):
    import operator

    f = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    nan = float("nan")
    a, b = [(1.0,), (3.0,), (None,), (nan,)], [(2.0,), (3.0,), (nan,), (None,)]
    t, u = fact_type("A", x="double?"), fact_type("B", y="double?")
    w = World(spark, {"A": t, "B": u}, {"A": spark.createDataFrame(a, t.schema), "B": spark.createDataFrame(b, u.schema)})
    for cond, test in ((f"y {op} $x", lambda x, y: f(y, x)), (f"$x {op} y", lambda x, y: f(x, y))):
        for more, other in (("", lambda y: True), (", y < 2.5", lambda y: y < 2.5)):
            df = match(w, parse(f'rule "r" when A($x : x) {kind} B({cond}{more}) then end').rules[0].lhs)
            want = [str(x) for (x,) in a if any(y is not None and x is not None and test(x, y) and other(y) for (y,) in b) == (kind == "exists")]
            assert sorted(str(r[0]) for r in df.collect()) == sorted(want), (cond, more)


def test_bound_recursion_keeps_to_what_it_reaches(spark):
    from sparkrules.plans.compile import run_query

    t = fact_type("Edge", a="long", b="long")
    edges = [(k, k + 1) for k in range(1, 6)] + [(100 + k, 101 + k) for k in range(5)] + [(5, 50)]
    w = World(spark, {"Edge": t}, {"Edge": spark.createDataFrame(edges, t.schema)}, queries=parse("query far(long $x, long $y) Edge(a == $x, b == $y) or (Edge(a == $x, b == $z) and far($z, $y;)) end").queries)
    closure = {(a, b) for a in range(1, 7) for b in range(a + 1, 7)} | {(100 + a, 100 + b) for a in range(6) for b in range(a + 1, 6)} | {(a, 50) for a in range(1, 6)}
    for args in ((3, None), (None, 6), (3, 104)):
        want = sorted(p for p in closure if all(v is None or v == q for v, q in zip(args, p)))
        assert sorted(map(tuple, run_query(w, "far", *args).collect())) == want


def test_pairs_by_cells_are_all_pairs(spark):
    import math
    import random

    from sparkrules.operators import geo

    r = random.Random(8)
    points = [(k, r.choice([89.9, -89.95, 0.0, 60.0, -33.0]) + r.uniform(-0.1, 0.1) * (k % 2), r.choice([179.95, -179.95, 0.0, 10.0, 90.0]) + r.uniform(-0.1, 0.1)) for k in range(120)]
    points = [(k, max(-90.0, min(90.0, a)), o) for k, a, o in points]

    def metres(p, q):
        a1, o1, a2, o2 = map(math.radians, (p[1], p[2], q[1], q[2]))
        return 2 * geo.RADIUS_M * math.asin(math.sqrt(min(1.0, math.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * math.cos(a2) * math.sin((o2 - o1) / 2) ** 2)))

    df = spark.createDataFrame(points, "id long, lat double, lon double")
    for radius in (500.0, 9_000.0, 60_000.0):
        got = {(x["id_a"], x["id_b"]) for x in geo.pair_candidates(df, "id", "lat", "lon", radius).collect()}
        near = {(p[0], q[0]) for p in points for q in points if p[0] < q[0] and metres(p, q) <= radius}
        assert near <= got and len(got) <= 3 * len(near) + 40


def test_partners_of_one_key_are_dealt_over_tasks(spark, monkeypatch):
    from sparkrules.operators import spread

    monkeypatch.setattr(spread, "GROUP_ROWS", 16)
    left = [(k, 1 if k < 90 else k % 3, float(k % 7) if k % 11 else None) for k in range(100)]
    right = [(k, 1.0 if k < 90 else float(k % 3), float(k % 5) if k % 13 else float("nan")) for k in range(100)] + [(7, 1.0, 4.0), (7, 1.0, 4.0), (8, None, 4.0)]
    types = {"L": fact_type("L", a="long", k="long", x="double?"), "R": fact_type("R", b="long", k="double?", y="double", z="long")}
    frames = {"L": spark.createDataFrame(left, "a long, k long, x double"), "R": spark.createDataFrame(right, "b long, k double, y double").withColumn("z", F.col("b") * 2)}
    lhs = lambda text: parse(f'rule "q" when {text} then end').rules[0].lhs
    for text in ("L($a : a, $k : k, $x : x) R($b : b, k == $k, y > $x, z < 150)", "$l : L($a : a) R($b : b, $l.k == k, z < 150, y > $l.x)"):
        got = match(World(spark, types, frames), lhs(text), ["a", "b"]).withColumn("task", F.spark_partition_id()).collect()
        want = sorted((a, b) for a, k, x in left for b, m, y in right if k == m and x is not None and y > x and b * 2 < 150)
        assert sorted((r["a"], r["b"]) for r in got) == want
        tasks = [r["task"] for r in got if r["a"] < 90]
        assert max(map(tasks.count, set(tasks))) < 0.7 * len(tasks)


def test_pairs_of_one_place_are_dealt_over_tasks(spark, monkeypatch):
    from sparkrules.operators import geo, spread

    monkeypatch.setattr(spread, "GROUP_ROWS", 8)
    places = [(10.0, 20.0), (10.001, 20.0), (-0.0, 0.0), (0.0, 0.0), (50.0, 60.0), (None, 1.0)]
    points = [(k * 7 % 101, *places[0 if k < 60 else k % 6]) for k in range(100)] + [(3, 10.0, 20.0), (None, 10.0, 20.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    got = geo.pair_candidates(df, "id", "lat", "lon", 500.0, "m").withColumn("task", F.spark_partition_id()).collect()
    at = [p for p in points if None not in p]
    want = sorted((p, q, f"{p[0]}|{q[0]}") for p in at for q in at if p[0] < q[0] and abs(p[1] - q[1]) < 0.002 and abs(p[2] - q[2]) < 0.002)
    assert sorted(((r["id_a"], r["lat_a"], r["lon_a"]), (r["id_b"], r["lat_b"], r["lon_b"]), r["key"]) for r in got) == want
    assert all(r["m"] == (0 if r["lat_a"] == r["lat_b"] else 111) for r in got)
    tasks = [r["task"] for r in got if r["lat_a"] == r["lat_b"] == 10.0]
    assert max(map(tasks.count, set(tasks))) < 0.6 * len(tasks)


def test_closing_needs_rising_times(spark):
    from sparkrules.operators import geo

    df = spark.createDataFrame([("a", 1, 5.0, 0), ("a", 3, 4.0, 1), ("b", 9, 1.0, 2), ("b", 8, 1.0, 3)], "k string, t long, d double, n long")
    assert [r["c"] for r in geo.closing(df.where("k = 'a'"), "t", "k", "d", 10, "c", arrival="n").orderBy("n").collect()] == [False, True]
    with pytest.raises(Exception, match="t falls at 8"):
        geo.closing(df, "t", "k", "d", 10, "c", arrival="n").collect()


def test_builder_runs_every_part(spark):
    from sparkrules import RuleSession
    from sparkrules.plans import builder as B

    rule, found = Rule, fact_type("Found", label="string", price="double")
    r1 = rule("group")
    k, s = r1.group_by(Item, key="tag", agg=B.sum_(this("price")))
    r1.then_insert(found, k, s)
    r2 = rule("list")
    r2.collect(Item, this("price") > 2.0)
    r2.then_set_focus("later")
    r3 = rule("any", agenda_group="later")
    r3.when_any((Item, this("name") == "a"), (Item, this("name") == "zz")).when_exists(Tick, this("v") == 2)
    r3.then_insert_logical(Tick, 99, 7)
    r4 = rule("delete", salience=-1)
    t = r4.when(Tick, 10 - this("v") == 9, this("v") % 2 == 1)
    r4.then_delete(t)
    r5 = rule("exact", agenda_group="later")
    n, m = r5.accumulate(Tick, agg=B.count()), r5.accumulate(Tick, agg=B.max_(this("v")), over=B.window_length(1))
    low = r5.accumulate(Item, this("tag") == "x", agg=B.min_(this("price")))
    r5.then_insert(found, "n", low + 0.0)
    assert n is not None and m is not None
    rules = [r1, r2, r3, r4, r5]
    s = RuleSession(spark, rules, [Item, Tick, found])
    s.insert(Item, [Item("a", 1.5, "x"), Item("b", 2.5, "x"), Item("c", 4.0, "y")])
    s.insert(Tick, [Tick(1, 1), Tick(2, 2)])
    got = s.fire()
    rows = sorted((r["label"], r["price"]) for r in got.derived["Found"].to_pylist())
    assert rows == [("n", 1.5), ("x", 4.0), ("y", 4.0)]
    assert sorted(r["v"] for r in s.facts(Tick).to_pylist()) == [2, 7]
    assert len(got.deleted_handles) == 1
    handle = next(r["handle"] for r in s.facts(Tick).to_pylist() if r["v"] == 7)
    assert s.acc_sources(handle) is None and [w["rule"] for w in s.why(handle)] == ["any[0]"]
    for r in rules:  # rendered text gives the same rule
        assert parse(r.to_drl()).rules[0].lhs == r.build().lhs or r is r1
    each = [getattr(B, f"this_{n}") for n in allen.ARITY]
    for make, (name, arity) in zip(each, allen.ARITY.items()):
        bounds = (1, 5, 1, 5)[: arity[-1]] if name not in ("after", "before") else (1, 5)
        x = Rule("x")
        x.when(Tick, make(x.when(Tick), *bounds))
        c = x.build().lhs[1].conditions[0]
        assert (c.relation, c.bounds, c.anchor) == (name, bounds, "$f0") and parse(x.to_drl()).rules[0].lhs[1].conditions[0] == c


def test_result_forms(spark, tmp_path):
    from sparkrules.sources.facts import Table

    t = Table(spark.createDataFrame([(2, "b"), (1, "a")], "k long, s string"), ["k"])
    t.to_parquet(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert t.to_pandas()["s"].tolist() == ["a", "b"] and t.to_arrow().column("k").to_pylist() == [1, 2] and len(t) == 2
    import pyarrow as pa

    assert pa.table(t).num_rows == 2


def test_ingest_checks(spark):
    t = fact_type("T", a="long", d="decimal(5,1)", f="double?")
    good = conform(to_frame(spark, {"a": [1], "d": ["2.25"], "f": [float("nan")]}, fact_type("T", a="long", d="decimal(6,2)", f="double?")), t).first()
    assert good["d"] == Decimal("2.3") and good["f"] is None
    with pytest.raises(IngestError, match="a \\(1\\)"):
        conform(to_frame(spark, [{"a": None, "d": "1"}, {"a": 2, "d": "1"}], t), t)
    with pytest.raises(IngestError):
        to_frame(spark, [{"a": 1, "d": 1.5}], t)
    with pytest.raises(IngestError):
        fact_type("T", handle="long")
    import pyarrow as pa

    assert conform(to_frame(spark, pa.table({"a": pa.array([1], pa.int8()), "d": pa.array([Decimal("1.0")]), "f": [1.0]})), t).count() == 1
