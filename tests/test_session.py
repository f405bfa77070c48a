import pytest

from sparkrules import RuleSession, run
from sparkrules.operators import session as session_module
from sparkrules.plans.ir import RuleError
from sparkrules.sources.facts import fact_type

T = fact_type("T", k="string", v="long")
OUT = fact_type("Out", k="string", v="long")
A, B, LK = fact_type("A", a="long"), fact_type("B", b="long"), fact_type("LK", v="long")


def rows(table, *names):
    return sorted(tuple(r[n] for n in names) for r in table.to_pylist())


def test_insert_chain_and_log(spark):
    s, got = run(spark, """
        rule "first" when $t : T($k : k, v > 1) then insert(new Out($k, $t.v + 1)); end
        rule "second" when Out($k : k, $v : v < 100) then insert(new T($k, $v * 100)); end
    """, {"T": {"k": ["a", "b", "c"], "v": [1, 2, 3]}}, [T, OUT])
    assert rows(s.facts("Out"), "k", "v") == [("b", 3), ("b", 301), ("c", 4), ("c", 401)]
    assert got.fired == 6 and got.deleted_handles == []
    assert rows(got.derived["T"], "k", "v") == [("b", 300), ("c", 400)]
    assert {r["rule"] for r in got.firings.to_pylist()} == {"first", "second"}


def test_salience_orders_rules_and_values(spark):
    order = []
    run(spark, """
        rule "plain" salience 5 when T(k == "q") then end
        rule "dyn" salience ($v) when T($v : v, k == "p") then end
    """, {"T": {"k": ["p", "p", "q"], "v": [3, 7, 0]}}, [T], on_fire=order.append)
    assert order == ["dyn", "plain", "dyn"]


def test_logical_facts_share_supports_and_fall(spark):
    s, _ = run(spark, """
        rule "r1" when A($a : a) then insertLogical(new LK(1)); end
        rule "r2" when B($b : b) then insertLogical(new LK(1)); end
    """, {"A": {"a": [1, 2]}, "B": {"b": [1]}}, [A, B, LK])
    assert len(s.facts("LK")) == 1
    handle = s.facts("LK").to_pylist()[0]["handle"]
    assert len(s.why(handle)) == 3
    assert s.delete(1) == [] and len(s.why(handle)) == 2
    s.delete(2)
    assert s.delete(3) == [handle]
    assert len(s.facts("LK")) == 0 and s.why(handle) is None


def test_mutual_support_stays(spark):
    root, m1, m2 = fact_type("Root", r="long"), fact_type("M1", v="long"), fact_type("M2", v="long")
    s, _ = run(spark, """
        rule "a" when Root($r : r) then insertLogical(new M1($r)); end
        rule "b" when M1($v : v) then insertLogical(new M2($v)); end
        rule "c" when M2($v : v) then insertLogical(new M1($v)); end
    """, {"Root": {"r": [1]}}, [root, m1, m2])
    s.delete(1)
    assert len(s.facts("M1")) == 1 and len(s.facts("M2")) == 1
    assert s.lints["logical_cycles"] == ["M1 can support itself", "M2 can support itself"]


def test_modify_property_reactivity_and_no_loop(spark):
    s, got = run(spark, """
        rule "up" no-loop true when $t : T($v : v < 10) then modify($t) { setV($v + 1) } end
        rule "other" when T(k == "a") then insert(new Out("seen", 0)); end
    """, {"T": {"k": ["a"], "v": [1]}}, [T, OUT])
    assert rows(s.facts("T"), "k", "v") == [("a", 2)]
    assert got.fired == 2


def test_update_and_delete_guards_and_reactivity(spark):
    s = RuleSession(spark, 'rule "r" when T($k : k, v > 5) then insertLogical(new Out($k, 0)); end', [T, OUT], {"T": {"k": ["a"], "v": [9]}})
    with pytest.raises(RuleError, match="first fire"):
        s.update(1, v=3)
    s.fire()
    assert len(s.facts("Out")) == 1
    s.update(1, v=3)
    assert s.fire().deleted_handles == [2] and len(s.facts("Out")) == 0
    s.update(1, v=6)
    assert s.fire().fired == 1 and len(s.facts("Out")) == 1
    s.reset()
    assert len(s.facts("T")) == 0


def test_agenda_focus(spark):
    order = []
    run(spark, """
        rule "start" when T(k == "a") then drools.setFocus("g1"); drools.setFocus("g2"); end
        rule "one" agenda-group "g1" when T(k == "a") then end
        rule "two" agenda-group "g2" when T(k == "a") then end
        rule "never" agenda-group "g3" when T(k == "a") then end
    """, {"T": {"k": ["a"], "v": [1]}}, [T], on_fire=order.append)
    assert order == ["start", "two", "one"]


def test_fire_limit(spark):
    with pytest.raises(RuleError, match="fire limit"):
        run(spark, 'rule "r" when A($a : a) then insert(new A($a + 1)); end', {"A": {"a": [1]}}, [A], fire_limit=3)


def test_large_tables_are_no_runaway(spark, monkeypatch):
    s = RuleSession(spark, 'rule "r" when A($a : a) then insert(new B($a)); end', [A, B])
    s.insert("A", spark.range(100_001).withColumnRenamed("id", "a"))
    assert s.fire().fired == 100_001
    assert s.facts("B").frame.count() == 100_001
    monkeypatch.setattr(session_module, "FIRE_LIMIT", 3)
    with pytest.raises(RuleError, match="fire limit"):
        run(spark, 'rule "r" when A($a : a) then insert(new A($a + 1)); end', {"A": {"a": [1]}}, [A])


def test_events_windows_and_expiry(spark):
    e = fact_type("E", timestamp="ts", expires_ms=1000, ts="long", v="long")
    total = fact_type("Total", v="long")
    s, _ = run(spark, 'rule "w" when accumulate(E($v : v) over window:time(500ms); $s : sum($v)) then insertLogical(new Total($s)); end', {"E": {"ts": [0, 400], "v": [10, 20]}}, [e, total])
    assert rows(s.facts("Total"), "v") == [(30,)]
    s.advance(600)
    s.fire()
    assert rows(s.facts("Total"), "v") == [(20,)]
    s.advance(401)
    assert s.fire().deleted_handles and rows(s.facts("E"), "v") == [(20,)]


def test_deferred_absence_waits_for_its_window(spark):
    a, b = fact_type("Ask", timestamp="ts", ts="long"), fact_type("Answer", timestamp="ts", ts="long")
    s, _ = run(spark, 'rule "late" when $a : Ask() not Answer(this after[0ms,100ms] $a) then insert(new T("late", 0)); end', {"Ask": {"ts": [0]}}, [a, b, T])
    assert len(s.facts("T")) == 0
    s.advance(100)
    s.fire()
    assert len(s.facts("T")) == 1


def test_entry_points_and_sources(spark):
    s = RuleSession(spark, """
        rule "s1" when T($v : v) from entry-point "S1" then insert(new Out("s1", $v)); end
        rule "sum" when accumulate(T($v : v); $s : sum($v)) then insertLogical(new LK($s)); end
    """, [T, OUT, LK])
    s.insert("T", {"k": ["x"], "v": [5]}, entry_point="S1")
    s.insert("T", {"k": ["y", "z"], "v": [7, 8]})
    s.fire()
    assert rows(s.facts("Out"), "k", "v") == [("s1", 5)] and rows(s.facts("LK"), "v") == [(15,)]
    assert sorted(r["contribution"] for r in s.acc_sources("sum").collect()) == [7, 8]


def test_queries_bound_unbound_recursive_and_pull(spark):
    loc = fact_type("Location", thing="string", location="string")
    edges = [("office", "house"), ("kitchen", "house"), ("knife", "kitchen"), ("cheese", "kitchen"), ("desk", "office"), ("key", "desk")]
    data = {"Location": {"thing": [a for a, _ in edges], "location": [b for _, b in edges]}}
    text = """
        query isIn(String $x, String $y)
          Location(thing == $x, location == $y) or (Location(thing == $x, location == $z) and isIn($z, $y;))
        end
        rule "pull" when T($k : k) ?isIn($k, "house";) then insert(new Out($k, 1)); end
    """
    s, _ = run(spark, text, data | {"T": {"k": ["key", "knife", "moon"], "v": [1, 1, 1]}}, [loc, T, OUT])
    assert s.query("isIn", None, None).count() == 11 + 0
    assert s.query("isIn", "key", "house").count() == 1
    assert rows(s.facts("Out"), "k") == [("key",), ("knife",)]
    s.insert("Location", {"thing": ["house"], "location": ["key"]})
    with pytest.raises(RuleError, match="step limit"):
        s.query("isIn", None, None)


def test_aggregate_over_repeated_rows_without_handles(spark):
    from sparkrules.plans.compile import World, match
    from sparkrules.plans.drl import parse

    l, r = fact_type("L", k="long", v="long"), fact_type("R", v="long")
    w = World(spark, {"L": l, "R": r}, {"L": spark.createDataFrame([(1, 5), (1, 5), (2, 7), (3, None)], "k long, v long"), "R": spark.createDataFrame([(1,), (3,), (6,)], "v long")})
    got = match(w, parse('rule "r" when L($k : k, $v : v) accumulate(R(v < $v, $x : v); $s : sum($x)) then end').rules[0].lhs)
    assert sorted(map(tuple, got.select("k", "s").collect())) == [(1, 4), (1, 4), (2, 10), (3, 0)]


def test_length_window_keeps_the_places_of_facts_that_are_gone(spark):
    e = fact_type("E", timestamp="ts", expires_ms=100, ts="long", v="long", tag="string")
    s, _ = run(spark, 'rule "w" when accumulate(E(tag == "z", $v : v) over window:length(2); $s : sum($v)) then insertLogical(new LK($s)); end', {"E": {"ts": [0, 0, 0, 50], "v": [1, 10, 1000, 100], "tag": ["z", "z", "x", "z"]}}, [e, LK])
    total = lambda: rows(s.facts("LK"), "v")
    assert total() == [(110,)]
    s.delete(4)
    s.fire()
    assert total() == [(10,)]  # the first does not come back
    s.insert("E", {"ts": [50], "v": [7], "tag": ["z"]})
    s.fire()
    assert total() == [(7,)]  # the place of the deleted one counts
    s.insert("E", {"ts": [60, 60], "v": [5, 500], "tag": ["z", "y"]})
    s.fire()
    assert total() == [(12,)]
    s.advance(151)
    s.fire()
    assert total() == [(5,)]
    (state,) = s.rings.values()
    assert state[2].where("slot is not null").count() == 2


def test_advance_stops_between_deadlines(spark):
    short, long_ = fact_type("S", timestamp="ts", expires_ms=10, ts="long"), fact_type("L", timestamp="ts", expires_ms=100, ts="long")
    text = 'rule "alone" when L($t : ts) not S() then insert(new Out("alone", $t)); end'
    s, first = run(spark, text, {"S": {"ts": [0, 1]}, "L": {"ts": [0, 150]}}, [short, long_, OUT])
    assert first.fired == 0
    s.advance(300)
    got = s.fire()
    assert rows(s.facts("Out"), "v") == [(0,), (150,)] and got.fired == 2 and got.deleted_handles == [1, 2, 3, 4]
    assert rows(got.derived["Out"], "v") == [(0,), (150,)]
    assert len(s.facts("S")) == 0 and len(s.facts("L")) == 0


def test_expiry_is_inferred(spark):
    a, b, c = (fact_type(n, timestamp="ts", ts="long") for n in ("EA", "EB", "EC"))
    s, _ = run(spark, 'rule "r" when $a : EA() $b : EB(this after[5ms,20ms] $a) then end', {"EA": {"ts": [0, 90]}, "EB": {"ts": [10]}}, [a, b, c])
    assert s.expires == {"EA": 20}
    s.advance(20)
    assert len(s.facts("EA")) == 2
    s.advance(1)
    assert rows(s.facts("EA"), "ts") == [(90,)] and s.fire().deleted_handles == [1]
    s.advance(1_000_000)
    assert len(s.facts("EA")) == 0 and len(s.facts("EB")) == 1


def test_expiry_closure():
    from sparkrules.plans.drl import parse
    from sparkrules.plans.lints import expiry_closure

    closure = lambda *lhs: expiry_closure(parse(" ".join(f'rule "r{k}" when {x} then end' for k, x in enumerate(lhs))), set("ABC"))
    assert closure("$a : A() $b : B(this coincides $a) $c : C(this after[0ms,100ms] $b)") == {"A": 100, "B": 100, "C": 0}
    assert closure("$a : A() $b : B(this coincides $a)", "$b : B() $c : C(this after[0ms,100ms] $b)") == {"A": 0, "B": 100, "C": 0}
    assert closure("$a : A() B(this after[10ms,20ms] $a) C(this after[30ms,40ms] $a)") == {"A": 40, "B": 30, "C": None}
    assert closure("$a : A() B(this coincides $a)", "$a : A() C(this during $a)") == {"A": None, "B": 0, "C": None}
    assert closure("$a : A() $b : A(this after[50ms,100ms] $a)") == {"A": None}
    assert closure("$a : A() not B(this after[0ms,9ms] $a)", "X()") == {"A": 9, "B": 0}
    assert closure("accumulate(A($v : v) over window:time(50ms); $s : sum($v))") == {"A": 50}


def test_batch_updates_and_deletes(spark):
    s, _ = run(spark, 'rule "r" when T($k : k, $v : v > 5) then insertLogical(new Out($k, $v)); end', {"T": {"k": list("abcd"), "v": [1, 2, 3, 9]}}, [T, OUT])
    assert s.insert_row("T", k="e", v=0) == 6
    s.update([1, 2], v=7)
    s.update(2, k="B")
    s.update(spark.createDataFrame([(3, 8), (6, 10)], "handle long, v int"))
    assert s.fire().fired == 4
    assert rows(s.facts("Out"), "k", "v") == [("B", 7), ("a", 7), ("c", 8), ("d", 9), ("e", 10)]
    assert len(s.delete([1, 4])) == 2 and s.delete(spark.createDataFrame([(3,)], "handle long")) != []
    assert rows(s.facts("Out"), "k") == [("B",), ("e",)]
    with pytest.raises(RuleError, match="no fields"):
        s.update(2, w=1)
    with pytest.raises(RuleError, match="handle 99"):
        s.update(99, v=1)
    with pytest.raises(RuleError, match="handle 1"):
        s.update(1, v=1)
        s.fire()


def test_long_chains_fall_together(spark):
    """A thousand facts that rest on each other, a ring, and a fact with a second support."""
    s = RuleSession(spark, 'rule "r" when A($a : a) then end', [A], {"A": {"a": list(range(1, 1106))}})
    s.fire()
    s._set("A", s.frames["A"].withColumn("stated", s.frames["A"].handle.isin(1, 1100)))
    chain = [("A", k + 1, "r", (k, 0), [k], k) for k in range(1, 1000)]
    ring = [("A", 1010 + (k + 1) % 3, "r", (k, 1), [1010 + k], k) for k in range(3)]
    twice = [("A", 1050, "r", (1, 2), [500], 1), ("A", 1050, "r", (1, 3), [1100], 2), ("A", 1051, "r", (2, 4), [1050, 1100], 3), ("A", 1052, "r", (2, 5), [999, 1100], 3)]
    s.support = spark.createDataFrame(chain + ring + twice, "type string, handle long, rule string, key struct<x:long,y:long>, tuple array<long>, seq long")
    s._drop("A", spark.createDataFrame([(1,)], "handle long"))
    s._cascade()
    left = {r[0] for r in s.facts("A").frame.select("handle").collect()}
    assert left == {*range(1001, 1106)} - {1052}
    assert {r[0] for r in s.support.select("handle").collect()} == {1010, 1011, 1012, 1050, 1051} and s.support.count() == 5


def test_rules_that_begin_alike_share_their_matches(spark, monkeypatch):
    from sparkrules.plans.compile import Compilation

    text = """
        rule "one" when T($k : k, $v : v) A(a == $v) B($b : b, b > $v) then insertLogical(new Out("one", $b)); end
        rule "two" when T($k : k, $v : v) A(a == $v) not B(b == $v) then insertLogical(new Out($k, $v)); end
        rule "three" when T($k : k, $v : v) A(a == $v) then insert(new LK($v)); end
    """
    s = RuleSession(spark, text, [T, A, B, OUT, LK], {"T": {"k": ["x", "y"], "v": [1, 2]}, "A": {"a": [1, 2, 3]}, "B": {"b": [2, 5]}})
    assert s._shared == {"one": 2, "two": 2, "three": 2}
    whole, plain = [], Compilation.lhs
    monkeypatch.setattr(Compilation, "lhs", lambda self, parts, env=None: (whole.append(parts), plain(self, parts, env))[1])
    s.fire()
    assert len(whole) == 1 and rows(s.facts("Out"), "k", "v") == [("one", 2), ("one", 5), ("x", 1)] and rows(s.facts("LK"), "v") == [(1,), (2,)]
    s.delete(1)
    s.fire()
    assert len(whole) == 2 and rows(s.facts("Out"), "k", "v") == [("one", 5)]
    s.reset()
    assert s.prefixes == {}


def test_equal_saliences_by_value_fire_the_newest_first(spark):
    _, got = run(spark, 'rule "dyn" salience ($v) when $t : T($k : k, $v : v) then end', {"T": {"k": ["a", "b", "c", "d"], "v": [1, 5, 5, 1]}}, [T])
    assert [r["handle"] for r in sorted(got.firings.to_pylist(), key=lambda r: r["seq"])] == [3, 2, 4, 1]


def test_length_window_takes_members_back_by_writes_of_bound_fields(spark):
    e = fact_type("E", v="long", tag="string", note="string")
    s, _ = run(spark, 'rule "w" when accumulate(E(tag == "z", $v : v) over window:length(2); $s : sum($v)) then insertLogical(new LK($s)); end', {"E": {"v": [1, 10, 100], "tag": ["z"] * 3, "note": [""] * 3}}, [e, LK])

    def total():
        s.fire()
        return rows(s.facts("LK"), "v")

    assert total() == [(110,)]
    s.update(1, note="seen")  # not a bound field
    assert total() == [(110,)]
    s.update(1, v=2)  # pushed out, and back outside the places
    assert total() == [(112,)]
    s.insert("E", {"v": [1000], "tag": ["z"], "note": [""]})
    first = s.next_handle - 1
    assert total() == [(1102,)]  # 10 gave up its place, 2 has none to give up
    s.update(3, tag="x")
    assert total() == [(1002,)]  # who leaves the source is no member
    s.update(3, tag="z")
    assert total() == [(1002,)]  # and does not come back by that alone
    s.update(3, v=200)
    assert total() == [(1202,)]
    s.insert("E", {"v": [5], "tag": ["x"], "note": [""]})
    assert total() == [(1202,)]
    s.update(s.next_handle - 1, tag="z")  # admitted for the first time: the last place, which pushes 200 out
    assert total() == [(1007,)]
    s.delete(first)
    assert total() == [(7,)]


def test_a_pulled_query_is_asked_once_for_a_row(spark):
    text = """
        query of(long $v, String $k) T(k == $k, v == $v) end
        rule "pull" when A($a : a) ?of($a, $k;) then insert(new Out($k, $a)); end
    """
    s, got = run(spark, text, {"A": {"a": [1, 2]}, "T": {"k": ["x"], "v": [1]}}, [A, T, OUT])
    assert got.fired == 1 and rows(s.facts("Out"), "k", "v") == [("x", 1)]
    s.insert("T", {"k": ["y", "z"], "v": [2, 3]})
    assert s.fire().fired == 0  # facts of the query do not wake the rule
    s.insert("A", {"a": [3, 1]})
    assert s.fire().fired == 2 and rows(s.facts("Out"), "k", "v") == [("x", 1), ("x", 1), ("z", 3)]
    s.update(2, a=3)  # a new row asks again
    assert s.fire().fired == 1


def test_quiet_writes_do_not_wake_pulls_nor_swallow_others(spark):
    text = """
        query of(long $v, String $k) T(k == $k, v == $v) end
        rule "set" salience 5 when $a : A(a == 1) then $a.setA(2); end
        rule "pull" when A($a : a) ?of($a, $k;) then insert(new Out($k, $a)); end
    """
    s, _ = run(spark, text, {"A": {"a": [1, 2]}, "T": {"k": ["x"], "v": [2]}}, [A, T, OUT])
    assert rows(s.facts("A"), "a") == [(2,), (2,)] and rows(s.facts("Out"), "k", "v") == [("x", 2)]
