"""Scenario documents with known outcomes."""

import json

import pytest

from sparkrules.plans.ir import RuleError
from sparkrules.sources.scenario import load, read_types, replay

LONG = lambda *names: [{"name": n, "type": "i64"} for n in names]


def doc(rules, facts, **more):
    types = [{"name": "P", "fields": LONG("k", "v")}, {"name": "Q", "fields": LONG("k")}, {"name": "R", "fields": LONG("k", "n")}]
    types.append({"name": "E", "fields": LONG("ts", "k"), "event": {"timestamp": "ts", "expires_ms": 20}})
    return {"types": types, "drl": rules, "facts": [{"type": t, "fields": f} for t, f in facts], **more}


P = lambda k, v: ("P", {"k": k, "v": v})
Q = lambda k: ("Q", {"k": k})
E = lambda ts, k: ("E", {"ts": ts, "k": k})
PAIR = 'rule "pair" when P($k : k, $v : v) Q(k == $k) then insertLogical(new R($k, $v)); end'
ALONE = 'rule "alone" when P($k : k, $v : v) not Q(k == $k) then insertLogical(new R($k, $v)); end'
SUM = 'rule "sum" when accumulate(P($v : v); $s : sum($v)) then insertLogical(new R(0, $s)); end'
CASES = {
    "join": (doc(PAIR, [P(1, 5), Q(2), P(2, 6), Q(1)]), [(1, 5), (2, 6)]),
    "join, delete": (doc(PAIR, [P(1, 5), Q(2), P(2, 6), Q(1)], epochs=[{"actions": [{"op": "delete", "target": 3}]}]), [(2, 6)]),
    "join, update": (doc(PAIR, [P(1, 5), Q(2)], epochs=[{"actions": [{"op": "update", "target": 0, "fields": {"k": 2}}]}]), [(2, 5)]),
    "join, insert": (doc(PAIR, [P(1, 5)], epochs=[{"actions": [{"op": "insert", "type": "Q", "fields": {"k": 1}}]}]), [(1, 5)]),
    "not": (doc(ALONE, [P(1, 5), P(2, 6), Q(1)]), [(2, 6)]),
    "not, insert": (doc(ALONE, [P(1, 5), P(2, 6)], epochs=[{"facts": [{"type": "Q", "fields": {"k": 2}}]}]), [(1, 5)]),
    "not, delete": (doc(ALONE, [P(1, 5), Q(1)], epochs=[{"actions": [{"op": "delete", "target": 1}]}]), [(1, 5)]),
    "sum": (doc(SUM, [P(1, 5), P(2, 6)]), [(0, 11)]),
    "sum, update": (doc(SUM, [P(1, 5), P(2, 6)], epochs=[{"actions": [{"op": "update", "target": 1, "fields": {"v": 1}}]}]), [(0, 6)]),
    "reset": (doc(SUM, [P(1, 5)], epochs=[{"actions": [{"op": "reset"}], "facts": [{"type": "P", "fields": {"k": 3, "v": 4}}]}]), [(0, 4)]),
    "exists": (doc('rule "r" when exists Q(k > 1) P($k : k) then insert(new R($k, 1)); end', [P(1, 5), Q(2), Q(3)]), [(1, 1)]),
    "or": (doc('rule "r" when (P($k : k, v > 5) or Q($k : k)) then insert(new R($k, 2)); end', [P(1, 6), P(2, 1), Q(3)]), [(1, 2), (3, 2)]),
    "modify": (doc('rule "r" when $p : P(v < 3) then modify($p) { setV($p.v + 1) } end rule "s" salience -1 when P($k : k, $v : v) then insert(new R($k, $v)); end', [P(1, 0)]), [(1, 3)]),
    "advance": (doc('rule "r" when E($k : k) not Q() then insertLogical(new R($k, 3)); end', [E(0, 1), E(30, 2)], epochs=[{"actions": [{"op": "advance", "ms": 21}]}]), [(2, 3)]),
    "after": (doc('rule "r" when $a : E($k : k) E(this after[5ms,10ms] $a, $j : k) then insert(new R($k, $j)); end', [E(0, 1), E(7, 2), E(18, 3)]), [(1, 2)]),
    "time window": (doc('rule "r" when accumulate(E($k : k) over window:time(10ms); $s : sum($k)) then insertLogical(new R(9, $s)); end', [E(0, 1), E(4, 2)], epochs=[{"actions": [{"op": "advance", "ms": 12}]}]), [(9, 2)]),
    "length window": (doc('rule "r" when accumulate(E($k : k) over window:length(2); $s : sum($k)) then insertLogical(new R(9, $s)); end', [E(0, 1), E(4, 2), E(5, 4)], epochs=[{"actions": [{"op": "delete", "target": 2}]}]), [(9, 2)]),
    "focus": (doc('rule "a" agenda-group "g" when P($k : k) then insert(new R($k, 7)); end rule "b" when Q() then drools.setFocus("g"); end', [P(1, 1), Q(1)]), [(1, 7)]),
    "no focus": (doc('rule "a" agenda-group "g" when P($k : k) then insert(new R($k, 7)); end', [P(1, 1)]), []),
    "group": (doc('rule "r" when groupby(P($k : k, $v : v); $k; $s : sum($v)) then insert(new R($k, $s)); end', [P(1, 5), P(1, 6), P(2, 1)]), [(1, 11), (2, 1)]),
}


@pytest.mark.parametrize("name", list(CASES))
def test_replay(spark, name):
    document, want = CASES[name]
    got = replay(spark, json.dumps(document))
    assert sorted((r["k"], r["n"]) for r in got.facts()["R"]) == want


def test_queries_entry_points_and_order(spark, tmp_path):
    d = doc('query big(long $x) P(k == $x, v > 4) end rule "r" when P($k : k) from entry-point "s" then insert(new R($k, 0)); end', [P(1, 5), P(2, 3)], queries=[{"name": "big", "args": [None]}, {"name": "big", "args": [2]}])
    d["facts"].append({"type": "P", "fields": {"k": 8, "v": 9}, "entry_point": "s"})
    (tmp_path / "d.json").write_text(json.dumps(d))
    got = replay(spark, str(tmp_path / "d.json"))
    assert [[r["x"] for r in q] for q in got.queries] == [[1], []] and got.fired() == ["r"]
    assert load(json.dumps(d)) == d
    with pytest.raises(RuleError, match="field type"):
        read_types([{"name": "X", "fields": [{"name": "a", "type": "u8"}]}])
    with pytest.raises(RuleError, match="no action"):
        replay(spark, {**d, "epochs": [{"actions": [{"op": "halt"}]}]})
