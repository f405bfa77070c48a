"""More queries, over sessions: ingestion forms, external changes, expiry, windows, the builder and scenarios, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrules.operators.session import RuleSession, run
from sparkrules.plans import builder as B
from sparkrules.plans.catalog import GRADE, add, read, session
from sparkrules.plans.compile import World, match, run_query
from sparkrules.plans.drl import parse
from sparkrules.sources.facts import FactType, fact_type
from sparkrules.sources.scenario import replay

NATION = fact_type("Nation", n_nationkey="long", n_name="string", n_regionkey="long")
REGION = fact_type("Region", r_regionkey="long", r_name="string")
#: nations as events: they come at 10 ms times their key
STAMPED = FactType("Stamped", (("k", "long", False), ("r", "long", False), ("ts", "long", False)), timestamp="ts", expires_ms=100)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "nation").orderBy("n_nationkey")
    return df.select(F.col("n_nationkey").cast("bigint"), "n_name", F.col("n_regionkey").cast("bigint"))


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"), (F.col("n_nationkey") * 10).alias("ts"))


def grades(s: RuleSession) -> DataFrame:
    return s.facts("Grade").frame.select("custkey", "grade")


# --- sources and sinks
def _ingest(form):
    def go(spark, sf_dir):
        s = RuleSession(spark, 'rule "r" when Region($k : r_regionkey, $n : r_name) then insert(new Grade($k, $n)); end', [REGION, GRADE])
        s.insert("Region", form(read(spark, sf_dir, "region")))
        s.fire()
        return grades(s)

    return go


REGIONS = "SELECT r_regionkey::BIGINT AS custkey, r_name AS grade FROM region"
add("ingest_arrow", _ingest(lambda df: df.toArrow()), REGIONS)
add("ingest_columns", _ingest(lambda df: df.toPandas().to_dict("list")), REGIONS)
add("ingest_rows", _ingest(lambda df: [r.asDict() for r in df.collect()]), REGIONS)
add("ingest_widened", _ingest(lambda df: df.withColumn("r_regionkey", F.col("r_regionkey").cast("tinyint"))), REGIONS)


def _insert_row(spark, sf_dir):
    s = RuleSession(spark, 'rule "r" when Region($k : r_regionkey, $n : r_name) then insert(new Grade($k, $n)); end', [REGION, GRADE])
    for r in read(spark, sf_dir, "region").collect():
        s.insert_row("Region", **r.asDict())
    s.fire()
    return grades(s)


add("insert_row", _insert_row, REGIONS)


def _run(spark, sf_dir):
    _, got = run(spark, 'rule "r" when Region($k : r_regionkey, $n : r_name) then insert(new Grade($k, $n)); end', {"Region": read(spark, sf_dir, "region")}, [REGION, GRADE])
    return got.derived["Grade"].frame.select("custkey", "grade")


add("run_once", _run, REGIONS)

# --- external changes
_BIG = 'rule "big" when $n : Nation($k : n_nationkey, n_regionkey > 2) then insertLogical(new Grade($k, $n.n_name)); end'


def _updated(spark, sf_dir):
    s = RuleSession(spark, _BIG, [NATION, GRADE])
    s.insert("Nation", nations(spark, sf_dir))
    s.fire()
    s.update(1, n_regionkey=4)
    s.update([2, 3], n_regionkey=0)
    s.update(s.facts("Nation").frame.where("n_nationkey >= 20").select("handle", (4 - F.col("n_regionkey")).alias("n_regionkey")))
    s.fire()
    return grades(s)


add("update_batches", _updated, "SELECT n_nationkey::BIGINT AS custkey, n_name AS grade FROM nation WHERE CASE WHEN n_nationkey = 0 THEN 4 WHEN n_nationkey IN (1, 2) THEN 0 WHEN n_nationkey >= 20 THEN 4 - n_regionkey ELSE n_regionkey END > 2")


def _deleted(spark, sf_dir):
    s = RuleSession(spark, _BIG, [NATION, GRADE])
    s.insert("Nation", nations(spark, sf_dir))
    s.fire()
    s.delete(s.facts("Nation").frame.where("n_nationkey % 2 = 0").select("handle"))
    s.fire()
    return grades(s)


add("delete_batch", _deleted, "SELECT n_nationkey::BIGINT AS custkey, n_name AS grade FROM nation WHERE n_regionkey > 2 AND n_nationkey % 2 = 1")


def _handles(spark, sf_dir):
    s = RuleSession(spark, _BIG, [NATION, GRADE])
    s.insert("Nation", nations(spark, sf_dir))
    s.fire()
    first = s.facts("Grade").frame.select("handle", "custkey")
    s.delete(s.facts("Nation").frame.where("n_nationkey < 10").select("handle"))
    gone = s.fire().deleted
    return first.join(gone, "handle").select("custkey")


add("deleted_handles", _handles, "SELECT n_nationkey::BIGINT AS custkey FROM nation WHERE n_regionkey > 2 AND n_nationkey < 10")


def _reset(spark, sf_dir):
    s = RuleSession(spark, _BIG, [NATION, GRADE])
    s.insert("Nation", nations(spark, sf_dir))
    s.fire()
    s.reset()
    s.insert("Nation", nations(spark, sf_dir).where("n_nationkey > 20"))
    s.fire()
    return grades(s)


add("reset", _reset, "SELECT n_nationkey::BIGINT AS custkey, n_name AS grade FROM nation WHERE n_regionkey > 2 AND n_nationkey > 20")


def _entry(spark, sf_dir):
    s = RuleSession(spark, 'rule "a" when Nation($k : n_nationkey) from entry-point "s" then insert(new Grade($k, "s")); end rule "b" when Nation($k : n_nationkey) then insert(new Grade($k, "main")); end', [NATION, GRADE])
    s.insert("Nation", nations(spark, sf_dir).where("n_regionkey = 1"), entry_point="s")
    s.insert("Nation", nations(spark, sf_dir).where("n_regionkey = 2"))
    s.fire()
    return grades(s)


add("entry_points", _entry, "SELECT n_nationkey::BIGINT AS custkey, CASE n_regionkey WHEN 1 THEN 's' ELSE 'main' END AS grade FROM nation WHERE n_regionkey IN (1, 2)")


def _asked(spark, sf_dir):
    s = RuleSession(spark, "query of(long $r, long $k) Nation(n_regionkey == $r, n_nationkey == $k) end", [NATION])
    s.insert("Nation", nations(spark, sf_dir))
    s.fire()
    s.delete(1)
    return s.query("of", 0, None)


add("session_query", _asked, "SELECT n_regionkey::BIGINT AS r, n_nationkey::BIGINT AS k FROM nation WHERE n_regionkey = 0 AND n_nationkey <> 0")


def _of_fact(spark, sf_dir):
    s = session(spark, sf_dir, 'rule "sum" when Region($r : r_regionkey) accumulate(Nation($k : n_nationkey, n_regionkey == $r); $s : sum($k)) then insertLogical(new Grade($s, "sum")); end', ["region", "nation"], [GRADE])
    s.fire()
    pairs = [(r["custkey"], c) for r in s.facts("Grade").to_pylist() for _, c in s.acc_sources(r["handle"])]
    return spark.createDataFrame(pairs, "total long, contribution long")


add("acc_sources_of_fact", _of_fact, "SELECT (sum(n_nationkey) OVER (PARTITION BY n_regionkey))::BIGINT AS total, n_nationkey::BIGINT AS contribution FROM nation")

# --- consequences
_GETTER = 'rule "r" when $n : Nation($k : n_nationkey) $r : Region(r_regionkey == $n.n_regionkey, r_name matches "A.*") then insert(new Grade($k, $r.r_name)); end'


def _getter(spark, sf_dir):
    s = session(spark, sf_dir, _GETTER, ["nation", "region"], [GRADE])
    s.fire()
    return grades(s)


add("getter_projection", _getter, "SELECT n_nationkey::BIGINT AS custkey, r_name AS grade FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name LIKE 'A%'")


def _quiet(spark, sf_dir):
    s = session(spark, sf_dir, """
        rule "set" when $n : Nation(n_regionkey == 0) then $n.setN_regionkey(9); end
        rule "seen" salience -1 when Nation($k : n_nationkey, n_regionkey == 9) then insert(new Grade($k, "seen")); end
        """, ["nation"], [GRADE])  # fmt: skip
    s.fire()
    return s.facts("Nation").frame.select(F.col("n_nationkey").alias("custkey"), F.col("n_regionkey").cast("string").alias("grade")).unionByName(grades(s))


add("quiet_setter", _quiet, "SELECT n_nationkey::BIGINT AS custkey, (CASE WHEN n_regionkey = 0 THEN 9 ELSE n_regionkey END)::VARCHAR AS grade FROM nation")


def _listening(spark, sf_dir):
    s = session(spark, sf_dir, """
        rule "rename" when $n : Nation(n_name != "x") then modify($n) { setN_name("x") } end
        rule "count" when Nation($k : n_nationkey, n_regionkey > 1) then insert(new Grade($k, "once")); end
        """, ["nation"], [GRADE])  # fmt: skip
    s.fire()
    return grades(s)


add("property_reactivity", _listening, "SELECT n_nationkey::BIGINT AS custkey, 'once' AS grade FROM nation WHERE n_regionkey > 1")


# --- expiry and windows
def _advanced(spark, sf_dir):
    s = RuleSession(spark, 'rule "r" when Stamped($k : k) then insertLogical(new Grade($k, "live")); end', [STAMPED, GRADE])
    s.insert("Stamped", stamped(spark, sf_dir))
    s.fire()
    s.advance(201)
    s.fire()
    return grades(s)


add("expiry_retracts", _advanced, "SELECT n_nationkey::BIGINT AS custkey, 'live' AS grade FROM nation WHERE n_nationkey * 10 + 101 > 201")


def _drained(spark, sf_dir):
    s = RuleSession(spark, 'rule "r" when Stamped($k : k, r == 0) not Stamped(r == 1) then insert(new Grade($k, "alone")); end', [STAMPED, GRADE])
    s.insert("Stamped", stamped(spark, sf_dir).where("r < 2 and k < 12"))
    s.insert("Stamped", spark.createDataFrame([(50, 0, 400)], "k long, r long, ts long"))
    s.fire()
    s.advance(1000)
    s.fire()
    return grades(s)


add("advance_in_order", _drained, "SELECT n_nationkey::BIGINT AS custkey, 'alone' AS grade FROM nation WHERE n_regionkey = 0 AND n_nationkey < 12 AND n_nationkey > (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 1 AND n_nationkey < 12) UNION ALL SELECT 50, 'alone'")


def _inferred(spark, sf_dir):
    bare = FactType("Stamped", STAMPED.fields, timestamp="ts")
    other = FactType("Later", (("k", "long", False), ("ts", "long", False)), timestamp="ts")
    s = RuleSession(spark, 'rule "r" when $a : Stamped() Later(this after[0ms,50ms] $a) then end', [bare, other])
    s.insert("Stamped", stamped(spark, sf_dir))
    s.insert("Later", spark.createDataFrame([(0, 0)], "k long, ts long"))
    s.fire()
    s.advance(171)
    return s.facts("Stamped").frame.select("k")


add("expiry_inferred", _inferred, "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey * 10 + 51 > 171")


def _ring(spark, sf_dir):
    s = RuleSession(spark, 'rule "w" when accumulate(Stamped(r != 3, $k : k) over window:length(4); $s : sum($k)) then insertLogical(new Grade($s, "ring")); end', [STAMPED, GRADE])
    s.insert("Stamped", stamped(spark, sf_dir))
    s.fire()
    s.delete(s.facts("Stamped").frame.where("k in (20, 24)").select("handle"))
    s.fire()
    return grades(s)


add("window_length_after_delete", _ring, "SELECT coalesce(sum(k), 0)::BIGINT AS custkey, 'ring' AS grade FROM (SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 3 ORDER BY 1 DESC LIMIT 4) WHERE k NOT IN (20, 24)")


def _sliding(spark, sf_dir):
    s = RuleSession(spark, 'rule "w" when accumulate(Stamped($k : k) over window:time(50ms); $s : sum($k)) then insertLogical(new Grade($s, "window")); end', [STAMPED, GRADE])
    s.insert("Stamped", stamped(spark, sf_dir))
    s.fire()
    s.advance(200)
    s.fire()
    return grades(s)


add("window_time_after_advance", _sliding, "SELECT sum(n_nationkey)::BIGINT AS custkey, 'window' AS grade FROM nation WHERE n_nationkey * 10 + 50 > 200")


# --- repeated rows, bound recursion, alternatives
def _repeated(spark, sf_dir):
    left, right = fact_type("L", s="long", q="long"), fact_type("Q", v="long")
    rows = read(spark, sf_dir, "lineitem").where("l_orderkey < 200").select(F.col("l_linenumber").cast("bigint").alias("s"), F.col("l_quantity").cast("bigint").alias("q"))
    values = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("v"))
    w = World(spark, {"L": left, "Q": right}, {"L": rows, "Q": values})
    return match(w, parse('rule "r" when L($s : s, $q : q) accumulate(Q(v < $q, $v : v); $t : sum($v)) then end').rules[0].lhs, ["s", "q", "t"])


add("acc_theta_repeated", _repeated, "SELECT l_linenumber::BIGINT AS s, l_quantity::BIGINT AS q, coalesce((SELECT sum(s_suppkey % 40) FROM supplier WHERE s_suppkey % 40 < l_quantity::BIGINT), 0)::BIGINT AS t FROM lineitem WHERE l_orderkey < 200")


def _reached(spark, sf_dir):
    w = World(spark, {"Nation": NATION}, {"Nation": nations(spark, sf_dir)}, queries=parse("query up(long $a, long $b) Nation(n_nationkey == $a, n_regionkey == $b) or (Nation(n_nationkey == $a, n_regionkey == $m, n_nationkey > n_regionkey) and up($m, $b;)) end").queries)
    return run_query(w, "up", 23, None)


add("query_recursive_bound", _reached, "WITH RECURSIVE u(a, b, k, r) AS (SELECT n_nationkey::BIGINT, n_regionkey::BIGINT, n_nationkey, n_regionkey FROM nation WHERE n_nationkey = 23 UNION ALL SELECT u.a, n_regionkey::BIGINT, n_nationkey, n_regionkey FROM u JOIN nation ON n_nationkey = u.r WHERE u.k > u.r) SELECT a, b FROM u")


def _built(spark, sf_dir):
    count = B.Rule("count", salience=2)
    key, n = count.group_by(NATION, B.this("n_nationkey") >= 5, key="n_regionkey", agg=B.count())
    count.then_insert(GRADE, key + n * 100, "count")
    either = B.Rule("either")
    either.when_any((NATION, B.this("n_nationkey") == 3), (NATION, B.this("n_nationkey").in_(4, 5))).when_exists(REGION, B.this("r_name").contains("A")).when_not(REGION, B.this("r_regionkey") > 100)
    either.then_insert_logical(GRADE, -1, "either").then_set_focus("later")
    drop = B.Rule("drop", agenda_group="later")
    least = drop.accumulate(NATION, agg=B.min_(B.this("n_nationkey")))
    drop.then_insert(GRADE, least - 1, "least")
    change = B.Rule("change", salience=5)
    r = change.when(REGION, B.this("r_regionkey") == 4, B.this("r_name") != "gone")
    change.then_modify(r, r_name="gone")
    end = B.Rule("end", salience=-5)
    end.then_delete(end.when(REGION, B.this("r_name") == "gone"))
    s = RuleSession(spark, [count, either, drop, change, end], [NATION, REGION, GRADE])
    s.insert("Nation", nations(spark, sf_dir))
    s.insert("Region", read(spark, sf_dir, "region"))
    s.fire()
    return grades(s).unionByName(s.facts("Region").frame.select(F.col("r_regionkey").alias("custkey"), F.col("r_name").alias("grade")))


add("builder_rules", _built, "SELECT (n_regionkey + count(*) * 100)::BIGINT AS custkey, 'count' AS grade FROM nation WHERE n_nationkey >= 5 GROUP BY n_regionkey UNION ALL SELECT -1, 'either' UNION ALL SELECT (min(n_nationkey) - 1)::BIGINT, 'least' FROM nation UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 4")


def _scenario(spark, sf_dir):
    long_ = lambda *names: [{"name": n, "type": "i64"} for n in names]
    rows = [{"type": "N", "fields": {"k": r["n_nationkey"], "r": r["n_regionkey"]}} for r in nations(spark, sf_dir).collect()]
    got = replay(spark, {
        "types": [{"name": "N", "fields": long_("k", "r")}, {"name": "Out", "fields": long_("r", "n")}],
        "drl": 'rule "s" when groupby(N($k : k, $r : r); $r; $n : sum($k)) then insertLogical(new Out($r, $n)); end',
        "facts": rows[:20], "epochs": [{"actions": [{"op": "delete", "target": 0}, {"op": "update", "target": 1, "fields": {"k": 1000}}], "facts": rows[20:]}],
    })
    return got.session.facts("Out").frame.select("r", "n")


add("scenario_replay", _scenario, "SELECT n_regionkey::BIGINT AS r, sum(CASE n_nationkey WHEN 1 THEN 1000 ELSE n_nationkey END)::BIGINT AS n FROM nation WHERE n_nationkey <> 0 GROUP BY 1")
