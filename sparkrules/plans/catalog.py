"""Queries over the sample tables: one or more for every operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrules.functions import exprs as E
from sparkrules.functions.exact import MODES
from sparkrules.operators import geo, windows
from sparkrules.operators.session import RuleSession
from sparkrules.plans.compile import World, match, run_query
from sparkrules.plans.drl import parse
from sparkrules.sources.facts import FactType, epoch_ms, infer

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_NAMES = {"events": "Event"} | {t: t.capitalize() for t in TABLES if t != "events"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def world(spark: SparkSession, sf_dir: str, clock: int | None = None, events_dur: bool = True) -> World:
    """The sample tables as fact types: integers as longs, timestamps as epoch milliseconds."""
    types, frames = {}, {}
    for table in TABLES:
        df = read(spark, sf_dir, table)
        times = [f.name for f in df.schema if f.dataType.typeName().startswith("timestamp")]
        df = epoch_ms(df, times)
        if table == "events":
            df = df.withColumn("dur", (F.col("value") * 1000).cast("bigint"))
        name = _NAMES[table]
        kind = infer(name, df)
        if table == "events":
            kind = FactType(name, kind.fields, timestamp="ts", duration="dur" if events_dur else None)
        df = df.select(*(F.col(n).cast(kind.kind(n)).alias(n) for n in kind.names))
        if table == "events":
            df = df.withColumn("handle", F.col("event_id"))
        types[name], frames[name] = kind, df
    # exact money: a fact of decimals
    money = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_suppkey").alias("sk"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount").cast("decimal(4,2)")).alias("disc"),
    )
    types["Money"] = FactType("Money", (("ok", "long", False), ("sk", "long", False), ("price", "decimal(18,2)", False), ("disc", "decimal(4,2)", True)))
    frames["Money"] = money
    return World(spark, types, frames, clock=clock)


def lhs_query(lhs: str, *names: str, **options) -> Callable:
    parsed = parse(f'rule "q" when {lhs} then end').rules[0].lhs

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return match(world(spark, sf_dir, **options), parsed, list(names) or None)

    return run


def named_query(text: str, name: str, *args) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = world(spark, sf_dir)
        w.queries = parse(text).queries
        return run_query(w, name, *args)

    return run


def derived(table: str, keys: list[str], **named) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        return E.with_columns(df, **named).select(*keys, *named)

    return run


QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Callable, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


L = "l_orderkey AS o, l_linenumber::BIGINT AS n"
LP = "$o : l_orderkey, $n : l_linenumber"
# --- filters
add("alpha_cmp", lhs_query(f"Lineitem({LP}, l_quantity > 30, l_discount <= 0.05, l_tax != 0.02)"), f"SELECT {L} FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.05 AND l_tax <> 0.02")
add("alpha_scan", lhs_query("Nation($k : n_nationkey, $n : n_name)"), "SELECT n_nationkey::BIGINT AS k, n_name AS n FROM nation")
add("alpha_same_pattern", lhs_query("Lineitem($o : l_orderkey, $n : l_linenumber, $d : l_discount, l_tax > $d)"), f"SELECT {L}, l_discount AS d FROM lineitem WHERE l_tax > l_discount")
add("alpha_group", lhs_query(f"Lineitem({LP}, (l_quantity > 45 || l_quantity < 3) && !(l_returnflag == \"R\" && l_linestatus == \"F\"))"), f"SELECT {L} FROM lineitem WHERE (l_quantity > 45 OR l_quantity < 3) AND NOT (l_returnflag = 'R' AND l_linestatus = 'F')")
add("alpha_abbreviated", lhs_query("Part($k : p_partkey, p_size > 5 && < 10 || == 30)"), "SELECT p_partkey AS k FROM part WHERE (p_size > 5 AND p_size < 10) OR p_size = 30")
add("alpha_bind_restrict", lhs_query("Part($k : p_partkey, $s : p_size > 40 || < 3)"), "SELECT p_partkey AS k, p_size::BIGINT AS s FROM part WHERE p_size > 40 OR p_size < 3")
add("alpha_matches", lhs_query('Part($k : p_partkey, p_name matches "(red|blue) [a-m].*")'), "SELECT p_partkey AS k FROM part WHERE regexp_full_match(p_name, '(red|blue) [a-m].*')")
add("alpha_contains", lhs_query('Part($k : p_partkey, p_name contains "ring", !(p_type contains "ECO"))'), "SELECT p_partkey AS k FROM part WHERE contains(p_name, 'ring') AND NOT contains(p_type, 'ECO')")
add("alpha_in", lhs_query('Customer($k : c_custkey, c_mktsegment in ("BUILDING", "MACHINERY"), c_nationkey not in (1, 2, 3))'), "SELECT c_custkey AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
add("alpha_null", lhs_query("Money($o : ok, $s : sk, disc == null)"), "SELECT l_orderkey AS o, l_suppkey AS s FROM lineitem WHERE NOT l_discount > 0.02")
add("alpha_three_valued", lhs_query("Money($o : ok, $s : sk, !(disc > 0.05B))".replace("0.05B", "1") + " "), "SELECT l_orderkey AS o, l_suppkey AS s FROM lineitem WHERE l_discount > 0.02")
add("alpha_arith", lhs_query("Lineitem($o : l_orderkey, $n : l_linenumber, l_partkey * 2 + 1 > l_suppkey * 60 - 7, l_orderkey % 7 == 3, l_partkey / 10 < 90)"), f"SELECT {L} FROM lineitem WHERE l_partkey * 2 + 1 > l_suppkey * 60 - 7 AND l_orderkey % 7 = 3 AND l_partkey // 10 < 90")
add("alpha_promotion", lhs_query("Lineitem($o : l_orderkey, $n : l_linenumber, l_quantity == l_linenumber)"), f"SELECT {L} FROM lineitem WHERE l_quantity = l_linenumber")
add("alpha_decimal", lhs_query("Money($o : ok, $p : price, price + price > 180000, price * 2 < 200000)"), "SELECT l_orderkey AS o, l_extendedprice::DECIMAL(18,2) AS p FROM lineitem WHERE l_extendedprice::DECIMAL(18,2) * 2 > 180000 AND l_extendedprice::DECIMAL(18,2) * 2 < 200000")
# --- joins
add("join_equi", lhs_query("$c : Customer($k : c_custkey, c_mktsegment == \"BUILDING\") Orders($o : o_orderkey, o_custkey == $k, $t : o_totalprice > 200000)"), "SELECT c_custkey AS k, o_orderkey AS o, o_totalprice AS t FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000")
add("join_three", lhs_query("Nation($nk : n_nationkey, $nn : n_name) Customer($c : c_custkey, c_nationkey == $nk) Orders($o : o_orderkey, o_custkey == $c, o_orderstatus == \"F\")"), "SELECT n_nationkey::BIGINT AS nk, n_name AS nn, c_custkey AS c, o_orderkey AS o FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
add("join_fact_field", lhs_query("$c : Customer($k : c_custkey, c_acctbal < 0) Supplier($s : s_suppkey, s_nationkey == $c.c_nationkey, s_acctbal > $c.c_acctbal)"), "SELECT c_custkey AS k, s_suppkey AS s FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal WHERE c_acctbal < 0")
add("self_join", lhs_query("Nation($a : n_nationkey, $r : n_regionkey) Nation($b : n_nationkey, n_regionkey == $r)"), "SELECT x.n_nationkey::BIGINT AS a, x.n_regionkey::BIGINT AS r, y.n_nationkey::BIGINT AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey")
add("join_theta", lhs_query("Nation($a : n_nationkey) Region($r : r_regionkey, r_regionkey < $a, r_regionkey != 2)"), "SELECT n_nationkey::BIGINT AS a, r_regionkey::BIGINT AS r FROM nation, region WHERE r_regionkey < n_nationkey AND r_regionkey <> 2")
add("join_multi_key", lhs_query("Lineitem($o : l_orderkey, $n : l_linenumber, $p : l_partkey, $s : l_suppkey, l_quantity > 40) Lineitem($o2 : l_orderkey, l_partkey == $p, l_suppkey == $s, l_orderkey != $o)"), "SELECT a.l_orderkey AS o, a.l_linenumber::BIGINT AS n, a.l_partkey AS p, a.l_suppkey AS s, b.l_orderkey AS o2 FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey <> b.l_orderkey WHERE a.l_quantity > 40")
add("join_cartesian", lhs_query("Nation($a : n_nationkey) Region($r : r_regionkey)"), "SELECT n_nationkey::BIGINT AS a, r_regionkey::BIGINT AS r FROM nation, region")
add("not_ce", lhs_query("Orders($o : o_orderkey, o_totalprice > 300000) not Lineitem(l_orderkey == $o, l_returnflag == \"R\")"), "SELECT o_orderkey AS o FROM orders WHERE o_totalprice > 300000 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
add("not_leading", lhs_query("not Nation(n_name == \"none\") Region($r : r_regionkey)"), "SELECT r_regionkey::BIGINT AS r FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'none')")
add("exists_ce", lhs_query("Customer($k : c_custkey) exists Orders(o_custkey == $k, o_totalprice > 400000)"), "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
add("exists_range", lhs_query("Nation($k : n_nationkey) exists Region(r_regionkey > $k)"), "SELECT n_nationkey::BIGINT AS k FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey > n_nationkey)")
add("not_range", lhs_query("Nation($k : n_nationkey) not Region(r_regionkey >= $k)"), "SELECT n_nationkey::BIGINT AS k FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey >= n_nationkey)")
add("not_group", lhs_query("Customer($k : c_custkey) not (Orders($o : o_orderkey, o_custkey == $k) and Lineitem(l_orderkey == $o, l_quantity > 49))"), "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity > 49)")
add("exists_group", lhs_query("Customer($k : c_custkey) exists (Orders($o : o_orderkey, o_custkey == $k) and Lineitem(l_orderkey == $o, l_quantity > 48))"), "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity > 48)")
add("not_or", lhs_query("Nation($k : n_nationkey) not (Customer(c_nationkey == $k, c_acctbal > 9900) or Supplier(s_nationkey == $k, s_acctbal > 9000))"), "SELECT n_nationkey::BIGINT AS k FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
add("exists_or", lhs_query("Nation($k : n_nationkey) exists (Customer(c_nationkey == $k, c_acctbal > 9900) or Supplier(s_nationkey == $k, s_acctbal > 9000))"), "SELECT n_nationkey::BIGINT AS k FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
add("not_nested", lhs_query("Customer($k : c_custkey, c_acctbal > 9000) not (Orders($o : o_orderkey, o_custkey == $k) and not Lineitem(l_orderkey == $o))"), "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))")
add("or_dnf", lhs_query("(Customer($k : c_custkey, c_acctbal > 9500) or Supplier($k : s_suppkey, s_acctbal > 5000)) Region($r : r_regionkey, r_regionkey < 2)"), "SELECT c_custkey AS k, r_regionkey::BIGINT AS r FROM customer, region WHERE c_acctbal > 9500 AND r_regionkey < 2 UNION ALL SELECT s_suppkey, r_regionkey::BIGINT FROM supplier, region WHERE s_acctbal > 5000 AND r_regionkey < 2")
# --- aggregates
S0 = "Supplier($s : s_suppkey)"
add("acc_sum_empty0", lhs_query(f"{S0} accumulate(Money($p : price, sk == $s, price > 100000); $t : sum($p))"), "SELECT s_suppkey AS s, coalesce(sum(l_extendedprice::DECIMAL(18,2)), 0)::DECIMAL(38,2) AS t FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_extendedprice::DECIMAL(18,2) > 100000 GROUP BY s_suppkey")
add("acc_sum_long", lhs_query(f"{S0} accumulate(Lineitem($p : l_partkey, l_suppkey == $s); $t : sum($p))"), "SELECT s_suppkey AS s, coalesce(sum(l_partkey), 0)::BIGINT AS t FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
add("acc_count", lhs_query("Nation($n : n_nationkey) accumulate(Supplier(s_nationkey == $n); $c : count())"), "SELECT n_nationkey::BIGINT AS n, count(s_suppkey) AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
add("acc_count_value", lhs_query(f"{S0} accumulate(Money($d : disc, sk == $s); $c : count($d))"), "SELECT s_suppkey AS s, count(CASE WHEN l_discount > 0.02 THEN 1 END) AS c FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
add("acc_avg_nofire", lhs_query("Nation($n : n_nationkey) accumulate(Supplier($k : s_suppkey, s_nationkey == $n); $a : average($k))"), "SELECT s_nationkey::BIGINT AS n, avg(s_suppkey::DOUBLE) AS a FROM supplier GROUP BY s_nationkey")
add("acc_minmax", lhs_query("Nation($n : n_nationkey) accumulate(Customer($b : c_acctbal, c_nationkey == $n); $lo : min($b)) accumulate(Customer($d : c_acctbal, c_nationkey == $n); $hi : max($d))"), "SELECT c_nationkey::BIGINT AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY c_nationkey")
add("acc_theta", lhs_query("Region($r : r_regionkey) accumulate(Nation(n_nationkey > $r, n_regionkey <= $r); $c : count())"), "SELECT r_regionkey::BIGINT AS r, count(n_nationkey) AS c FROM region LEFT JOIN nation ON n_nationkey > r_regionkey AND n_regionkey <= r_regionkey GROUP BY r_regionkey")
add("acc_global", lhs_query("accumulate(Orders($k : o_orderkey, o_orderstatus == \"F\"); $c : count($k))"), "SELECT count(*) AS c FROM orders WHERE o_orderstatus = 'F'")
add("acc_joined", lhs_query("Customer($k : c_custkey) accumulate(Orders(o_custkey == $k); $c : count()) Nation($n : n_nationkey, n_nationkey == $c)"), "WITH x AS (SELECT c_custkey AS k, count(o_orderkey) AS c FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT k, c, n_nationkey::BIGINT AS n FROM x JOIN nation ON n_nationkey = c")
add("acc_result_test", lhs_query("Customer($k : c_custkey) accumulate(Orders(o_custkey == $k); $c : count(); $c > 12)"), "SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY 1 HAVING count(*) > 12")
add("collect_set", lhs_query("Nation($n : n_nationkey) accumulate(Customer($m : c_mktsegment, c_nationkey == $n); $l : collectSet($m))"), "SELECT n_nationkey::BIGINT AS n, coalesce(list_sort(list(DISTINCT c_mktsegment) FILTER (c_mktsegment IS NOT NULL)), []) AS l FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
add("collect_list", lhs_query("Nation($n : n_nationkey, n_nationkey < 5) accumulate(Event($v : value, user_id == $n); $l : collectList($v))"), "SELECT n_nationkey::BIGINT AS n, coalesce(list(value ORDER BY event_id DESC) FILTER (event_id IS NOT NULL), []) AS l FROM nation LEFT JOIN events ON user_id = n_nationkey WHERE n_nationkey < 5 GROUP BY 1")


def _collect_facts(spark, sf_dir):
    got = lhs_query('$l : List() from collect(Region(r_regionkey > 1))', "l")(spark, sf_dir)
    return got.select(F.size("l").cast("bigint").alias("size"), F.sort_array(F.transform("l", lambda x: x["r_name"])).alias("names"))


add("collect_facts", _collect_facts, "SELECT count(*) AS size, list_sort(list(r_name)) AS names FROM region WHERE r_regionkey > 1")
add("groupby_sum", lhs_query("groupby(Lineitem($s : l_suppkey, $p : l_partkey, l_returnflag == \"R\"); $s; $t : sum($p))"), "SELECT l_suppkey AS s, sum(l_partkey)::BIGINT AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
add("groupby_count", lhs_query("groupby(Event($e : event_type); $e; $c : count())"), "SELECT event_type AS e, count(*) AS c FROM events GROUP BY 1")
for _fn in ("min", "max", "average", "collectSet"):
    _sql = {"min": "min(l_linenumber)::BIGINT", "max": "max(l_linenumber)::BIGINT", "average": "avg(l_linenumber::DOUBLE)", "collectSet": "list_sort(list(DISTINCT l_linenumber::BIGINT))"}[_fn]
    add(f"groupby_{_fn.lower()}", lhs_query(f"groupby(Lineitem($s : l_suppkey, $x : l_linenumber); $s; $r : {_fn}($x))"), f"SELECT l_suppkey AS s, {_sql} AS r FROM lineitem GROUP BY 1")


def _exact_sql(mode: str, scale: int) -> str:
    n, d = f"(u * {10 ** max(scale - 2, 0)})", f"(c * {10 ** max(2 - scale, 0)})"
    away = {
        "up": "r <> 0", "down": "false", "ceiling": "r <> 0 AND u > 0", "floor": "r <> 0 AND u < 0", "half_up": "2 * abs(r) >= d", "half_down": "2 * abs(r) > d",
        "half_even": "2 * abs(r) > d OR (2 * abs(r) = d AND q % 2 <> 0)",
    }[mode]
    return (
        f"WITH g AS (SELECT l_suppkey AS s, sum((l_extendedprice::DECIMAL(18,2) * 100)::HUGEINT)::HUGEINT - 7000000000::HUGEINT AS u, count(*)::HUGEINT AS c FROM lineitem GROUP BY 1), "
        f"h AS (SELECT s, u, {d} AS d, {n} % {d} AS r, {n} // {d} AS q FROM g) SELECT s, (q + CASE WHEN {away} THEN CASE WHEN u < 0 THEN -1 ELSE 1 END ELSE 0 END)::DECIMAL(38,0) AS a FROM h"
    )


def _exact(mode: str, scale: int) -> Callable:
    def run(spark, sf_dir):
        got = lhs_query(f"groupby(Money($s : sk, $p : price); $s; $a : averageExact($p, {scale}, {mode}))")(spark, sf_dir)
        return got.select("s", F.col("a").cast(f"decimal(38,{scale})").alias("a"))

    return run


for _mode in MODES:
    _sql = _exact_sql(_mode, 1).replace(" - 7000000000::HUGEINT", "").replace("::DECIMAL(38,0) AS a", "::DECIMAL(38,1) / 10 AS a")
    add(f"avg_exact_{_mode}", _exact(_mode, 1), f"SELECT s, a::DECIMAL(38,1) AS a FROM ({_sql})")
# --- time
EV = "ts, epoch_ms(ts) AS t, epoch_ms(ts) + trunc(value * 1000)::BIGINT AS te"
add("temporal_after", lhs_query("$a : Event($i : event_id, $u : user_id, event_type == \"error\") $b : Event($j : event_id, user_id == $u, this after[1ms,3600000ms] $a)", "i", "j"), f"WITH e AS (SELECT *, {EV} FROM events) SELECT a.event_id AS i, b.event_id AS j FROM e a JOIN e b ON a.user_id = b.user_id AND b.t - a.te BETWEEN 1 AND 3600000 WHERE a.event_type = 'error'".replace("*, ts, epoch", "*, epoch"))
add("temporal_before", lhs_query("$a : Event($i : event_id, $u : user_id, event_type == \"purchase\") $b : Event($j : event_id, user_id == $u, this before[0ms,30m] $a)", "i", "j"), "WITH e AS (SELECT *, epoch_ms(ts) AS t, epoch_ms(ts) + trunc(value * 1000)::BIGINT AS te FROM events) SELECT a.event_id AS i, b.event_id AS j FROM e a JOIN e b ON a.user_id = b.user_id AND a.t - b.te BETWEEN 0 AND 1800000 WHERE a.event_type = 'purchase'")
add("temporal_bucketed", lhs_query("$a : Event($i : event_id, event_type == \"error\") $b : Event($j : event_id, event_type == \"purchase\", this after[0ms,5m] $a)", "i", "j"), "WITH e AS (SELECT *, epoch_ms(ts) AS t, epoch_ms(ts) + trunc(value * 1000)::BIGINT AS te FROM events) SELECT a.event_id AS i, b.event_id AS j FROM e a JOIN e b ON b.t - a.te BETWEEN 0 AND 300000 WHERE a.event_type = 'error' AND b.event_type = 'purchase'")
add("temporal_not", lhs_query("$a : Event($i : event_id, $u : user_id, event_type == \"error\") not Event(user_id == $u, this after[1ms,60m] $a)", "i"), "WITH e AS (SELECT *, epoch_ms(ts) AS t, epoch_ms(ts) + trunc(value * 1000)::BIGINT AS te FROM events) SELECT event_id AS i FROM e a WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM e b WHERE a.user_id = b.user_id AND b.t - a.te BETWEEN 1 AND 3600000)")
add("temporal_not_bucketed", lhs_query("$a : Event($i : event_id, event_type == \"error\") not Event(event_type == \"purchase\", this after[0ms,1m] $a)", "i"), "WITH e AS (SELECT *, epoch_ms(ts) AS t, epoch_ms(ts) + trunc(value * 1000)::BIGINT AS te FROM events) SELECT event_id AS i FROM e a WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM e b WHERE event_type = 'purchase' AND b.t - a.te BETWEEN 0 AND 60000)")
_ALLEN = {
    "coincides": ("[500000ms]", "abs(b.t - a.t) <= 500000 AND abs(b.te - a.te) <= 500000"), "meets": ("[60000ms]", "abs(b.te - a.t) <= 60000"), "metby": ("[60000ms]", "abs(b.t - a.te) <= 60000"),
    "overlaps": ("", "b.t < a.t AND a.t < b.te AND b.te < a.te"), "overlappedby": ("", "a.t < b.t AND b.t < a.te AND a.te < b.te"), "during": ("", "a.t < b.t AND b.te < a.te"), "includes": ("", "b.t < a.t AND a.te < b.te"),
    "starts": ("[300000ms]", "abs(b.t - a.t) <= 300000 AND b.te < a.te"), "startedby": ("[300000ms]", "abs(b.t - a.t) <= 300000 AND b.te > a.te"), "finishes": ("[300000ms]", "abs(b.te - a.te) <= 300000 AND b.t > a.t"),
    "finishedby": ("[300000ms]", "abs(b.te - a.te) <= 300000 AND b.t < a.t"),
}
for _op, (_bounds, _cond) in _ALLEN.items():
    add(
        f"allen_{_op}",
        lhs_query(f"$a : Event($i : event_id, $u : user_id) $b : Event($j : event_id, user_id == $u, this {_op}{_bounds} $a)", "i", "j"),
        f"WITH e AS (SELECT *, epoch_ms(ts) AS t, epoch_ms(ts) + trunc(value * 1000)::BIGINT AS te FROM events) SELECT a.event_id AS i, b.event_id AS j FROM e a JOIN e b ON a.user_id = b.user_id AND {_cond}",
    )
CLOCK = 1_704_240_000_000  # 2024-01-03
add("window_time", lhs_query("accumulate(Event($v : value) over window:time(6h); $c : count($v))", clock=CLOCK), f"SELECT count(*) AS c FROM events WHERE epoch_ms(ts) + 21600000 > {CLOCK}")
add("window_length", lhs_query("accumulate(Event($v : event_id, event_type == \"click\") over window:length(100); $c : sum($v))"), "SELECT sum(event_id)::BIGINT AS c FROM (SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 100)")


def _replay(spark, sf_dir):
    df = epoch_ms(read(spark, sf_dir, "events"), ["ts"])
    return windows.replay_time_window(df, ["user_id"], "ts", 3_600_000, F.count("*"), "n").select("event_id", "n")


add("window_time_replay", _replay, "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS n FROM events")
add("window_length_by_key", lambda s, d: windows.in_length_window(read(s, d, "events"), ["user_id"], [F.desc("event_id")], 3).select("user_id", "event_id"), "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
add("expires_at_clock", lambda s, d: windows.live_at(epoch_ms(read(s, d, "events"), ["ts"]).withColumn("dur", (F.col("value") * 1000).cast("bigint")), "ts", 3_600_000, CLOCK, "dur").select("event_id"), f"SELECT event_id FROM events WHERE epoch_ms(ts) + trunc(value * 1000)::BIGINT + 3600001 > {CLOCK}")
# --- queries
PEOPLE = """
query customers(long $n, long $k) Customer($n := c_nationkey, $k := c_custkey, c_acctbal > 5000) end
query same(long $n, long $k) Customer(c_nationkey == $n, c_custkey == $k) end
query both(long $n, long $a) Customer(c_nationkey == $n, c_custkey == $a, c_acctbal > 9000) or Supplier(s_nationkey == $n, s_suppkey == $a, s_acctbal > 5000) end
query orders(long $n, long $o) same($n, $c;) Orders(o_custkey == $c, o_orderkey == $o, o_totalprice > 450000) end
query pos(long $k, long $r) Nation($k, "NATION_3", $r;) end
query up(long $a, long $b)
  Nation(n_nationkey == $a, n_regionkey == $b) or (Nation(n_nationkey == $a, n_regionkey == $m, n_nationkey > n_regionkey) and up($m, $b;))
end
""".replace("query customers(long $n, long $k) Customer($n := c_nationkey, $k := c_custkey, c_acctbal > 5000) end\n", "")  # fmt: skip
add("query_bound", named_query(PEOPLE, "same", 7, None), "SELECT c_nationkey::BIGINT AS n, c_custkey AS k FROM customer WHERE c_nationkey = 7")
add("query_unbound", named_query(PEOPLE, "same", None, None), "SELECT c_nationkey::BIGINT AS n, c_custkey AS k FROM customer")
add("query_or", named_query(PEOPLE, "both", None, None), "SELECT c_nationkey::BIGINT AS n, c_custkey AS a FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey::BIGINT, s_suppkey FROM supplier WHERE s_acctbal > 5000")
add("query_calls_query", lambda s, d: named_query(PEOPLE, "orders", None, None)(s, d).select("n", "o"), "SELECT c_nationkey::BIGINT AS n, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000")
add("query_positional", named_query(PEOPLE, "pos", None, None), "SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS r FROM nation WHERE n_name = 'NATION_3'")
add("query_recursive", lambda s, d: named_query(PEOPLE, "up", None, None)(s, d), "WITH RECURSIVE u(a, b) AS (SELECT n_nationkey::BIGINT, n_regionkey::BIGINT FROM nation UNION ALL SELECT n_nationkey::BIGINT, u.b FROM nation JOIN u ON n_regionkey = u.a WHERE n_nationkey > n_regionkey) SELECT a, b FROM u")


def _pull(spark, sf_dir):
    w = world(spark, sf_dir)
    w.queries = parse(PEOPLE).queries
    return match(w, parse('rule "p" when Nation($n : n_nationkey, n_regionkey == 1) ?both($n, $a;) then end').rules[0].lhs, ["n", "a"])


add("pull_query", _pull, "SELECT n_nationkey::BIGINT AS n, a FROM nation JOIN (SELECT c_nationkey AS k, c_custkey AS a FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, s_suppkey FROM supplier WHERE s_acctbal > 5000) ON k = n_nationkey WHERE n_regionkey = 1")

# --- sessions
VIP = FactType("Vip", (("custkey", "long", False), ("orderkey", "long", False)))
VIP_RULES = """
rule "vip" when
  Customer($c : c_custkey, c_mktsegment == "BUILDING")
  Orders($o : o_orderkey, o_custkey == $c, o_totalprice > 200000)
  not Lineitem(l_orderkey == $o, l_returnflag == "R")
then insert(new Vip($c, $o)); end
"""
VIP_SQL = "SELECT c_custkey AS custkey, o_orderkey AS orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"


def session(spark: SparkSession, sf_dir: str, rules: str, tables: list[str], more: list[FactType]) -> RuleSession:
    w = world(spark, sf_dir, events_dur=False)
    names = [_NAMES.get(t, t) for t in tables]
    s = RuleSession(spark, rules, [w.types[n] for n in names] + more)
    for n in names:
        s.insert(n, w.frames[n].select(*w.types[n].names))
    return s


def vip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, VIP_RULES, ["customer", "orders", "lineitem"], [VIP])
    return s.fire().derived["Vip"].frame.select("custkey", "orderkey")


add("session_vip", vip, VIP_SQL)
GRADE = FactType("Grade", (("custkey", "long", False), ("grade", "string", False)))


def _chain(spark, sf_dir):
    s = session(spark, sf_dir, """
        rule "rich" when Customer($c : c_custkey, c_acctbal > 9000) then insert(new Grade($c, "rich")); end
        rule "far" when Grade($c : custkey, grade == "rich") Customer(c_custkey == $c, c_nationkey > 20) then insert(new Grade($c, "far")); end
        """, ["customer"], [GRADE])  # fmt: skip
    return s.fire().derived["Grade"].frame.select("custkey", "grade")


add("chain_insert", _chain, "SELECT c_custkey AS custkey, 'rich' AS grade FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT c_custkey, 'far' FROM customer WHERE c_acctbal > 9000 AND c_nationkey > 20")
_LOGICAL = """
rule "held" when Nation($n : n_nationkey, $r : n_regionkey) then insertLogical(new Grade($r, "held")); end
rule "next" when Grade($r : custkey, grade == "held") then insertLogical(new Grade($r, "next")); end
"""


def _tms(spark, sf_dir):
    s = session(spark, sf_dir, _LOGICAL, ["nation"], [GRADE])
    s.fire()
    for h in [r["handle"] for r in s.facts("Nation").to_pylist() if r["n_regionkey"] == 2 or r["n_nationkey"] == 4]:
        s.delete(h)
    s.fire()
    return s.facts("Grade").frame.select("custkey", "grade")


add("tms_retract", _tms, "SELECT DISTINCT n_regionkey::BIGINT AS custkey, g AS grade FROM nation, (VALUES ('held'), ('next')) v(g) WHERE n_regionkey <> 2 AND n_nationkey <> 4")


def _why(spark, sf_dir):
    s = session(spark, sf_dir, _LOGICAL, ["nation"], [GRADE])
    s.fire()
    facts = s.facts("Grade").frame.select("handle", "custkey", "grade")
    return s.justifications().join(facts, "handle").groupBy("custkey", "grade").agg(F.count("*").alias("supports"))


add("why_graph", _why, "SELECT n_regionkey::BIGINT AS custkey, 'held' AS grade, count(*) AS supports FROM nation GROUP BY 1 UNION ALL SELECT DISTINCT n_regionkey::BIGINT, 'next', 1 FROM nation")


def _salience(spark, sf_dir):
    s = session(spark, sf_dir, 'rule "r" salience ($k) when $x : Region($k : r_regionkey) then end rule "fixed" salience 2 when Region(r_regionkey == 0) then end', ["region"], [])
    return s.fire().firings.frame.select("seq", "rule", F.get_json_object("values_json", "$.r_regionkey").cast("bigint").alias("k"))


def _firing(spark, sf_dir):
    s = session(spark, sf_dir, 'rule "r" when $n : Nation(n_regionkey == 1) $r : Region(r_regionkey == $n.n_regionkey) then end', ["nation", "region"], [])
    rows = s.fire().firings.frame
    return rows.groupBy("rule", "type").agg(F.count("*").alias("facts"), F.countDistinct("seq").alias("firings"))


add("firing_audit", _firing, "SELECT 'r' AS rule, t AS type, count(*) AS facts, count(*) AS firings FROM nation, (VALUES ('Nation'), ('Region')) v(t) WHERE n_regionkey = 1 GROUP BY t")


def _modify(spark, sf_dir):
    s = session(spark, sf_dir, """
        rule "move" no-loop true when $n : Nation($k : n_nationkey, $r : n_regionkey, n_regionkey < 3) then modify($n) { setN_regionkey($r + 10) } end
        rule "drop" salience -1 when $n : Nation(n_regionkey == 3) then delete($n); end
        """, ["nation"], [])  # fmt: skip
    s.fire()
    return s.facts("Nation").frame.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))


add("modify_delete", _modify, "SELECT n_nationkey::BIGINT AS k, (CASE WHEN n_regionkey < 3 THEN n_regionkey + 10 ELSE n_regionkey END)::BIGINT AS r FROM nation WHERE n_regionkey <> 3")


def _logical_sum(spark, sf_dir):
    s = session(spark, sf_dir, 'rule "sum" when accumulate(Nation($r : n_regionkey, $k : n_nationkey); $s : sum($k)) then insertLogical(new Grade($s, "sum")); end', ["nation"], [GRADE])
    s.fire()
    s.delete(next(r["handle"] for r in s.facts("Nation").to_pylist() if r["n_nationkey"] == 24))
    s.fire()
    return s.facts("Grade").frame.select("custkey", "grade")


add("logical_aggregate", _logical_sum, "SELECT sum(n_nationkey)::BIGINT AS custkey, 'sum' AS grade FROM nation WHERE n_nationkey <> 24")


def _sources(spark, sf_dir):
    s = session(spark, sf_dir, 'rule "sum" when Region($r : r_regionkey) accumulate(Nation($k : n_nationkey, n_regionkey == $r); $s : sum($k)) then end', ["region", "nation"], [])
    s.fire()
    region = s.facts("Region").frame.select(F.col("handle").alias("h"), F.col("r_regionkey").alias("r"))
    return s.acc_sources("sum").join(region, F.col("left")[0] == F.col("h")).select("r", "contribution")


add("acc_sources", _sources, "SELECT n_regionkey::BIGINT AS r, n_nationkey::BIGINT AS contribution FROM nation")


def _focus(spark, sf_dir):
    s = session(spark, sf_dir, """
        rule "start" when Region(r_regionkey == 0) then drools.setFocus("g1"); drools.setFocus("g2"); end
        rule "one" agenda-group "g1" when Region($k : r_regionkey) then insert(new Grade($k, "one")); end
        rule "two" agenda-group "g2" when Region($k : r_regionkey, r_regionkey < 2) then insert(new Grade($k, "two")); end
        rule "starved" agenda-group "g3" when Region($k : r_regionkey) then insert(new Grade($k, "never")); end
        """, ["region"], [GRADE])  # fmt: skip
    return s.fire().derived["Grade"].frame.select("custkey", "grade")


add("agenda_focus", _focus, "SELECT r_regionkey::BIGINT AS custkey, 'one' AS grade FROM region UNION ALL SELECT r_regionkey::BIGINT, 'two' FROM region WHERE r_regionkey < 2")


def _places_of(spark, sf_dir):
    rows = _salience(spark, sf_dir).where("rule = 'r'")
    return rows.select(F.row_number().over(Window.partitionBy("rule").orderBy("seq")).cast("bigint").alias("place"), F.coalesce("k", F.lit(-1)).alias("k"))


add("salience_rank", _places_of, "SELECT row_number() OVER (ORDER BY r_regionkey DESC) AS place, r_regionkey::BIGINT AS k FROM region")

# --- derived columns
c = E.col
K = ["l_orderkey", "l_linenumber"]
KS = "l_orderkey, l_linenumber"
add("derive_arith", derived("lineitem", K, a=c("l_partkey") * 2 + c("l_suppkey") - 7, b=c("l_quantity") * c("l_discount"), n=-c("l_partkey"), m=abs(c("l_suppkey") - 50)), f"SELECT {KS}, l_partkey * 2 + l_suppkey - 7 AS a, l_quantity * l_discount AS b, -l_partkey AS n, abs(l_suppkey - 50) AS m FROM lineitem")
add("derive_div_ieee", derived("lineitem", K, d=c("l_quantity") / c("l_tax"), z=(c("l_tax") - c("l_tax")) / c("l_discount"), i=c("l_partkey") // 7, r=c("l_partkey") % 7, q=c("l_quantity") % 4.5), f"SELECT {KS}, CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE l_quantity / l_tax END AS d, CASE WHEN l_discount = 0 THEN 'nan'::DOUBLE ELSE 0 / l_discount END AS z, l_partkey // 7 AS i, l_partkey % 7 AS r, l_quantity % 4.5::DOUBLE AS q FROM lineitem")
add("derive_pow", derived("lineitem", K, p=c("l_linenumber") ** 2, h=c("l_quantity") ** 0.5), f"SELECT {KS}, pow(l_linenumber, 2)::DOUBLE AS p, sqrt(l_quantity) AS h FROM lineitem")
add("derive_compare", derived("lineitem", K, e=c("l_quantity") == c("l_linenumber"), g=c("l_tax") > c("l_discount"), x=(c("l_tax") > 0.05) & ~(c("l_discount") <= 0.03) | (c("l_returnflag") != "R")), f"SELECT {KS}, l_quantity = l_linenumber AS e, l_tax > l_discount AS g, (l_tax > 0.05 AND NOT l_discount <= 0.03) OR l_returnflag <> 'R' AS x FROM lineitem")
_NAN = (c("l_tax") - c("l_tax")) / (c("l_tax") - c("l_tax"))
add("derive_nan_compare", derived("lineitem", K, eq=_NAN == _NAN, ne=_NAN != 1.0, gt=_NAN > 1.0, lt=_NAN < 1.0), f"SELECT {KS}, false AS eq, true AS ne, false AS gt, false AS lt FROM lineitem")
add("derive_nulls", lambda s, d: E.with_columns(read(s, d, "labels"), n=c("quality").is_null(), m=c("toxic").is_not_null(), f=c("quality").fill_null(9), k=E.if_else(c("quality") == 1, "good", "bad")).select("doc_id", "n", "m", "f", "k"), "SELECT doc_id, quality IS NULL AS n, toxic IS NOT NULL AS m, coalesce(quality, 9)::BIGINT AS f, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS k FROM labels")
add("derive_cast_half_even", derived("lineitem", K, i=(c("l_quantity") / 2).cast("i64"), f=c("l_partkey").cast("f64")), f"SELECT {KS}, round_even(l_quantity / 2, 0)::BIGINT AS i, l_partkey::DOUBLE AS f FROM lineitem")
add("derive_round", derived("lineitem", K, r=(c("l_extendedprice") / 7).round(3), t=c("l_extendedprice").round(-2), fl=(c("l_quantity") / 4).floor(), ce=(c("l_quantity") / 4).ceil()), f"SELECT {KS}, round(l_extendedprice / 7, 3) AS r, round(l_extendedprice, -2) AS t, floor(l_quantity / 4)::DOUBLE AS fl, ceil(l_quantity / 4)::DOUBLE AS ce FROM lineitem")
_T = c("l_discount") * 3
add(
    "derive_math",
    derived("lineitem", K, sq=c("l_quantity").sqrt().round(9), si=_T.sin().round(9), co=_T.cos().round(9), ta=_T.tan().round(9), asi=c("l_discount").asin().round(9), aco=c("l_discount").acos().round(9), ata=_T.atan().round(9), ln=c("l_quantity").ln().round(9), lg=c("l_quantity").log10().round(9), ex=_T.exp().round(9), dg=_T.degrees().round(9), ra=c("l_quantity").radians().round(9)),
    f"SELECT {KS}, round(sqrt(l_quantity), 9) AS sq, round(sin(l_discount * 3), 9) AS si, round(cos(l_discount * 3), 9) AS co, round(tan(l_discount * 3), 9) AS ta, round(asin(l_discount), 9) AS asi, round(acos(l_discount), 9) AS aco, round(atan(l_discount * 3), 9) AS ata, round(ln(l_quantity), 9) AS ln, round(log10(l_quantity), 9) AS lg, round(exp(l_discount * 3), 9) AS ex, round(degrees(l_discount * 3), 9) AS dg, round(radians(l_quantity), 9) AS ra FROM lineitem",
)
add("derive_strings", derived("part", ["p_partkey"], n=c("p_name").str_len(), a=c("p_name").str_contains("in"), b=c("p_name").str_starts_with("red"), e=c("p_name").str_ends_with(c("p_type")), x=E.concat(c("p_brand"), "-", c("p_type"))), "SELECT p_partkey, strlen(p_name) AS n, contains(p_name, 'in') AS a, starts_with(p_name, 'red') AS b, ends_with(p_name, p_type) AS e, p_brand || '-' || p_type AS x FROM part")
add("derive_regexp", derived("part", ["p_partkey"], s=c("p_name").regexp_matches("r[a-e]"), f=c("p_name").regexp_full_match(r"\w+ ring")), r"SELECT p_partkey, regexp_matches(p_name, 'r[a-e]') AS s, regexp_full_match(p_name, '\w+ ring') AS f FROM part")
add("derive_filter", lambda s, d: E.filter(read(s, d, "lineitem"), (c("l_quantity") > 45) & (c("l_returnflag") == "A")).select(*K), f"SELECT {KS} FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'A'")


def _places(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37 % 180) - 90).cast("double").alias("lat"), ((F.col("s_suppkey") * 101 % 360) - 180).cast("double").alias("lon"))


_P = "SELECT s_suppkey, ((s_suppkey * 37 % 180) - 90)::DOUBLE AS lat, ((s_suppkey * 101 % 360) - 180)::DOUBLE AS lon FROM supplier"
_D = "2 * 6371000 * asin(sqrt(least(1, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


def _haversine(spark, sf_dir):
    p = _places(spark, sf_dir)
    return geo.haversine(p.withColumn("la", F.lit(10.0)).withColumn("lo", F.lit(20.0)), "la", "lo", "lat", "lon", "m").select("s_suppkey", "m")


add("haversine", _haversine, f"WITH a AS (SELECT 10.0 AS lat, 20.0 AS lon), b AS ({_P}) SELECT s_suppkey, round({_D})::BIGINT AS m FROM a, b")


def _pairs(spark, sf_dir):
    return geo.pair_candidates(_places(spark, sf_dir), "s_suppkey", "lat", "lon", 2_000_000.0, "m").where("m <= 2000000").select("key", "m")


add("pair_candidates", _pairs, f"WITH p AS ({_P}) SELECT a.s_suppkey || '|' || b.s_suppkey AS key, round({_D})::BIGINT AS m FROM p a JOIN p b ON a.s_suppkey < b.s_suppkey WHERE round({_D}) <= 2000000")


def _closing(spark, sf_dir):
    df = epoch_ms(read(spark, sf_dir, "events"), ["ts"])
    return geo.closing(df, "ts", "user_id", "value", 3_600_000, "closing", "event_id").select("event_id", "closing")


add("closing", _closing, "SELECT event_id, coalesce(lag(epoch_ms(ts)) OVER w >= epoch_ms(ts) - 3600000 AND value < lag(value) OVER w, false) AS closing FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id)")
