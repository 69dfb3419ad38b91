"""Queries over revised facts, vintages, as-of joins and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, history, intervals, rules
from . import registry as g
from .registry import query, r, table

CUT = "1998-06-30"


@query("d1_keep_first", "SELECT cik, tag, accepted, adsh, value FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag ORDER BY accepted, adsh, value) n FROM facts) WHERE n = 1")
def d1(spark, d):
    return history.keep_first(g.facts(spark, d), ["cik", "tag"], "accepted", ["adsh", "value"])


@query("d2_first_filed_value", "SELECT cik, tag, min(accepted) AS first_accepted, count(*) AS versions FROM facts GROUP BY 1, 2")
def d2(spark, d):
    return g.facts(spark, d).groupBy("cik", "tag").agg(F.min("accepted").alias("first_accepted"), F.count("*").alias("versions"))


@query("d3_equal_time_conflicts", "SELECT cik, tag, accepted, count(DISTINCT value) AS distinct_values, count(*) AS candidate_rows, array_to_string(list_sort(list(DISTINCT CAST(CAST(value AS INT) AS VARCHAR))), ',') AS vals FROM facts GROUP BY 1, 2, 3 HAVING count(DISTINCT value) > 1")
def d3(spark, d):
    f = g.facts(spark, d).withColumn("value", F.col("value").cast("int"))
    return history.conflicts(f, ["cik", "tag"], "accepted", "value").select("cik", "tag", "accepted", "distinct_values", "candidate_rows", F.array_join("values", ",").alias("vals"))


@query("d4_vintages_as_of", """SELECT series, observed, available, value FROM (SELECT *, row_number() OVER (PARTITION BY series, observed ORDER BY available DESC, value, event_id) n
FROM vintages WHERE available <= TIMESTAMP '2024-01-20 12:00:00') WHERE n = 1""")
def d4(spark, d):
    at = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return history.latest_vintages(g.vintages(spark, d), "series", "observed", "available", "value", at, ["event_id"]).select("series", "observed", "available", "value")


@query("d5_latest_unambiguous", """WITH t AS (SELECT cik, accepted, min(value) a, max(value) b FROM facts GROUP BY 1, 2), u AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY accepted DESC) n FROM t)
SELECT cik, accepted, CASE WHEN a = b THEN a END AS value, a <> b AS conflict FROM u WHERE n = 1""")
def d5(spark, d):
    return history.latest_unambiguous(g.facts(spark, d), ["cik"], "accepted", "value")


@query("d6_precision_coalescing", """WITH p AS (SELECT l_partkey AS k, l_extendedprice AS v, CAST(l_linenumber % 3 AS INT) AS decimals FROM lineitem), b AS (SELECT k, max_by(v, (decimals, v)) AS best FROM p GROUP BY 1)
SELECT p.k, any_value(best) AS v, bool_and(round(best * pow(10.0, decimals)) = round(v * pow(10.0, decimals))) AS agrees, count(*) AS rows FROM p JOIN b USING (k) GROUP BY 1""")
def d6(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("v"), (F.col("l_linenumber") % 3).cast("int").alias("decimals"))
    return history.coalesce_by_precision(p, ["k"], "v", "decimals")


@query("d7_highest_version", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def d7(spark, d):
    return history.keep_last(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("d22_content_gate", "SELECT cik, tag, count(DISTINCT (adsh, value)) AS contents FROM facts GROUP BY 1, 2 HAVING count(DISTINCT (adsh, value)) > 1")
def d22(spark, d):
    return history.distinct_count_gate(g.facts(spark, d), ["cik", "tag"], F.struct("adsh", "value"))


@query("b1_whole_or_parts", """SELECT cik, tag, accepted, value FROM facts WHERE value > 10 UNION ALL
SELECT cik, tag, accepted, value FROM facts f WHERE value <= 10 AND value IN (1,2,3) AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.cik = f.cik AND g.tag = f.tag AND g.value > 10)""")
def b1(spark, d):
    return history.prefer_whole(g.facts(spark, d), ["cik", "tag"], F.col("value") > 10, F.col("value").isin(1, 2, 3)).select("cik", "tag", "accepted", "value")


@query("b2_invariants", "SELECT count(*) FILTER (WHERE cik IS NULL OR tag IS NULL) AS null_keys, count(*) FILTER (WHERE value IS DISTINCT FROM abs(value)) AS sign_drift, (SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)) AS orphans FROM facts")
def b2(spark, d):
    f = g.facts(spark, d)
    orphans = f.join(table(spark, d, "orders"), F.col("cik") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans"))
    bad = f.agg(F.count_if(F.col("cik").isNull() | F.col("tag").isNull()).alias("null_keys"), F.count_if(~F.col("value").eqNullSafe(F.abs("value"))).alias("sign_drift"))
    return bad.crossJoin(orphans)  # one row each


@query("b6_availability_guard", f"SELECT cik, tag, accepted, value, accepted <= DATE '{CUT}' AS visible FROM facts")
def b6(spark, d):
    return g.facts(spark, d).select("cik", "tag", "accepted", "value", (F.col("accepted") <= F.lit(CUT).cast("date")).alias("visible"))


@query("i1_pit_view", """WITH bad AS (SELECT DISTINCT cik, tag FROM (SELECT cik, tag FROM facts GROUP BY cik, tag, accepted HAVING count(DISTINCT value) > 1))
SELECT cik, tag, accepted, adsh, value FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag ORDER BY accepted, adsh, value) n FROM facts f WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.cik = f.cik AND bad.tag = f.tag)) WHERE n = 1""")
def i1_pit(spark, d):
    return history.pit_views(g.facts(spark, d), ["cik", "tag"], "accepted", "value", ["adsh", "value"])[0]


@query("i1_latest_view", """WITH bad AS (SELECT DISTINCT cik, tag FROM (SELECT cik, tag FROM facts GROUP BY cik, tag, accepted HAVING count(DISTINCT value) > 1))
SELECT cik, tag, accepted, adsh, value FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag ORDER BY accepted DESC, adsh DESC, value DESC) n FROM facts f WHERE (cik, tag) NOT IN (SELECT cik, tag FROM bad)) WHERE n = 1""")
def i1_latest(spark, d):
    return history.pit_views(g.facts(spark, d), ["cik", "tag"], "accepted", "value", ["adsh", "value"])[1]


def _events(spark, d, kind):
    return table(spark, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.col("value").alias("v"), F.col("event_id").alias("id"))


_SIDES = "WITH kinds AS (SELECT DISTINCT event_type FROM events ORDER BY 1), l AS (SELECT user_id k, ts t, event_id id FROM events WHERE event_type = 'click'), q AS (SELECT user_id k, ts t, value v, event_id id FROM events WHERE event_type = 'view')"


def _sides(spark, d):
    left = _events(spark, d, "click").select("k", "t", F.col("id").alias("left_id"))
    right = _events(spark, d, "view").select("k", F.col("t").alias("rt"), "v", F.col("id").alias("rid"))
    return left, right


@query("c1_asof_backward", _SIDES + " SELECT l.id AS left_id, q.t AS rt, q.v AS v FROM l ASOF LEFT JOIN q ON l.k = q.k AND l.t >= q.t")
def c1(spark, d):
    left, right = _sides(spark, d)
    return asof.asof_backward(left, right, ["k"], "t", "rt").select("left_id", "match.rt", "match.v")


# One key with all rows: each bucket of time is sorted by itself, and the last row before it is handed over.
@query("c1_asof_hot_key", "WITH l AS (SELECT event_id id, ts t FROM events WHERE event_type = 'click'), q AS (SELECT ts t, max(value) v FROM events WHERE event_type = 'view' GROUP BY 1) SELECT l.id AS left_id, b.t AS before_t, b.v AS before_v, f.t AS after_t FROM l ASOF LEFT JOIN q b ON l.t > b.t ASOF LEFT JOIN q f ON l.t <= f.t")
def c1_hot(spark, d):
    one = F.lit(1).alias("k")
    left = _events(spark, d, "click").select(one, "t", F.col("id").alias("left_id"))
    right = _events(spark, d, "view").select(one, F.col("t").alias("rt"), "v").groupBy("k", "rt").agg(F.max("v").alias("v"))
    back = asof.asof_backward(left, right, ["k"], "t", "rt", "b", strict=True, buckets=64)
    return asof.asof_forward(back, right, ["k"], "t", "rt", "f", buckets=64).select("left_id", F.col("b.rt").alias("before_t"), F.col("b.v").alias("before_v"), F.col("f.rt").alias("after_t"))


@query("c2_asof_tolerant", _SIDES + " SELECT l.id AS left_id, CASE WHEN date_diff('day', CAST(q.t AS DATE), CAST(l.t AS DATE)) <= 1 THEN q.v END AS v FROM l ASOF LEFT JOIN q ON l.k = q.k AND l.t >= q.t")
def c2(spark, d):
    left, right = _sides(spark, d)
    return asof.asof_tolerant(left, right, ["k"], "t", "rt", 1).select("left_id", "match.v")


@query("c3_asof_either_side", _SIDES + """, b AS (SELECT l.id, l.t, q.t bt, q.v bv FROM l ASOF LEFT JOIN q ON l.k = q.k AND l.t >= q.t), f AS (SELECT l.id, q.t ft, q.v fv FROM l ASOF LEFT JOIN q ON l.k = q.k AND l.t <= q.t)
SELECT id AS left_id, CASE WHEN abs(date_diff('day', CAST(bt AS DATE), CAST(t AS DATE))) <= 1 THEN bv WHEN abs(date_diff('day', CAST(t AS DATE), CAST(ft AS DATE))) <= 1 THEN fv END AS v FROM b JOIN f USING (id)""")
def c3(spark, d):
    left, right = _sides(spark, d)
    return asof.asof_either(left, right, ["k"], "t", "rt", 1).select("left_id", "match.v")


@query("c4_nearest", _SIDES + """, b AS (SELECT l.id, l.t, q.t bt, q.v bv FROM l ASOF LEFT JOIN q ON l.k = q.k AND l.t >= q.t), f AS (SELECT l.id, q.t ft, q.v fv FROM l ASOF LEFT JOIN q ON l.k = q.k AND l.t <= q.t)
SELECT id AS left_id, CASE WHEN bt IS NULL THEN fv WHEN ft IS NULL OR date_diff('day', CAST(bt AS DATE), CAST(t AS DATE)) <= date_diff('day', CAST(t AS DATE), CAST(ft AS DATE)) THEN bv ELSE fv END AS v FROM b JOIN f USING (id)""")
def c4(spark, d):
    left, right = _sides(spark, d)
    return asof.asof_nearest(left, right, ["k"], "t", "rt").select("left_id", "match.v")


@query("c5_asof_or_first", _SIDES + """, b AS (SELECT l.id, l.k, q.t bt, q.v bv FROM l ASOF LEFT JOIN q ON l.k = q.k AND l.t >= q.t), f AS (SELECT k, min_by(v, t) fv FROM q GROUP BY 1)
SELECT id AS left_id, CASE WHEN bt IS NULL THEN fv ELSE bv END AS v FROM b LEFT JOIN f USING (k)""")
def c5(spark, d):
    left, right = _sides(spark, d)
    return asof.asof_or_first(left, right, ["k"], "t", "rt").select("left_id", "match.v")


@query("c25_first_fill_after", _SIDES + " SELECT l.id AS left_id, q.t AS fill_t, q.v AS fill FROM l ASOF LEFT JOIN q ON l.k = q.k AND l.t < q.t")
def c25(spark, d):
    left, right = _sides(spark, d)
    return asof.asof_forward(left, right, ["k"], "t", "rt", strict=True).select("left_id", F.col("match.rt").alias("fill_t"), F.col("match.v").alias("fill"))


@query("e41_observation_intervals", "SELECT customer, status, valid_from, valid_to FROM intervals")
def e41(spark, d):
    return g.intervals(spark, d)


@query("c6_interval_join", "SELECT o.o_orderkey, i.status, i.valid_from FROM orders o JOIN intervals i ON o.o_custkey = i.customer AND i.valid_from <= CAST(o.o_orderdate AS DATE) + 3 AND (i.valid_to IS NULL OR CAST(o.o_orderdate AS DATE) + 3 < i.valid_to)")
def c6(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.date_add(F.to_date("o_orderdate"), 3).alias("day"))
    return intervals.interval_join(o, g.intervals(spark, d), ["customer"], "day", "valid_from", "valid_to").select("o_orderkey", "status", "valid_from")


@query("c7_resolve_unique", """WITH h AS (SELECT e.event_id, list(DISTINCT i.status) FILTER (WHERE i.status IS NOT NULL) l FROM events e LEFT JOIN intervals i ON e.user_id = i.customer AND i.valid_from <= DATE '1997-06-01' + CAST(e.event_id % 900 AS INT) AND (i.valid_to IS NULL OR DATE '1997-06-01' + CAST(e.event_id % 900 AS INT) < i.valid_to) GROUP BY 1)
SELECT event_id, CASE WHEN len(l) = 1 THEN l[1] END AS status_found, coalesce(len(l), 0) AS candidates, CASE WHEN len(l) = 1 THEN 'mapped' WHEN coalesce(len(l), 0) = 0 THEN 'unmapped' ELSE 'ambiguous_mapping' END AS status FROM h""")
def c7(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("customer"), F.expr("date_add(DATE '1997-06-01', cast(event_id % 900 AS int))").alias("day"))
    i = g.intervals(spark, d).withColumnRenamed("status", "status_found")
    return intervals.resolve_unique(e, i, ["customer"], "day", "valid_from", "valid_to", "status_found", ["event_id"])


@query("c8_overlapping_window", "SELECT customer, status, valid_from, valid_to FROM intervals WHERE valid_from <= DATE '1998-12-31' AND (valid_to IS NULL OR valid_to > DATE '1998-01-01')")
def c8(spark, d):
    day = lambda x: F.lit(x).cast("date")
    return intervals.overlapping_window(g.intervals(spark, d), "valid_from", "valid_to", day("1998-01-01"), day("1998-12-31"))


# One key holds every interval: points and intervals meet in aligned bins.
@query("c6_interval_join_hot_key", "WITH q AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS e FROM orders WHERE o_orderkey % 7 <> 0) SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem JOIN q ON CAST(l_shipdate AS DATE) >= s AND CAST(l_shipdate AS DATE) < e WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 50")
def c6_hot(spark, d):
    day = F.to_date("o_orderdate")
    q = table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.lit(1).alias("k"), "o_orderkey", day.alias("s"), F.date_add(day, F.expr("cast(o_orderkey % 3 AS int)")).alias("e"))
    points = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 50").select(F.lit(1).alias("k"), "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("at"))
    return intervals.dyadic_join(points, q, ["k"], "at", "s", "e").select("l_orderkey", "l_linenumber", "o_orderkey")


@query("c9_overlap_collisions", """WITH w AS (SELECT o_orderkey id, o_custkey k, o_orderpriority p, CAST(o_orderdate AS DATE) s, CAST(o_orderdate AS DATE) + 60 e FROM orders)
SELECT a.k AS o_custkey, a.id AS left_id, b.id AS right_id, greatest(a.s, b.s) AS overlap_from, least(a.e, b.e) AS overlap_to FROM w a JOIN w b ON a.k = b.k AND a.id < b.id AND a.p <> b.p AND a.s < b.e AND b.s < a.e""")
def c9(spark, d):
    s = F.to_date("o_orderdate")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", s.alias("s"), F.date_add(s, 60).alias("e"))
    return intervals.overlaps(o, ["o_custkey"], "s", "e", "o_orderkey", "o_orderpriority")


@query("c10_members_on", "SELECT customer, status FROM intervals WHERE valid_from <= DATE '1998-06-30' AND (valid_to IS NULL OR valid_to > DATE '1998-06-30')")
def c10(spark, d):
    return intervals.members_on(g.intervals(spark, d), F.lit(CUT).cast("date"), "valid_from", "valid_to").select("customer", "status")


@query("c11_closed_intervals", "SELECT customer, status FROM intervals WHERE valid_from <= DATE '1998-06-30' AND (valid_to IS NULL OR valid_to >= DATE '1998-06-30')")
def c11(spark, d):
    return intervals.members_on(g.intervals(spark, d), F.lit(CUT).cast("date"), "valid_from", "valid_to", inclusive_end=True).select("customer", "status")


@query("c20_range_lookup", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 15 THEN 'small' WHEN p_size BETWEEN 16 AND 40 THEN 'mid' ELSE 'other' END AS size_group FROM part")
def c20(spark, d):
    ranges = spark.createDataFrame([(1, 15, "small"), (16, 40, "mid")], "lo int, hi int, size_group string")
    return intervals.range_lookup(table(spark, d, "part"), ranges, "p_size", "lo", "hi", "size_group", "other").select("p_partkey", "size_group")


@query("c26_position_at_cycle", """WITH c AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1999-12-01', INTERVAL 3 MONTH))::DATE AS cycle) SELECT cycle, customer, status, valid_from FROM c JOIN intervals ON valid_from <= cycle AND (valid_to IS NULL OR cycle < valid_to)""")
def c26(spark, d):
    i = g.intervals(spark, d)
    quarter = F.sequence(F.lit("1996-01-01").cast("date"), F.lit("1999-12-01").cast("date"), F.expr("INTERVAL 3 MONTH"))
    spread = i.withColumn("cycle", F.explode(quarter))  # 16 cycles
    return spread.where(intervals.covers(F.col("cycle"), F.col("valid_from"), F.col("valid_to"))).select("cycle", "customer", "status", "valid_from")


@query("c29_one_to_one", """WITH p AS (SELECT DISTINCT l_partkey a, l_suppkey b FROM lineitem), x AS (SELECT a, count(*) n FROM p GROUP BY 1), y AS (SELECT b, count(*) n FROM p GROUP BY 1)
SELECT p.a AS l_partkey, p.b AS l_suppkey, (x.n = 1 AND y.n = 1) AS unique_pair FROM p JOIN x USING (a) JOIN y USING (b)""")
def c29(spark, d):
    return intervals.one_to_one(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("c30_every_match", "SELECT o_custkey, count(*) AS series FROM orders GROUP BY 1 HAVING bool_and(o_totalprice > 20000)")
def c30(spark, d):
    o = table(spark, d, "orders")
    return intervals.every_match(o, o, ["o_custkey"], F.col("o_totalprice") > 20000)


@query("c13_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def c13(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    has = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").withColumn("has_orders", F.lit(True))
    none = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").withColumn("has_orders", F.lit(False))
    return has.unionByName(none)


@query("c15_full_outer_compare", """WITH a AS (SELECT cik, min(value) v FROM facts WHERE tag = 1 GROUP BY 1), b AS (SELECT cik, min(value) v FROM facts WHERE tag = 2 GROUP BY 1)
SELECT coalesce(a.cik, b.cik) AS cik, CASE WHEN a.cik IS NULL THEN 'missing_edge' WHEN b.cik IS NULL THEN 'missing_base' ELSE 'value_mismatch' END AS kind FROM a FULL JOIN b ON a.cik = b.cik WHERE a.cik IS NULL OR b.cik IS NULL OR a.v <> b.v""")
def c15(spark, d):
    side = lambda n: g.facts(spark, d).where(F.col("tag") == n).groupBy("cik").agg(F.min("value").alias("value"))
    return rules.compare_keys(side(1), side(2), ["cik"], "value", names=("missing_edge", "missing_base", "value_mismatch"))


@query("d17_observed_ranges", "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1")
def d17(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))


@query("d21_latest_regime", "SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")
def d21(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))


@query("d40_greatest_per_group", "SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def d40(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


__all__ = ["r"]
