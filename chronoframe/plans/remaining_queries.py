"""Queries of the inventory's smaller rows: vendor pages, exports, selections and compositions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import history, prices, risk, rules, screening, selection
from ..operators import cross_section as x
from ..operators import series as s
from ..operators.asof import asof_backward
from ..sources import readers, sinks
from . import registry as g
from .panel_queries import candidates
from .registry import cut, query, r, table
from .screening_queries import stem_sql

K = ["security_id"]


@query("a5_safe_pit_scan", "SELECT cik, tag, value FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag ORDER BY accepted, adsh, value) n FROM facts f WHERE NOT EXISTS (SELECT 1 FROM (SELECT cik, tag FROM facts GROUP BY cik, tag, accepted HAVING count(DISTINCT value) > 1) b WHERE b.cik = f.cik AND b.tag = f.tag)) WHERE n = 1 AND accepted <= DATE '1998-06-30'")
def a5(spark, d):
    view = readers.tag_view(history.pit_views(g.facts(spark, d), ["cik", "tag"], "accepted", "value", ["adsh", "value"])[0], "pit")
    return readers.read_pit_as_of(view, F.lit("1998-06-30").cast("date"), "accepted", ["cik", "tag", "value"])


@query("a15_requested_symbols", "SELECT event_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def a15(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("symbol"))
    wanted = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("symbol"))
    return readers.requested_symbols(rows, wanted, "symbol", F.col("symbol")).select("event_id")


@query("a17_declared_actions", "SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_returnflag = 'A' THEN 'splits' ELSE 'dividends' END AS action, l_quantity AS amount FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def a17(spark, d):
    li = table(spark, d, "lineitem")
    item = lambda f: F.collect_list(F.when(F.col("l_returnflag") == f, F.struct(F.col("l_suppkey").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ex_date"), F.col("l_quantity").alias("rate"))))
    pages = li.groupBy("l_suppkey").agg(item("A").alias("splits"), item("R").alias("dividends"))
    return readers.declared_actions(pages, {"splits": ("ex_date", "rate"), "dividends": ("ex_date", "rate")})


@query("a32_associations", "SELECT CAST(o_custkey AS VARCHAR) AS cik, o_orderpriority AS title FROM orders WHERE o_orderkey % 6 <> 0")
def a32(spark, d):
    row = F.array(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")))
    docs = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(row).alias("data")).select(F.to_json(F.struct("data")).alias("j"))
    return readers.associations(docs, "j", ["cik", "title"])[0]


# Shipped lines are the bulk source's facts; open ones come from filings and are brought to the same schema.
@query("a33_raw_fact_union", "SELECT l_orderkey AS adsh, l_linenumber AS tag, CAST(l_shipdate AS DATE) AS ddate, l_quantity AS value, 'bulk' AS source FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE), l_quantity, 'edge' FROM lineitem WHERE l_linestatus <> 'F' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def a33(spark, d):
    li = table(spark, d, "lineitem")
    bulk = li.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("adsh"), F.col("l_linenumber").alias("tag"), F.to_date("l_shipdate").alias("ddate"), F.col("l_quantity").alias("value"))
    filed = li.where("l_linestatus <> 'F'").select(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("concept"), F.date_format("l_shipdate", "yyyyMMdd").alias("period_end"), F.col("l_quantity").cast("string").alias("amount"))
    edge = readers.to_raw_facts(filed, {"adsh": "accession", "tag": "concept", "ddate": "period_end", "value": "amount"}, bulk.schema)
    return readers.union_of_sources(bulk, edge, ["adsh"])


@query("a27_a28_export_state", "SELECT c_custkey, max(o_orderdate) AS last_order, count(o_orderkey) AS orders_n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a27(spark, d):
    o = table(spark, d, "orders")
    sinks.guard_regression(o.where("o_orderkey % 2 = 0"), o, ["o_orderdate"])
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.max("o_orderdate").alias("last_order"), F.count("o_orderkey").alias("orders_n"))


@query("b10_profitability_blocker", "SELECT c_custkey, c_acctbal < 0 AND c_nationkey <= 12 AS blocked FROM customer")
def b10(spark, d):
    return table(spark, d, "customer").select("c_custkey", rules.profitability_blocker(F.col("c_acctbal"), F.col("c_nationkey") - 12).alias("blocked"))


@query("b18_single_cap", "SELECT security_id, month FROM (SELECT *, row_number() OVER (PARTITION BY month, sector ORDER BY turnover DESC, security_id) n FROM months) WHERE n <= 2")
def b18(spark, d):
    return selection.top_k(g.months(spark, d), ["month", "sector"], [F.desc("turnover"), F.asc("security_id")], 2).select("security_id", "month")


@query("b19_reason_ladder", "SELECT c_custkey, c_acctbal >= 1000 AND c_nationkey < 20 AS eligible, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'small' WHEN c_nationkey >= 20 THEN 'nation' ELSE 'ok' END AS reason FROM customer")
def b19(spark, d):
    a, n = F.col("c_acctbal"), F.col("c_nationkey")
    reason = rules.first_reason([(a < 0, "debt"), (a < 1000, "small"), (n >= 20, "nation")], "ok")
    return table(spark, d, "customer").select("c_custkey", (reason == "ok").alias("eligible"), reason.alias("reason"))


@query("c28_candidate_enrichment", "SELECT security_id, month, name, price FROM months JOIN securities USING (security_id) WHERE price > 2000")
def c28(spark, d):
    return rules.enriched(g.months(spark, d), g.securities(spark, d), K, ["name"], [F.col("price") > 2000]).select("security_id", "month", "name", "price")


@query("c31_candidate_regimes", "WITH c AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), f AS (SELECT s_suppkey, s_acctbal > 5000 AS foreign_filer FROM supplier WHERE s_suppkey % 5 <> 0) SELECT l_partkey, CASE WHEN count(foreign_filer) = 0 THEN 'unknown' WHEN count(*) FILTER (WHERE foreign_filer) = count(foreign_filer) THEN 'all' WHEN count(*) FILTER (WHERE foreign_filer) > 0 THEN 'some' ELSE 'none' END AS regime FROM c LEFT JOIN f ON s_suppkey = l_suppkey GROUP BY 1")
def c31(spark, d):
    c = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    f = table(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") > 5000).alias("foreign_filer"))
    return screening.single_regime(c, ["l_partkey"], f, "l_suppkey", F.col("foreign_filer"))


@query("c32_admitted_pairs", "WITH p AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F') SELECT o.o_orderkey, CASE WHEN p.o_custkey IS NULL THEN 'gap' ELSE 'admitted' END AS status FROM orders o LEFT JOIN p USING (o_custkey, o_orderpriority)")
def c32(spark, d):
    o = table(spark, d, "orders")
    return rules.admitted_or_gap(o, o.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"]).select("o_orderkey", "status")


@query("c33_merged_provenance", "SELECT l_partkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS pointers FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def c33(spark, d):
    side = lambda f: table(spark, d, "lineitem").where(F.col("l_returnflag") == f)
    return rules.merged_provenance([side("A"), side("R")], "l_partkey", "l_suppkey")


@query("c33_matched_candidates", f"""WITH p AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN 'T' || c_custkey END AS ticker, c_name AS name FROM customer),
k AS (SELECT row_id, ticker, CASE WHEN row_id % 4 = 0 THEN 'The ' || name || ' Inc.' ELSE name END AS name FROM p WHERE row_id % 2 = 0),
t AS (SELECT upper(trim(ticker)) AS x, min(row_id) AS e FROM k WHERE ticker <> '' GROUP BY 1 HAVING count(DISTINCT row_id) = 1), m AS (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS x, min(row_id) AS e FROM k GROUP BY 1 HAVING count(DISTINCT row_id) = 1),
u AS (SELECT {stem_sql("name")} AS x, min(row_id) AS e FROM k GROUP BY 1 HAVING count(DISTINCT row_id) = 1)
SELECT row_id, coalesce(t.e, m.e, u.e) AS entity, CASE WHEN t.e IS NOT NULL THEN 'ticker' WHEN m.e IS NOT NULL THEN 'name' WHEN u.e IS NOT NULL THEN 'stem' ELSE 'none' END AS how
FROM p LEFT JOIN t ON t.x = upper(trim(ticker)) LEFT JOIN m ON m.x = regexp_replace(lower(name), '[^a-z0-9]', '', 'g') LEFT JOIN u ON u.x = {stem_sql("p.name")}""")
def c33_matched(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("T"), "c_custkey")).alias("ticker"), F.col("c_name").alias("name"))
    known = p.where("row_id % 2 = 0").withColumn("entity", F.col("row_id")).withColumn("name", F.when(F.col("row_id") % 4 == 0, F.concat(F.lit("The "), "name", F.lit(" Inc."))).otherwise(F.col("name")))
    return rules.match_candidates(p, known, "row_id", "ticker", "name", "entity", sc.normalize_name, sc.name_stem)


@query("d43_latest_ratios", "SELECT s.company_id, q.q, floor(q.revenue / q.orders * 10000 + 0.123456) / 10000 AS ratio FROM (SELECT DISTINCT company_id, DATE '1999-06-30' AS day FROM quarters) s ASOF LEFT JOIN quarters q ON q.company_id = s.company_id AND s.day >= q.published")
def d43(spark, d):
    q = g.quarters(spark, d)
    keys = q.select("company_id").distinct().withColumn("day", F.lit("1999-06-30").cast("date"))
    m = asof_backward(keys, q, ["company_id"], "day", "published")
    return m.select("company_id", "match.q", cut(F.try_divide(F.col("match.revenue"), F.col("match.orders"))).alias("ratio"))


@query("e25_calendar_momentum", "WITH k AS (SELECT security_id, max(session) AS day FROM bars GROUP BY 1), p AS (SELECT k.security_id, k.day - 30 AS t0, k.day - 120 AS t1, k.day - 210 AS t2 FROM k), a AS (SELECT p.*, b.close AS c0 FROM p ASOF LEFT JOIN bars b ON b.security_id = p.security_id AND p.t0 >= b.session), c AS (SELECT a.*, b.close AS c1 FROM a ASOF LEFT JOIN bars b ON b.security_id = a.security_id AND a.t1 >= b.session), e AS (SELECT c.*, b.close AS c2 FROM c ASOF LEFT JOIN bars b ON b.security_id = c.security_id AND c.t2 >= b.session) SELECT security_id, round((c0 / c1 - 1) * 0.4 + (c0 / c2 - 1) * 0.6, 5) AS momentum FROM e")
def e25(spark, d):
    b = g.bars(spark, d).select("security_id", "session", "close")
    k = b.groupBy("security_id").agg(F.max("session").alias("day"))
    for n, back in enumerate((30, 120, 210)):
        k = asof_backward(k.withColumn("t", F.date_sub("day", back)), b, K, "t", "session", f"m{n}").drop("t")
    c = [F.col(f"m{n}.close") for n in range(3)]
    return k.select("security_id", r(x.weighted_mean([(c[0] / c[1] - 1, 0.4), (c[0] / c[2] - 1, 0.6)]), 5).alias("momentum"))


# Picks of F-3 and those that take their place: the tests compare it with a plain loop.
@query("f12_replace_correlated")
def f12(spark, d):
    m = candidates(spark, d)
    acted = m.join(selection.select_constrained(m, ["month"], "score", "security_id", "sector", 15, 2), ["month", "security_id"])
    returns = g.months(spark, d).withColumn("ret", s.log_return("price", K, "month"))
    return selection.replace_picks_by_returns(acted, returns, ["month"], "score", "security_id", "sector", 2, 0.1, "month", "ret", 20)


@query("g7_common_dates", "SELECT session FROM bars WHERE security_id = 1 INTERSECT SELECT session FROM bars WHERE security_id = 2")
def g7(spark, d):
    b = g.bars(spark, d)
    return b.where("security_id = 1").select("session").join(b.where("security_id = 2").select("session"), "session")


@query("g12_evidence_union", "SELECT o_custkey, min(o_orderpriority) AS code FROM (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1998-01-01' UNION ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1998-01-01') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1")
def g12(spark, d):
    o = history.visible(table(spark, d, "orders"), "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"))
    side = lambda st: o.where(F.col("o_orderstatus") == st).select("o_custkey", F.col("o_orderpriority").alias("code"))
    both = side("F").unionByName(side("P"))
    bad = history.distinct_count_gate(both, ["o_custkey"], F.col("code"))
    return both.join(bad, "o_custkey", "left_anti").distinct()


@query("h16_labels", "SELECT o_orderkey, o_orderstatus || ': ' || replace(o_orderpriority, '-', ' / ') AS label FROM orders")
def h16(spark, d):
    items = F.array_join(F.transform(F.split("o_orderpriority", "-"), lambda w: w), " / ")
    return table(spark, d, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit(": "), items).alias("label"))


@query("i28_basis_drift", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE abs(l_discount / 0.05 - 1) > 0.9 GROUP BY 1, 2")
def i28(spark, d):
    li = table(spark, d, "lineitem").withColumn("vendor", F.lit(0.05))
    return prices.basis_drift(li, "l_discount", "vendor", 0.9).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("i32_raw_stress", "SELECT security_id, month, CASE WHEN price < 1000 THEN 2 WHEN price < 1500 THEN 1 ELSE 0 END + CASE WHEN turnover < 200000 THEN 2 WHEN turnover < 400000 THEN 1 ELSE 0 END AS stress FROM months")
def i32(spark, d):
    stress = rules.stress_points([(F.col("price"), ((1000, 2), (1500, 1))), (F.col("turnover"), ((200000, 2), (400000, 1)))])
    return g.months(spark, d).select("security_id", "month", stress.alias("stress"))


@query("i34_conviction", "SELECT security_id, month, floor(greatest(0.0, least(100.0, (greatest(0.0, least(100.0, price / 3000 * 100)) * 0.5 + greatest(0.0, least(100.0, turnover / 600000 * 100)) * 0.5) / (0.5 + 0.5) - CASE WHEN bars < 3 THEN 10.0 ELSE 0.0 END)) * 10000 + 0.123456) / 10000 AS score FROM months")
def i34(spark, d):
    parts = [(sc.linear_scale(F.col("price"), 0, 3000), 0.5), (sc.linear_scale(F.col("turnover"), 0, 600000), 0.5)]
    score = screening.conviction(parts, F.when(F.col("bars") < 3, 10.0).otherwise(0.0))
    return g.months(spark, d).select("security_id", "month", cut(score).alias("score"))


@query("i50_item_adjustments", "SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') IS NOT NULL AS restated, count(*) - count(*) FILTER (WHERE o_orderstatus = 'P') AS rest FROM orders GROUP BY 1")
def i50(spark, d):
    items = F.collect_list(F.struct(F.col("o_orderstatus").alias("item_code"), F.lit(1).alias("value")))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(items.alias("items"))
    rest = F.size(F.filter("items", lambda i: i["item_code"] != "P")).cast("long")
    return o.select("o_custkey", sc.item_value(F.col("items"), ["P"]).isNotNull().alias("restated"), rest.alias("rest"))


@query("i53_thesis_break", "WITH v AS (SELECT security_id, min(session) AS signal FROM bars WHERE close < 200 GROUP BY 1), n AS (SELECT security_id, session, lead(session) OVER (PARTITION BY security_id ORDER BY session) AS nx FROM bars) SELECT v.security_id, signal, nx AS exit_session FROM v JOIN n ON n.security_id = v.security_id AND n.session = v.signal")
def i53(spark, d):
    b = g.bars(spark, d).withColumn("exit_session", F.lead("session").over(s.ordered(K, "session"))).where("close < 200")
    return history.keep_first(b, K, "session").select("security_id", F.col("session").alias("signal"), "exit_session")


@query("i55_holding_inputs", "SELECT c_custkey, coalesce(n.nav, c_acctbal, 0.0) AS nav, CASE WHEN n.nav IS NOT NULL THEN 'parts' ELSE 'book' END AS source FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS nav FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) n ON o_custkey = c_custkey")
def i55(spark, d):
    n = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(r(F.sum("o_totalprice"), 2).alias("parts"))
    nav, source = rules.first_known([(F.col("parts"), "parts"), (F.col("c_acctbal"), "book")], "book", F.lit(0.0))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", nav.alias("nav"), source.alias("source"))


@query("i58_override_columns", "SELECT security_id, month, price, floor((price - avg(price) OVER (PARTITION BY month, sector)) * 10000 + 0.123456) / 10000 AS price_override FROM months")
def i58(spark, d):
    return g.months(spark, d).select("security_id", "month", "price", cut(rules.less_group_mean("price", ["month", "sector"])).alias("price_override"))
