"""Queries over domain scores, universes, listings, and stateful rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit, history, risk, rules, scores
from ..operators import cross_section as x
from ..operators import prices as pr
from ..operators import series as s
from ..sources import readers
from . import registry as g
from .registry import cut, query, r, table

K = ["security_id"]
_SCALE = "greatest(0.0, least(100.0, {0}))"


def _scale(v, low, high):
    return _SCALE.format(f"({v} - {low}) / ({high} - {low} + 0.0) * 100")


@query("i12_quality_subscores", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY q DESC) n FROM quarters), a AS (SELECT company_id, avg(revenue) AS l, stddev_pop(revenue) / abs(avg(revenue)) AS s, avg(revenue / orders) AS m, count(*) AS c FROM l WHERE n <= 5 GROUP BY 1),
b AS (SELECT company_id, {_scale('l', 0, 400000)} AS l, CASE WHEN c >= 3 THEN {_scale('s', 1.0, 0.0)} END AS s, {_scale('m', 0, 200000)} AS m FROM a) SELECT company_id, floor(l * 10000 + 0.123456) / 10000 AS level_score, floor((l * 0.4 + coalesce(s * 0.3, 0) + m * 0.3) / (0.7 + CASE WHEN s IS NULL THEN 0 ELSE 0.3 END) * 10000 + 0.123456) / 10000 AS combined FROM b""")
def i12(spark, d):
    q = g.quarters(spark, d).withColumn("margin", F.col("revenue") / F.col("orders"))
    out = scores.quality_subscores(q, ["company_id"], "q", "revenue", "margin")
    return out.select("company_id", cut(F.col("level_score")).alias("level_score"), cut(F.col("combined")).alias("combined"))


@query("i15_growth_at_price", "WITH p AS (SELECT a.company_id, a.q, a.revenue / b.revenue - 1 AS gr, a.orders * 1.0 AS pe FROM quarters a JOIN quarters b ON b.company_id = a.company_id AND b.q = a.q - 4) SELECT company_id, q, CASE WHEN gr >= 0.2 THEN 'fast' WHEN gr >= 0.1 THEN 'stalwart' WHEN gr >= 0 THEN 'slow' ELSE 'declining' END AS category, CASE WHEN pe > 0 AND gr > 0 THEN floor(pe / (gr * 100) * 100000000 + 0.123456) / 100000000 END AS peg FROM p")
def i15(spark, d):
    from ..operators.fundamentals import prior_year

    p = prior_year(g.quarters(spark, d), ["company_id"], "q", ["revenue"]).where("prior_revenue IS NOT NULL")
    peg, _, category = scores.growth_at_price(F.col("orders") * 1.0, F.col("revenue") / F.col("prior_revenue") - 1)
    return p.select("company_id", "q", category.alias("category"), cut(peg, 8).alias("peg"))


@query("i16_yield_and_return", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN floor(c_nationkey / c_acctbal * 100000000 + 0.123456) / 100000000 END AS ey, CASE WHEN c_nationkey > 0 THEN CAST(1.0 AS DOUBLE) END AS roc FROM customer")
def i16(spark, d):
    ey, roc = scores.yield_and_return(F.col("c_nationkey"), F.col("c_acctbal"), F.col("c_nationkey"))
    return table(spark, d, "customer").select("c_custkey", cut(ey, 8).alias("ey"), r(roc).alias("roc"))


@query("i19_hybrid_peer_score", f"WITH p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY sector, month) = 1 THEN 50.0 ELSE (row_number() OVER (PARTITION BY sector, month ORDER BY price, security_id) - 1) / (count(*) OVER (PARTITION BY sector, month) - 1) * 100 END AS peer FROM months) SELECT security_id, month, floor(({_scale('price', 0, 3000)} * 0.6 + peer * 0.4) / (0.6 + 0.4) * 10000 + 0.123456) / 10000 AS score FROM p")
def i19(spark, d):
    out = scores.hybrid_peer_score(g.months(spark, d), ["sector", "month"], "price", "security_id", 0, 3000, "score")
    return out.select("security_id", "month", cut(F.col("score")).alias("score"))


@query("i20_peer_rank_score", "WITH p AS (SELECT *, (rank() OVER (PARTITION BY month ORDER BY price) + (count(*) OVER (PARTITION BY month, price) - 1) / 2.0) / count(*) OVER (PARTITION BY month) AS a, (rank() OVER (PARTITION BY month ORDER BY turnover DESC) + (count(*) OVER (PARTITION BY month, turnover) - 1) / 2.0) / count(*) OVER (PARTITION BY month) AS b FROM months) SELECT security_id, month, floor((a * 100 * 0.7 + b * 100 * 0.3) / (0.7 + 0.3) * 10000 + 0.123456) / 10000 AS score FROM p")
def i20(spark, d):
    out = scores.peer_rank_score(g.months(spark, d), ["month"], [("price", 0.7, True), ("turnover", 0.3, False)], "score")
    return out.select("security_id", "month", cut(F.col("score")).alias("score"))


@query("i33_trend_labels", "WITH t AS (SELECT security_id, month, price, CASE WHEN count(price) OVER f = 3 THEN avg(price) OVER f END AS fast, CASE WHEN count(price) OVER w = 10 THEN avg(price) OVER w END AS slow FROM months WINDOW f AS (PARTITION BY security_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w AS (PARTITION BY security_id ORDER BY month ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT security_id, month, CASE WHEN slow IS NULL THEN NULL WHEN price > slow AND fast > slow THEN 'up' WHEN price < slow AND fast < slow THEN 'down' ELSE 'flat' END AS trend FROM t")
def i33(spark, d):
    m = g.months(spark, d)
    return m.select("security_id", "month", scores.trend_label(F.col("price"), s.sma("price", K, "month", 3), s.sma("price", K, "month", 10)).alias("trend"))


# The technical blend joins folds and windows; its parts are held against loops and SQL.
_ROLL = "OVER (PARTITION BY security_id ORDER BY session ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_MEAN = lambda c, n: f"CASE WHEN count({c}) {_ROLL.format(n - 1)} = {n} THEN avg({c}) {_ROLL.format(n - 1)} END"


@query("i18_technical_score", f"""WITH {g.rsi_sql("w")}, a AS (SELECT security_id, close, {_MEAN("close", 200)} AS slow, ({_MEAN("volume", 20)}) / ({_MEAN("volume", 60)}) AS vr, row_number() OVER (PARTITION BY security_id ORDER BY session DESC) AS k FROM bars),
v AS (SELECT security_id, CASE WHEN close > slow THEN 100.0 WHEN close <= slow THEN 0.0 END AS p1, greatest(0.0, least(100.0, (abs(rsi - 50) - 50) / -50 * 100)) AS p2, greatest(0.0, least(100.0, (vr - 0.5) / 1.0 * 100)) AS p3, rsi, vr FROM a JOIN w USING (security_id) WHERE k = 1),
u AS (SELECT security_id, p1, CASE WHEN rsi IS NOT NULL THEN p2 END AS p2, CASE WHEN vr IS NOT NULL THEN p3 END AS p3 FROM v),
x AS (SELECT *, CASE WHEN p1 IS NULL THEN 0.0 ELSE 0.4 END + CASE WHEN p2 IS NULL THEN 0.0 ELSE 0.3 END + CASE WHEN p3 IS NULL THEN 0.0 ELSE 0.3 END AS weight FROM u)
SELECT security_id, CASE WHEN weight > 0 THEN round((coalesce(p1 * 0.4, 0) + coalesce(p2 * 0.3, 0) + coalesce(p3 * 0.3, 0)) / weight, 4) END AS score, CAST(CAST(p1 IS NOT NULL AS INT) + CAST(p2 IS NOT NULL AS INT) + CAST(p3 IS NOT NULL AS INT) AS INTEGER) AS signals FROM x""")
def i18(spark, d):
    b = g.bars(spark, d)
    last = b.withColumn("slow", s.sma("close", K, "session", 200)).withColumn("vr", s.volume_ratio("volume", K, "session"))
    last = history.keep_last(last, K, "session").join(s.rsi(b, "close", K, "session"), "security_id")
    score, number = scores.technical_blend(F.col("close") > F.col("slow"), F.col("rsi"), F.col("vr"))
    return last.select("security_id", r(score, 4).alias("score"), number.alias("signals"))


@query("i17_dividend_score", """WITH a AS (SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS day, l_discount AS dps FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0 AND CAST(l_shipdate AS DATE) BETWEEN DATE '2000-12-31' - 1826 AND DATE '2000-12-31'),
s AS (SELECT security_id, coalesce(sum(dps) FILTER (WHERE day >= DATE '2000-12-31' - 365), 0) AS paid, count(DISTINCT year(day)) FILTER (WHERE year(day) >= 1995) AS years FROM a GROUP BY 1), p AS (SELECT security_id, max_by(close, session) AS price FROM bars WHERE session <= DATE '2000-12-31' AND close > 0 GROUP BY 1)
SELECT security_id, years AS paying_years, round(0.6 * coalesce(greatest(0.0, least(100.0, paid / price / 0.08 * 100)), 0) + 0.4 * least(100.0, years / 5 * 100), 4) AS score FROM s LEFT JOIN p USING (security_id)""")
def i17(spark, d):
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("day"), F.col("l_discount").alias("dps"))
    out = scores.dividend_score(a, g.bars(spark, d), K, "day", "dps", "session", "close", F.lit("2000-12-31").cast("date"))
    return out.select("security_id", "paying_years", r(F.col("score"), 4).alias("score"))


@query("i45_calibrated_score", "WITH p AS (SELECT security_id, month, (rank() OVER (PARTITION BY month ORDER BY price) + (count(*) OVER (PARTITION BY month, price) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY month) * 100 AS base, 0.6 * least(1.0, bars / 10) + 0.4 * least(1.0, count(*) OVER (PARTITION BY month, sector) / 20) AS trust, CASE WHEN turnover > 300000 THEN 1.0 ELSE 0.8 END AS inv FROM months) SELECT security_id, month, floor(greatest(0.0, least(100.0, (50 + (base - 50) * trust + 2) * inv)) * 10000 + 0.123456) / 10000 AS score FROM p")
def i45(spark, d):
    peers = F.count("*").over(Window.partitionBy("month", "sector"))
    trust = scores.confidence(F.least(F.lit(1.0), F.col("bars") / 10), peers)
    m = g.months(spark, d).withColumn("trust", trust).withColumn("base", x.midrank_percentile("price", ["month"]) * 100)
    score = scores.calibrated(F.col("base"), F.col("trust"), F.lit(2.0), F.when(F.col("turnover") > 300000, 1.0).otherwise(0.8))
    return m.select("security_id", "month", cut(score).alias("score"))


@query("i48_relative_strength", f"WITH a AS (SELECT security_id, month, price / lag(price, 6) OVER (PARTITION BY security_id ORDER BY month) - 1 AS r6 FROM months) SELECT a.security_id, a.month, CASE WHEN a.r6 - b.r6 IS NOT NULL THEN floor({_scale('(a.r6 - b.r6)', -0.5, 0.5)} * 10000 + 0.123456) / 10000 END AS strength FROM a JOIN a b ON b.month = a.month AND b.security_id = 1")
def i48(spark, d):
    a = g.months(spark, d).select("security_id", "month", s.simple_return("price", K, "month", 6).alias("r6"))
    b = a.where("security_id = 1").select("month", F.col("r6").alias("bench"))
    return a.join(b, "month").select("security_id", "month", cut(scores.relative_strength(F.col("r6"), F.col("bench"))).alias("strength"))


@query("i56_risk_grades", "WITH m AS (SELECT security_id, ln(price / lag(price) OVER (PARTITION BY security_id ORDER BY month)) AS ret FROM months), v AS (SELECT security_id, stddev_pop(ret) AS vol FROM m GROUP BY 1) SELECT security_id, CASE WHEN vol < 0.15 THEN 'low' WHEN vol < 0.3 THEN 'medium' WHEN vol < 0.6 THEN 'high' ELSE 'extreme' END AS grade, CASE WHEN security_id % 3 <= 1 THEN 'none' WHEN 4 * vol * vol < 0.5 THEN 'moderate' ELSE 'severe' END AS decay FROM v")
def i56(spark, d):
    v = g.months(spark, d).withColumn("ret", s.log_return("price", K, "month")).groupBy("security_id").agg(F.stddev_pop("ret").alias("vol"))
    grade, decay = scores.risk_grade(F.col("vol"), F.col("security_id") % 3)
    return v.select("security_id", grade.alias("grade"), decay.alias("decay"))


@query("i59_idle_return", "SELECT security_id, month, round(coalesce(price / lag(price) OVER (PARTITION BY security_id ORDER BY month) - 1, 0.05 * 30 / 365), 6) AS idle FROM months")
def i59(spark, d):
    before = F.lag("price").over(s.ordered(K, "month"))
    return g.months(spark, d).select("security_id", "month", r(scores.idle_return(before, F.col("price"), F.lit(0.05), F.lit(30))).alias("idle"))


@query("i21_owner_earnings", "SELECT a.company_id, a.q, floor((a.revenue + a.orders - greatest(0.0, least(a.revenue * 0.1, a.revenue * 0.1 - greatest(a.revenue - b.revenue, 0) * 0.05))) * 10000 + 0.123456) / 10000 AS owner FROM quarters a JOIN quarters b ON b.company_id = a.company_id AND b.q = a.q - 4")
def i21(spark, d):
    from ..operators.fundamentals import prior_year

    p = prior_year(g.quarters(spark, d), ["company_id"], "q", ["revenue"]).where("prior_revenue IS NOT NULL")
    v = scores.owner_earnings(F.col("revenue"), F.col("orders"), F.col("revenue") * 0.1, F.col("revenue"), F.lit(0.05), F.col("prior_revenue"))
    return p.select("company_id", "q", cut(v).alias("owner"))


@query("i22_stale_cache", "WITH c AS (SELECT company_id, min(published) AS v FROM quarters WHERE revenue > 400000 GROUP BY 1) SELECT q.company_id, q.q, CASE WHEN v IS NULL OR published < v THEN 'v1' END AS version FROM quarters q LEFT JOIN c USING (company_id)")
def i22(spark, d):
    q = g.quarters(spark, d)
    return scores.stale_from(q.where("revenue > 400000"), q.withColumn("version", F.lit("v1")), ["company_id"], "published", "published", "version").select("company_id", "q", "version")


@query("i26_universe_snapshot", """WITH adv AS (SELECT security_id, avg(close * volume) AS adv, count(*) AS n, max(session) AS last_session FROM bars WHERE session BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' GROUP BY 1)
SELECT s.security_id, concat_ws(',', CASE WHEN n IS NULL OR n < 85 THEN 'history' END, CASE WHEN adv IS NULL OR adv < 50000 THEN 'liquidity' END, CASE WHEN last_session IS NULL OR last_session < DATE '1999-12-20' THEN 'stale' END, CASE WHEN balance < 0 THEN 'balance' END) AS why, CASE WHEN adv >= 60000 THEN 'large' WHEN adv >= 50000 THEN 'mid' ELSE 'small' END AS bucket FROM securities s LEFT JOIN adv USING (security_id)""")
def i26(spark, d):
    from ..functions.scalars import reasons

    b = g.bars(spark, d).where("session BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'")
    a = b.groupBy("security_id").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"), F.count("*").alias("n"), F.max("session").alias("last_session"))
    j = g.securities(spark, d).join(a, "security_id", "left")
    why = reasons([(F.col("n") >= 85, "history"), (F.col("adv") >= 50000, "liquidity"), (F.col("last_session") >= F.lit("1999-12-20").cast("date"), "stale"), (F.col("balance") >= 0, "balance")])
    return j.select("security_id", F.array_join(why, ",").alias("why"), F.when(F.col("adv") >= 60000, "large").when(F.col("adv") >= 50000, "mid").otherwise("small").alias("bucket"))


@query("i40_deflated_nav", "SELECT m.security_id, m.month, floor(m.price / c.index * 10000 + 0.123456) / 10000 AS real_nav FROM months m ASOF JOIN (SELECT month, price AS index FROM months WHERE security_id = 1) c ON m.month >= c.month".replace("index", "level"))
def i40(spark, d):
    from ..operators.asof import asof_backward

    m = g.months(spark, d).select("security_id", "month", "price").withColumn("k", F.lit(1))
    level = m.where("security_id = 1").select("k", F.col("month").alias("at"), F.col("price").alias("level"))
    days = asof_backward(m.select("k", "month").distinct(), level, ["k"], "month", "at")  # one row a month
    j = m.join(days.select("month", "match.level"), "month").where("level IS NOT NULL")
    return j.select("security_id", "month", cut(F.col("price") / F.col("level")).alias("real_nav"))


@query("i52_cash_overlay", g.state_machine_sql("SELECT security_id, month AS t, CASE WHEN price < 1500 AND turnover < 300000 THEN 3 WHEN price < 1500 OR turnover < 300000 THEN 2 ELSE 0 END AS raw FROM months", "security_id", 1, 0))
def i52(spark, d):
    m = g.months(spark, d).withColumn("raw", risk.stress_target(F.when(F.col("price") < 1500, 2).otherwise(0), F.when(F.col("turnover") < 300000, 2).otherwise(0)))
    return s.state_machine(m, K, "month", "raw", "state", confirm=1, cooldown_days=0)


@query("e13_splice_factors", "WITH e AS (SELECT security_id, month, price, CASE WHEN price / lag(price) OVER w > 8 THEN price / lag(price) OVER w ELSE 1.0 END AS f FROM months WINDOW w AS (PARTITION BY security_id ORDER BY month)) SELECT security_id, month, round(coalesce(sum(ln(f)) OVER (PARTITION BY security_id ORDER BY month DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS log_factor FROM e")
def e13(spark, d):
    ratio = F.col("price") / F.lag("price").over(s.ordered(K, "month"))
    m = g.months(spark, d).withColumn("f", F.when(ratio > 8, ratio).otherwise(1.0)).withColumn("one", F.lit(1.0))
    return pr.back_adjust(m, K, "month", "one", "f", "factor").select("security_id", "month", r(F.log("factor")).alias("log_factor"))


@query("b12_screen_predicate", "SELECT security_id, month FROM months WHERE price >= 500 AND turnover >= 200000 AND (bars >= 5 OR sector = 3)")
def b12(spark, d):
    return g.months(spark, d).where((F.col("price") >= 500) & (F.col("turnover") >= 200000) & ((F.col("bars") >= 5) | (F.col("sector") == 3))).select("security_id", "month")


@query("b14_title_patterns", "SELECT p_partkey, regexp_matches(lower(p_name), 'part 1|green|steel') OR regexp_matches(p_type, 'PROMO|COPPER') AS excluded FROM part")
def b14(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.rlike(F.lower("p_name"), F.lit("part 1|green|steel")) | F.rlike("p_type", F.lit("PROMO|COPPER"))).alias("excluded"))


@query("b4_form_and_tag_filter", "SELECT cik, tag, value FROM facts WHERE tag IN (1, 3, 5) AND NOT adsh % 7 = 0")
def b4(spark, d):
    return g.facts(spark, d).where(F.col("tag").isin(1, 3, 5) & ~(F.col("adsh") % 7 == 0)).select("cik", "tag", "value")


@query("a4_consolidated_as_of", "SELECT l_orderkey FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-06-30' AND l_returnflag = 'N'")
def a4(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("accepted"), (F.col("l_returnflag") == "N").alias("is_consolidated"))
    return readers.consolidated_as_of(li, F.lit("1997-06-30").cast("timestamp_ntz"), ["l_orderkey"])


@query("a9_form_index", "SELECT DISTINCT o_custkey AS key FROM orders")
def a9(spark, d):
    lines = table(spark, d, "orders").select(F.concat(F.rpad("o_orderstatus", 12, " "), F.rpad(F.col("o_custkey").cast("string"), 10, " "), F.lit("path")).alias("value"))
    return readers.form_index_keys(lines, 13, 10)


@query("a12_membership", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 30 END AS until FROM orders WHERE o_orderkey % 10 <> 0")
def a12(spark, d):
    day = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "bad").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("start"), F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add(day, 30), "yyyy-MM-dd")).otherwise("").alias("until"))
    return readers.membership(rows, "start", "until", 1)


@query("a13_two_state_listing", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'delisted' END AS state FROM customer")
def a13(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return readers.two_state_listing(c.where("c_acctbal >= 0"), c.where("c_acctbal < 0")).select("c_custkey", "state")


@query("a16_bar_pages", "SELECT CAST(user_id AS VARCHAR) AS symbol, count(*) AS bars FROM events WHERE value > 0 AND event_id % 9 <> 0 GROUP BY 1")
def a16(spark, d):
    e = table(spark, d, "events").where("value > 0")
    bar = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.col("value").alias("o"), F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.col("value") + 1).alias("h"), F.col("value").alias("l"), F.col("value").alias("c"), F.lit(1).alias("v"))
    pages = e.groupBy("user_id").agg(F.collect_list(bar).alias("b")).select(F.to_json(F.create_map(F.col("user_id").cast("string"), "b")).alias("j"))
    return readers.bar_pages(pages, "j")[0].groupBy("symbol").agg(F.count("*").alias("bars"))


@query("a26_version_as_of", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def a26(spark, d):
    e = history.visible(table(spark, d, "events"), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("g1_union_of_batches", "SELECT l_returnflag AS batch, l_orderkey, l_linenumber FROM lineitem")
def g1(spark, d):
    li = table(spark, d, "lineitem")
    one = lambda f: li.where(F.col("l_returnflag") == f).select(F.lit(f).alias("batch"), "l_orderkey", "l_linenumber")
    return one("A").unionByName(one("N")).unionByName(one("R"))


@query("g11_rebase", "WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) v FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1), b AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) v FROM orders GROUP BY 1) SELECT a.o_custkey FROM a JOIN b USING (o_custkey) WHERE a.v = b.v")
def g11(spark, d):
    from ..operators.selection import key_changes

    o = table(spark, d, "orders")
    old = o.where("o_orderdate < '2000-01-01'")
    return old.select("o_custkey").distinct().join(key_changes(old, o, ["o_custkey"], "o_orderpriority"), "o_custkey", "left_anti")


@query("h22_sector_map", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'industrial' WHEN regexp_matches(c_mktsegment, 'AUTO|HOUSE') THEN 'consumer' ELSE 'other' END AS kind FROM customer")
def h22(spark, d):
    m = spark.createDataFrame([("BUILDING", "industrial"), ("MACHINERY", "industrial")], "c_mktsegment string, mapped string")
    c = table(spark, d, "customer").join(m, "c_mktsegment", "left")
    return c.select("c_custkey", F.coalesce("mapped", F.when(F.rlike("c_mktsegment", F.lit("AUTO|HOUSE")), "consumer").otherwise("other")).alias("kind"))


@query("j5_daily_state", g.state_machine_sql("SELECT user_id, CAST(ts AS DATE) AS t, max(CASE WHEN value > 60 THEN 2 WHEN value > 30 THEN 1 ELSE 0 END) AS raw FROM events GROUP BY 1, 2", "user_id"))
def j5(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("t")).agg(F.max(F.when(F.col("value") > 60, 2).when(F.col("value") > 30, 1).otherwise(0)).alias("raw"))
    return s.state_machine(e, ["user_id"], "t", "raw", "state")


@query("j8_forward_observation", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS rows FROM (SELECT DISTINCT o_orderdate, o_custkey FROM orders) GROUP BY 1")
def j8(spark, d):
    from ..functions.scalars import content_id

    o = table(spark, d, "orders").withColumn("id", content_id(F.col("o_orderdate"), F.col("o_custkey")))
    return history.keep_first(o, ["id"], "o_orderkey").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("rows"))


@query("j10_emitted_once", "SELECT event_id FROM events WHERE value > 80 AND event_id % 4 <> 0")
def j10(spark, d):
    e = table(spark, d, "events").where("value > 80").select("event_id")
    return e.join(e.where("event_id % 4 = 0"), "event_id", "left_anti")


@query("l3_acceptance_gate", "SELECT c_custkey FROM customer")
def l3(spark, d):
    c = table(spark, d, "customer")
    return audit.enforce(c, [("mapped", F.count("c_nationkey") / F.count("*"), 0.99), ("rows", F.count("*"), 1)]).select("c_custkey")


@query("l5_feed_health", "WITH c AS (SELECT session, count(DISTINCT security_id) AS n FROM bars GROUP BY 1) SELECT count(*) FILTER (WHERE close <= 0) AS bad_prices, CAST((SELECT count(*) FROM securities WHERE security_id NOT IN (SELECT security_id FROM bars WHERE session >= DATE '2001-10-01')) AS BIGINT) AS missing, (SELECT max(session) FROM c WHERE n >= 0.5 * (SELECT max(n) FROM c)) AS cutoff FROM bars")
def l5(spark, d):
    return rules.feed_health(g.bars(spark, d), g.securities(spark, d), "security_id", "close", "session", F.lit("2001-10-01").cast("date"))
