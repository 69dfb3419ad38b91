"""Queries over quarterly statements, prices with actions, scalars and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import fundamentals as fu
from ..operators import prices as pr
from . import registry as g
from .registry import cut, query, r, table

C = ["company_id"]


@query("e18_trailing_four", """SELECT company_id, q, round(ttm, 2) AS ttm, published FROM (SELECT company_id, q, sum(revenue) OVER w AS ttm, max(published) OVER w AS published, count(*) OVER w AS n, q - lag(q, 3) OVER (PARTITION BY company_id ORDER BY q) AS span FROM quarters
WINDOW w AS (PARTITION BY company_id ORDER BY q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n = 4 AND span = 3""")
def e18(spark, d):
    return fu.trailing_four(g.quarters(spark, d), C, "q", "revenue", "published").withColumn("ttm", r(F.col("ttm"), 2))


@query("c21_prior_year", "SELECT a.company_id, a.q, a.revenue, b.revenue AS prior_revenue FROM quarters a LEFT JOIN quarters b ON a.company_id = b.company_id AND b.q = a.q - 4")
def c21(spark, d):
    return fu.prior_year(g.quarters(spark, d), C, "q", ["revenue"]).select("company_id", "q", "revenue", "prior_revenue")


_YTD = "y AS (SELECT a.company_id, CAST(a.q // 4 AS BIGINT) AS year, CAST(a.q % 4 + 1 AS BIGINT) AS part, sum(b.revenue) AS v FROM quarters a JOIN quarters b ON a.company_id = b.company_id AND b.q BETWEEN (a.q // 4) * 4 AND a.q GROUP BY 1, 2, 3)"


def _ytd(spark, d):
    from pyspark.sql import Window

    y = g.quarters(spark, d).select("company_id", F.floor(F.col("q") / 4).alias("year"), (F.col("q") % 4 + 1).alias("part"), "revenue")
    w = Window.partitionBy("company_id", "year").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return y.select("company_id", "year", "part", F.lit("revenue").alias("item"), F.sum("revenue").over(w).alias("v"))


@query("c22_ttm_composition", f"""WITH {_YTD} SELECT n.company_id, n.year, n.part, round(n.v + a.v - p.v, 2) AS ttm FROM y n LEFT JOIN y a ON a.company_id = n.company_id AND a.year = n.year - 1 AND a.part = 4 LEFT JOIN y p ON p.company_id = n.company_id AND p.year = n.year - 1 AND p.part = n.part WHERE n.part <> 4""")
def c22(spark, d):
    return fu.compose_ttm(_ytd(spark, d), C, "year", "part", "item", "v").select("company_id", "year", "part", r(F.col("ttm"), 2).alias("ttm"))


@query("i2_standardize_concepts", """WITH ch(concept, tag, position) AS (VALUES ('a', 1, 2), ('a', 2, 1), ('b', 3, 1), ('b', 4, 2), ('b', 1, 3)), h AS (SELECT f.cik, concept, value, f.tag AS source_tag, accepted AS available, row_number() OVER (PARTITION BY cik, concept ORDER BY position, accepted, value) n FROM facts f JOIN ch ON ch.tag = f.tag)
SELECT cik, concept, value, source_tag, available FROM h WHERE n = 1""")
def i2(spark, d):
    chains = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 3, 1), ("b", 4, 2), ("b", 1, 3)], "concept string, tag int, position int")
    return fu.standardize(g.facts(spark, d), chains, ["cik"], "tag", "value", "accepted")


@query("i2_component_sum", "SELECT cik, accepted, CASE WHEN count(DISTINCT CASE WHEN tag IN (1, 2) THEN tag END) = 2 THEN sum(CASE WHEN tag IN (1, 2) THEN value END) END AS debt FROM facts GROUP BY 1, 2")
def i2_sum(spark, d):
    return fu.sum_components(g.facts(spark, d), ["cik", "accepted"], "tag", "value", [1, 2], "debt")


@query("c14_single_candidate", "SELECT o_custkey, min(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1")
def c14(spark, d):
    return fu.recover_single_candidate(table(spark, d, "orders").where("o_orderstatus = 'F'"), ["o_custkey"], "o_orderpriority")


def _statements(spark, d):
    q = g.quarters(spark, d).withColumn("cents", F.round(F.col("revenue") * 100).cast("long")).withColumn("year", F.floor(F.col("q") / 4))
    end = F.expr("make_date(cast(year AS int), cast((q % 4) * 3 + 3 AS int), 28)")
    parts = q.where("q % 4 < 3").select("company_id", end.alias("end"), "cents", "published")
    years = q.groupBy("company_id", "year").agg(F.sum("cents").alias("cents"), F.max("published").alias("published"))
    years = years.select("company_id", F.expr("make_date(cast(year AS int), 12, 28)").alias("end"), F.expr("make_date(cast(year AS int) - 1, 12, 28)").alias("start"), "cents", "published")
    return years, parts


@query("i3_quarter_derivation", """WITH qq AS (SELECT company_id, CAST(q // 4 AS INT) AS y, CAST(q % 4 AS INT) AS k, CAST(round(revenue * 100) AS BIGINT) AS cents, published FROM quarters), n AS (SELECT company_id, y, count(*) FILTER (WHERE k < 3) AS n, sum(cents) AS total, max(published) AS late FROM qq GROUP BY 1, 2),
a AS (SELECT company_id, make_date(y, 12, 28) AS fiscal_end, CAST(row_number() OVER (PARTITION BY company_id, y ORDER BY k) AS INT) AS quarter, cents AS value, published AS available FROM qq JOIN n USING (company_id, y) WHERE n = 3 AND k < 3),
b AS (SELECT company_id, make_date(y, 12, 28), 4, CAST(total - (SELECT sum(cents) FROM qq WHERE qq.company_id = n.company_id AND qq.y = n.y AND k < 3) AS BIGINT), late FROM n WHERE n = 3)
SELECT company_id, fiscal_end, 'ok' AS status, quarter, value, available FROM a UNION ALL SELECT company_id, 1, 'ok', 4, 1, late FROM (SELECT 1 AS company_id, DATE '1900-01-01' AS late) WHERE false UNION ALL SELECT *, NULL, NULL, NULL FROM (SELECT company_id, make_date(y, 12, 28), 'quarter_count' FROM n WHERE n <> 3)""".replace("UNION ALL SELECT company_id, 1, 'ok', 4, 1, late FROM (SELECT 1 AS company_id, DATE '1900-01-01' AS late) WHERE false ", "UNION ALL SELECT company_id, c1, 'ok', 4, c3, late FROM (SELECT * FROM b) AS t(company_id, c1, c2, c3, late) "))
def i3(spark, d):
    years, parts = _statements(spark, d)
    return fu.derive_quarters(years, parts, C, "end", "start", "cents", "published")


# A closure over intervals: the tests compare it with hand-made cases.
def _closure_sql(rounds: int) -> str:
    """Rounds of sums and differences; values of one interval agree, as whole cents, whichever way they come."""
    parts = ["r0 AS MATERIALIZED (SELECT company_id, year * 4 AS s, year * 4 + part AS e, CAST(round(v * 100) AS BIGINT) AS v FROM y WHERE part IN (1, 2, 4))"]
    for k in range(rounds):
        parts.append(f"""r{k + 1} AS MATERIALIZED (SELECT * FROM r{k} UNION SELECT a.company_id, a.s, b.e, a.v + b.v FROM r{k} a JOIN r{k} b ON a.company_id = b.company_id AND a.e = b.s WHERE b.e - a.s <= 4
UNION SELECT a.company_id, b.e, a.e, a.v - b.v FROM r{k} a JOIN r{k} b ON a.company_id = b.company_id AND a.s = b.s AND a.e > b.e)""")
    return f"WITH {_YTD}, {', '.join(parts)} SELECT company_id, s, e, v, 0 AS t FROM r{rounds}"


@query("i4_interval_closure", _closure_sql(5))
def i4(spark, d):
    y = _ytd(spark, d).where("part IN (1, 2, 4)")
    spans = y.select("company_id", (F.col("year") * 4).alias("s"), (F.col("year") * 4 + F.col("part")).alias("e"), F.round(F.col("v") * 100).cast("long").alias("v"), F.lit(0).alias("t"))
    return fu.close_intervals(spans, C, "s", "e", "v", "t", longest=4)


@query("i5_scale_guard", "SELECT o_orderkey FROM orders JOIN (SELECT o_custkey, median(o_totalprice) m FROM orders GROUP BY 1) USING (o_custkey) WHERE o_totalprice >= 0.5 * m")
def i5(spark, d):
    return fu.scale_guard(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", 0.5).select("o_orderkey")


@query("i6_statement_visibility", """WITH v AS (SELECT *, max(CASE WHEN tag IN (1, 2) THEN accepted END) OVER (PARTITION BY cik) AS visible_from FROM facts)
SELECT cik, visible_from, count(*) AS items, count(*) FILTER (WHERE accepted <= visible_from) AS known FROM v WHERE visible_from IS NOT NULL GROUP BY 1, 2""")
def i6(spark, d):
    f = g.facts(spark, d).withColumn("period", F.lit(1))
    s = fu.statement_rows(f, ["cik"], "period", "tag", "value", "accepted", [1, 2])
    known = F.size(F.filter("items", lambda x: x["value"].isNotNull())).cast("long")
    return s.select("cik", "visible_from", F.size("items").cast("long").alias("items"), known.alias("known"))


@query("i7_structural_zero", "SELECT o_orderkey, CASE WHEN n - a - b = 0 THEN 'zero' WHEN n - a - b > 0 THEN 'positive' END AS evidence FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY 1)")
def i7(spark, d):
    flag = lambda v: F.count_if(F.col("l_returnflag") == v)
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), flag("A").alias("a"), flag("R").alias("b"))
    return fu.structural_zero(p, ["o_orderkey"], "n", ["a", "b"], "evidence")


@query("c19_d11_coverage_grid", """WITH con(tier, tag) AS (VALUES ('core', 1), ('core', 2), ('second', 3), ('second', 6)), cells AS (SELECT tier, con.tag, i.cik, f.cik IS NOT NULL AS ok FROM (SELECT DISTINCT cik FROM facts) i CROSS JOIN con LEFT JOIN (SELECT DISTINCT cik, tag FROM facts) f ON f.cik = i.cik AND f.tag = con.tag)
SELECT tier, tag, count(*) FILTER (WHERE ok) AS covered, count(*) AS cells, round(count(*) FILTER (WHERE ok) / count(*), 6) AS rate FROM cells GROUP BY ROLLUP (tier, tag)""")
def c19(spark, d):
    concepts = spark.createDataFrame([("core", 1), ("core", 2), ("second", 3), ("second", 6)], "tier string, tag int")
    f = g.facts(spark, d)
    return fu.coverage_grid(f, f, concepts, "cik", "tag", "tier").withColumn("rate", r(F.col("rate")))


_SIG = ("revenue > prior_revenue", "orders > prior_orders", "revenue / orders > prior_revenue / prior_orders", "revenue > 200000")


@query("i10_piotroski", f"WITH p AS (SELECT a.*, b.revenue AS prior_revenue, b.orders AS prior_orders FROM quarters a LEFT JOIN quarters b ON a.company_id = b.company_id AND b.q = a.q - 4) SELECT company_id, q, CAST({' + '.join(f'CAST({s} AS INT)' for s in _SIG)} AS DOUBLE) AS strict, CAST(CASE WHEN prior_revenue IS NULL THEN CAST({_SIG[3]} AS INT) * 4.0 ELSE {' + '.join(f'CAST({s} AS INT)' for s in _SIG)} END AS DOUBLE) AS lenient FROM p")
def i10(spark, d):
    p = fu.prior_year(g.quarters(spark, d), C, "q", ["revenue", "orders"])
    signals = [F.expr(s) for s in _SIG]
    return p.select("company_id", "q", fu.piotroski(signals).alias("strict"), fu.piotroski(signals, strict=False).alias("lenient"))


@query("i14_dcf", """WITH b AS (SELECT c_custkey, c_acctbal AS e, 0.01 * (c_nationkey - 5) AS gr FROM customer), t AS (SELECT c_custkey, sum(e * pow((1 + gr) / 1.1, k)) AS s, any_value(e * pow(1 + gr, 10) * 1.02 / 0.08 / pow(1.1, 10)) AS l FROM b, generate_series(1, 10) x(k) GROUP BY 1) SELECT c_custkey, round(s + l, 2) AS dcf FROM t""")
def i14(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", r(fu.dcf_per_share(F.col("c_acctbal"), 0.01 * (F.col("c_nationkey") - 5), F.lit(0.1), F.lit(0.02)), 2).alias("dcf"))


@query("i13_graham_number", "SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_nationkey > 0 THEN round(sqrt(22.5 * c_acctbal * c_nationkey), 5) END AS number FROM customer")
def i13(spark, d):
    return table(spark, d, "customer").select("c_custkey", r(fu.graham_number(F.col("c_acctbal"), F.col("c_nationkey")), 5).alias("number"))


@query("e11_event_detection", """WITH x AS (SELECT security_id, session, close / lag(close) OVER w AS ratio, session - lag(session) OVER w AS gap, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY session))
SELECT security_id, session, round(ratio, 6) AS ratio FROM x WHERE (ratio < 0.1 OR ratio > 10) AND gap <= 3 AND n > 5""")
def e11(spark, d):
    return pr.detect_events(g.bars(spark, d), ["security_id"], "session", "close", 0.1, 10, 3, 5).withColumn("ratio", r(F.col("ratio")))


@query("e14_cumulative_factor", "WITH a AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem WHERE l_quantity = 50 GROUP BY 1, 2) SELECT l_suppkey, day, round(CAST(0.3010299956639812 AS DOUBLE) * sum(n) OVER (PARTITION BY l_suppkey ORDER BY day), 6) AS log_factor FROM a")
def e14(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity = 50").select("l_suppkey", F.to_date("l_shipdate").alias("day"), F.lit(2.0).alias("ratio"))
    return pr.cumulative_split_factor(a, ["l_suppkey"], "day", "ratio").select("l_suppkey", "day", r(F.log10("factor")).alias("log_factor"))


@query("e15_anchored_factors", """WITH a AS (SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS eff, CASE WHEN l_linenumber % 2 = 0 THEN 2.0 ELSE 1.5 END AS ratio, l_partkey <> 77 AS ok FROM lineitem WHERE l_quantity = 50 AND l_shipdate < TIMESTAMP '1998-12-20')
SELECT b.security_id, b.session, CASE WHEN coalesce(bool_and(ok), true) THEN round(coalesce(sum(ln(ratio)), 0), 6) END AS log_factor FROM bars b LEFT JOIN a ON a.security_id = b.security_id AND a.eff > b.session AND a.eff <= DATE '1998-12-31' WHERE b.session BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY 1, 2""")
def e15(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("eff"), F.date_add(F.to_date("l_shipdate"), 12).alias("known"), F.when(F.col("l_linenumber") % 2 == 0, 2.0).otherwise(1.5).alias("ratio"), (F.col("l_partkey") != 77).alias("ok"))
    day = F.lit("1998-12-31").cast("date")
    prices = g.bars(spark, d).where("session BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
    out = pr.anchored_factors(prices, a, ["security_id"], "session", "eff", "known", "ratio", "ok", day, day)
    return out.select("security_id", "session", r(F.log("factor")).alias("log_factor"))


_E16 = """SELECT security_id, session, p / close AS o FROM (SELECT security_id, session, close, volume, high / lag(high) OVER w AS a, lag(close) OVER w AS p, session - lag(session) OVER w AS gap,
 median(volume) OVER (PARTITION BY security_id ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mid FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY session))
 WHERE abs(1.0 / (p / close) - 1) > 0.25 AND abs(a - 1) <= 0.25 AND abs(close / p - a) > 0.25 AND volume / mid >= 1.5 AND gap <= 5"""


@query("e16_split_candidates", g.split_ratio_sql(_E16, "security_id, session", pr.PRICE_SPLITS, pr.PRICE_TOLERANCE))
def e16(spark, d):
    # highs stand for the adjusted series
    found = pr.split_candidates(g.bars(spark, d), ["security_id"], "session", "close", "high", "volume", flat=0.25, max_gap_days=5)
    return found.withColumn("ratio", r(F.col("ratio")))


_E17 = """SELECT company_id, q, v / p AS o FROM (SELECT company_id, q, orders AS v, lag(orders) OVER w AS p, lag(orders, 2) OVER w AS p2, lead(orders) OVER w AS n FROM quarters WINDOW w AS (PARTITION BY company_id ORDER BY q))
 WHERE abs(n / v - 1) <= 0.15 AND (p2 IS NULL OR abs(p / p2 - 1) <= 0.15) AND p IS NOT NULL"""


@query("e17_inferred_splits", g.split_ratio_sql(_E17, "company_id, q", pr.SHARE_SPLITS, pr.SHARE_TOLERANCE, either_way=True))
def e17(spark, d):
    return pr.inferred_splits(g.quarters(spark, d), C, "q", "orders").withColumn("ratio", r(F.col("ratio")))


_H14 = "SELECT DISTINCT l_quantity, l_quantity / 3.0 AS o FROM lineitem"


@query("h14_split_ratio", f"""SELECT l_orderkey, l_linenumber, max(a.ratio) AS price_ratio, max(b.ratio) AS share_ratio FROM lineitem LEFT JOIN ({g.split_ratio_sql(_H14, "l_quantity", pr.PRICE_SPLITS, pr.PRICE_TOLERANCE)}) a USING (l_quantity)
LEFT JOIN ({g.split_ratio_sql(_H14, "l_quantity", pr.SHARE_SPLITS, pr.SHARE_TOLERANCE, either_way=True)}) b USING (l_quantity) GROUP BY 1, 2""")
def h14(spark, d):
    jump = F.col("l_quantity") / 3.0
    share = pr.nearest_split_ratio(jump, pr.SHARE_SPLITS, pr.SHARE_TOLERANCE, either_way=True)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pr.nearest_split_ratio(jump).alias("p"), share.alias("s"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.max(r(F.col("p"))).alias("price_ratio"), F.max(r(F.col("s"))).alias("share_ratio"))


@query("i27_reconcile_actions", """SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, CASE WHEN max(l_quantity) - min(l_quantity) <= 0.2 * max(l_quantity) AND count(DISTINCT l_linestatus) <= 1 THEN round(avg(l_quantity), 6) END AS value, count(DISTINCT l_suppkey) AS sources,
CASE WHEN NOT (max(l_quantity) - min(l_quantity) <= 0.2 * max(l_quantity) AND count(DISTINCT l_linestatus) <= 1) THEN 'conflict' WHEN count(DISTINCT l_suppkey) >= 2 THEN 'confirmed' ELSE 'single_source' END AS status FROM lineitem GROUP BY 1, 2""")
def i27(spark, d):
    o = table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return pr.reconcile_actions(o, ["l_partkey", "day"], "l_suppkey", "l_quantity", "l_linestatus", 0.2).withColumn("value", r(F.col("value")))


@query("i29_adjustment_drift", "SELECT l_suppkey, ratio FROM (SELECT l_suppkey, min_by(l_quantity / l_linenumber, (l_shipdate, l_orderkey, l_linenumber)) AS ratio FROM lineitem GROUP BY 1) WHERE abs(ratio - 1) > 2")
def i29(spark, d):
    li = table(spark, d, "lineitem").withColumn("t", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).dropDuplicates(["l_suppkey", "t"])
    first = li.groupBy("l_suppkey").agg(F.min_by(F.col("l_quantity") / F.col("l_linenumber"), "t").alias("stored")).withColumn("vendor", F.lit(1.0))
    return pr.basis_drift(first, "stored", "vendor", 2.0).select("l_suppkey", F.col("stored").alias("ratio"))


@query("h1_h2_ratios", "SELECT company_id, q, CASE WHEN orders - 1 > 0 THEN floor(revenue / (orders - 1) * 10000 + 0.123456) / 10000 END AS ratio FROM quarters")
def h1(spark, d):
    return g.quarters(spark, d).select("company_id", "q", cut(sc.safe_ratio(F.col("revenue"), F.col("orders") - 1)).alias("ratio"))


@query("h3_h4_names", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS plain FROM part")
def h3(spark, d):
    return table(spark, d, "part").select("p_partkey", sc.normalize_name(F.col("p_name")).alias("plain"))


@query("h6_month_end", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) - (date_trunc('month', o_orderdate)::DATE - 1) <= last_day(o_orderdate::DATE) - CAST(o_orderdate AS DATE) THEN date_trunc('month', o_orderdate)::DATE - 1 ELSE last_day(o_orderdate::DATE) END AS month_end FROM orders")
def h6(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sc.nearest_month_end(F.to_date("o_orderdate")).alias("month_end"))


@query("h7_quarter_count", "SELECT customer, valid_from, CASE WHEN floor((valid_to - valid_from) * 4 / 365.25 + 0.5) BETWEEN 1 AND 4 THEN CAST(floor((valid_to - valid_from) * 4 / 365.25 + 0.5) AS INT) END AS quarters_n FROM intervals")
def h7(spark, d):
    return g.intervals(spark, d).select("customer", "valid_from", sc.quarter_count(F.col("valid_from"), F.col("valid_to")).alias("quarters_n"))


@query("h8_quarter_end", """WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 AS a, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS DATE) - 1 AS b FROM orders), y AS (SELECT o_orderkey, day, CASE WHEN day - a <= b - day THEN a ELSE b END AS near FROM x)
SELECT o_orderkey, CASE WHEN abs(day - near) <= 30 THEN near END AS quarter_end FROM y""")
def h8(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sc.calendar_quarter_end(F.to_date("o_orderdate"), 30).alias("quarter_end"))


@query("h9_h10_scales", """SELECT c_custkey, round(greatest(0.0, least(100.0, c_acctbal / 5000 * 100)), 6) AS up, round(greatest(0.0, least(100.0, (c_acctbal - 8000) / -8000 * 100)), 6) AS down,
round(CASE WHEN p <= 0 THEN NULL WHEN p <= 0.5 THEN 100 WHEN p <= 1 THEN 100 - (p - 0.5) / 0.5 * 25 WHEN p <= 2 THEN 75 - (p - 1) * 50 WHEN p <= 3 THEN 25 - (p - 2) * 25 ELSE 0 END, 6) AS peg FROM (SELECT *, c_acctbal / 2500 AS p FROM customer)""")
def h9(spark, d):
    a = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", r(sc.linear_scale(a, 0, 5000)).alias("up"), r(sc.linear_scale(a, 8000, 0)).alias("down"), r(sc.peg_score(a / 2500)).alias("peg"))


@query("h11_deflate", "SELECT a.security_id, a.month, round(a.price * z.price / a.price, 4) AS real_price, round((1 + a.bars / 100.0) / (1 + 0.02) - 1, 6) AS real_rate FROM months a JOIN months z ON a.security_id = z.security_id AND z.month = DATE '1998-01-01'")
def h11(spark, d):
    m = g.months(spark, d)
    now = m.where("month = DATE '1998-01-01'").select("security_id", F.col("price").alias("now"))
    return m.join(now, "security_id").select("security_id", "month", r(sc.deflate(F.col("price"), F.col("price"), F.col("now")), 4).alias("real_price"), r(sc.real_rate(F.col("bars") / 100.0, F.lit(0.02))).alias("real_rate"))


@query("h15_rotation", "SELECT o_orderkey, DATE '1995-01-02' + CAST(floor((CAST(o_orderdate AS DATE) - DATE '1995-01-02') / 28.0) * 28 AS INT) AS cycle FROM orders")
def h15(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sc.rotation_start(F.to_date("o_orderdate"), F.lit("1995-01-02").cast("date"), 4).alias("cycle"))


@query("h17_keyword_sentiment", "SELECT doc_id, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'tion') AS INT) - CAST(contains(lower(text), 'ch') AS INT) AS tone FROM documents")
def h17(spark, d):
    return table(spark, d, "documents").select("doc_id", sc.keyword_sentiment(F.col("text"), ["the", "tion"], ["ch"]).alias("tone"))


@query("h18_phrase_without_negation", """WITH p AS (SELECT doc_id, string_split_regex(lower(text), 'tion') AS s FROM documents) SELECT doc_id, len(s) > 1 AND len(list_filter(generate_series(1, len(s) - 1), lambda i: NOT regexp_matches(right(s[i], 20) || ' ' || left(s[i + 1], 20), '\\bthe\\b'))) > 0 AS firm FROM p""")
def h18(spark, d):
    return table(spark, d, "documents").select("doc_id", sc.phrase_without_negation(F.col("text"), "tion", r"\bthe\b", 20).alias("firm"))


@query("h19_json_items", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def h19(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("h21_content_ids", "SELECT o_orderkey, sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS id FROM orders")
def h21(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sc.content_id(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("id"))


_BARE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r]+', ' ', 'g')"""


@query("a22_document_text", f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_BARE}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM pages")
def a22(spark, d):
    return table(spark, d, "pages").select("page_id", sc.document_text(F.col("html")).alias("text"))


@query("b3_unit_predicate", "SELECT nation.n_nationkey, lower(n_name) IN ('shares', 'share') OR regexp_matches(n_name, '^[A-Z]{3}$') AS valid FROM nation")
def b3(spark, d):
    return table(spark, d, "nation").select("n_nationkey", sc.valid_unit(F.col("n_name")).alias("valid"))


@query("b8_reason_filter", """SELECT c_custkey, concat_ws(',', CASE WHEN NOT c_acctbal > 0 THEN 'negative_balance' END, CASE WHEN NOT c_nationkey < 20 THEN 'excluded_nation' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'excluded_segment' END) AS why, c_acctbal > 0 AND c_nationkey < 20 AND c_mktsegment <> 'MACHINERY' AS included FROM customer""")
def b8(spark, d):
    why = sc.reasons([(F.col("c_acctbal") > 0, "negative_balance"), (F.col("c_nationkey") < 20, "excluded_nation"), (F.col("c_mktsegment") != "MACHINERY", "excluded_segment")])
    return table(spark, d, "customer").select("c_custkey", F.array_join(why, ",").alias("why"), (F.size(why) == 0).alias("included"))
