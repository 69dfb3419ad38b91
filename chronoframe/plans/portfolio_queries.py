"""Queries over returns, regimes, universes and audits, and the flagship."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, audit, history, risk, rules
from ..operators import cross_section as x
from ..operators import selection as sel
from ..operators import series as s
from . import registry as g
from .registry import cut, query, r, table

K = ["security_id"]
_MR = "mr AS (SELECT security_id, month, price, sector, turnover, ln(price / lag(price) OVER (PARTITION BY security_id ORDER BY month)) AS ret FROM months)"


def _returns(spark, d):
    return g.months(spark, d).withColumn("ret", s.log_return("price", K, "month"))


@query("flagship_pit_screen", """WITH bad AS (SELECT DISTINCT cik, tag FROM (SELECT cik, tag FROM facts WHERE accepted <= DATE '1999-06-30' GROUP BY cik, tag, accepted HAVING count(DISTINCT value) > 1)),
v AS (SELECT *, row_number() OVER (PARTITION BY cik, tag ORDER BY accepted, adsh, value) n FROM facts f WHERE accepted <= DATE '1999-06-30' AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.cik = f.cik AND bad.tag = f.tag)),
p AS (SELECT adsh % 100000 AS security_id, accepted, cik, tag, value FROM v WHERE n = 1), l AS (SELECT *, DATE '1999-06-30' AS day FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY accepted DESC, cik DESC, tag DESC) k FROM p) WHERE k = 1),
j AS (SELECT l.security_id, l.value, l.accepted, b.close FROM l ASOF LEFT JOIN bars b ON l.security_id = b.security_id AND l.day >= b.session), e AS (SELECT j.*, s.sector, value / close AS factor FROM j JOIN securities s USING (security_id)),
q AS (SELECT *, (rank() OVER (PARTITION BY sector ORDER BY factor) + (count(*) OVER (PARTITION BY sector, factor) - 1) / 2.0 - 0.5) / count(factor) OVER (PARTITION BY sector) AS pct FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY pct DESC, security_id) AS m FROM q), t AS (SELECT *, row_number() OVER (ORDER BY pct DESC, security_id) AS rank FROM c WHERE m <= 2)
SELECT security_id, sector, accepted, value, close, round(pct, 6) AS pct, CAST(rank AS INT) AS rank FROM t WHERE rank <= 20""")
def flagship(spark, d):
    """As of a day: each security's latest first-filed fact over its price then, ranked in its sector, two of a sector, twenty in all."""
    at = F.lit("1999-06-30").cast("date")
    seen = history.visible(g.facts(spark, d), "accepted", at)
    first, _, _ = history.pit_views(seen, ["cik", "tag"], "accepted", "value", ["adsh", "value"])
    own = first.select((F.col("adsh") % 100000).alias("security_id"), "accepted", "cik", "tag", "value")
    latest = history.keep_last(own, K, "accepted", ["cik", "tag"]).withColumn("at", at)
    priced = asof.asof_backward(latest, g.bars(spark, d).select("security_id", "session", "close"), K, "at", "session", "bar")
    e = priced.join(g.securities(spark, d).select("security_id", "sector"), "security_id").withColumn("close", F.col("bar.close"))
    e = e.withColumn("factor", F.col("value") / F.col("close"))
    e = e.withColumn("pct", x.midrank_percentile("factor", ["sector"])).withColumn("all", F.lit(1))
    top = sel.capped_top_k(e, ["all"], "sector", [F.desc("pct"), F.asc("security_id")], 2, 20)
    return top.select("security_id", "sector", "accepted", "value", "close", r(F.col("pct")).alias("pct"), "rank")


@query("d32_tail_risk", f"""WITH {_MR}, k AS (SELECT *, count(*) OVER (PARTITION BY security_id) AS n, row_number() OVER (PARTITION BY security_id ORDER BY ret) AS p FROM mr WHERE ret IS NOT NULL)
SELECT security_id, count(*) AS n, round(min(ret), 6) AS worst, round(sqrt(avg(pow(least(ret, 0), 2))), 6) AS downside, round(avg(ret) FILTER (WHERE p <= greatest(1, floor(n * 0.05))), 6) AS cvar FROM k GROUP BY 1""")
def d32(spark, d):
    t = risk.tail_risk(_returns(spark, d), K, "ret")
    return t.select("security_id", "n", r(F.col("worst")).alias("worst"), r(F.col("downside")).alias("downside"), r(F.col("cvar")).alias("cvar"))


@query("d32_moments", f"WITH {_MR} SELECT security_id, count(ret) AS n, round(skewness(ret), 5) AS skew, round(kurtosis(ret), 5) AS kurtosis FROM mr GROUP BY 1")
def d32_m(spark, d):
    return risk.sample_moments(_returns(spark, d), K, "ret").select("security_id", "n", r(F.col("skew"), 5).alias("skew"), r(F.col("kurtosis"), 5).alias("kurtosis"))


@query("d34_beta", f"WITH {_MR} SELECT a.security_id, count(*) AS n, round(covar_samp(a.ret, b.ret) / var_samp(b.ret), 5) AS beta, round(avg(a.ret - b.ret), 6) AS alpha FROM mr a JOIN mr b ON a.month = b.month AND b.security_id = 1 WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1")
def d34(spark, d):
    m = _returns(spark, d)
    bench = m.where("security_id = 1").select("month", F.col("ret").alias("bench"))
    b = risk.beta(m.select("security_id", "month", "ret"), bench, K, "month", "ret", "bench")
    return b.select("security_id", "n", r(F.col("beta"), 5).alias("beta"), r(F.col("alpha")).alias("alpha"))


@query("d33_pair_correlations", f"WITH {_MR} SELECT a.security_id AS a, b.security_id AS b, count(*) AS n, round(corr(a.ret, b.ret), 5) AS corr FROM mr a JOIN mr b ON a.month = b.month AND a.security_id < b.security_id WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL AND a.sector = b.sector GROUP BY 1, 2 HAVING count(*) >= 30")
def d33(spark, d):
    p = risk.pair_correlations(_returns(spark, d), "security_id", "month", "ret", 30, ["sector"])
    return p.withColumn("corr", r(F.col("corr"), 5))


@query("d33_sector_pair_correlations", f"WITH {_MR} SELECT a.security_id AS a, b.security_id AS b, count(*) AS n, round(corr(a.ret, b.ret), 5) AS corr FROM mr a JOIN mr b ON a.month = b.month AND a.sector = b.sector AND a.security_id < b.security_id WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20")
def d33_sectors(spark, d):
    p = risk.pair_correlations(_returns(spark, d), "security_id", "month", "ret", 20, ["sector"])
    return p.withColumn("corr", r(F.col("corr"), 5))


@query("d36_log_growth", "SELECT company_id, count(*) AS n, round(exp(regr_slope(ln(revenue), q)) - 1, 5) AS growth FROM quarters GROUP BY 1")
def d36(spark, d):
    return risk.log_growth(g.quarters(spark, d), ["company_id"], "q", "revenue").withColumn("growth", r(F.col("growth"), 5))


@query("d37_relative_trend", "SELECT company_id, round(regr_slope(revenue, CAST(q AS DOUBLE)) / avg(abs(revenue)), 5) AS trend FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY q DESC) n FROM quarters) WHERE n <= 5 GROUP BY 1")
def d37(spark, d):
    return risk.relative_trend(g.quarters(spark, d), ["company_id"], "q", "revenue").withColumn("trend", r(F.col("trend"), 5))


@query("d38_geometric_growth", "WITH y AS (SELECT company_id, revenue / lag(revenue) OVER (PARTITION BY company_id ORDER BY q) - 1 AS gr FROM quarters) SELECT company_id, CASE WHEN min(gr) > -1 THEN round(exp(avg(ln(1 + gr))) - 1, 5) ELSE -1.0 END AS growth FROM y GROUP BY 1")
def d38(spark, d):
    q = g.quarters(spark, d).withColumn("gr", s.simple_return("revenue", ["company_id"], "q"))
    return risk.geometric_growth(q, ["company_id"], "gr").withColumn("growth", r(F.col("growth"), 5))


@query("i39_nav_metrics", """WITH n AS (SELECT security_id, month, price, price / lag(price) OVER (PARTITION BY security_id ORDER BY month) - 1 AS re, price / max(price) OVER (PARTITION BY security_id ORDER BY month) - 1 AS dd FROM months)
SELECT security_id, count(*) AS n, round(max_by(price, month) / min_by(price, month) - 1, 5) AS total, round(stddev_samp(re) * sqrt(12), 5) AS volatility, round(avg(re) * sqrt(12) / stddev_samp(re), 5) AS sharpe, round(min(dd), 6) AS max_drawdown, round(sqrt(avg(dd * dd)), 6) AS ulcer FROM n GROUP BY 1""")
def i39(spark, d):
    m = risk.nav_metrics(g.months(spark, d), K, "month", "price", 12)
    five = {c: r(F.col(c), 5) for c in ("total", "volatility", "sharpe")} | {c: r(F.col(c)) for c in ("max_drawdown", "ulcer")}
    return m.withColumns(five).drop("sortino")


@query("i38_period_ledger", """WITH c AS (SELECT DISTINCT sector, month FROM months), nx AS (SELECT sector, month, lead(month) OVER (PARTITION BY sector ORDER BY month) AS nm FROM c), h AS (SELECT a.sector, a.month, b.price / a.price - 1 AS re FROM months a JOIN nx ON nx.sector = a.sector AND nx.month = a.month JOIN months b ON b.security_id = a.security_id AND b.month = nx.nm),
p AS (SELECT sector, month, count(*) AS positions, avg(re) AS pr FROM h GROUP BY 1, 2) SELECT sector, month, positions, round(pr, 6) AS period_return, round(sum(ln(1 + pr)) OVER (PARTITION BY sector ORDER BY month), 5) AS log_nav FROM p""")
def i38(spark, d):
    led = risk.period_ledger(g.months(spark, d), ["sector"], "month", "security_id", "price")
    return led.select("sector", "month", "positions", r(F.col("period_return")).alias("period_return"), r(F.log("nav"), 5).alias("log_nav"))


@query("i36_inverse_volatility", f"""WITH {_MR}, v AS (SELECT security_id, sector, stddev_samp(ret) AS vol FROM mr GROUP BY 1, 2), a AS (SELECT *, (1 / greatest(vol, 0.05)) / sum(1 / greatest(vol, 0.05)) OVER (PARTITION BY sector) AS w FROM v), b AS (SELECT *, least(w, 0.4) AS c, CASE WHEN w < 0.4 THEN w ELSE 0 END AS f FROM a)
SELECT security_id, sector, round(c + CASE WHEN sum(f) OVER (PARTITION BY sector) > 0 THEN (1 - sum(c) OVER (PARTITION BY sector)) * f / sum(f) OVER (PARTITION BY sector) ELSE 0 END, 5) AS weight FROM b""")
def i36(spark, d):
    v = _returns(spark, d).groupBy("security_id", "sector").agg(F.stddev_samp("ret").alias("vol"))
    return risk.inverse_volatility_weights(v, ["sector"], "vol", 0.05, 0.4).select("security_id", "sector", r(F.col("weight"), 5).alias("weight"))


# Resampling draws from a hash: the tests check its law, not its numbers.
@query("i41_block_bootstrap")
def i41(spark, d):
    m = _returns(spark, d).where("ret IS NOT NULL").withColumn("i", F.row_number().over(Window.partitionBy("security_id").orderBy("month")) - 1)
    b = risk.bootstrap_means(m.select("security_id", "i", "ret"), K, "i", "ret", 50, 6, 11)
    return b.groupBy("security_id").agg(r(F.percentile("mean", 0.05), 6).alias("low"), r(F.percentile("mean", 0.95), 6).alias("high"))


@query("i42_purged_windows", """WITH s AS (SELECT session, CAST(row_number() OVER (ORDER BY session) - 1 AS INT) AS n FROM (SELECT DISTINCT session FROM bars)), t AS (SELECT max(n) + 1 AS c FROM s), w AS (SELECT unnest(generate_series(0, CAST(floor((c - 500 - 20 - 120) / 120.0) AS INT))) AS win FROM t)
SELECT CAST(win AS INT) AS "window", n, CASE WHEN n - win * 120 < 500 THEN 'fit' ELSE 'evaluate' END AS role FROM w JOIN s ON n BETWEEN win * 120 AND win * 120 + 639 AND (n - win * 120 < 500 OR n - win * 120 >= 520)""")
def i42(spark, d):
    sessions = g.bars(spark, d).select("session").distinct()  # one row a day: a calendar
    n = sessions.withColumn("n", F.row_number().over(Window.orderBy("session")) - 1)
    return risk.rolling_windows(n, "n", 500, 120, 120, 20).select("window", "n", "role")


@query("i30_i51_regime_labels", """SELECT security_id, month, CASE WHEN turnover / 1000 >= 700 THEN 2 WHEN turnover / 1000 >= 500 THEN 1 ELSE 0 END + CASE WHEN bars >= 12 THEN 1 ELSE 0 END AS points FROM months""".replace("SELECT security_id, month, CASE", "SELECT security_id, month, CASE WHEN p >= 2 THEN 'defensive' WHEN p = 1 THEN 'cautious' ELSE 'neutral' END AS label, CASE WHEN p >= 4 THEN 3 WHEN p >= 2 THEN 2 WHEN p >= 1 THEN 1 ELSE 0 END AS target FROM (SELECT security_id, month, CASE") .replace(" AS points FROM months", " AS p FROM months)"))
def i30(spark, d):
    m = g.months(spark, d)
    oas, real = F.col("turnover") / 1000, F.col("bars") / 480
    points = F.when(oas >= 700, 2).when(oas >= 500, 1).otherwise(0)
    return m.select("security_id", "month", risk.credit_label(oas, real).alias("label"), risk.stress_target(points, F.when(F.col("bars") >= 12, 1).otherwise(0)).alias("target"))


@query("i31_regime_weights", """WITH dim(regime, factor, weight) AS (VALUES ('up', 'value', 0.5), ('up', 'momentum', 0.7), ('down', 'value', 0.9), ('down', 'quality', 0.6)), m AS (SELECT security_id, month, CASE WHEN bars >= 8 THEN 'up' ELSE 'down' END AS regime FROM months)
SELECT security_id, month, factor, round(CAST(weight AS DOUBLE) / sum(CAST(weight AS DOUBLE)) OVER (PARTITION BY security_id, month), 6) AS weight FROM m JOIN dim USING (regime)""")
def i31(spark, d):
    dim = spark.createDataFrame([("up", "value", 0.5), ("up", "momentum", 0.7), ("down", "value", 0.9), ("down", "quality", 0.6)], "regime string, factor string, weight double")
    m = g.months(spark, d).select("security_id", "month", F.when(F.col("bars") >= 8, "up").otherwise("down").alias("regime"))
    return risk.regime_weights(m, dim, "regime", "factor", "weight", ["security_id", "month"]).select("security_id", "month", "factor", r(F.col("weight")).alias("weight"))


@query("i35_trade_levels", "WITH a AS (SELECT *, least(greatest((high - low) * 2 / close, 0.05), 0.2) AS k FROM bars) SELECT security_id, session, floor(close * (1 - k) * 10000 + 0.123456) / 10000 AS stop, floor(close * (1 + 2 * k) * 10000 + 0.123456) / 10000 AS target FROM a")
def i35(spark, d):
    stop, target = risk.trade_levels(F.col("close"), F.col("high") - F.col("low"))
    return g.bars(spark, d).select("security_id", "session", cut(stop).alias("stop"), cut(target).alias("target"))


@query("d8_complete_window_median", "SELECT security_id, CASE WHEN count(*) = 90 THEN median(close) END AS mid FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY session DESC) n FROM bars WHERE session < DATE '1996-12-31') WHERE n <= 90 GROUP BY 1".replace("median(close) END", "round(median(close), 5) END"))
def d8(spark, d):
    b = g.bars(spark, d).where("session < DATE '1996-12-31'")
    last = b.withColumn("n", F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("session")))).where("n <= 90")
    return last.groupBy("security_id").agg(F.when(F.count("*") == 90, r(F.median("close"), 5)).alias("mid"))


@query("d8_all_complete_window_median", "SELECT security_id, CASE WHEN count(*) = 90 THEN round(median(close), 5) END AS mid FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY session DESC) n FROM bars WHERE session < DATE '1996-12-31') WHERE n <= 90 GROUP BY 1")
def d8_all(spark, d):
    b = g.bars(spark, d).where("session < DATE '1996-12-31'")
    last = b.withColumn("n", F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("session")))).where("n <= 90")
    return last.groupBy("security_id").agg(F.when(F.count("*") == 90, r(F.median("close"), 5)).alias("mid"))


@query("d9_complete_totals", "SELECT l_orderkey, CASE WHEN count(*) = count(CASE WHEN l_quantity > 1 THEN 1 END) THEN sum(l_quantity) END AS total FROM lineitem GROUP BY 1")
def d9(spark, d):
    v = F.when(F.col("l_quantity") > 1, F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(F.count("*") == F.count(v), F.sum(v)).alias("total"))


@query("d10_most_liquid_line", "SELECT sector, arg_max(security_id, (turnover, -security_id)) AS security_id FROM (SELECT sector, security_id, sum(turnover) AS turnover FROM months GROUP BY 1, 2) GROUP BY 1")
def d10(spark, d):
    t = g.months(spark, d).groupBy("sector", "security_id").agg(F.sum("turnover").alias("turnover"))
    return t.groupBy("sector").agg(F.max_by("security_id", F.struct("turnover", -F.col("security_id"))).alias("security_id"))


@query("d12_mapping_rates", "SELECT c_nationkey, count(*) AS cells, count(*) FILTER (WHERE o.k IS NOT NULL) AS mapped, round(count(*) FILTER (WHERE o.k IS NOT NULL) / count(*), 6) AS rate FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') o ON o.k = c_custkey GROUP BY 1")
def d12(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("k")).distinct()
    out = table(spark, d, "customer").join(o, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("cells"), F.count("k").alias("mapped"))
    return out.withColumn("rate", r(F.col("mapped") / F.col("cells")))


@query("d13_average_turnover", "SELECT security_id, floor(avg(close * volume) * 100 + 0.123456) / 100 AS adv FROM bars WHERE session > DATE '1999-12-31' - 60 AND session <= DATE '1999-12-31' GROUP BY 1")
def d13(spark, d):
    b = g.bars(spark, d).where("session > date_sub(DATE '1999-12-31', 60) AND session <= DATE '1999-12-31'")
    return b.groupBy("security_id").agg(cut(F.avg(F.col("close") * F.col("volume")), 2).alias("adv"))


@query("d15_broad_coverage_date", "WITH n AS (SELECT session, count(DISTINCT security_id) AS n FROM bars GROUP BY 1) SELECT max(session) AS session FROM n WHERE n >= 0.5 * (SELECT max(n) FROM n)")
def d15(spark, d):
    n = g.bars(spark, d).groupBy("session").agg(F.count_distinct("security_id").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("top")))).where("n >= 0.5 * top").agg(F.max("session").alias("session"))  # one row beside each


@query("d16_recent_print", "SELECT DISTINCT security_id FROM bars WHERE session >= DATE '2001-10-25' AND close > 0")
def d16(spark, d):
    b = g.bars(spark, d)
    return b.select("security_id").distinct().join(b.where("session >= DATE '2001-10-25' AND close > 0"), "security_id", "left_semi")


@query("d19_survivorship", "SELECT security_id, min(session) AS first_session, max(session) AS last_session, count(*) AS bars_n, CASE WHEN max(session) < DATE '2001-09-01' THEN 'inactive' ELSE 'active' END AS status FROM bars GROUP BY 1")
def d19(spark, d):
    return g.bars(spark, d).groupBy("security_id").agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count("*").alias("bars_n"), F.when(F.max("session") < F.lit("2001-09-01").cast("date"), "inactive").otherwise("active").alias("status"))


@query("d20_dominant_entity", """WITH h AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS p, lead(n) OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS second FROM h) SELECT l_partkey, l_suppkey, n FROM k WHERE p = 1 AND n >= 2 AND n >= 2 * coalesce(second, 0)""")
def d20(spark, d):
    h = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_partkey").orderBy(F.desc("n"), "l_suppkey")
    k = h.withColumn("p", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("n").over(w), F.lit(0)))
    return k.where("p = 1 AND n >= 2 AND n >= 2 * second").select("l_partkey", "l_suppkey", "n")


@query("d24_net_flow", "SELECT l_suppkey, sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) AS flow FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def d24(spark, d):
    q = F.col("l_quantity")
    flow = F.when(F.col("l_returnflag") == "A", q).when(F.col("l_returnflag") == "R", -q).otherwise(0.0)
    return table(spark, d, "lineitem").where("l_shipdate >= '1998-01-01'").groupBy("l_suppkey").agg(F.sum(flow).alias("flow"))


@query("d25_broad_period", "SELECT max(q) AS q FROM (SELECT q, count(DISTINCT company_id) AS n FROM quarters GROUP BY 1) WHERE n >= 400")
def d25(spark, d):
    return g.quarters(spark, d).groupBy("q").agg(F.count_distinct("company_id").alias("n")).where("n >= 400").agg(F.max("q").alias("q"))


@query("d26_peer_counts", "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal > 0) AS peers FROM customer GROUP BY 1")
def d26(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 0).alias("peers"))


@query("d41_positions", "SELECT o.o_orderkey, b.session, round(b.close / (o.o_totalprice / 100) - 1, 6) AS ret, CAST(DATE '1999-12-31' - CAST(o.o_orderdate AS DATE) AS INT) AS holding_days FROM (SELECT *, o_custkey % 100 + 1 AS security_id, DATE '1999-12-31' AS day FROM orders WHERE o_orderdate < TIMESTAMP '1999-12-31') o ASOF LEFT JOIN bars b ON b.security_id = o.security_id AND o.day >= b.session")
def d41(spark, d):
    at = F.lit("1999-12-31").cast("date")
    o = table(spark, d, "orders").where("o_orderdate < '1999-12-31'").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 100 + 1).alias("security_id"), at.alias("at"))
    p = asof.asof_backward(o, g.bars(spark, d).select("security_id", "session", "close"), K, "at", "session", "bar")
    return p.select("o_orderkey", "bar.session", r(F.col("bar.close") / (F.col("o_totalprice") / 100) - 1).alias("ret"), F.datediff("at", "day").alias("holding_days"))


@query("d42_coverage_rollup", "SELECT r_name, n_name, count(*) AS cells, count(*) FILTER (WHERE c_acctbal > 0) AS covered FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def d42(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("cells"), F.count_if(F.col("c_acctbal") > 0).alias("covered"))


@query("c23_sum_of_parts", "SELECT o_custkey, round(sum(l_quantity * l_extendedprice), 2) AS nav, floor(sum(l_quantity * l_extendedprice) / sum(l_quantity) * 100 + 0.123456) / 100 AS quality FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def c23(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    n = rules.sum_of_parts(table(spark, d, "orders"), li, "o_custkey", "o_orderkey", "l_quantity", "l_extendedprice")
    return n.select("o_custkey", r(F.col("nav"), 2).alias("nav"), cut(F.col("quality"), 2).alias("quality"))


@query("c24_coverage_matrix", "SELECT s_suppkey, r_name, coalesce(CASE WHEN n.n_regionkey = r_regionkey THEN 'direct' END, CASE WHEN r_regionkey < 2 THEN 'default' ELSE 'none' END) AS cell FROM supplier JOIN nation n ON n_nationkey = s_nationkey CROSS JOIN region")
def c24(spark, d):
    s_ = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    own = F.when(F.col("n_regionkey") == F.col("r_regionkey"), "direct")
    return rules.coverage_matrix(s_, table(spark, d, "region"), ["s_suppkey"], "r_name", own, F.when(F.col("r_regionkey") < 2, "default").otherwise("none"))


@query("i23_risk_tier", f"""WITH {_MR}, v AS (SELECT security_id, stddev_samp(ret) AS vol, avg(turnover) AS t FROM mr GROUP BY 1) SELECT security_id, round((CASE WHEN vol < 1.2 THEN 1 WHEN vol < 1.5 THEN 2 ELSE 3 END * 0.6 + CASE WHEN t > 500000 THEN 1 WHEN t > 400000 THEN 2 ELSE 3 END * 0.4) / 1.0, 4) AS score FROM v""")
def i23(spark, d):
    v = _returns(spark, d).groupBy("security_id").agg(F.stddev_samp("ret").alias("vol"), F.avg("turnover").alias("t"))
    level = lambda c, a, b: F.when(a, 1).when(b, 2).when(c.isNotNull(), 3)
    parts = [(level(F.col("vol"), F.col("vol") < 1.2, F.col("vol") < 1.5), 0.6), (level(F.col("t"), F.col("t") > 500000, F.col("t") > 400000), 0.4)]
    return v.select("security_id", r(x.weighted_mean(parts), 4).alias("score"))


@query("i47_score_change", "WITH a AS (SELECT security_id, month, price - lag(price) OVER w AS dp, bars - lag(bars) OVER w AS db FROM months WINDOW w AS (PARTITION BY security_id ORDER BY month)) SELECT security_id, month, CASE WHEN dp IS NULL THEN NULL WHEN abs(dp) > 500 AND abs(db) > 5 THEN 'price,bars' WHEN abs(dp) > 500 THEN 'price' WHEN abs(db) > 5 THEN 'bars' ELSE 'stable' END AS moved FROM a")
def i47(spark, d):
    moved = rules.score_change(K, "month", [("price", 500), ("bars", 5)])
    return g.months(spark, d).select("security_id", "month", moved.alias("moved"))


# Orders arrive by their number; their dates do not rise with it.
@query("l1_nav_audit", "WITH o AS (SELECT *, coalesce(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) >= o_orderdate, false) AS back FROM orders) SELECT o_custkey, count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS identity_breaks, count(*) FILTER (WHERE back) AS order_breaks FROM o GROUP BY 1")
def l1(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("nav"), F.lit(0.0).alias("cash"), (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 50 == 0, 1.0).otherwise(0.0)).alias("held"))
    return audit.nav_audit(o, ["o_custkey"], "o_orderkey", "o_orderdate", "nav", "cash", "held", 0.01)


# Each customer's orders are a log in which every record names the hash before it; two kinds of damage are put in.
@query("l2_hash_chain", "WITH o AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) SELECT o_orderkey, coalesce(p % 97 = 0, false) OR o_orderkey % 89 = 0 AS broken_link, o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 AS broken_hash FROM o WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 OR p % 97 = 0")
def l2(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("payload"))
    log = audit.chain_hashes(o, ["o_custkey"], "o_orderkey", "payload")
    spoiled = log.withColumn("own", F.when(F.col("o_orderkey") % 97 == 0, "x").otherwise(F.col("own"))).withColumn("previous", F.when(F.col("o_orderkey") % 89 == 0, "y").otherwise(F.col("previous")))
    return audit.chain_breaks(spoiled, ["o_custkey"], "o_orderkey", "payload", "own", "previous").select("o_orderkey", "broken_link", "broken_hash")


@query("l4_gates", "SELECT 'mapped' AS \"check\", CAST(count(c_nationkey) / count(*) AS DOUBLE) AS value, CAST(0.9 AS DOUBLE) AS least, 'pass' AS status FROM customer UNION ALL SELECT 'funded', round(count(*) FILTER (WHERE c_acctbal > 0) / count(*), 6), 0.99, 'warn' FROM customer")
def l4(spark, d):
    checks = [("mapped", F.count("c_nationkey") / F.count("*"), 0.9), ("funded", r(F.count_if(F.col("c_acctbal") > 0) / F.count("*")), 0.99)]
    return audit.gates(table(spark, d, "customer"), checks)


@query("l7_look_ahead", "SELECT cik, tag FROM facts WHERE false")
def l7(spark, d):
    at = F.lit("1998-06-30").cast("date")
    view = lambda f: history.visible(f, "accepted", at)
    return audit.look_ahead_leaks(view, g.facts(spark, d), "accepted", 7, ["cik", "tag"])


@query("l8_export_contract", "SELECT event_id FROM events WHERE false")
def l8(spark, d):
    return audit.secret_looking_keys(table(spark, d, "events"), "props").select("event_id")


@query("a25_content_fingerprint")
def a25(spark, d):
    return audit.content_fingerprint(table(spark, d, "orders"))
