"""Queries over daily bars and monthly cross-sections: windows, folds, ranks and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cross_section as x
from ..operators import index_aware as ia
from ..operators import segments
from ..operators import selection as sel
from ..operators import series as s
from . import registry as g
from .registry import cut, query, r, table

K, T = ["security_id"], "session"
_W = "OVER (PARTITION BY security_id ORDER BY session"


def _roll(n: int) -> str:
    return f"{_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("e19_moving_average", f"SELECT security_id, session, CASE WHEN count(close) {_roll(20)} = 20 THEN round(avg(close) {_roll(20)}, 6) END AS sma20 FROM bars")
def e19(spark, d):
    return g.bars(spark, d).select("security_id", "session", r(s.sma("close", K, T, 20)).alias("sma20"))


@query("e10_price_jumps", f"SELECT * FROM (SELECT security_id, session, round(close / lag(close) {_W}), 6) AS ratio FROM bars) WHERE ratio >= 1.9 OR ratio <= 0.55")
def e10(spark, d):
    b = g.bars(spark, d).select("security_id", "session", r(F.col("close") / F.lag("close").over(s.ordered(K, T))).alias("ratio"))
    return b.where("ratio >= 1.9 OR ratio <= 0.55")


@query("e20_month_end_trend", """WITH m AS (SELECT security_id, CAST(date_trunc('month', session) AS DATE) AS month, max(session) AS session, max_by(close, session) AS close FROM bars GROUP BY 1, 2)
SELECT security_id, month, close, CASE WHEN count(close) OVER w = 10 THEN close > avg(close) OVER w END AS above FROM m WINDOW w AS (PARTITION BY security_id ORDER BY month ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def e20(spark, d):
    m = s.month_ends(g.bars(spark, d), K, T, "close")
    return m.select("security_id", "month", "close", (F.col("close") > s.sma("close", K, "month", 10)).alias("above"))


@query("e21_dual_confirmation", f"SELECT security_id, session, close > 1500 AND close > avg(close) {_roll(20)} AS stress FROM bars QUALIFY count(close) {_roll(20)} = 20")
def e21(spark, d):
    b = g.bars(spark, d).withColumn("m", s.sma("close", K, T, 20)).where("m IS NOT NULL")
    return b.select("security_id", "session", ((F.col("close") > 1500) & (F.col("close") > F.col("m"))).alias("stress"))


@query("e22_ratio_zscore", f"""WITH p AS (SELECT a.security_id, a.session, a.close / b.close AS ratio FROM bars a JOIN bars b ON a.session = b.session AND b.security_id = 1 WHERE a.security_id <> 1)
SELECT security_id, session, round((ratio - avg(ratio) {_roll(20)}) / stddev_pop(ratio) {_roll(20)}, 4) AS z FROM p QUALIFY count(ratio) {_roll(20)} = 20""")
def e22(spark, d):
    b = g.bars(spark, d)
    base = b.where("security_id = 1").select("session", F.col("close").alias("base"))
    p = b.where("security_id <> 1").join(base, "session").withColumn("ratio", F.col("close") / F.col("base"))
    z = (F.col("ratio") - s.sma("ratio", K, T, 20)) / s.full_window(F.col("ratio"), F.stddev_pop, K, T, 20)
    return p.select("security_id", "session", r(z, 4).alias("z")).where("z IS NOT NULL")


@query("e23_trend_and_volatility_state", f"""WITH l AS (SELECT *, ln(close / lag(close) {_W})) AS ret FROM bars), v AS (SELECT *, CASE WHEN count(ret) {_roll(20)} = 20 THEN stddev_samp(ret) {_roll(20)} END AS vol, CASE WHEN count(close) {_roll(60)} = 60 THEN avg(close) {_roll(60)} END AS slow,
CASE WHEN count(close) {_roll(15)} = 15 THEN avg(close) {_roll(15)} END AS fast FROM l)
SELECT security_id, session, CASE WHEN close < slow AND vol > quantile_cont(vol, 0.5) {_roll(60)} THEN 'stress' WHEN close > slow AND fast > slow THEN 'bull' ELSE 'mixed' END AS state FROM v WHERE slow IS NOT NULL AND vol IS NOT NULL
QUALIFY count(vol) {_roll(60)} = 60""")
def e23(spark, d):
    b = g.bars(spark, d).withColumn("ret", s.log_return("close", K, T))
    b = b.withColumn("vol", s.full_window(F.col("ret"), F.stddev_samp, K, T, 20)).withColumn("slow", s.sma("close", K, T, 60)).withColumn("fast", s.sma("close", K, T, 15))
    b = b.where("slow IS NOT NULL AND vol IS NOT NULL").withColumn("mid", s.full_window(F.col("vol"), lambda c: F.percentile(c, 0.5), K, T, 60)).where("mid IS NOT NULL")
    stress = (F.col("close") < F.col("slow")) & (F.col("vol") > F.col("mid"))
    bull = (F.col("close") > F.col("slow")) & (F.col("fast") > F.col("slow"))
    return b.select("security_id", "session", F.when(stress, "stress").when(bull, "bull").otherwise("mixed").alias("state"))


@query("e24_momentum_skip", f"SELECT security_id, session, round(lag(close, 21) {_W}) / lag(close, 252) {_W}) - 1, 6) AS momentum FROM bars")
def e24(spark, d):
    return g.bars(spark, d).select("security_id", "session", r(s.momentum("close", K, T)).alias("momentum"))


@query("e28_true_range", f"SELECT security_id, session, round(greatest(high - low, abs(high - lag(close) {_W})), abs(low - lag(close) {_W}))), 6) AS tr FROM bars")
def e28(spark, d):
    return g.bars(spark, d).select("security_id", "session", r(s.true_range("high", "low", "close", K, T)).alias("tr"))


@query("e29_bollinger", f"SELECT security_id, session, CASE WHEN count(close) {_roll(20)} = 20 THEN round((close - (avg(close) {_roll(20)} - 2 * stddev_pop(close) {_roll(20)})) / (4 * stddev_pop(close) {_roll(20)}), 4) END AS position FROM bars")
def e29(spark, d):
    return g.bars(spark, d).select("security_id", "session", r(s.bollinger_position("close", K, T), 4).alias("position"))


@query("e30_obv", f"WITH c AS (SELECT *, sign(coalesce(close - lag(close) {_W}), 0)) AS sg FROM bars) SELECT security_id, session, CAST(sum(sg * volume) {_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS obv FROM c")
def e30(spark, d):
    return s.with_obv(g.bars(spark, d), "close", "volume", K, T).select("security_id", "session", F.col("obv").cast("long").alias("obv"))


@query("e31_range_position", f"SELECT security_id, session, round((close - min(close) {_roll(252)}) / nullif(max(close) {_roll(252)} - min(close) {_roll(252)}, 0), 6) AS place FROM bars")
def e31(spark, d):
    return g.bars(spark, d).select("security_id", "session", r(s.range_position("close", K, T)).alias("place"))


@query("e32_volume_ratio", f"SELECT security_id, session, floor(avg(volume) {_roll(20)} / avg(volume) {_roll(60)} * 10000 + 0.123456) / 10000 AS ratio FROM bars QUALIFY count(volume) {_roll(60)} = 60")
def e32(spark, d):
    return g.bars(spark, d).select("security_id", "session", cut(s.volume_ratio("volume", K, T)).alias("ratio")).where("ratio IS NOT NULL")


@query("e33_annual_volatility", f"""WITH l AS (SELECT *, ln(close / lag(close) {_W})) AS ret FROM bars) SELECT security_id, session, round(stddev_samp(ret) {_roll(60)} * sqrt(252), 4) AS vol FROM l QUALIFY count(ret) {_roll(60)} = 60""")
def e33(spark, d):
    b = g.bars(spark, d).withColumn("ret", s.log_return("close", K, T))
    return b.select("security_id", "session", r(s.annualized_volatility("ret", K, T, 60), 4).alias("vol")).where("vol IS NOT NULL")


@query("e34_drawdown", f"WITH x AS (SELECT security_id, close / max(close) {_W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars) SELECT security_id, round(min(dd), 6) AS max_drawdown FROM x GROUP BY 1")
def e34(spark, d):
    b = g.bars(spark, d).select("security_id", s.drawdown("close", K, T).alias("dd"))
    return b.groupBy("security_id").agg(r(F.min("dd")).alias("max_drawdown"))


@query("e35_rolling_win_rate", """WITH m AS (SELECT security_id, month, price > lag(price) OVER (PARTITION BY security_id ORDER BY month) AS won, round(price / lag(price, 12) OVER (PARTITION BY security_id ORDER BY month) - 1, 6) AS year_return FROM months)
SELECT security_id, month, year_return, round(avg(CAST(won AS INT)) OVER (PARTITION BY security_id ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS win_rate FROM m""")
def e35(spark, d):
    m = g.months(spark, d).withColumn("won", (F.col("price") > F.lag("price").over(s.ordered(K, "month"))).cast("int"))
    return m.select("security_id", "month", r(s.simple_return("price", K, "month", 12)).alias("year_return"), r(F.avg("won").over(s.last_n(K, "month", 12))).alias("win_rate"))


@query("e36_calendar_year_return", """WITH y AS (SELECT security_id, CAST(year(session) AS INT) AS year, max_by(close, session) AS v FROM bars GROUP BY 1, 2) SELECT security_id, year, round(v / lag(v) OVER (PARTITION BY security_id ORDER BY year) - 1, 6) AS ret FROM y""")
def e36(spark, d):
    y = g.bars(spark, d).groupBy("security_id", F.year("session").alias("year")).agg(F.max_by("close", "session").alias("v"))
    return y.select("security_id", "year", r(s.simple_return("v", K, "year")).alias("ret"))


@query("e38_hysteresis", f"""WITH a AS (SELECT *, CASE WHEN count(close) {_roll(20)} = 20 THEN avg(close) {_roll(20)} END AS m FROM bars), b AS (SELECT *, CASE WHEN close > 1.05 * m THEN true WHEN close < 0.95 * m THEN false END AS st FROM a)
SELECT security_id, session, last_value(st IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS risk_on FROM b""")
def e38(spark, d):
    b = g.bars(spark, d).withColumn("m", s.sma("close", K, T, 20))
    return s.hysteresis(b, K, T, F.col("close") > 1.05 * F.col("m"), F.col("close") < 0.95 * F.col("m"), "risk_on").select("security_id", "session", "risk_on")


@query("e39_streaks", f"""WITH b AS (SELECT *, close > 1500 AS up FROM bars), c AS (SELECT *, CASE WHEN up IS DISTINCT FROM lag(up) {_W}) THEN 1 ELSE 0 END AS n FROM b), i AS (SELECT *, sum(n) {_W}) AS island FROM c)
SELECT security_id, session, CAST(row_number() OVER (PARTITION BY security_id, island ORDER BY session) AS INT) AS streak FROM i""")
def e39(spark, d):
    return s.streaks(g.bars(spark, d).withColumn("up", F.col("close") > 1500), K, T, "up").select("security_id", "session", "streak")


@query("e40_after_reset", "SELECT b.security_id, b.session, b.close FROM bars b LEFT JOIN (SELECT security_id, max(session) AS reset FROM bars WHERE volume > 90 GROUP BY 1) t USING (security_id) WHERE reset IS NULL OR session >= reset")
def e40(spark, d):
    return s.after_last_reset(g.bars(spark, d), K, T, F.col("volume") > 90).select("security_id", "session", "close")


@query("e42_trailing_stop", f"SELECT security_id, session, round(max(close) {_W} ROWS UNBOUNDED PRECEDING) * 0.8, 6) AS stop, close < max(close) {_W} ROWS UNBOUNDED PRECEDING) * 0.8 AS hit FROM bars")
def e42(spark, d):
    stop = F.max("close").over(s.ordered(K, T).rowsBetween(Window.unboundedPreceding, 0)) * 0.8
    return g.bars(spark, d).select("security_id", "session", r(stop).alias("stop"), (F.col("close") < stop).alias("hit"))


@query("e43_first_touch", """WITH f AS (SELECT security_id, min_by(close, session) AS entry FROM bars GROUP BY 1), t AS (SELECT b.security_id, session, CASE WHEN low <= entry * 0.8 THEN 'stop' WHEN high >= entry * 1.2 THEN 'target' END AS kind FROM bars b JOIN f USING (security_id))
SELECT security_id, min(session) AS exit_session, min_by(kind, session) AS kind FROM t WHERE kind IS NOT NULL GROUP BY 1""")
def e43(spark, d):
    b = g.bars(spark, d)
    entry = b.groupBy("security_id").agg(F.min_by("close", "session").alias("entry"))
    kind = F.when(F.col("low") <= F.col("entry") * 0.8, "stop").when(F.col("high") >= F.col("entry") * 1.2, "target")
    touched = b.join(entry, "security_id").withColumn("kind", kind).where("kind IS NOT NULL")
    return touched.groupBy("security_id").agg(F.min("session").alias("exit_session"), F.min_by("kind", "session").alias("kind"))


@query("e44_forward_return", """WITH l AS (SELECT security_id, session, close FROM bars), f AS (SELECT security_id, session - 90 AS at, close AS later FROM bars)
SELECT l.security_id, l.session, round(f.later / l.close - 1, 6) AS forward FROM l ASOF LEFT JOIN f ON l.security_id = f.security_id AND l.session >= f.at""")
def e44(spark, d):
    from ..operators.asof import asof_backward

    b = g.bars(spark, d)
    later = b.select("security_id", F.date_sub("session", 90).alias("at"), F.col("close").alias("later"))
    out = asof_backward(b, later, K, T, "at")
    return out.select("security_id", "session", r(F.col("match.later") / F.col("close") - 1).alias("forward"))


@query("e45_year_over_year", "SELECT a.security_id, a.month, round(a.price / b.price - 1, 6) AS yoy, CAST(a.month + INTERVAL 1 MONTH + INTERVAL 14 DAY AS DATE) AS visible_from FROM months a JOIN months b ON a.security_id = b.security_id AND b.month = a.month - INTERVAL 12 MONTH")
def e45(spark, d):
    m = g.months(spark, d).select("security_id", "month", "price")
    before = m.select("security_id", F.add_months("month", 12).alias("month"), F.col("price").alias("base"))
    return m.join(before, ["security_id", "month"]).select("security_id", "month", r(F.col("price") / F.col("base") - 1).alias("yoy"), F.date_add(F.add_months("month", 1), 14).alias("visible_from"))


@query("e46_forward_fill", f"SELECT security_id, session, last_value(CASE WHEN volume > 40 THEN close END IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS filled FROM bars")
def e46(spark, d):
    b = g.bars(spark, d).withColumn("x", F.when(F.col("volume") > 40, F.col("close")))
    return b.select("security_id", "session", s.forward_fill("x", K, T).alias("filled"))


@query("e47_look_back_returns", f"SELECT security_id, session, round(close / coalesce(lag(close, 4) {_W}), first_value(close) {_W})) - 1, 6) AS r5, round(close / coalesce(lag(close, 19) {_W}), first_value(close) {_W})) - 1, 6) AS r20 FROM bars")
def e47(spark, d):
    back = lambda n: r(s.look_back_return("close", K, T, n))
    return g.bars(spark, d).select("security_id", "session", back(5).alias("r5"), back(20).alias("r20"))


@query("e12_back_adjusted", f"""WITH e AS (SELECT *, CASE WHEN close / lag(close) {_W}) >= 40 THEN close / lag(close) {_W}) ELSE 1.0 END AS f FROM bars)
SELECT security_id, session, round(log10(close * coalesce(exp(sum(ln(f)) OVER (PARTITION BY security_id ORDER BY session DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1)), 6) AS log_adjusted FROM e""")
def e12(spark, d):
    from ..operators.prices import back_adjust

    ratio = F.col("close") / F.lag("close").over(s.ordered(K, T))
    return back_adjust(g.bars(spark, d).withColumn("f", F.when(ratio >= 40, ratio).otherwise(1.0)), K, T, "close", "f", "adjusted").select("security_id", "session", r(F.log10("adjusted")).alias("log_adjusted"))


# Folds: their SQL gives each row its weight in the recursion, or steps through the rows; the tests also compare plain loops.
@query("e26_rsi", f"WITH {g.rsi_sql('w')} SELECT security_id, round(rsi, 6) AS rsi FROM w")
def e26(spark, d):
    return s.rsi(g.bars(spark, d), "close", K, T).select("security_id", r(F.col("rsi")).alias("rsi"))


_TR = f"greatest(high - low, abs(high - lag(close) {_W})), abs(low - lag(close) {_W})))"


@query("e26_atr", f"WITH t AS (SELECT security_id, session, {_TR} AS tr FROM bars), k AS (SELECT *, row_number() {_W}) AS i, count(*) OVER (PARTITION BY security_id) AS n FROM t WHERE tr IS NOT NULL) SELECT security_id, CASE WHEN max(n) >= 14 THEN round(sum(tr / 14 * pow(13.0 / 14, CASE WHEN i <= 14 THEN n - 14 ELSE n - i END)), 6) END AS atr FROM k GROUP BY 1")
def e26_atr(spark, d):
    b = g.bars(spark, d).withColumn("tr", s.true_range("high", "low", "close", K, T))
    return s.wilder("tr", b, K, T, 14, "atr").select("security_id", r(F.col("atr")).alias("atr"))


@query("e27_ema", f"WITH k AS (SELECT *, row_number() {_W}) AS i, count(*) OVER (PARTITION BY security_id) AS n FROM bars) SELECT security_id, CASE WHEN max(n) >= 12 THEN round(sum(CASE WHEN i <= 12 THEN close / 12 * pow(11.0 / 13, n - 12) ELSE close * (2.0 / 13) * pow(11.0 / 13, n - i) END), 6) END AS ema FROM k GROUP BY 1")
def e27(spark, d):
    return s.ema(g.bars(spark, d), "close", K, T, 12).select("security_id", r(F.col("ema")).alias("ema"))


@query("e37_state_machine", g.state_machine_sql("SELECT security_id, session AS t, CASE WHEN close > 1600 THEN 2 WHEN close > 1450 THEN 1 ELSE 0 END AS raw FROM bars", "security_id"))
def e37(spark, d):
    b = g.bars(spark, d).withColumn("raw", F.when(F.col("close") > 1600, 2).when(F.col("close") > 1450, 1).otherwise(0))
    return s.state_machine(b, K, T, "raw", "state")


# The same recursions for every row, over series that are cut into segments.
_SERIES_ROWS = 150


@query("e27_ema_rows", f"""WITH k AS (SELECT *, row_number() {_W}) AS i FROM bars), w AS (SELECT a.security_id, a.session, a.i, sum(CASE WHEN b.i <= 12 THEN b.close / 12 * pow(11.0 / 13, greatest(a.i - 12, 0)) ELSE b.close * (2.0 / 13) * pow(11.0 / 13, a.i - b.i) END) AS s
FROM k a JOIN k b ON b.security_id = a.security_id AND b.i <= a.i GROUP BY ALL) SELECT security_id, session, CASE WHEN i >= 12 THEN round(s, 6) END AS ema FROM w""")
def e27_rows(spark, d):
    return segments.ema_rows(g.bars(spark, d).select("security_id", "session", "close"), "close", K, T, 12, rows=_SERIES_ROWS).select("security_id", "session", r("ema").alias("ema"))


@query("e26_rsi_rows", f"""WITH c AS (SELECT *, close - lag(close) {_W}) AS d, row_number() {_W}) - 1 AS i FROM bars), w AS (SELECT a.security_id, a.session, a.i, sum(greatest(b.d, 0.0) / 14 * pow(13.0 / 14, CASE WHEN b.i <= 14 THEN greatest(a.i - 14, 0) ELSE a.i - b.i END)) AS up,
sum(greatest(-b.d, 0.0) / 14 * pow(13.0 / 14, CASE WHEN b.i <= 14 THEN greatest(a.i - 14, 0) ELSE a.i - b.i END)) AS down FROM c a LEFT JOIN c b ON b.security_id = a.security_id AND b.i <= a.i AND b.i > 0 GROUP BY ALL)
SELECT security_id, session, CASE WHEN i < 14 THEN NULL WHEN down = 0 THEN 100.0 ELSE round(100 - 100 / (1 + up / down), 6) END AS rsi FROM w""")
def e26_rows(spark, d):
    return segments.rsi_rows(g.bars(spark, d).select("security_id", "session", "close"), "close", K, T, rows=_SERIES_ROWS).select("security_id", "session", r("rsi").alias("rsi"))


_LEVEL = "CASE WHEN close > 1600 THEN 2 WHEN close > 1450 THEN 1 ELSE 0 END"


@query("e37_state_rows", g.state_machine_sql(f"SELECT security_id, session AS t, {_LEVEL} AS raw FROM bars", "security_id", last="SELECT security_id, t AS session, state FROM m JOIN raw USING (security_id, i)"))
def e37_rows(spark, d):
    b = g.bars(spark, d).select("security_id", "session", F.expr(_LEVEL).alias("raw"))
    return segments.state_rows(b, K, T, "raw", "state", rows=_SERIES_ROWS).select("security_id", "session", "state")


_N = "count(price) OVER (PARTITION BY month)"
_AVG = "(rank() OVER (PARTITION BY month ORDER BY price) + (count(*) OVER (PARTITION BY month, price) - 1) / 2.0)"


@query("e1_midrank_percentile", f"SELECT security_id, month, round(({_AVG} - 0.5) / {_N}, 6) AS p FROM months")
def e1(spark, d):
    return g.months(spark, d).select("security_id", "month", r(x.midrank_percentile("price", ["month"])).alias("p"))


@query("e2_percentile_0_100", f"SELECT security_id, month, round(CASE WHEN {_N} = 1 THEN 100.0 ELSE ({_AVG} - 1) / ({_N} - 1) * 100 END, 6) AS p FROM months")
def e2(spark, d):
    return g.months(spark, d).select("security_id", "month", r(x.percentile_0_100("price", ["month"])).alias("p"))


@query("e3_ordinal_percentile", f"SELECT security_id, month, round(CASE WHEN {_N} = 1 THEN 50.0 ELSE 100 - (row_number() OVER (PARTITION BY month ORDER BY price, security_id) - 1) / ({_N} - 1) * 100 END, 6) AS p FROM months")
def e3(spark, d):
    return g.months(spark, d).select("security_id", "month", r(x.ordinal_percentile("price", ["month"], "security_id", invert=True)).alias("p"))


@query("e4_rank_share", f"SELECT security_id, month, round({_AVG} / {_N}, 6) AS p FROM months")
def e4(spark, d):
    return g.months(spark, d).select("security_id", "month", r(x.rank_share("price", ["month"])).alias("p"))


@query("e5_rank_sum", "SELECT security_id, month, CAST(row_number() OVER (PARTITION BY month ORDER BY price DESC, security_id) + row_number() OVER (PARTITION BY month ORDER BY turnover DESC, security_id) AS BIGINT) AS total FROM months")
def e5(spark, d):
    return g.months(spark, d).select("security_id", "month", x.rank_sum_percentile(["price", "turnover"], ["month"], "security_id").cast("long").alias("total"))


@query("e6_winsorize", "SELECT security_id, month, round(CASE WHEN coalesce(stddev_samp(price) OVER w, 0) = 0 THEN price ELSE greatest(least(price, avg(price) OVER w + 2 * stddev_samp(price) OVER w), avg(price) OVER w - 2 * stddev_samp(price) OVER w) END, 4) AS held FROM months WINDOW w AS (PARTITION BY month)")
def e6(spark, d):
    return g.months(spark, d).select("security_id", "month", r(x.winsorize("price", ["month"], 2.0), 4).alias("held"))


_Z = """z AS (SELECT security_id, month, sector, price, CASE WHEN count(price) OVER s >= 3 AND stddev_samp(price) OVER s > 0 THEN (price - avg(price) OVER s) / stddev_samp(price) OVER s
WHEN stddev_samp(price) OVER m > 0 THEN (price - avg(price) OVER m) / stddev_samp(price) OVER m ELSE 0 END AS z FROM months WINDOW s AS (PARTITION BY month, sector), m AS (PARTITION BY month))"""


@query("e7_sector_zscore", f"WITH {_Z} SELECT security_id, month, round(z, 4) AS z FROM z")
def e7(spark, d):
    return g.months(spark, d).select("security_id", "month", r(x.sector_zscore("price", ["month"], "sector"), 4).alias("z"))


_W8 = """w AS (SELECT security_id, month, sector, turnover, CASE WHEN coalesce(stddev_samp(price) OVER m, 0) = 0 THEN price ELSE greatest(least(price, avg(price) OVER m + 3 * stddev_samp(price) OVER m), avg(price) OVER m - 3 * stddev_samp(price) OVER m) END AS price FROM months WINDOW m AS (PARTITION BY month)),
z AS (SELECT security_id, month, sector, turnover, round(CASE WHEN count(price) OVER s >= 3 AND stddev_samp(price) OVER s > 0 THEN (price - avg(price) OVER s) / stddev_samp(price) OVER s WHEN stddev_samp(price) OVER m > 0 THEN (price - avg(price) OVER m) / stddev_samp(price) OVER m ELSE 0 END, 9) AS z FROM w WINDOW s AS (PARTITION BY month, sector), m AS (PARTITION BY month)),
n AS (SELECT security_id, month, sector, turnover, CASE WHEN count(z) OVER (PARTITION BY month) = 1 THEN 100.0 ELSE (rank() OVER (PARTITION BY month ORDER BY z) + (count(*) OVER (PARTITION BY month, z) - 1) / 2.0 - 1) / (count(z) OVER (PARTITION BY month) - 1) * 100 END AS score FROM z)"""


@query("e8_normalize_factor", f"WITH {_W8} SELECT security_id, month, round(score, 4) AS score FROM n")
def e8(spark, d):
    return x.normalize_factor(g.months(spark, d), "price", ["month"], "sector", "score").select("security_id", "month", r(F.col("score"), 4).alias("score"))


@query("e9_harmonized_composite", f"""WITH p AS (SELECT *, {_N} AS n, count(price) OVER (PARTITION BY month, sector) AS peers, CASE WHEN {_N} = 1 THEN 100.0 ELSE ({_AVG} - 1) / ({_N} - 1) * 100 END AS gp,
CASE WHEN count(price) OVER (PARTITION BY month, sector) <= 1 THEN 50.0 ELSE (rank() OVER (PARTITION BY month, sector ORDER BY price) + (count(*) OVER (PARTITION BY month, sector, price) - 1) / 2.0 - 1) / (count(price) OVER (PARTITION BY month, sector) - 1) * 100 END AS lp FROM months)
SELECT security_id, month, round(0.5 * gp + 0.5 * (50 + (lp - 50) * least(1.0, peers / 5)), 6) AS score FROM p""")
def e9(spark, d):
    return x.harmonize(g.months(spark, d), "price", ["month"], "sector", "score").select("security_id", "month", r(F.col("score")).alias("score"))


@query("i8_weighted_mean", "SELECT security_id, month, floor((coalesce(price * 0.5, 0) + coalesce(CASE WHEN bars > 3 THEN turnover / 100 END * 0.3, 0) + coalesce(CASE WHEN bars > 5 THEN bars END * 0.2, 0)) / (0.5 + CASE WHEN bars > 3 THEN 0.3 ELSE 0 END + CASE WHEN bars > 5 THEN 0.2 ELSE 0 END) * 10000 + 0.123456) / 10000 AS score FROM months")
def i8(spark, d):
    parts = [(F.col("price"), 0.5), (F.when(F.col("bars") > 3, F.col("turnover") / 100), 0.3), (F.when(F.col("bars") > 5, F.col("bars")), 0.2)]
    return g.months(spark, d).select("security_id", "month", cut(x.weighted_mean(parts)).alias("score"))


@query("d14_sector_medians", "SELECT sector, month, count(*) AS members, round(median(price), 5) AS median_price, round(median(turnover), 3) AS median_turnover FROM months GROUP BY 1, 2")
def d14(spark, d):
    m = x.group_medians(g.months(spark, d), ["sector", "month"], ["price", "turnover"])
    return m.withColumn("median_price", r(F.col("median_price"), 5)).withColumn("median_turnover", r(F.col("median_turnover"), 3))


_FWD = "f AS (SELECT security_id, month, price, turnover, lead(price) OVER (PARTITION BY security_id ORDER BY month) / price - 1 AS fwd FROM months)"


def _forward(spark, d):
    m = g.months(spark, d)
    return m.withColumn("fwd", F.lead("price").over(s.ordered(K, "month")) / F.col("price") - 1)


@query("d27_information_coefficient", f"""WITH {_FWD}, k AS (SELECT month, rank() OVER (PARTITION BY month ORDER BY turnover) + (count(*) OVER (PARTITION BY month, turnover) - 1) / 2.0 AS a, rank() OVER (PARTITION BY month ORDER BY fwd) + (count(*) OVER (PARTITION BY month, fwd) - 1) / 2.0 AS b FROM f WHERE fwd IS NOT NULL)
SELECT month, count(*) AS n, round(corr(a, b), 5) AS ic FROM k GROUP BY 1 HAVING count(*) > 2""")
def d27(spark, d):
    return x.information_coefficient(_forward(spark, d), "month", "turnover", "fwd").where("n > 2").select("month", "n", r(F.col("ic"), 5).alias("ic"))


@query("d28_decile_spread", f"""WITH {_FWD}, t AS (SELECT month, fwd, ntile(10) OVER (PARTITION BY month ORDER BY turnover, security_id) AS tile FROM f WHERE fwd IS NOT NULL)
SELECT month, round(avg(fwd) FILTER (WHERE tile = 10) - avg(fwd) FILTER (WHERE tile = 1), 6) AS spread FROM t GROUP BY 1""")
def d28(spark, d):
    return x.decile_spread(_forward(spark, d), "month", "turnover", "fwd", "security_id").select("month", r(F.col("spread")).alias("spread"))


_ORD = "price DESC, turnover DESC, security_id"


def _order():
    return [F.desc("price"), F.desc("turnover"), F.asc("security_id")]


@query("f1_total_order", f"SELECT security_id, month, CAST(row_number() OVER (PARTITION BY month ORDER BY {_ORD}) AS INT) AS rank FROM months")
def f1(spark, d):
    return g.months(spark, d).select("security_id", "month", F.row_number().over(Window.partitionBy("month").orderBy(*_order())).alias("rank"))


@query("f2_capped_top_k", f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY month, sector ORDER BY {_ORD}) AS n FROM months), b AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY {_ORD}) AS k FROM a WHERE n <= 2)
SELECT security_id, month, CAST(k AS INT) AS rank FROM b WHERE k <= 12""")
def f2(spark, d):
    return sel.capped_top_k(g.months(spark, d), ["month"], "sector", _order(), 2, 12).select("security_id", "month", "rank")


def candidates(spark, d):
    """Each month's candidates of the constrained choice."""
    m = x.normalize_factor(g.months(spark, d), "price", ["month"], "sector", "score")
    held = (F.col("security_id") % 7) == 0
    return m.withColumn("held", held).withColumn("stays", F.col("score") >= 40)


# A greedy choice under one cap: ranks within sectors and a running count say what the walk would; the tests walk it.
@query("f3_constrained_selection", f"""WITH {_W8}, c AS (SELECT *, security_id % 7 = 0 AS held, score >= 40 AS stays FROM n), o AS (SELECT *, held AND NOT stays AS ex, held AND stays AS fi FROM c),
f AS (SELECT *, NOT ex AND row_number() OVER (PARTITION BY month, sector, ex ORDER BY fi DESC, score DESC, security_id) <= 2 AS fits FROM o),
t AS (SELECT *, count(*) FILTER (WHERE fits) OVER (PARTITION BY month ORDER BY fi DESC, score DESC, security_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM f)
SELECT month, security_id, CASE WHEN ex THEN 'exit_band' WHEN taken >= 15 THEN 'no_slot' WHEN NOT fits THEN 'sector_cap' WHEN held THEN 'hold' ELSE 'enter' END AS action FROM t""")
def f3(spark, d):
    return sel.select_constrained(candidates(spark, d), ["month"], "score", "security_id", "sector", 15, 2)


# Four passes around an index core; the SQL tries one candidate of one pass after another, with what a cycle has picked as its state.
@query("f3_index_aware", f"""WITH RECURSIVE {_W8}, u AS (SELECT month, avg(price) AS level FROM months GROUP BY 1), h AS (SELECT month, level, lag(level, 3) OVER (ORDER BY month) AS old FROM u),
p AS (SELECT security_id, month, price, lag(price, 3) OVER (PARTITION BY security_id ORDER BY month) AS old FROM months),
c AS (SELECT n.month, n.security_id, n.sector, n.security_id % 7 = 0 AS held, n.security_id % 4 <> 0 AS core, n.security_id % 10 = 0 AS bank, n.security_id % 5 = 0 AS sleeve, round(n.score, 4) AS base,
 CASE WHEN p.old > 0 AND h.old > 0 THEN round(greatest(0.0, least(100.0, 50 + (p.price / p.old - h.level / h.old) * 200)), 4) ELSE 50.0 END AS relative FROM n JOIN p USING (security_id, month) JOIN h USING (month)),
d AS (SELECT *, round((base * 0.75 + relative * 0.35 + 50.0 * 0.05) / (0.75 + 0.35 + 0.05), 4) AS score FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, security_id) AS k, count(*) FILTER (WHERE core) OVER (PARTITION BY month) AS n_core FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY stage, k) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS stage FROM k WHERE n_core >= 8)
 WHERE stage = 4 OR (stage = 1 AND k <= 18 AND held AND base >= 70) OR (stage = 2 AND core) OR (stage = 3 AND core AND sleeve AND score >= 60 AND relative >= 50)),
m AS (SELECT month, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS stages, CAST([] AS BIGINT[]) AS sectors, 0 AS banks, 0 AS outs, 0 AS cores, 0 AS sleeves FROM t GROUP BY 1
 UNION ALL SELECT month, i, CASE WHEN ok THEN list_append(ids, security_id) ELSE ids END, CASE WHEN ok THEN list_append(stages, stage) ELSE stages END, CASE WHEN ok THEN list_append(sectors, sector) ELSE sectors END,
 banks + (ok AND bank)::INT, outs + (ok AND NOT core)::INT, cores + (ok AND core)::INT, sleeves + (ok AND sleeve)::INT
 FROM (SELECT t.*, m.ids, m.stages, m.sectors, m.banks, m.outs, m.cores, m.sleeves, NOT list_contains(m.ids, t.security_id) AND len(list_filter(m.sectors, lambda s: s = t.sector)) < 2 AND (NOT t.bank OR m.banks < 1) AND (t.core OR m.outs < 2)
 AND (t.stage <> 2 OR m.cores < 3) AND (t.stage <> 3 OR m.sleeves = 0) AS ok FROM m JOIN t ON t.month = m.month AND t.i = m.i + 1 WHERE len(m.ids) < 10)),
e AS (SELECT month, arg_max(ids, i) AS ids, arg_max(stages, i) AS stages, arg_max(sectors, i) AS sectors, arg_max(banks, i) AS banks, arg_max(outs, i) AS outs FROM m GROUP BY 1)
SELECT k.month, security_id, CASE WHEN list_contains(ids, security_id) THEN CASE WHEN held THEN 'hold' ELSE 'enter' END WHEN len(list_filter(sectors, lambda s: s = k.sector)) >= 2 THEN 'sector_cap' WHEN bank AND banks >= 1 THEN 'bank_cap'
 WHEN NOT core AND outs >= 2 THEN 'outside_cap' ELSE 'no_slot' END AS action, ['incumbent', 'core', 'sleeve', 'fill'][stages[list_position(ids, security_id)]] AS stage FROM k JOIN e ON e.month = k.month""")
def f3_index_aware(spark, d):
    return ia.select_with_core(core_candidates(spark, d), ["month"], "security_id", "score", CORE_RULES).select("month", "security_id", "action", "stage")


#: Limits of the index-aware queries.
CORE_RULES = ia.CoreRules(slots=10, min_core=3, max_outside=2, window=18, incumbent_base=70.0, sleeve_score=60.0, sleeve_relative=50.0, per_sector=2, banks=1, correlation=0.7)


def core_candidates(spark, d):
    """Each month's candidates of the choice around a core: normalised price blended with the strength against the mean price over three months."""
    m = x.normalize_factor(g.months(spark, d), "price", ["month"], "sector", "base").withColumn("base", r(F.col("base"), 4))
    level = g.months(spark, d).groupBy("month").agg(F.avg("price").alias("level"))
    level = level.withColumn("level_then", F.lag("level", 3).over(Window.orderBy("month")))  # one row a month
    then = g.months(spark, d).select("security_id", "month", F.col("price").alias("now"), F.lag("price", 3).over(s.ordered(K, "month")).alias("then"))
    i = F.col("security_id")
    c = m.join(then, ["security_id", "month"]).join(level, "month").withColumn("relative", r(ia.relative_strength(F.col("then"), F.col("now"), F.col("level_then"), F.col("level")), 4))
    c = c.withColumn("score", ia.blended_score(F.col("base"), F.col("relative"), F.lit(50.0)))
    return c.withColumn("held", i % 7 == 0).withColumn("core", i % 4 != 0).withColumn("bank", i % 10 == 0).withColumn("sleeve", i % 5 == 0)


# Caps on sectors, large ones and a sleeve at once: the tests compare it with a plain loop.
@query("b18_portfolio_caps")
def b18_caps(spark, d):
    c = candidates(spark, d).withColumn("large", F.col("turnover") > 400000).withColumn("sleeve", F.col("security_id") % 10 == 0)
    return sel.choose_under_caps(c, ["month"], "score", "security_id", 15, {"sector": 2}, {"large": 5, "sleeve": 3})


@query("f4_band", f"WITH p AS (SELECT security_id, month, ({_AVG} - 0.5) / {_N} AS p FROM months) SELECT security_id, month, CASE WHEN security_id % 7 = 0 THEN p >= 0.7 ELSE p >= 0.9 END AS belongs FROM p")
def f4(spark, d):
    return g.months(spark, d).select("security_id", "month", sel.band(x.midrank_percentile("price", ["month"]), F.col("security_id") % 7 == 0).alias("belongs"))


@query("f5_turnover_budget", """WITH RECURSIVE k AS (SELECT month, security_id, security_id % 11 = 0 AS forced, round(turnover / 1000, 2) AS amount, row_number() OVER (PARTITION BY month ORDER BY security_id) AS i FROM months),
m AS (SELECT month, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS security_id, CAST(0 AS DOUBLE) AS used, false AS admitted FROM k GROUP BY 1
UNION ALL SELECT k.month, k.i, k.security_id, CASE WHEN k.forced OR m.used + k.amount <= 2000.0 THEN m.used + k.amount ELSE m.used END, k.forced OR m.used + k.amount <= 2000.0 FROM m JOIN k ON k.month = m.month AND k.i = m.i + 1)
SELECT month, security_id, admitted FROM m WHERE i > 0""")
def f5(spark, d):
    m = g.months(spark, d).withColumn("forced", F.col("security_id") % 11 == 0).withColumn("amount", r(F.col("turnover") / 1000, 2))
    return sel.turnover_budget(m, ["month"], "security_id", "amount", "forced", 2000.0)


@query("f6_fund_prefix", f"WITH c AS (SELECT security_id, month, sum(round(turnover, 0)) OVER (PARTITION BY month ORDER BY {_ORD} ROWS UNBOUNDED PRECEDING) AS spent FROM months) SELECT security_id, month, spent, spent <= 500000 AS funded FROM c")
def f6(spark, d):
    out = sel.fund_prefix(g.months(spark, d), ["month"], _order(), F.lit(500000), F.round("turnover", 0))
    return out.select("security_id", "month", "spent", "funded")


@query("f7_top_factors", """SELECT c_custkey, array_to_string(list_transform(list_sort([{'v': -c_acctbal, 'k': 'c_acctbal'}, {'v': -CAST(c_nationkey AS DOUBLE) * 300, 'k': 'nation'}, {'v': -CAST(c_custkey AS DOUBLE), 'k': 'key'}])[1:2], lambda x: x.k), ',') AS top FROM customer""")
def f7(spark, d):
    c = table(spark, d, "customer").withColumn("nation", F.col("c_nationkey") * 300.0).withColumn("key", F.col("c_custkey").cast("double"))
    return c.select("c_custkey", sel.top_factors(["c_acctbal", "nation", "key"], 2).alias("top"))


@query("f8_open_or_top", "SELECT DISTINCT security_id FROM (SELECT s_suppkey AS security_id FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL SELECT security_id FROM (SELECT * FROM securities ORDER BY balance DESC, security_id LIMIT 20))")
def f8(spark, d):
    u = g.securities(spark, d)
    return u.where("security_id % 9 = 0").select("security_id").unionByName(u.orderBy(F.desc("balance"), "security_id").limit(20).select("security_id")).distinct()


@query("f13_mixed_top_n", """WITH a AS (SELECT user_id, event_id, event_type = 'click' AS ev, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts DESC, event_id DESC) AS n, max(CAST(event_type = 'click' AS INT)) OVER (PARTITION BY user_id) AS has_ev, min(CAST(event_type = 'click' AS INT)) OVER (PARTITION BY user_id) AS only_ev FROM events)
SELECT user_id, event_id FROM a WHERE CASE WHEN ev THEN n <= CASE WHEN only_ev = 1 THEN 4 ELSE 1 END ELSE n <= CASE WHEN has_ev = 1 THEN 3 ELSE 4 END END""")
def f13(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "click").alias("ev"))
    n = F.row_number().over(Window.partitionBy("user_id", "ev").orderBy(F.desc("ts"), F.desc("event_id")))
    w = Window.partitionBy("user_id")
    e = e.withColumn("n", n).withColumn("has", F.max(F.col("ev").cast("int")).over(w)).withColumn("only", F.min(F.col("ev").cast("int")).over(w))
    keep = F.when(F.col("ev"), F.col("n") <= F.when(F.col("only") == 1, 4).otherwise(1)).otherwise(F.col("n") <= F.when(F.col("has") == 1, 3).otherwise(4))
    return e.where(keep).select("user_id", "event_id")


@query("f14_persist_selection", """WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal > 7000), n AS (SELECT c_custkey FROM customer WHERE c_nationkey < 8)
SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'add' WHEN n.c_custkey IS NULL THEN 'close' ELSE 'keep' END AS action FROM c FULL JOIN n ON c.c_custkey = n.c_custkey""")
def f14(spark, d):
    c = table(spark, d, "customer")
    return sel.persist_selection(c.where("c_acctbal > 7000"), c.where("c_nationkey < 8"), ["c_custkey"])


@query("g3_key_changes", """WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) v FROM orders GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.v IS DISTINCT FROM b.v""")
def g3(spark, d):
    o = table(spark, d, "orders")
    return sel.key_changes(o.where("o_orderdate < '1998-01-01'"), o, ["o_custkey"], "o_orderpriority")


@query("g4_replace_subset", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_quantity END AS q FROM lineitem WHERE l_orderkey % 5 <> 0 OR l_linenumber = 1")
def g4(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    patch = li.where("l_orderkey % 5 = 0 AND l_linenumber = 1").withColumn("q", F.lit(0.0))
    keys = li.where("l_orderkey % 5 = 0").select("l_orderkey").distinct()
    return li.join(keys, "l_orderkey", "left_anti").unionByName(patch)


@query("g5_partition_check", "SELECT CAST(0 AS BIGINT) AS duplicated, count(*) FILTER (WHERE c_custkey % 10 = 3) AS missing, CAST(0 AS BIGINT) AS unexpected FROM customer")
def g5(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return sel.partition_problems(c.where("c_custkey % 10 <> 3").withColumn("shard", F.col("c_custkey") % 4), c, ["c_custkey"], "shard")


@query("g9_merge_earliest", """WITH u AS (SELECT o_custkey AS k, o_orderdate AS t, o_totalprice AS v, 0 AS p FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderdate, o_totalprice, 1 FROM orders WHERE o_orderstatus = 'O'),
m AS (SELECT k, t, min(v) v, p FROM u GROUP BY k, t, p) SELECT k, t, v, CAST(p AS INT) AS source_position FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, p) n FROM m) WHERE n = 1""")
def g9(spark, d):
    o = table(spark, d, "orders")
    side = lambda st: o.where(F.col("o_orderstatus") == st).groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t")).agg(F.min("o_totalprice").alias("v"))
    return sel.merge_earliest([side("F"), side("O")], ["k"], "t")


@query("g2_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def g2(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("g6_intersect", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def g6(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").intersect(li.where("l_returnflag = 'A'").select("l_partkey"))
