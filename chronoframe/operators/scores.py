"""Domain scores as column expressions: value, quality, peers, technicals, regimes, and the alpha scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import linear_scale, peg_score
from .cross_section import ordinal_percentile, rank_share, weighted_mean


def quality_subscores(df: DataFrame, key: Sequence[str], period: str, level: str, margin: str, points: int = 5) -> DataFrame:
    """``(key, level_score, steady_score, margin_score, combined)`` from the last points of each key."""
    from pyspark.sql import Window

    last = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(period)))).where(F.col("_r") <= points)
    g = last.groupBy(*key).agg(F.avg(level).alias("_l"), F.try_divide(F.stddev_pop(level), F.abs(F.avg(level))).alias("_s"), F.avg(margin).alias("_m"), F.count("*").alias("_n"))
    level_score, steady = linear_scale(F.col("_l"), 0, 400_000), F.when(F.col("_n") >= 3, linear_scale(F.col("_s"), 1.0, 0.0))
    margin_score = linear_scale(F.col("_m"), 0, 200_000)
    return g.select(*key, level_score.alias("level_score"), steady.alias("steady_score"), margin_score.alias("margin_score"), weighted_mean([(level_score, 0.4), (steady, 0.3), (margin_score, 0.3)]).alias("combined"))


def growth_at_price(pe: Column, growth: Column) -> tuple[Column, Column, Column]:
    """PEG, its score, and the category of a growth rate."""
    peg = F.when((pe > 0) & (growth > 0), pe / (growth * 100))
    category = F.when(growth.isNull(), None).when(growth >= 0.2, "fast").when(growth >= 0.1, "stalwart").when(growth >= 0, "slow").otherwise("declining")
    return peg, peg_score(peg), category


#: The yield that scores 100, the years looked back, and the weights of yield and steadiness.
FULL_YIELD, DIVIDEND_YEARS, YIELD_WEIGHT = 0.08, 5, 0.6


def dividend_score(actions: DataFrame, prices: DataFrame, key: Sequence[str], day: str, amount: str, session: str, close: str, at: Column) -> DataFrame:
    """``(key, paid, paying_years, score)`` of keys that paid within the years before ``at``; 0..100.

    The yield is the last 365 days' payments over the latest positive close; without one it scores 0.
    Steadiness is the share of the calendar years with a payment. Two groupings and a join on the key.
    """
    days = DIVIDEND_YEARS * 365 + 1
    recent = actions.where((F.col(amount) > 0) & (F.col(day) <= at) & (F.datediff(at, day) <= days))
    paid = recent.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(F.datediff(at, day) <= 365, F.col(amount))), F.lit(0.0)).alias("paid"),
        F.count_distinct(F.when(F.year(day) >= F.year(at) - DIVIDEND_YEARS, F.year(day))).alias("paying_years"),
    )
    last = prices.where((F.col(session) <= at) & (F.col(close) > 0)).groupBy(*key).agg(F.max_by(close, session).alias("_close"))
    share = F.coalesce(linear_scale(F.col("paid") / F.col("_close"), 0, FULL_YIELD), F.lit(0.0))
    steady = F.least(F.lit(100.0), F.col("paying_years") / DIVIDEND_YEARS * 100)
    return paid.join(last, list(key), "left").select(*key, "paid", "paying_years", (YIELD_WEIGHT * share + (1 - YIELD_WEIGHT) * steady).alias("score"))


def yield_and_return(ebit: Column, value: Column, capital: Column) -> tuple[Column, Column]:
    """Earnings yield and return on capital; null over a denominator that is not positive."""
    return F.when(value > 0, ebit / value), F.when(capital > 0, ebit / capital)


def hybrid_peer_score(df: DataFrame, part: Sequence[str], metric: str, tie: str, floor: float, ceiling: float, out: str, peer: float = 0.4) -> DataFrame:
    """An absolute scale and an ordinal peer percentile, blended."""
    absolute = linear_scale(F.col(metric), floor, ceiling)
    return df.withColumn(out, weighted_mean([(absolute, 1 - peer), (ordinal_percentile(metric, part, tie), peer)]))


def peer_rank_score(df: DataFrame, part: Sequence[str], metrics: Sequence[tuple[str, float, bool]], out: str) -> DataFrame:
    """Weighted mean of rank shares times 100; a metric that is better when low is ranked downward."""
    return df.withColumn(out, weighted_mean([(rank_share(m, part, up) * 100, w) for m, w, up in metrics]))


def trend_label(price: Column, fast: Column, slow: Column) -> Column:
    return F.when(slow.isNull(), None).when((price > slow) & (fast > slow), "up").when((price < slow) & (fast < slow), "down").otherwise("flat")


def technical_blend(above: Column, rsi: Column, volume: Column) -> tuple[Column, Column]:
    """Mean of the signals that are there, 0..100, and their number."""
    parts = [(F.when(above.isNotNull(), F.when(above, 100.0).otherwise(0.0)), 0.4), (linear_scale(F.abs(rsi - 50), 50, 0), 0.3), (linear_scale(volume, 0.5, 1.5), 0.3)]
    return weighted_mean(parts), sum((p.isNotNull().cast("int") for p, _ in parts), F.lit(0))


def confidence(coverage: Column, peers: Column, full_peers: int = 20) -> Column:
    """0..1: three fifths coverage, two fifths peers."""
    return 0.6 * coverage + 0.4 * F.least(F.lit(1.0), peers / full_peers)


def calibrated(base: Column, trust: Column, overlay: Column, investable: Column) -> Column:
    """A score drawn to 50 by lack of trust, moved by an overlay, scaled by investability, within 0..100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (50 + (base - 50) * trust + overlay) * investable))


def risk_grade(volatility: Column, leverage: Column) -> tuple[Column, Column]:
    """A grade by annual volatility, and the class of decay of a leveraged fund."""
    grade = F.when(volatility.isNull(), None).when(volatility < 0.15, "low").when(volatility < 0.3, "medium").when(volatility < 0.6, "high").otherwise("extreme")
    decay = F.when(leverage <= 1, "none").when(leverage * leverage * volatility * volatility < 0.5, "moderate").otherwise("severe")
    return grade, decay


def relative_strength(own: Column, bench: Column) -> Column:
    """An excess return on 0..100; 50 means even."""
    return linear_scale(own - bench, -0.5, 0.5)


def idle_return(then: Column, now: Column, rate: Column, days: Column) -> Column:
    """A commodity's move if both prices are there, else a yearly rate for the days."""
    return F.coalesce(F.when(then > 0, now / then - 1), rate * days / 365)


def owner_earnings(net: Column, depreciation: Column, capex: Column, sales: Column, ppe_share: Column, prior_sales: Column) -> Column:
    """Earnings plus depreciation less the capital spending that growth does not explain."""
    growth = F.greatest(sales - prior_sales, F.lit(0.0)) * ppe_share
    maintenance = F.greatest(F.lit(0.0), F.least(capex, capex - growth))
    return net + depreciation - F.coalesce(maintenance, capex)


def stale_from(changes: DataFrame, cache: DataFrame, key: Sequence[str], visible: str, date: str, version: str) -> DataFrame:
    """``cache`` with versions nulled from each key's earliest changed visibility on."""
    first = changes.groupBy(*key).agg(F.min(visible).alias("_v"))
    out = cache.join(first, list(key), "left")
    return out.withColumn(version, F.when(F.col("_v").isNull() | (F.col(date) < F.col("_v")), F.col(version))).drop("_v")
