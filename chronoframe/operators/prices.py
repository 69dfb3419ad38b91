"""Prices: adjustment factors, split detection, and agreement between sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import expanding_median, ordered

# The ratios that count as splits, of a price jump, and of a jump of the share count, either way.
PRICE_SPLITS = (4, 3, 2, 1.5, 1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 10, 1 / 20, 1 / 30, 1 / 40, 1 / 50, 1 / 80, 1 / 100)
SHARE_SPLITS = (1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 15.0, 20.0, 25.0, 30.0, 40.0, 50.0, 100.0)
#: How far a ratio may be off, relatively, and how steady share counts must be before and after a split.
PRICE_TOLERANCE, SHARE_TOLERANCE, SHARE_BAND = 0.02, 0.04, 0.15


def back_adjust(df: DataFrame, key: Sequence[str], time: str, price: str, ratio: str, out: str) -> DataFrame:
    """Prices times the product of all later rows' ratios (1 where nothing happens)."""
    later = Window.partitionBy(*key).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.col(price) * F.coalesce(F.exp(F.sum(F.log(ratio)).over(later)), F.lit(1.0)))


def detect_events(df: DataFrame, key: Sequence[str], time: str, price: str, low: float, high: float, max_gap_days: int, grace_rows: int = 0) -> DataFrame:
    """``(key, time, ratio)`` where a price leaves ``[low, high]`` times the one before, within a gap and after a listing's first rows."""
    w = ordered(key, time)
    ratio = F.col(price) / F.lag(price).over(w)
    gap = F.datediff(F.col(time), F.lag(time).over(w))
    seen = df.select(*key, time, ratio.alias("ratio"), gap.alias("_gap"), F.row_number().over(w).alias("_n"))
    return seen.where(((F.col("ratio") < low) | (F.col("ratio") > high)) & (F.col("_gap") <= max_gap_days) & (F.col("_n") > grace_rows)).select(*key, time, "ratio")


def nearest_split_ratio(observed: Column, ratios: Sequence[float] = PRICE_SPLITS, tolerance: float = PRICE_TOLERANCE, either_way: bool = False) -> Column:
    """The one of ``ratios`` (or, ``either_way``, of their inverses) nearest to ``observed`` within a relative tolerance, else null."""
    known = [float(v) for x in ratios for v in ((x, 1 / x) if either_way else (x,))]
    errors = F.transform(F.array(*map(F.lit, known)), lambda v: F.struct(F.abs(observed / v - 1).alias("e"), v.alias("r")))
    # one array that is looked at once: an expression a ratio makes methods too long for the JVM to compile
    near = F.filter(F.array(F.array_min(errors)), lambda best: (observed > 0) & (best["e"] <= tolerance))
    return F.get(near, F.lit(0))["r"]


def split_candidates(
    df: DataFrame, key: Sequence[str], time: str, raw: str, adjusted: str, volume: str, jump: float = 0.25, flat: float = 0.05, volume_factor: float = 1.5,
    ratios: Sequence[float] = PRICE_SPLITS, tolerance: float = PRICE_TOLERANCE, max_gap_days: int | None = None,
) -> DataFrame:
    """``(key, time, ratio)``: raw jumps near a known ratio where the adjusted series is flat, far from the raw one, and volume is high for its past.

    The past is all bars before, whose median :func:`~chronoframe.operators.series.expanding_median` keeps up to date.
    With ``max_gap_days`` only where the bar before is no further away.
    """
    w = ordered(key, time)
    step, own = F.col(raw) / F.lag(raw).over(w), F.col(adjusted) / F.lag(adjusted).over(w)
    c = df.repartition(*(F.col(k) for k in key)).select(
        *key, time, F.col(volume).alias("_volume"), step.alias("_s"), own.alias("_a"), (F.lag(raw).over(w) / F.col(raw)).alias("_o"), F.datediff(F.col(time), F.lag(time).over(w)).alias("_gap"),
    )
    c = expanding_median(c, key, time, "_volume", "_median", placed=True)
    c = c.where((F.abs(F.lit(1.0) / F.col("_o") - 1) > jump) & (F.abs(F.col("_a") - 1) <= flat) & (F.abs(F.col("_s") - F.col("_a")) > jump) & (F.col("_volume") / F.col("_median") >= volume_factor))
    if max_gap_days is not None:
        c = c.where(F.col("_gap") <= max_gap_days)
    return c.withColumn("ratio", nearest_split_ratio(F.col("_o"), ratios, tolerance)).where("ratio IS NOT NULL").select(*key, time, "ratio")


def anchored_factors(prices: DataFrame, actions: DataFrame, key: Sequence[str], session: str, effective: str, known: str, ratio: str, resolved: str, anchor: Column, as_of: Column) -> DataFrame:
    """``(key, session, factor)``: product of the ratios of actions after a session up to the anchor, known by ``as_of``.

    A factor with an unresolved action in it is null. Actions are few per key; prices meet those of their key.
    """
    usable = actions.where((F.col(effective) <= anchor) & (F.col(known) <= as_of)).select(*key, F.col(effective).alias("_e"), F.col(ratio).alias("_r"), F.col(resolved).alias("_ok"))
    per_day = usable.groupBy(*key, "_e").agg(F.product("_r").alias("_r"), F.bool_and("_ok").alias("_ok"))
    own = prices.where(F.col(session) <= anchor).select(*key, F.col(session).alias("_e"), F.lit(True).alias("_price"))
    both = own.withColumn("_r", F.lit(1.0)).withColumn("_ok", F.lit(True)).unionByName(per_day.withColumn("_price", F.lit(False)))
    later = Window.partitionBy(*key).orderBy(F.col("_e").desc(), F.col("_price").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # an action on the session itself does not apply to it: prices of a day sort before that day's actions
    run = both.withColumn("_p", F.sum(F.log("_r")).over(later)).withColumn("_bad", F.max((~F.col("_ok")).cast("int")).over(later))
    return run.where("_price").select(*key, F.col("_e").alias(session), F.when(F.col("_bad") == 0, F.exp("_p")).alias("factor"))


def cumulative_split_factor(actions: DataFrame, key: Sequence[str], day: str, ratio: str) -> DataFrame:
    """``(key, day, factor)``: the product of all ratios up to each action's day; joined as of a date it gives F(d)."""
    per_day = actions.groupBy(*key, day).agg(F.product(ratio).alias("_r"))
    upto = ordered(key, day).rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select(*key, day, F.exp(F.sum(F.log("_r")).over(upto)).alias("factor"))


def inferred_splits(shares: DataFrame, key: Sequence[str], time: str, value: str, ratios: Sequence[float] = SHARE_SPLITS, tolerance: float = SHARE_TOLERANCE, band: float = SHARE_BAND) -> DataFrame:
    """``(key, time, ratio)``: share counts that jump by a known ratio between levels that are steady on both sides.

    A count must follow the jump; before it, one count alone is steady.
    """
    w = ordered(key, time)
    now, before, before2, after = F.col(value), F.lag(value, 1).over(w), F.lag(value, 2).over(w), F.lead(value, 1).over(w)
    stable = (before2.isNull() | (F.abs(before / before2 - 1) <= band)) & after.isNotNull() & (F.abs(after / now - 1) <= band)
    c = shares.where(F.col(value) > 0).select(*key, time, nearest_split_ratio(now / before, ratios, tolerance, either_way=True).alias("ratio"), stable.alias("_ok"))
    return c.where(F.col("_ok") & F.col("ratio").isNotNull()).select(*key, time, "ratio")


def reconcile_actions(obs: DataFrame, key: Sequence[str], source: str, value: str, currency: str, tolerance: float = 0.01, least_sources: int = 2) -> DataFrame:
    """One row per action: its mean value, number of sources, and status (confirmed, single_source, conflict)."""
    g = obs.groupBy(*key).agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"), F.avg(value).alias("value"), F.count_distinct(source).alias("sources"), F.count_distinct(currency).alias("_cur"))
    agree = (F.col("_hi") - F.col("_lo") <= tolerance * F.abs("_hi")) & (F.col("_cur") <= 1)
    status = F.when(~agree, "conflict").when(F.col("sources") >= least_sources, "confirmed").otherwise("single_source")
    return g.select(*key, F.when(agree, F.col("value")).alias("value"), "sources", status.alias("status"))


def basis_drift(samples: DataFrame, stored: str, vendor: str, tolerance: float) -> DataFrame:
    """Samples whose stored and vendor values differ relatively by more than ``tolerance``."""
    error = F.abs(F.col(stored) / F.col(vendor) - 1)
    return samples.withColumn("error", error).where(error > tolerance)


def adjustment_drift(prices: DataFrame, vendor: DataFrame, key: Sequence[str], time: str, stored: str, adjusted: str, tolerance: float) -> DataFrame:
    """``(key, ratio)``: keys whose stored adjusted close at their earliest common date is off the vendor's."""
    both = prices.select(*key, time, stored).join(vendor.select(*key, time, adjusted), [*key, time])
    first = both.groupBy(*key).agg(F.min_by(F.col(stored) / F.col(adjusted), time).alias("ratio"))
    return first.where(F.abs(F.col("ratio") - 1) > tolerance)
