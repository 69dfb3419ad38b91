"""Series by entity: moving windows, recursive folds, streaks, drawdowns and returns."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: Sequence[str], time: str):
    return Window.partitionBy(*key).orderBy(time)


def last_n(key: Sequence[str], time: str, n: int):
    return ordered(key, time).rowsBetween(-(n - 1), 0)


def full_window(value: Column, agg: Callable[[Column], Column], key: Sequence[str], time: str, n: int) -> Column:
    """``agg`` over the last ``n`` rows; null until there are ``n`` values."""
    w = last_n(key, time, n)
    return F.when(F.count(value).over(w) == n, agg(value).over(w))


def sma(value: str, key: Sequence[str], time: str, n: int) -> Column:
    return full_window(F.col(value), F.avg, key, time, n)


def expanding_median(df: DataFrame, key: Sequence[str], time: str, value: str, out: str, placed: bool = False) -> DataFrame:
    """``df`` with the median of ``value`` over all rows of the key before each in ``out``; null where there is none.

    Nulls and NaN count for nothing. Rows pass in order of time, in Arrow batches: the values so far lie in two heaps, the lower half and
    the upper, so that a row costs the logarithm of the rows before it, and a task holds the values of one key
    (some 60 bytes each), not its rows. Rows of equal time are in no particular order. ``placed`` says that
    rows of a key already lie in one partition, so that none are shuffled.
    """
    keys = list(key)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, low, high = None, [], []  # low holds negated values
        for pdf in batches:
            found = np.full(len(pdf), np.nan)
            values = pdf["_value"].to_numpy(dtype=float, na_value=np.nan).tolist()
            for n, (k, v) in enumerate(zip(pdf[keys].itertuples(index=False, name=None), values, strict=True)):
                k = tuple(None if pd.isna(x) else x for x in k)
                if k != now:
                    now, low, high = k, [], []
                if low:
                    found[n] = -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2
                if v == v:
                    heapq.heappush(high, -heapq.heappushpop(low, -v))
                    if len(high) > len(low):
                        heapq.heappush(low, -heapq.heappop(high))
            yield pdf.drop(columns="_value").assign(**{out: pd.array(found, dtype="Float64")})

    rows = df.drop(out).withColumn("_value", F.col(value).cast("double"))
    rows = rows if placed else rows.repartition(*(F.col(k) for k in keys))
    types = df.drop(out).schema.add(out, "double")
    return rows.sortWithinPartitions(*keys, time).mapInPandas(walk, types).withColumn(out, F.when(~F.isnan(out), F.col(out)))


def simple_return(value: str, key: Sequence[str], time: str, lag: int = 1) -> Column:
    return F.col(value) / F.lag(value, lag).over(ordered(key, time)) - 1


def log_return(value: str, key: Sequence[str], time: str) -> Column:
    return F.log(F.col(value) / F.lag(value).over(ordered(key, time)))


def momentum(value: str, key: Sequence[str], time: str, skip: int = 21, back: int = 252) -> Column:
    w = ordered(key, time)
    return F.lag(value, skip).over(w) / F.lag(value, back).over(w) - 1


def true_range(high: str, low: str, close: str, key: Sequence[str], time: str) -> Column:
    before = F.lag(close).over(ordered(key, time))
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def bollinger_position(value: str, key: Sequence[str], time: str, n: int = 20, width: float = 2.0) -> Column:
    """Place within the band of population deviations: 0 at the lower edge, 1 at the upper."""
    mean, sd = sma(value, key, time, n), full_window(F.col(value), F.stddev_pop, key, time, n)
    return F.when(sd > 0, (F.col(value) - (mean - width * sd)) / (2 * width * sd))


def on_balance_volume(close: str, volume: str, key: Sequence[str], time: str) -> Column:
    """Volume summed with the sign of the change; a two-step expression needs the change as a column."""
    return F.sum(F.signum(F.coalesce(F.col("_change"), F.lit(0.0))) * F.col(volume)).over(ordered(key, time).rowsBetween(Window.unboundedPreceding, 0))


def with_obv(df: DataFrame, close: str, volume: str, key: Sequence[str], time: str, out: str = "obv") -> DataFrame:
    df = df.withColumn("_change", F.col(close) - F.lag(close).over(ordered(key, time)))
    return df.withColumn(out, on_balance_volume(close, volume, key, time)).drop("_change")


def range_position(value: str, key: Sequence[str], time: str, n: int = 252) -> Column:
    w = last_n(key, time, n)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low))


def volume_ratio(volume: str, key: Sequence[str], time: str, short: int = 20, long: int = 60) -> Column:
    return sma(volume, key, time, short) / sma(volume, key, time, long)


def annualized_volatility(ret: str, key: Sequence[str], time: str, n: int = 252, periods: int = 252, sample: bool = True) -> Column:
    return full_window(F.col(ret), F.stddev_samp if sample else F.stddev_pop, key, time, n) * F.sqrt(F.lit(float(periods)))


def drawdown(value: str, key: Sequence[str], time: str) -> Column:
    peak = F.max(value).over(ordered(key, time).rowsBetween(Window.unboundedPreceding, 0))
    return F.col(value) / peak - 1


def month_ends(df: DataFrame, key: Sequence[str], time: str, value: str) -> DataFrame:
    """``(key, month, time, value)``: the last value of each month."""
    month = F.date_trunc("month", F.col(time)).cast("date")
    return df.groupBy(*key, month.alias("month")).agg(F.max(time).alias(time), F.max_by(value, time).alias(value))


def hysteresis(df: DataFrame, key: Sequence[str], time: str, on: Column, off: Column, out: str) -> DataFrame:
    """True from where ``on`` holds until ``off`` does; between both it stays as it was; null before the first."""
    state = F.when(on, True).when(off, False)
    return df.withColumn("_s", state).withColumn(out, F.last("_s", ignorenulls=True).over(ordered(key, time).rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def streaks(df: DataFrame, key: Sequence[str], time: str, bucket: str, out: str = "streak") -> DataFrame:
    """Length so far of the run of equal buckets that each row ends."""
    w = ordered(key, time)
    marked = df.withColumn("_new", (~F.col(bucket).eqNullSafe(F.lag(bucket).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn(out, F.row_number().over(Window.partitionBy(*key, "_island").orderBy(time))).drop("_new", "_island")


def after_last_reset(df: DataFrame, key: Sequence[str], time: str, reset: Column) -> DataFrame:
    """Rows from each key's latest reset on; all rows of a key without one."""
    at = F.max(F.when(reset, F.col(time))).over(Window.partitionBy(*key))
    return df.withColumn("_at", at).where(F.col("_at").isNull() | (F.col(time) >= F.col("_at"))).drop("_at")


def forward_fill(value: str, key: Sequence[str], time: str) -> Column:
    return F.last(value, ignorenulls=True).over(ordered(key, time).rowsBetween(Window.unboundedPreceding, 0))


def cumulative_product(value: Column, key: Sequence[str], time: str) -> Column:
    """Product of positive values up to the row, by sums of logs."""
    return F.exp(F.sum(F.log(value)).over(ordered(key, time).rowsBetween(Window.unboundedPreceding, 0)))


def look_back_return(value: str, key: Sequence[str], time: str, bars: int) -> Column:
    """Return over the last ``bars`` bars, which is a lag of one less; from the first bar if there are fewer."""
    w = ordered(key, time)
    base = F.coalesce(F.lag(value, bars - 1).over(w), F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return F.col(value) / base - 1


def fold(df: DataFrame, key: Sequence[str], time: str, values: Sequence[str], start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column], out: str) -> DataFrame:
    """One result a key from a recursive pass over its rows in order of time, inside the JVM.

    For series of a few thousand points a key; ``step(state, row)`` sees the row's ``values``.
    """
    rows = F.array_sort(F.collect_list(F.struct(time, *values)))
    return df.groupBy(*key).agg(rows.alias("_rows")).select(*key, F.aggregate("_rows", start, step, finish).alias(out))


def wilder(change_up: str, df: DataFrame, key: Sequence[str], time: str, period: int, out: str) -> DataFrame:
    """Wilder's smoothing of a column at each key's last row: the mean of the first ``period`` values, then 1/period steps."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"))

    def step(a: Column, x: Column) -> Column:
        v = x[change_up]
        grown = F.when(a["n"] < period, a["s"] + v / period).otherwise((a["s"] * (period - 1) + v) / period)
        return F.when(v.isNull(), a).otherwise(F.struct((a["n"] + 1).alias("n"), grown.alias("s")))

    return fold(df, key, time, [change_up], start, step, lambda a: F.when(a["n"] >= period, a["s"]), out)


def rsi(df: DataFrame, close: str, key: Sequence[str], time: str, period: int = 14, out: str = "rsi") -> DataFrame:
    """Relative strength by Wilder's smoothing; 100 where nothing fell, null until ``period`` changes are there."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(None).cast("double").alias("last"))

    def step(a: Column, x: Column) -> Column:
        d = x[close] - a["last"]
        up, down = F.greatest(d, F.lit(0.0)), F.greatest(-d, F.lit(0.0))
        mix = lambda old, v: F.when(a["n"] < period, old + v / period).otherwise((old * (period - 1) + v) / period)
        first = F.struct(a["n"].alias("n"), a["up"].alias("up"), a["down"].alias("down"), x[close].alias("last"))
        return F.when(a["last"].isNull(), first).otherwise(F.struct((a["n"] + 1).alias("n"), mix(a["up"], up).alias("up"), mix(a["down"], down).alias("down"), x[close].alias("last")))

    value = lambda a: F.when(a["n"] < period, None).when(a["down"] == 0, 100.0).otherwise(100 - 100 / (1 + a["up"] / a["down"]))
    return fold(df, key, time, [close], start, step, value, out)


def ema(df: DataFrame, value: str, key: Sequence[str], time: str, period: int, out: str = "ema") -> DataFrame:
    """Exponential mean at each key's last row, seeded by the mean of the first ``period`` values."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"))
    k = 2.0 / (period + 1)

    def step(a: Column, x: Column) -> Column:
        grown = F.when(a["n"] < period, a["s"] + x[value] / period).otherwise(x[value] * k + a["s"] * (1 - k))
        return F.struct((a["n"] + 1).alias("n"), grown.alias("s"))

    return fold(df, key, time, [value], start, step, lambda a: F.when(a["n"] >= period, a["s"]), out)


def ewm(df: DataFrame, value: str, key: Sequence[str], time: str, alpha: float, out: str = "ewm") -> DataFrame:
    """Exponential mean at each key's last row that starts at the first value."""
    start = F.lit(None).cast("double")
    return fold(df, key, time, [value], start, lambda a, x: F.when(a.isNull(), x[value]).otherwise(alpha * x[value] + (1 - alpha) * a), lambda a: a, out)


def state_machine(df: DataFrame, key: Sequence[str], time: str, raw: str, out: str, confirm: int = 3, cooldown_days: int = 10) -> DataFrame:
    """The state of each key after its last day: one rung toward ``raw`` at a time.

    A move needs ``confirm`` days in a row whose raw level lies on the same side of the state, and
    ``cooldown_days`` calendar days since the last move.
    """
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("run"), F.lit(0).alias("side"), F.lit(None).cast("date").alias("moved"))

    def step(a: Column, x: Column) -> Column:
        side = F.signum((x[raw] - a["state"]).cast("double")).cast("int")
        run = F.when(side == 0, 0).when(side == a["side"], a["run"] + 1).otherwise(1)
        rested = a["moved"].isNull() | (F.datediff(x[time], a["moved"]) >= cooldown_days)
        moves = (side != 0) & (run >= confirm) & rested
        return F.struct(
            (a["state"] + F.when(moves, side).otherwise(0)).alias("state"), F.when(moves, 0).otherwise(run).cast("int").alias("run"),
            F.when(moves, 0).otherwise(side).cast("int").alias("side"), F.when(moves, x[time]).otherwise(a["moved"]).alias("moved"),
        )

    return fold(df, key, time, [raw], start, step, lambda a: a["state"], out)
