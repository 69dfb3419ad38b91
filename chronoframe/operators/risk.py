"""Risk and performance: moments, betas, correlations, NAV metrics, ledgers, sizing, and resampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

from ..storage import materialise
from .series import ordered
from .skew import small


def tail_risk(df: DataFrame, key: Sequence[str], ret: str, share: float = 0.05) -> DataFrame:
    """``(key, n, worst, downside, cvar)``: worst return, root mean square of losses, mean of the worst share (one row at least)."""
    w = Window.partitionBy(*key)
    ranked = df.where(F.col(ret).isNotNull()).withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(ret)))
    tail = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    g = ranked.groupBy(*key)
    return g.agg(F.count("*").alias("n"), F.min(ret).alias("worst"), F.sqrt(F.avg(F.pow(F.least(ret, F.lit(0.0)), F.lit(2)))).alias("downside"), F.avg(F.when(F.col("_r") <= tail, F.col(ret))).alias("cvar"))


def sample_moments(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis from the population moments; null under 3 and 4 values."""
    n = F.count(value)
    skew = F.when(n >= 3, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n >= 4, ((n + 1) * F.kurtosis(value) + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return df.groupBy(*key).agg(n.alias("n"), skew.alias("skew"), kurt.alias("kurtosis"))


def beta(df: DataFrame, benchmark: DataFrame, key: Sequence[str], time: str, ret: str, bench_ret: str) -> DataFrame:
    """``(key, n, beta, alpha)`` of returns against a benchmark's on common dates; the benchmark is one series by date."""
    both = df.join(benchmark, time).where(F.col(ret).isNotNull() & F.col(bench_ret).isNotNull())
    return both.groupBy(*key).agg(F.count("*").alias("n"), F.try_divide(F.covar_samp(ret, bench_ret), F.var_samp(bench_ret)).alias("beta"), F.avg(F.col(ret) - F.col(bench_ret)).alias("alpha"))


#: Series of a block; the pairs of two blocks are counted together, so a task holds this number squared at a time.
PAIR_BLOCK = 1024


def _instant(column: str, kind: DataType) -> Column:
    """A time as a number where it is a date or a timestamp: the same order and equality, cheaper to hand over."""
    if isinstance(kind, DateType):
        return F.unix_date(column)
    return F.unix_micros(F.col(column).cast("timestamp")) if isinstance(kind, TimestampType | TimestampNTZType) else F.col(column)


def series_rows(df: DataFrame, key: str, time: str, ret: str, within: Sequence[str] = ()) -> DataFrame:
    """``(within, key, _times, _counts, _sums, _spreads)``: a row a series, with arrays by time of its values' number, sum and squared deviations; nulls give none."""
    known = df.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(ret).isNotNull())
    for c in within:
        known = known.where(F.col(c).isNotNull())
    value = F.col(ret).cast("double")
    cells = known.groupBy(*within, key, time).agg(F.count("*").alias("_c"), F.sum(value).alias("_s"), (F.var_pop(value) * F.count("*")).alias("_v"))
    listed = F.collect_list(F.struct(_instant(time, df.schema[time].dataType).alias("t"), "_c", "_s", "_v"))
    return cells.groupBy(*within, key).agg(listed.alias("_l")).select(*within, key, F.col("_l.t").alias("_times"), F.col("_l._c").alias("_counts"), F.col("_l._s").alias("_sums"), F.col("_l._v").alias("_spreads"))


def dense_series(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of :func:`series_rows` as matrices, a row a series and a column a time: numbers, sums, squared deviations."""
    sizes = pdf["_times"].map(len).to_numpy()
    times, at = np.unique(np.concatenate(pdf["_times"].tolist()), return_inverse=True)
    row = np.repeat(np.arange(len(pdf)), sizes)
    out = np.zeros((3, len(pdf), len(times)))
    for m, c in zip(out, ("_counts", "_sums", "_spreads"), strict=True):
        m[row, at] = np.concatenate(pdf[c].tolist())
    return tuple(out)


def cross_correlations(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """``(n, corr)`` of each series of ``a`` with each of ``b`` on common times; NaN where a value is, where one does not vary, or under ``least``.

    The sums of all pairs are products of matrices of values about each series' own mean. Where a pair's variance is so
    small beside these sums that digits are lost, it is taken again from the values about the pair's own mean.
    """

    def centred(x):
        c, s, v = x
        bad = (c > 0) & ~np.isfinite(s + v)
        mean = np.where(bad, 0.0, s).sum(axis=1) / np.maximum(np.where(bad, 0.0, c).sum(axis=1), 1)
        s = np.where(bad, 0.0, s - c * mean[:, None])
        return c, s, np.where(bad, 0.0, v) + np.divide(s * s, c, out=np.zeros_like(s), where=c > 0), bad

    (ca, sa, qa, bad_a), (cb, sb, qb, bad_b) = centred(a), centred(b)
    n, x, y, xy, xx, yy = ca @ cb.T, sa @ cb.T, ca @ sb.T, sa @ sb.T, qa @ cb.T, ca @ qb.T
    enough = n >= max(least, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = xx - x * x / n, yy - y * y / n
        corr = (xy - x * y / n) / np.sqrt(vx * vy)
    doubtful = np.argwhere(enough & ((vx <= 1e-6 * xx) | (vy <= 1e-6 * yy)))
    for at in range(0, len(doubtful), 1 + (1 << 20) // ca.shape[1]):
        i, j = doubtful[at : at + 1 + (1 << 20) // ca.shape[1]].T

        def own(m, of, other):
            c, s, v = (z[of] for z in m)
            weight = c * other
            level = np.divide(s, c, out=np.zeros_like(s), where=c > 0)
            first = level[np.arange(len(of)), (weight > 0).argmax(axis=1)]
            level = np.where(weight > 0, level - first[:, None], 0.0)
            level = np.where(weight > 0, level - ((level * weight).sum(axis=1) / weight.sum(axis=1))[:, None], 0.0)
            return level, (weight * level * level).sum(axis=1) + (v * other).sum(axis=1)

        with np.errstate(divide="ignore", invalid="ignore"):
            (dx, ex), (dy, ey) = own(a, i, b[0][j]), own(b, j, a[0][i])
            corr[i, j] = (a[0][i] * b[0][j] * dx * dy).sum(axis=1) / np.sqrt(ex * ey)
    if bad_a.any() or bad_b.any():
        corr[(bad_a.astype(float) @ (cb > 0).T + (ca > 0).astype(float) @ bad_b.T) > 0] = np.nan
    return n, np.where(enough, np.clip(corr, -1.0, 1.0), np.nan)


def pair_correlations(df: DataFrame, key: str, time: str, ret: str, least: int, within: Sequence[str] = (), block: int = PAIR_BLOCK) -> DataFrame:
    """``(a, b, n, corr)`` of all pairs of series, on common dates; with ``within``, of pairs alike in these columns.

    The pairs' common dates are never rows: series are cut into blocks, each block meets each of its group once, and a
    task takes the pairs of two blocks by products of matrices. What is shuffled is the series, as often as its group has blocks;
    what is returned grows with the pairs. ``corr`` is NaN where a series does not vary. Pairs of series both of whose columns
    ``within`` change with time can meet in several groups; these alone are joined by date.
    """
    series = materialise(series_rows(df, key, time, ret, within), "pair-series")
    moving = series.groupBy(key).agg(F.count("*").alias("_groups")).where("_groups > 1").select(key, F.lit(True).alias("_moves")) if within else None
    if moving is not None and moving.isEmpty():
        moving = None
    number = series.groupBy(*within).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")) if within else series.agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    placed = series.join(number, list(within)) if within else series.crossJoin(F.broadcast(number))  # one row
    placed = placed if moving is None else placed.join(moving, key, "left")
    own = placed.withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    met = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select(key, "_times", "_counts", "_sums", "_spreads", "_own", *(["_moves"] if moving is not None else []), *within, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    kind, some_move = df.schema[key].dataType.simpleString(), moving is not None

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        c, s, v = dense_series(pdf)
        ids, own = pdf[key].to_numpy(), pdf["_own"].to_numpy()
        left, right = np.flatnonzero(own == pdf["_i"].iloc[0]), np.flatnonzero(own == pdf["_j"].iloc[0])
        n, corr = cross_correlations((c[left], s[left], v[left]), (c[right], s[right], v[right]), least)
        keep = n >= least
        if pdf["_i"].iloc[0] == pdf["_j"].iloc[0]:
            keep &= left[:, None] < right[None, :]
        if some_move:
            moves = pdf["_moves"].eq(True).to_numpy()
            keep &= ~(moves[left][:, None] & moves[right][None, :])
        i, j = np.nonzero(keep)
        lo, hi = np.minimum(left[i], right[j]), np.maximum(left[i], right[j])
        return pd.DataFrame({"a": ids[lo], "b": ids[hi], "n": n[i, j].astype("int64"), "corr": corr[i, j]})

    spread = met.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *within, "_i", "_j")
    out = spread.groupBy(*within, "_i", "_j").applyInPandas(pairs, f"a {kind}, b {kind}, n long, corr double")
    out = out.withColumn("corr", F.coalesce("corr", F.lit(float("nan"))))  # pandas hands NaN back as null
    if moving is None:
        return out
    rows = df.where(F.col(ret).isNotNull()).join(moving, key)
    side = lambda n: rows.select(F.col(key).alias(n), time, *within, F.col(ret).alias(f"_{n}"))
    both = side("a").join(side("b"), [time, *within]).where("a < b").groupBy("a", "b")
    flat = (F.min("_a") == F.max("_a")) | (F.min("_b") == F.max("_b"))
    terms = both.agg(F.count("*").alias("n"), F.covar_pop("_a", "_b").alias("_ab"), F.var_pop("_a").alias("_aa"), F.var_pop("_b").alias("_bb"), flat.alias("_flat"))
    corr = F.when(~F.col("_flat"), F.try_divide("_ab", F.sqrt(F.col("_aa") * F.col("_bb")))).otherwise(F.lit(float("nan")))
    return out.unionByName(terms.where(F.col("n") >= least).select("a", "b", "n", corr.alias("corr")))


def log_growth(df: DataFrame, key: Sequence[str], time: str, value: str) -> DataFrame:
    """``(key, growth)``: slope of the log of positive values, as a rate."""
    return df.where(F.col(value) > 0).groupBy(*key).agg(F.count("*").alias("n"), (F.exp(F.regr_slope(F.log(value), F.col(time))) - 1).alias("growth"))


def relative_trend(df: DataFrame, key: Sequence[str], time: str, value: str, points: int = 5) -> DataFrame:
    """Slope over the last points, relative to their mean size."""
    last = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(time)))).where(F.col("_r") <= points)
    return last.groupBy(*key).agg((F.regr_slope(F.col(value), F.col(time).cast("double")) / F.avg(F.abs(value))).alias("trend"))


def geometric_growth(df: DataFrame, key: Sequence[str], growth: str) -> DataFrame:
    """Geometric mean of growth rates; -1 if one of them is a total loss."""
    ok = F.min(growth) > -1
    return df.groupBy(*key).agg(F.when(ok, F.exp(F.avg(F.log(F.when(F.col(growth) > -1, 1 + F.col(growth))))) - 1).otherwise(-1.0).alias("growth"))


def nav_metrics(nav: DataFrame, key: Sequence[str], time: str, value: str, periods: int) -> DataFrame:
    """``(key, n, total, volatility, sharpe, sortino, max_drawdown, ulcer)`` of a NAV by period."""
    w = ordered(key, time)
    x = nav.withColumn("_r", F.col(value) / F.lag(value).over(w) - 1).withColumn("_d", F.col(value) / F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    year = F.sqrt(F.lit(float(periods)))
    down = F.sqrt(F.avg(F.pow(F.least("_r", F.lit(0.0)), F.lit(2))))
    return x.groupBy(*key).agg(
        F.count("*").alias("n"), (F.max_by(value, time) / F.min_by(value, time) - 1).alias("total"), (F.stddev_samp("_r") * year).alias("volatility"),
        F.try_divide(F.avg("_r") * year, F.stddev_samp("_r")).alias("sharpe"), F.try_divide(F.avg("_r") * year, down).alias("sortino"),
        F.min("_d").alias("max_drawdown"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("ulcer"),
    )


def period_ledger(marks: DataFrame, portfolio: Sequence[str], cycle: str, entity: str, price: str) -> DataFrame:
    """``(portfolio, cycle, positions, period_return, nav)``: equal-weight returns between cycle marks, linked.

    A position counts for a period if it has a mark at its start and at the next cycle of the portfolio.
    """
    cycles = marks.select(*portfolio, cycle).distinct()
    following = cycles.withColumn("_next", F.lead(cycle).over(Window.partitionBy(*portfolio).orderBy(cycle)))
    end = marks.select(*portfolio, F.col(cycle).alias("_next"), entity, F.col(price).alias("_end"))
    held = marks.join(following, [*portfolio, cycle]).join(end, [*portfolio, "_next", entity])
    periods = held.groupBy(*portfolio, cycle).agg(F.count("*").alias("positions"), F.avg(F.col("_end") / F.col(price) - 1).alias("period_return"))
    w = Window.partitionBy(*portfolio).orderBy(cycle).rowsBetween(Window.unboundedPreceding, 0)
    return periods.withColumn("nav", F.exp(F.sum(F.log(1 + F.col("period_return"))).over(w)))


def inverse_volatility_weights(df: DataFrame, part: Sequence[str], vol: str, floor: float, most: float) -> DataFrame:
    """Weights by inverse volatility; what exceeds ``most`` is handed once to the others by their weights."""
    w = Window.partitionBy(*part)
    raw = (1 / F.greatest(F.col(vol), F.lit(floor)))
    df = df.withColumn("_w", raw / F.sum(raw).over(w))
    df = df.withColumn("_c", F.least("_w", F.lit(most))).withColumn("_free", F.when(F.col("_w") < most, F.col("_w")).otherwise(0.0))
    spare = 1 - F.sum("_c").over(w)
    room = F.sum("_free").over(w)
    return df.withColumn("weight", F.col("_c") + F.when(room > 0, spare * F.col("_free") / room).otherwise(0.0)).drop("_w", "_c", "_free")


def bootstrap_means(df: DataFrame, key: Sequence[str], index: str, value: str, samples: int, block: float, seed: int) -> DataFrame:
    """``(key, sample, mean)`` of stationary-block resamples: blocks start at random places and wrap around.

    Draw ``i`` of a sample starts a block with chance ``1 / block``; uniforms come from a seeded hash, so a
    sample is the same on every run. ``index`` counts a key's rows from 0.
    """
    n = df.groupBy(*key).agg(F.count("*").alias("_n"))
    draws = n.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("_i", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    uniform = lambda salt: F.pmod(F.xxhash64(*key, "sample", "_i", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    starts = F.when((uniform(1) < 1 / block) | (F.col("_i") == 0), F.struct("_i", F.floor(uniform(2) * F.col("_n")).alias("p")))
    w = Window.partitionBy(*key, "sample").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    placed = draws.withColumn("_s", F.last(starts, ignorenulls=True).over(w))
    picked = placed.select(*key, "sample", F.pmod(F.col("_s.p") + F.col("_i") - F.col("_s._i"), F.col("_n")).alias(index))
    return picked.join(df.withColumn(index, F.col(index).cast("long")), [*key, index]).groupBy(*key, "sample").agg(F.avg(value).alias("mean"))


def rolling_windows(sessions: DataFrame, number: str, fit: int, evaluate: int, step: int, purge: int) -> DataFrame:
    """``(window, number, role)``: fit and evaluation rows of rolling windows, the rows between them purged."""
    top = sessions.agg((F.max(number) + 1).alias("_n"))
    last = (F.floor((F.col("_n") - fit - purge - evaluate) / step)).cast("int")
    wins = top.where(F.col("_n") >= fit + purge + evaluate).select(F.explode(F.sequence(F.lit(0), last)).alias("window"))
    wins = wins.withColumn("_s", F.col("window") * step).withColumn(number, F.explode(F.sequence(F.col("_s"), F.col("_s") + fit + purge + evaluate - 1)))
    off = F.col(number) - F.col("_s")
    role = F.when(off < fit, "fit").when(off >= fit + purge, "evaluate")
    return wins.withColumn("role", role).where("role IS NOT NULL").select("window", number, "role").join(sessions, number)


def credit_label(oas: Column, real_rate: Column) -> Column:
    """A macro label from a credit spread in basis points and a real rate."""
    points = F.when(oas >= 700, 2).when(oas >= 500, 1).otherwise(0) + F.when(real_rate >= 0.025, 1).otherwise(0)
    return F.when(oas.isNull(), None).when(points >= 2, "defensive").when(points == 1, "cautious").otherwise("neutral")


def stress_target(market: Column, macro: Column) -> Column:
    """Rungs of cash 0..3 from two stress scores."""
    total = market + macro
    return F.when(total >= 4, 3).when(total >= 2, 2).when(total >= 1, 1).otherwise(0)


def regime_weights(df: DataFrame, dimension: DataFrame, regime: str, factor: str, weight: str, key: Sequence[str]) -> DataFrame:
    """Factor weights of each row's regime, normalised to one; ``dimension`` is bounded and broadcast."""
    out = df.join(small(dimension), regime)
    return out.withColumn(weight, F.col(weight) / F.sum(weight).over(Window.partitionBy(*key)))


def trade_levels(price: Column, atr: Column, multiple: float = 2.0, low: float = 0.05, high: float = 0.2, reward: float = 2.0) -> tuple[Column, Column]:
    """Stop and target: an ATR stop held to a band of the price, and a target of ``reward`` times the risk."""
    risk = F.least(F.greatest(atr * multiple / price, F.lit(low)), F.lit(high))
    return price * (1 - risk), price * (1 + reward * risk)
