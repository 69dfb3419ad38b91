"""Ranks, outliers and scores within a cross-section (a date, or a date and a sector).

Four percentile conventions exist side by side; none is expressed through another. Nulls keep their
row, get a null rank and do not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _average_rank(value: str, part: Sequence[str], ascending: bool = True) -> tuple[Column, Column]:
    """Average rank among non-null values, and their number."""
    c = F.col(value)
    rank = F.rank().over(Window.partitionBy(*part).orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(*part, value))
    return rank + (ties - 1) / 2, F.count(c).over(Window.partitionBy(*part))


def midrank_percentile(value: str, part: Sequence[str]) -> Column:
    """``(average rank - 0.5) / n``."""
    rank, n = _average_rank(value, part)
    return F.when(F.col(value).isNotNull(), (rank - 0.5) / n)


def percentile_0_100(value: str, part: Sequence[str]) -> Column:
    """``(average rank - 1) / (n - 1) * 100``; a lone value has 100."""
    rank, n = _average_rank(value, part)
    return F.when(F.col(value).isNotNull(), F.when(n == 1, 100.0).otherwise((rank - 1) / (n - 1) * 100))


def ordinal_percentile(value: str, part: Sequence[str], tie: str, invert: bool = False) -> Column:
    """``(position - 1) / (n - 1) * 100`` by value then ``tie``; a lone value has 50."""
    w = Window.partitionBy(*part)
    order = F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), F.col(tie)))
    n = F.count(value).over(w)
    p = (order - 1) / (n - 1) * 100
    return F.when(F.col(value).isNotNull(), F.when(n == 1, 50.0).otherwise(100 - p if invert else p))


def rank_share(value: str, part: Sequence[str], ascending: bool = True) -> Column:
    """Average rank over n."""
    rank, n = _average_rank(value, part, ascending)
    return F.when(F.col(value).isNotNull(), rank / n)


def rank_sum_percentile(values: Sequence[str], part: Sequence[str], tie: str) -> Column:
    """Ordinal ranks of all values, best first, summed and ranked again onto 0..100; rows with a null stay out."""
    complete = F.lit(True)
    for v in values:
        complete = complete & F.col(v).isNotNull()
    rank = lambda c: F.row_number().over(Window.partitionBy(*part, complete).orderBy(c, F.col(tie)))
    total = sum((rank(F.col(v).desc()) for v in values[1:]), rank(F.col(values[0]).desc()))
    return F.when(complete, total)


def winsorize(value: str, part: Sequence[str], sigmas: float = 3.0) -> Column:
    """Held to the mean plus or minus ``sigmas`` sample deviations."""
    w = Window.partitionBy(*part)
    mean, sd = F.avg(value).over(w), F.stddev_samp(value).over(w)
    held = F.greatest(F.least(F.col(value), mean + sigmas * sd), mean - sigmas * sd)
    return F.when(sd.isNull() | (sd == 0), F.col(value)).otherwise(F.when(F.col(value).isNotNull(), held))


def sector_zscore(value: str, part: Sequence[str], sector: str, least: int = 3) -> Column:
    """z-score within the sector; within the whole section where the sector has under ``least`` values or no spread."""
    inner, outer = Window.partitionBy(*part, sector), Window.partitionBy(*part)
    n, sd = F.count(value).over(inner), F.stddev_samp(value).over(inner)
    all_sd = F.stddev_samp(value).over(outer)
    own = (F.col(value) - F.avg(value).over(inner)) / sd
    whole = F.when(all_sd > 0, (F.col(value) - F.avg(value).over(outer)) / all_sd).otherwise(F.when(F.col(value).isNotNull(), 0.0))
    return F.when((n >= least) & (sd > 0), own).otherwise(whole)


def normalize_factor(df: DataFrame, value: str, part: Sequence[str], sector: str, out: str) -> DataFrame:
    """Winsorize, z-score by sector, percentile 0-100."""
    z = df.withColumn("_w", winsorize(value, part)).withColumn("_z", F.round(sector_zscore("_w", part, sector), 9))
    return z.withColumn(out, percentile_0_100("_z", part)).drop("_w", "_z")


def harmonize(df: DataFrame, score: str, part: Sequence[str], sector: str, out: str, full_peers: int = 5) -> DataFrame:
    """Half the global and half the sector percentile, drawn toward 50 where peers are few; alone in a sector: 50 there."""
    peers = F.count(score).over(Window.partitionBy(*part, sector))
    local = F.when(peers <= 1, F.when(F.col(score).isNotNull(), 50.0)).otherwise(percentile_0_100(score, [*part, sector]))
    weight = F.least(F.lit(1.0), peers / full_peers)
    blend = 0.5 * percentile_0_100(score, part) + 0.5 * (50 + (local - 50) * weight)
    return df.withColumn(out, blend)


def weighted_mean(parts: Sequence[tuple[Column, float]]) -> Column:
    """Mean of the parts that are there, weights re-scaled to them; null if none is."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, top / weight)


def coverage(parts: Sequence[tuple[Column, float]]) -> Column:
    """Share of the weight whose parts are there."""
    return sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in parts), F.lit(0.0)) / float(sum(w for _, w in parts))


def information_coefficient(df: DataFrame, date: str, factor: str, outcome: str) -> DataFrame:
    """``(date, n, ic)``: Spearman correlation of factor and outcome in each cross-section."""
    both = df.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull())
    (rf, _), (ro, _) = _average_rank(factor, [date]), _average_rank(outcome, [date])
    ranked = both.select(date, rf.alias("_f"), ro.alias("_o"))
    return ranked.groupBy(date).agg(F.count("*").alias("n"), F.corr("_f", "_o").alias("ic"))


def decile_spread(df: DataFrame, date: str, factor: str, outcome: str, tie: str, tiles: int = 10) -> DataFrame:
    """``(date, spread)``: mean outcome of the top tile less that of the bottom one."""
    both = df.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull())
    tile = F.ntile(tiles).over(Window.partitionBy(date).orderBy(F.col(factor), F.col(tie)))
    cut = both.withColumn("_tile", tile).groupBy(date)
    return cut.agg((F.avg(F.when(F.col("_tile") == tiles, F.col(outcome))) - F.avg(F.when(F.col("_tile") == 1, F.col(outcome)))).alias("spread"))


def group_medians(df: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("members"), *(F.median(v).alias(f"median_{v}") for v in values))
