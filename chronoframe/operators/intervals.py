"""Validity intervals: membership, resolution, overlaps, and intervals from observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import bounded, small


def covers(at: Column, start: Column, end: Column, inclusive_end: bool = False) -> Column:
    """Whether ``[start, end)`` holds ``at``; a null end is open."""
    return (start <= at) & (end.isNull() | ((at <= end) if inclusive_end else (at < end)))


def members_on(intervals: DataFrame, at: Column, start: str, end: str, inclusive_end: bool = False) -> DataFrame:
    return intervals.where(covers(at, F.col(start), F.col(end), inclusive_end))


def interval_join(points: DataFrame, intervals: DataFrame, key: Sequence[str], at: str, start: str, end: str, how: str = "inner", inclusive_end: bool = False) -> DataFrame:
    """Points with the intervals of their key that hold them; the key's equality precedes the range."""
    right = intervals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), *(c for c in intervals.columns if c not in key))
    on = covers(F.col(at), F.col(start), F.col(end), inclusive_end)
    for i, k in enumerate(key):
        on = (points[k] == F.col(f"_k{i}")) & on
    return points.join(right, on, how).drop(*(f"_k{i}" for i in range(len(key))))


#: Days beyond which no interval reaches; an open one ends there.
FAR_DAY = 1 << 22


def _bits_of(start: Column, end: Column) -> Column:
    """``[start, end)``, two longs, as aligned bins ``(level, bin)`` of 2**level units: two a level at most, which do not overlap and cover it."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        low, high = F.ceil(start / size).cast("long"), F.floor(end / size).cast("long")
        odd = low % 2 != 0
        left = F.when(odd & (low < high), F.struct(level.alias("level"), low.alias("bin")))
        right = F.when((high % 2 != 0) & (low + odd.cast("long") < high), F.struct(level.alias("level"), (high - 1).alias("bin")))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.when(end > start, F.ceil(F.log2(end - start)).cast("int")).otherwise(0))
    return F.filter(F.flatten(F.transform(levels, at)), lambda b: b.isNotNull())


def dyadic_join(points: DataFrame, intervals: DataFrame, key: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Points with the intervals ``[start, end)`` of their key that hold them, days all; a null end is open.

    What :func:`interval_join` gives, for keys of any number of intervals: intervals are written to aligned bins, at most two a
    level, and a point asks one bin of each level that occurs. Both meet by equality, each pair once, so the work grows with
    what is read and what is returned, never with the pairs of a key. Intervals that end before they start hold nothing.
    """
    until = F.coalesce(F.unix_date(end), F.lit(FAR_DAY)).cast("long")
    binned = intervals.where(F.col(start).isNotNull()).withColumn("_b", F.explode(_bits_of(F.unix_date(start).cast("long"), until))).select("*", F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin")).drop("_b")
    levels = F.broadcast(binned.select("_level").distinct())  # one row a level
    asked = points.where(F.col(at).isNotNull()).crossJoin(levels).withColumn("_bin", F.floor(F.unix_date(at) / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
    return asked.join(binned, [*key, "_level", "_bin"]).drop("_level", "_bin")


def resolve_unique(points: DataFrame, intervals: DataFrame, key: Sequence[str], at: str, start: str, end: str, entity: str, row_id: Sequence[str]) -> DataFrame:
    """``(row_id, entity, candidates, status)``: mapped if exactly one entity fits, else unmapped or ambiguous."""
    hit = interval_join(points, intervals, key, at, start, end, "left")
    found = hit.groupBy(*row_id).agg(F.array_sort(F.collect_set(entity)).alias("candidates"))
    n = F.size("candidates")
    status = F.when(n == 1, "mapped").when(n == 0, "unmapped").otherwise("ambiguous_mapping")
    return found.select(*row_id, F.when(n == 1, F.element_at("candidates", 1)).alias(entity), n.cast("bigint").alias("candidates"), status.alias("status"))


#: Intervals of a key beyond which they are met by bins.
CROWD = 64


def overlaps(intervals: DataFrame, key: Sequence[str], start: str, end: str, row_id: str, differ: str, crowd: int = CROWD) -> DataFrame:
    """Pairs of overlapping intervals of one key that differ in column ``differ``, with the overlap's range.

    Of two that overlap, the later start lies in the other interval, so starts are looked up by :func:`dyadic_join`: a key with
    many intervals and few overlaps costs little more than reading it. Keys of ``crowd`` intervals at most are joined as they are,
    each interval shuffled once a side and not once a bin. A null start, id or value gives no pair.
    """
    far = F.lit("9999-12-31").cast("date")
    side = intervals.select(*key, F.col(row_id).alias("id"), F.col(differ).alias("what"), F.col(start).alias("s"), F.col(end).alias("e"))
    side = side.where(F.col("s").isNotNull() & F.col("id").isNotNull() & F.col("what").isNotNull())
    for k in key:
        side = side.where(F.col(k).isNotNull())
    crowded = small(side.groupBy(*key).count().where(F.col("count") > crowd).select(*key))

    def halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(rows.select(*(c if c in key else F.col(c).alias(f"{p}_{c}") for c in side.columns)) for p in "ab")

    (a, b), (few_a, few_b) = halves(side.join(crowded, list(key), "left_semi")), halves(side.join(crowded, list(key), "left_anti"))
    inside = (F.col("a_s") <= F.col("b_s")) & (F.col("a_e").isNull() | (F.col("b_s") < F.col("a_e")))
    pair = dyadic_join(b, a, key, "b_s", "a_s", "a_e").unionByName(few_a.join(few_b, list(key)).where(inside))
    last = lambda p: F.coalesce(f"{p}_e", far)
    pair = pair.where((F.col("a_s") < F.col("b_s")) | (F.col("a_id") < F.col("b_id")))
    pair = pair.where((F.col("a_id") != F.col("b_id")) & (F.col("a_what") != F.col("b_what")) & (F.col("a_s") < last("b")))
    until = F.least(last("a"), last("b"))
    return pair.select(*key, F.least("a_id", "b_id").alias("left_id"), F.greatest("a_id", "b_id").alias("right_id"), F.greatest("a_s", "b_s").alias("overlap_from"), F.when(until < far, until).alias("overlap_to"))


def overlapping_window(intervals: DataFrame, start: str, end: str, first: Column, last: Column) -> DataFrame:
    """Intervals ``[start, end)`` that touch ``[first, last]``."""
    return intervals.where((F.col(start) <= last) & (F.col(end).isNull() | (F.col(end) > first)))


def observations_to_intervals(obs: DataFrame, key: Sequence[str], time: str, value: str) -> DataFrame:
    """``(key, value, valid_from, valid_to)``: a value holds until another is observed; the last stays open.

    Equal neighbours melt into one interval; of several values at one time the greatest counts.
    """
    one = obs.groupBy(*key, time).agg(F.max(value).alias(value))
    w = Window.partitionBy(*key).orderBy(time)
    changed = one.withColumn("_new", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(time).over(w).isNull())
    heads = changed.where("_new")
    return heads.select(*key, value, F.col(time).alias("valid_from"), F.lead(time).over(w).alias("valid_to"))


def range_lookup(rows: DataFrame, ranges: DataFrame, at: str, low: str, high: str, label: str, default: str, most: int = 10_000) -> DataFrame:
    """``rows`` with ``label`` of the range that holds ``at``; the default if none, null with ``ambiguous`` if several.

    ``ranges`` is a dimension of at most ``most`` rows, which is asked before it is broadcast.
    """
    found = rows.select(at).distinct().join(bounded(ranges, most, "ranges"), F.col(at).between(F.col(low), F.col(high)), "left")
    found = found.groupBy(at).agg(F.count_distinct(label).alias("_n"), F.min(label).alias("_label"))
    out = rows.join(found, at, "left")
    return out.withColumn(label, F.when(F.col("_n") <= 1, F.coalesce("_label", F.lit(default)))).withColumn("ambiguous", F.coalesce(F.col("_n") > 1, F.lit(False))).drop("_n", "_label")


def every_match(rows: DataFrame, series: DataFrame, key: Sequence[str], holds: Column) -> DataFrame:
    """Keys of ``rows`` all of whose matching series satisfy ``holds``; a key without a match proves nothing."""
    hit = rows.select(*key).distinct().join(series, list(key))
    return hit.groupBy(*key).agg(F.bool_and(holds).alias("_all"), F.count("*").alias("series")).where("_all").drop("_all")


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose left has one right and whose right has one left; others marked."""
    n_right = pairs.groupBy(left).agg(F.count_distinct(right).alias("_r"))
    n_left = pairs.groupBy(right).agg(F.count_distinct(left).alias("_l"))
    out = pairs.select(left, right).distinct().join(n_right, left).join(n_left, right)
    return out.select(left, right, ((F.col("_r") == 1) & (F.col("_l") == 1)).alias("unique_pair"))
