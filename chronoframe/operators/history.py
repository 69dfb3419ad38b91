"""Revised facts: keep-first and keep-last rows, conflicts at equal times, vintages, and point-in-time views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NULL_MARK = "<NULL>"


def keep_row(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under a total ``order``; null keys are a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, key: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    return keep_row(df, key, [F.col(time).asc(), *(F.col(c).asc() for c in ties)])


def keep_last(df: DataFrame, key: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    return keep_row(df, key, [F.col(time).desc(), *(F.col(c).desc() for c in ties)])


def _as_text(value: str) -> Column:
    return F.coalesce(F.col(value).cast("string"), F.lit(NULL_MARK))


def conflicts(df: DataFrame, key: Sequence[str], time: str, value: str) -> DataFrame:
    """Keys that have more than one value at one time: counts and the sorted values.

    The keys are found by a count first; only their rows are collected, so no list grows with a clean key.
    """
    text, groups = _as_text(value), [*key, time]
    bad = df.groupBy(*groups).agg(F.count_distinct(text).alias("distinct_values"), F.count("*").alias("candidate_rows")).where("distinct_values > 1")
    rows = df.join(bad.select(*groups), groups, "left_semi")
    values = rows.groupBy(*groups).agg(F.array_sort(F.collect_set(text)).alias("values"))
    return bad.join(values, groups)


def visible(df: DataFrame, available: str, as_of: Column) -> DataFrame:
    """Rows known at ``as_of``; a row without a time of availability never is."""
    return df.where(F.col(available) <= as_of)


def latest_vintages(df: DataFrame, series: str, observed: str, available: str, value: str, as_of: Column, ties: Sequence[str] = ()) -> DataFrame:
    """The newest vintage visible at ``as_of`` of each observation; ``conflict`` marks values that differ at that time."""
    seen = visible(df, available, as_of)
    w = Window.partitionBy(series, observed)
    newest = seen.withColumn("_newest", F.max(available).over(w)).where(F.col(available) == F.col("_newest")).drop("_newest")
    marked = newest.withColumn("conflict", F.min(value).over(w) != F.max(value).over(w))
    return keep_row(marked, [series, observed], [F.col(value).asc_nulls_first(), *(F.col(c) for c in ties)])


def latest_unambiguous(df: DataFrame, key: Sequence[str], time: str, value: str) -> DataFrame:
    """``(key, time, value, conflict)`` at each key's newest time; value is null where that time disagrees with itself."""
    best = df.groupBy(*key, time).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(value).alias("_n"))
    best = keep_last(best, key, time)
    conflict = F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))
    return best.select(*key, time, F.when(~conflict, F.col("_low")).alias(value), conflict.alias("conflict"))


def coalesce_by_precision(df: DataFrame, key: Sequence[str], value: str, decimals: str) -> DataFrame:
    """The most precise value of each key, and whether the others agree once rounded to their own decimals."""
    best = df.groupBy(*key).agg(F.max_by(value, F.struct(decimals, value)).alias("_best"))
    scale = F.pow(F.lit(10.0), F.col(decimals))
    agrees = F.round(F.col("_best") * scale) == F.round(F.col(value) * scale)
    return df.join(best, list(key)).groupBy(*key).agg(F.first("_best").alias(value), F.bool_and(agrees).alias("agrees"), F.count("*").alias("rows"))


def distinct_count_gate(df: DataFrame, key: Sequence[str], value: Column) -> DataFrame:
    """Keys whose rows do not all have the same content."""
    return df.groupBy(*key).agg(F.count_distinct(value).alias("contents")).where("contents > 1")


def pit_view(facts: DataFrame, key: Sequence[str], time: str, value: str, ties: Sequence[str], newest: bool = False) -> DataFrame:
    """The first (or newest) known row of each key; a key that has two values at one time is left out.

    One shuffle on the key: all windows are over it or finer than it. Null keys are a key.
    """
    order = F.desc if newest else F.asc
    rows = facts.repartition(*key).withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(order(time), *(order(c) for c in ties))))
    at = Window.partitionBy(*key, time)
    split = F.min(_as_text(value)).over(at) != F.max(_as_text(value)).over(at)
    marked = rows.withColumn("_split", split).withColumn("_bad", F.max("_split").over(Window.partitionBy(*key)))
    return marked.where("_rank = 1 AND NOT _bad").drop("_rank", "_split", "_bad")


def pit_views(facts: DataFrame, key: Sequence[str], time: str, value: str, ties: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As-first-known view, latest view, and conflicts; a key with a conflict is in neither view."""
    return pit_view(facts, key, time, value, ties), pit_view(facts, key, time, value, ties, newest=True), conflicts(facts, key, time, value)


def prefer_whole(facts: DataFrame, key: Sequence[str], whole: Column, parts: Column) -> DataFrame:
    """Rows where ``whole`` holds, and rows where ``parts`` holds whose key has no whole row."""
    first = facts.where(whole)
    return first.unionByName(facts.where(parts & ~whole).join(first.select(*key).distinct(), list(key), "left_anti"))
