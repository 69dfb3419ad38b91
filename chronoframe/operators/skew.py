"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of all rows is hot; by that there are fewer hot keys than this.
HOT_SHARE = 200
#: Rows up to which a dimension is broadcast.
SMALL_ROWS = 100_000
#: Rows that a task of a spread table gets.
TASK_ROWS = 250_000


def small(dimension: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``dimension`` marked for broadcast if it has ``most`` rows or fewer, which are counted first; else as it is."""
    return F.broadcast(dimension) if dimension.limit(most + 1).count() <= most else dimension


def bounded(dimension: DataFrame, most: int, what: str) -> DataFrame:
    """``dimension`` marked for broadcast; refused if it has more than ``most`` rows."""
    if dimension.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(dimension)


def spread(rows: DataFrame, number: int, *by: str) -> DataFrame:
    """``rows``, about ``number`` of them, by columns ``by`` in as many tasks as keep each small, whatever the input.

    The session's number of shuffle partitions stays as it is when the input grows, so that tasks would grow with it.
    """
    return rows.repartition(max(1, -(-number // TASK_ROWS)), *by)


def join_unique(rows: DataFrame, found: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """``rows`` joined with ``found``, which has one row a key and in ``number`` how many of ``rows`` have it.

    Hot keys are fewer than :data:`HOT_SHARE` whatever the input, so they are broadcast and their rows
    stay where they are; the other rows are shuffled. Keys that ``found`` lacks, and null keys, give no
    row. Column ``number`` is dropped. ``rows`` is read twice: give it as a table or a cheap scan.
    """
    keys = list(keys)
    rest = found.drop(number)
    total, most = found.agg(F.sum(number), F.max(number)).first()
    if (most or 0) * HOT_SHARE <= (total or 0):
        return rows.join(rest, keys)
    hot = found.where(F.col(number) * HOT_SHARE > total).drop(number)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(rest, keys))
