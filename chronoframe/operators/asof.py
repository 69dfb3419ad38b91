"""As-of joins by union and window: one shuffle on the key, no comparison of all pairs.

Every function takes ``buckets``: give it where one key may hold a large part of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _asof(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, name: str, forward: bool, strict: bool, buckets: int = 0) -> DataFrame:
    """``left`` with struct ``name``: the right row that lies last before (or first after) the left time; null if none.

    Rows of both sides are sorted by time together; at equal times right rows come before left ones
    unless ``strict``. Among right rows of one time the greatest remaining columns win (the least
    when looking forward), so the choice is total. A null time matches nothing.

    With ``buckets`` a key's rows are cut at so many quantiles of all times, and no task sorts more than one
    (key, bucket). The right rows of each are first reduced to the one nearest to the next bucket, in part before the
    shuffle; a window over these few rows a key carries it into the buckets that need it, where it takes part as
    one more right row. Rows of one time are never cut apart, so the result is the same.
    """
    values = [c for c in right.columns if c not in key]
    r = right.where(F.col(right_time).isNotNull()).select(*key, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.struct(*values).alias("_right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    none = F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)
    both = left.select(*key, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), none.alias("_right"), F.struct("*").alias("_left")).unionByName(r)
    order = [F.col("_t").desc(), F.col("_side").asc(), F.col("_right").desc()] if forward else [F.col("_t").asc(), F.col("_side").asc(), F.col("_right").asc()]
    part = list(key)
    if buckets > 1:
        both, part = _carried(both, key, forward, buckets), [*key, "_bucket"]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where(F.col("_left").isNotNull())
    return found.select("_left.*", F.when(F.col("_t").isNotNull(), F.col("_found")).alias(name))


def _carried(both: DataFrame, key: list[str], forward: bool, buckets: int) -> DataFrame:
    """``both`` with ``_bucket``, and for every (key, bucket) with left rows the right row that its neighbours hand over."""
    cuts = both.agg(F.percentile_approx("_t", [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts"))  # one row
    both = both.crossJoin(F.broadcast(cuts)).withColumn("_bucket", F.when(F.col("_t").isNotNull(), F.size(F.filter("_cuts", lambda c: c <= F.col("_t"))))).drop("_cuts")
    nearest = (F.min if forward else F.max)(F.when(F.col("_right").isNotNull(), F.struct("_t", "_right")))
    edges = both.where("_t IS NOT NULL").groupBy(*key, "_bucket").agg(nearest.alias("_edge"), F.max(F.col("_left").isNotNull()).alias("_asked"))
    behind = Window.partitionBy(*key).orderBy(F.desc("_bucket") if forward else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.withColumn("_edge", F.last("_edge", ignorenulls=True).over(behind)).where(F.col("_asked") & F.col("_edge").isNotNull())
    nothing = F.lit(None).cast(both.schema["_left"].dataType)
    return both.unionByName(carry.select(*key, "_bucket", F.col("_edge._t").alias("_t"), F.lit(0).alias("_side"), F.col("_edge._right").alias("_right"), nothing.alias("_left")))


def asof_backward(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, name: str = "match", strict: bool = False, buckets: int = 0) -> DataFrame:
    """The latest right row at or before the left time (before it if ``strict``)."""
    return _asof(left, right, key, left_time, right_time, name, False, strict, buckets)


def asof_forward(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, name: str = "match", strict: bool = False, buckets: int = 0) -> DataFrame:
    """The earliest right row at or after the left time (after it if ``strict``)."""
    return _asof(left, right, key, left_time, right_time, name, True, strict, buckets)


def within_days(match: str, right_time: str, left_time: str, days: int) -> Column:
    """The matched struct, or null if it lies more than ``days`` off."""
    return F.when(F.abs(F.datediff(F.col(left_time), F.col(f"{match}.{right_time}"))) <= days, F.col(match))


def asof_tolerant(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, days: int, name: str = "match", buckets: int = 0) -> DataFrame:
    out = asof_backward(left, right, key, left_time, right_time, name, buckets=buckets)
    return out.withColumn(name, within_days(name, right_time, left_time, days))


def asof_either(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, days: int, name: str = "match", buckets: int = 0) -> DataFrame:
    """Backward within ``days``, else forward within ``days``."""
    out = asof_forward(asof_backward(left, right, key, left_time, right_time, "_b", buckets=buckets), right, key, left_time, right_time, "_f", buckets=buckets)
    return out.withColumn(name, F.coalesce(within_days("_b", right_time, left_time, days), within_days("_f", right_time, left_time, days))).drop("_b", "_f")


def asof_nearest(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, name: str = "match", buckets: int = 0) -> DataFrame:
    """The right row nearest in days; of two equally near ones the earlier."""
    out = asof_forward(asof_backward(left, right, key, left_time, right_time, "_b", buckets=buckets), right, key, left_time, right_time, "_f", buckets=buckets)
    before = F.datediff(F.col(left_time), F.col(f"_b.{right_time}"))
    after = F.datediff(F.col(f"_f.{right_time}"), F.col(left_time))
    nearest = F.when(F.col("_b").isNull(), F.col("_f")).when(F.col("_f").isNull() | (before <= after), F.col("_b")).otherwise(F.col("_f"))
    return out.withColumn(name, nearest).drop("_b", "_f")


def asof_or_first(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, name: str = "match", buckets: int = 0) -> DataFrame:
    """Backward, or the first right row of the key where the left time precedes all of them."""
    out = asof_backward(left, right, key, left_time, right_time, name, buckets=buckets)
    values = [c for c in right.columns if c not in key]
    first = right.groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(right_time, *(c for c in values if c != right_time))).alias("_first"))
    return out.join(first, key, "left").withColumn(name, F.coalesce(name, "_first")).drop("_first")
