"""Data-quality checks, gates and content-addressed snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nav_audit(nav: DataFrame, key: Sequence[str], arrival: str, time: str, value: str, cash: str, holdings: str, tolerance: float) -> DataFrame:
    """``(key, rows, identity_breaks, order_breaks)``: rows whose value is not cash plus holdings, and rows whose time is not after that of the row that arrived before.

    ``arrival`` tells the order in which rows arrived (a sequence number, an offset); rows of one arrival are taken by time.
    """
    w = Window.partitionBy(*key).orderBy(arrival, time)
    nav = nav.withColumn("_back", F.coalesce(F.lag(time).over(w) >= F.col(time), F.lit(False)))
    return nav.groupBy(*key).agg(F.count("*").alias("rows"), F.count_if(F.abs(F.col(value) - F.col(cash) - F.col(holdings)) > tolerance).alias("identity_breaks"), F.count_if("_back").alias("order_breaks"))


def chain_hashes(log: DataFrame, chain: Sequence[str], order: str, payload: str) -> DataFrame:
    """``log`` with ``previous`` and ``own``: the hash of the record before, and that of this one and the hash before it.

    A fold over each chain, so a chain's payloads are held in one row: some thousands.
    """
    rest = [c for c in log.columns if c not in (*chain, order, payload)]
    rows = F.array_sort(F.collect_list(F.struct(order, payload, *rest)))

    def step(done: Column, x: Column) -> Column:
        before = F.try_element_at(done, F.lit(-1))["own"]
        own = F.sha2(F.concat_ws("|", F.coalesce(before, F.lit("")), x[payload]), 256)
        return F.concat(done, F.array(F.struct(before.alias("previous"), own.alias("own"))))

    none = F.array().cast("array<struct<previous:string,own:string>>")
    each = log.groupBy(*chain).agg(rows.alias("_r")).withColumn("_h", F.aggregate("_r", none, step))
    pairs = each.select(*chain, F.explode(F.arrays_zip("_r", "_h")).alias("_x"))
    return pairs.select(*chain, *(F.col(f"_x._r.{c}").alias(c) for c in (order, payload, *rest)), F.col("_x._h.previous").alias("previous"), F.col("_x._h.own").alias("own"))


def chain_breaks(log: DataFrame, chain: Sequence[str], order: str, payload: str, own: str, previous: str) -> DataFrame:
    """Rows of a hash-chained log whose hash is not that of their payload, or which do not name the hash before them."""
    before = F.lag(own).over(Window.partitionBy(*chain).orderBy(order))
    bad_link = ~F.col(previous).eqNullSafe(before)
    bad_hash = ~F.col(own).eqNullSafe(F.sha2(F.concat_ws("|", F.coalesce(F.col(previous), F.lit("")), F.col(payload)), 256))
    return log.withColumn("broken_link", bad_link).withColumn("broken_hash", bad_hash).where("broken_link OR broken_hash")


def gates(df: DataFrame, checks: Sequence[tuple[str, Column, float]]) -> DataFrame:
    """``(check, value, least, status)``: each check is an aggregate that must reach its least value."""
    one = df.agg(*(e.cast("double").alias(n) for n, e, _ in checks))
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("value"), F.lit(float(least)).alias("least")) for n, _, least in checks))
    return one.select(F.inline(rows)).withColumn("status", F.when(F.col("value") >= F.col("least"), "pass").otherwise("warn"))


def enforce(df: DataFrame, checks: Sequence[tuple[str, Column, float]]) -> DataFrame:
    """``df`` unchanged if all gates pass; else the query that reads it fails and names the gate."""
    failed = gates(df, checks).where("status = 'warn'").agg(F.array_join(F.array_sort(F.collect_list("check")), ",").alias("_failed"))
    guard = F.when(F.col("_failed") != "", F.raise_error(F.concat(F.lit("gate failed: "), F.col("_failed"))).isNull()).otherwise(True)
    return df.crossJoin(F.broadcast(failed)).where(guard).drop("_failed")  # one row beside each


def content_fingerprint(df: DataFrame) -> DataFrame:
    """``(rows, content)``: the number of rows and an order-free hash of them; equal rows do not cancel."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content"))


def snapshot_id(spark: SparkSession, inputs: Sequence[tuple[str, str]]) -> str:
    """An id from the sorted descriptors of the inputs: the same inputs give the same snapshot."""
    rows = spark.createDataFrame([(f"{a}={b}",) for a, b in inputs], "d string")
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ";"), 256).alias("id")).first()["id"]


def look_ahead_leaks(operator, facts: DataFrame, available: str, days: int, key: Sequence[str]) -> DataFrame:
    """Rows that appear only when availability is put ``days`` later: there must be none."""
    shifted = facts.withColumn(available, F.date_add(available, days))
    return operator(shifted).select(*key).exceptAll(operator(facts).select(*key))


def missing_fields(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def secret_looking_keys(df: DataFrame, json_col: str) -> DataFrame:
    """Rows whose JSON object has a key that looks like a secret's name."""
    keys = F.map_keys(F.from_json(json_col, "map<string,string>"))
    return df.where(F.exists(keys, lambda k: F.rlike(F.lower(k), F.lit("token|secret|password|api_?key"))))
