"""How queries are registered, and the stand-in frames that they share.

The driver's tables play the part of a securities store: suppliers are securities, their shipments
per day are daily bars, nations are sectors, orders are filings, and events are vintaged observations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL it equals. ``WITH`` frames named in the SQL are put before it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_frames(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column, digits: int = 6):
    """Rounded, so that engines with other orders of summation agree."""
    return F.round(column, digits)


def cut(column, digits: int = 4):
    """So many digits, downward; the offset keeps quotients off the steps, where engines would differ."""
    return F.floor(column * 10**digits + 0.123456) / 10**digits


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars ``(security_id, session, close, high, low, volume)``."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("session")).agg(
        cut(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), cut(F.max(price)).alias("high"), cut(F.min(price)).alias("low"), F.sum("l_quantity").alias("volume")
    )


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(security_id, sector, name, balance)``."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("security_id"), F.col("s_nationkey").alias("sector"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monthly panel ``(security_id, month, price, turnover, bars, sector)``."""
    b = bars(spark, sf_dir)
    m = b.groupBy("security_id", F.to_date(F.date_trunc("month", "session")).alias("month")).agg(
        F.max_by("close", "session").alias("price"), cut(F.sum(F.col("close") * F.col("volume")), 2).alias("turnover"), F.count("*").alias("bars")
    )
    return m.join(securities(spark, sf_dir).select("security_id", "sector"), "security_id")


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements ``(company_id, q, revenue, orders, published)``; q counts quarters from year 0."""
    o = table(spark, sf_dir, "orders")
    q = F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1
    return o.groupBy(F.col("o_custkey").alias("company_id"), q.cast("long").alias("q")).agg(
        r(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("orders"), F.to_date(F.max("o_orderdate")).alias("published")
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revised facts ``(cik, tag, accepted, adsh, value)``: line numbers as tags, ship times as acceptance."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("cik"), F.col("l_linenumber").alias("tag"), F.to_date("l_shipdate").alias("accepted"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("adsh"), F.col("l_quantity").alias("value"))


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(series, observed, available, value, event_id)`` from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("series"), F.to_date("ts").alias("observed"), F.col("ts").alias("available"), "value", "event_id")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(customer, status, valid_from, valid_to)``: spans of order statuses."""
    from ..operators.intervals import observations_to_intervals

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("status"))
    return observations_to_intervals(o, ["customer"], "day", "status")


_FRAMES = {
    "bars": """bars AS (SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS session, floor(sum(l_extendedprice)/sum(l_quantity)*10000+0.123456)/10000 AS close,
 floor(max(l_extendedprice/l_quantity)*10000+0.123456)/10000 AS high, floor(min(l_extendedprice/l_quantity)*10000+0.123456)/10000 AS low, sum(l_quantity) AS volume FROM lineitem GROUP BY 1,2)""",
    "securities": "securities AS (SELECT s_suppkey AS security_id, s_nationkey AS sector, s_name AS name, s_acctbal AS balance FROM supplier)",
    "months": """months AS (SELECT b.security_id, CAST(date_trunc('month', session) AS DATE) AS month, max_by(close, session) AS price,
 floor(sum(close*volume)*100+0.123456)/100 AS turnover, count(*) AS bars, any_value(s.sector) AS sector FROM bars b JOIN securities s USING (security_id) GROUP BY 1,2)""",
    "quarters": """quarters AS (SELECT o_custkey AS company_id, CAST(year(o_orderdate)*4+quarter(o_orderdate)-1 AS BIGINT) AS q, round(sum(o_totalprice),2) AS revenue,
 count(*) AS orders, CAST(max(o_orderdate) AS DATE) AS published FROM orders GROUP BY 1,2)""",
    "facts": "facts AS (SELECT l_orderkey AS cik, l_linenumber AS tag, CAST(l_shipdate AS DATE) AS accepted, l_partkey*100000+l_suppkey AS adsh, l_quantity AS value FROM lineitem)",
    "vintages": "vintages AS (SELECT user_id AS series, CAST(ts AS DATE) AS observed, ts AS available, value, event_id FROM events)",
    "intervals": """day_status AS (SELECT o_custkey AS customer, CAST(o_orderdate AS DATE) AS day, max(o_orderpriority) AS status FROM orders GROUP BY 1,2),
marked AS (SELECT *, lag(status) OVER (PARTITION BY customer ORDER BY day) AS p FROM day_status),
intervals AS (SELECT customer, status, day AS valid_from, lead(day) OVER (PARTITION BY customer ORDER BY day) AS valid_to FROM marked WHERE p IS NULL OR p <> status)""",
}
_NEEDS = {"months": ("bars", "securities")}


def with_frames(sql: str) -> str:
    """The SQL with the frames it names before it, and after them its own ``WITH`` parts."""
    import re

    wanted: list[str] = []
    for name in _FRAMES:
        if re.search(rf"\b{name}\b", sql):
            wanted += [n for n in (*_NEEDS.get(name, ()), name) if n not in wanted]
    if not wanted:
        return sql
    frames = ",\n".join(_FRAMES[n] for n in wanted)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {own[1] or ''}{frames},\n{sql[own.end() :]}" if own else f"WITH {frames}\n{sql}"


def rsi_sql(name: str) -> str:
    """A ``WITH`` part ``(security_id, rsi)`` over bars: Wilder's recursion as weights of the changes, newest last."""
    side = lambda d: f"sum(greatest({d}, 0.0) / 14 * pow(13.0 / 14, CASE WHEN i <= 14 THEN n - 14 ELSE n - i END))"
    return f"""{name}_d AS (SELECT security_id, session, close - lag(close) OVER (PARTITION BY security_id ORDER BY session) AS d FROM bars),
{name}_k AS (SELECT security_id, d, row_number() OVER (PARTITION BY security_id ORDER BY session) AS i, count(*) OVER (PARTITION BY security_id) AS n FROM {name}_d WHERE d IS NOT NULL),
{name}_s AS (SELECT security_id, max(n) AS n, {side("d")} AS up, {side("-d")} AS down FROM {name}_k GROUP BY 1),
{name} AS (SELECT a.security_id, CASE WHEN coalesce(n, 0) < 14 THEN NULL WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM (SELECT DISTINCT security_id FROM bars) a LEFT JOIN {name}_s USING (security_id))"""


def state_machine_sql(rows: str, key: str, confirm: int = 3, cooldown_days: int = 10, last: str | None = None) -> str:
    """The state after each key's last row of ``rows``, a query that gives ``(key, t, raw)``: one recursion step a row. ``last`` takes another query's place at the end, over ``m`` and ``raw``."""
    return f"""WITH RECURSIVE raw AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t) AS i FROM ({rows})),
m AS (SELECT {key}, CAST(0 AS BIGINT) AS i, 0 AS state, 0 AS run, 0 AS side, CAST(NULL AS DATE) AS moved FROM raw GROUP BY 1
UNION ALL SELECT {key}, i, CASE WHEN mv THEN state + s ELSE state END, CASE WHEN mv THEN 0 ELSE rn END, CASE WHEN mv THEN 0 ELSE s END, CASE WHEN mv THEN t ELSE moved END FROM (
SELECT *, s <> 0 AND rn >= {confirm} AND (moved IS NULL OR t - moved >= {cooldown_days}) AS mv FROM (SELECT *, CASE WHEN s = 0 THEN 0 WHEN s = side THEN run + 1 ELSE 1 END AS rn FROM (
SELECT m.{key}, r.i, r.t, state, run, side, moved, CAST(sign(r.raw - state) AS INTEGER) AS s FROM m JOIN raw r ON r.{key} = m.{key} AND r.i = m.i + 1))))
{last or f"SELECT {key}, max_by(state, i) AS state FROM m GROUP BY 1"}"""


def split_ratio_sql(rows: str, keys: str, ratios, tolerance: float, either_way: bool = False, digits: int = 6) -> str:
    """The known ratio nearest to column ``o`` of a query ``rows``, within the tolerance; other rows are left out."""
    known = ", ".join(repr(float(v)) for x in ratios for v in ((x, 1 / x) if either_way else (x,)))
    nearest = f"SELECT {keys}, o, min((abs(o / r - 1), r)) AS b FROM ({rows}), (SELECT unnest([{known}]::DOUBLE[]) AS r) GROUP BY ALL"
    return f"SELECT {keys}, round(struct_extract(b, 2), {digits}) AS ratio FROM ({nearest}) WHERE o > 0 AND struct_extract(b, 1) <= {tolerance}"
