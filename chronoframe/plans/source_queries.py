"""Queries over sources, and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, sinks
from ..streaming import twins
from . import registry as g
from .registry import query, r, table


@query("a2_typed_filings", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS filed, CASE WHEN o_custkey % 10 = 0 THEN 'cik' ELSE '' END AS issue FROM orders")
def a2(spark, d):
    o = table(spark, d, "orders")
    adsh = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-24-000001"))
    sub = o.select(adsh.alias("adsh"), F.when(F.col("o_custkey") % 10 == 0, "0").otherwise("7").alias("cik"), F.lit("10-K").alias("form"), F.date_format("o_orderdate", "yyyyMMdd").alias("filed"), F.lit("20240131").alias("period"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("accepted"))
    out = readers.typed_filings(sub)
    return out.select(F.substring("adsh", 1, 10).cast("bigint").alias("o_orderkey"), "filed", "issue")


@query("a3_typed_facts", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS value, l_returnflag = 'N' AS is_consolidated FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def a3(spark, d):
    li = table(spark, d, "lineitem")
    num = li.select(F.col("l_orderkey").cast("string").alias("adsh"), F.col("l_linenumber").cast("string").alias("tag"), F.lit("v").alias("version"), F.lit("20240101").alias("ddate"), F.lit("1").alias("qtrs"), F.lit("USD").alias("uom"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("segments"), F.lit(None).cast("string").alias("coreg"), F.col("l_quantity").cast("string").alias("value"))
    filings = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("adsh"), F.col("o_custkey").alias("cik"), F.lit("10-K").alias("form"), F.col("o_orderdate").alias("accepted"))
    facts, _ = readers.typed_facts(num, filings)
    return facts.select(F.col("adsh").cast("bigint").alias("l_orderkey"), F.col("tag").cast("int").alias("l_linenumber"), F.col("value").cast("double").alias("value"), "is_consolidated")


@query("a6_nested_json_facts", "SELECT event_type AS tag, CASE WHEN user_id % 2 = 0 THEN 'USD' ELSE 'shares' END AS unit, count(*) AS facts, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def a6(spark, d):
    e = table(spark, d, "events").withColumn("unit", F.when(F.col("user_id") % 2 == 0, "USD").otherwise("shares"))
    fact = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("end"), F.col("value").alias("val"), F.col("event_id").cast("string").alias("accn"), F.lit("10-Q").alias("form"))
    units = e.groupBy("user_id", "event_type", "unit").agg(F.collect_list(fact).alias("rows")).groupBy("user_id", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("unit", "rows"))).alias("units"))
    docs = units.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("units").alias("body")))).alias("tags"))
    docs = docs.select(F.to_json(F.struct(F.col("user_id").alias("cik"), F.create_map(F.lit("gaap"), F.col("tags")).alias("facts"))).alias("doc"))
    filings = e.select(F.col("event_id").cast("string").alias("adsh"), F.col("ts").alias("accepted"), F.lit("10-Q").alias("form"))
    out = readers.company_facts(docs, "doc", filings).where("issue IS NULL")
    return out.groupBy("tag", "unit").agg(F.count("*").alias("facts"), r(F.sum("val"), 3).alias("total"))


@query("a7_parallel_arrays", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders")
def a7(spark, d):
    o = table(spark, d, "orders")
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    docs = rows.select("o_custkey", F.struct(F.col("x.o_orderkey").alias("o_orderkey"), F.col("x.o_orderstatus").alias("o_orderstatus")).alias("recent"))
    return readers.parallel_arrays(docs, ["o_custkey"], "recent", ["o_orderkey", "o_orderstatus"])


@query("a10_master_index", "SELECT o_custkey AS cik, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def a10(spark, d):
    o = table(spark, d, "orders")
    lines = o.select(F.concat_ws("|", "o_custkey", F.lit("name"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("path")).alias("value"))
    day = lambda s: F.lit(s).cast("date")
    return readers.master_index(lines, day("1997-01-01"), day("1997-12-31")).select("cik", "form", "filed")


@query("a11_observations", "SELECT user_id AS series, CAST(ts AS DATE) AS observed, value * 100 AS value FROM events WHERE event_id % 5 <> 0")
def a11(spark, d):
    e = table(spark, d, "events")
    rows = e.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(F.col("event_id") % 5 == 0, ".").otherwise(F.col("value").cast("string")).alias("value"))
    calendar = e.select(F.to_date("ts").alias("observed"), F.date_add(F.to_date("ts"), 1).alias("available")).distinct()
    return readers.observations(rows, calendar, F.col("user_id"), 100.0).select("series", "observed", "value")


@query("a19_header_field", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS sic FROM orders")
def a19(spark, d):
    body = F.concat(F.lit("SIC=["), F.col("o_custkey").cast("string"), F.lit("] "), F.when(F.col("o_orderkey") % 3 == 0, "SIC=[999999]").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", readers.header_field(body, r"SIC=\[(\d+)\]").alias("sic"))


@query("a29_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def a29(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return sinks.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query("a30_newest_rows", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 25")
def a30(spark, d):
    return sinks.newest(table(spark, d, "events"), "event_id", 25).select("event_id")


@query("a34_macro_table", """WITH w AS (SELECT CAST(ts AS DATE) AS day, max(event_id) FILTER (WHERE event_type = 'click') AS click, max(event_id) FILTER (WHERE event_type = 'purchase' AND event_id % 40 = 0) AS purchase FROM events GROUP BY 1)
SELECT * FROM (SELECT day, last_value(click IGNORE NULLS) OVER (ORDER BY day) AS click, last_value(purchase IGNORE NULLS) OVER (ORDER BY day) AS purchase FROM w) WHERE day >= DATE '2024-01-05'""")
def a34(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", F.when((F.col("event_type") == "click") | (F.col("event_id") % 40 == 0), F.col("event_id")).alias("v"))
    long = e.groupBy("day", "event_type").agg(F.max("v").alias("v"))
    return readers.macro_table(long, "day", "event_type", "v", ["click", "purchase"], F.lit("2024-01-05").cast("date"))


@query("j1_new_filings", "SELECT event_id FROM events WHERE event_type = 'purchase'")
def j1(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return twins.new_filings(e.unionByName(e), "event_id", "ts", "1 day").select("event_id")


@query("j2_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def j2(spark, d):
    w = twins.windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "value", "1 hour")
    return w.select(F.col("window.start").alias("start"), "event_type", "n", r(F.col("total"), 4).alias("total"))


@query("j4_alert_once", "SELECT user_id, event_type, min(ts) AS ts FROM events WHERE value > 90 GROUP BY 1, 2")
def j4(spark, d):
    return twins.alert_once(table(spark, d, "events"), ["user_id", "event_type"], "ts", F.col("value") > 90, "1 day").select("user_id", "event_type", "ts")


@query("j6_live_quotes", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j6(spark, d):
    u = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return twins.live_quotes(table(spark, d, "events"), u, "user_id").select("event_id")


@query("j7_freshness", "SELECT user_id, CAST(max(ts) AS DATE) AS last, CAST(DATE '2024-02-01' - CAST(max(ts) AS DATE) AS INT) AS age_days, DATE '2024-02-01' - CAST(max(ts) AS DATE) > 3 AS stale FROM events GROUP BY 1")
def j7(spark, d):
    return twins.freshness(table(spark, d, "events"), ["user_id"], "ts", F.lit("2024-02-01").cast("date"), 3)


# A feed's cadence is one to four days; what its table says is what the stream says of any replay.
@query("j7_silent_feeds", """WITH e AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS t FROM events WHERE ts IS NOT NULL), g AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt, t + (user_id % 4 + 1) * 86400000 AS due FROM e)
SELECT user_id, make_timestamp(t * 1000) AS last, make_timestamp(due * 1000) AS due FROM g WHERE (nxt IS NULL OR nxt > due) AND due + 1 < (SELECT max(t) - 3600000 FROM e)""")
def j7_silent(spark, d):
    return twins.silent_feeds(table(spark, d, "events"), _feeds(spark, d), "user_id", "ts", "cadence", 3_600_000)


@query("j7_overdue_share", """WITH f AS (SELECT DISTINCT user_id FROM events), l AS (SELECT user_id, max(ts) AS last FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1),
r AS (SELECT user_id, last, coalesce(epoch_ms(TIMESTAMP '2024-01-20') - epoch_us(last) // 1000 > (user_id % 4 + 1) * 86400000, true) AS red FROM f LEFT JOIN l USING (user_id)) SELECT user_id, last, red, round(avg(red::INT) OVER (), 6) AS red_share FROM r""")
def j7_overdue(spark, d):
    out = twins.overdue(table(spark, d, "events"), _feeds(spark, d), "user_id", "ts", "cadence", F.lit("2024-01-20").cast("timestamp"))
    return out.withColumn("red_share", F.round("red_share", 6))


def _feeds(spark, d):
    return table(spark, d, "events").select("user_id", ((F.col("user_id") % 4 + 1) * 86_400_000).alias("cadence")).distinct()


@query("j9_running_high", "SELECT user_id, max(value) AS high, count(*) AS rows FROM events GROUP BY 1")
def j9(spark, d):
    return twins.running_high(table(spark, d, "events"), "user_id", "ts", "value")


@query("j11_stale_dates", "SELECT month FROM months GROUP BY 1 HAVING NOT bool_and(bars >= 2)")
def j11(spark, d):
    m = g.months(spark, d).withColumn("version", F.when(F.col("bars") >= 2, "v2").otherwise("v1"))
    return twins.stale_dates(m, "month", "version", "v2")
