"""Queries over names, evidence, universes, exits and domain scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import asof, fundamentals, hygiene, identity, rules, screening, skew
from ..operators import cross_section as x
from ..operators import series as s
from ..operators.components import connected_components
from ..storage import materialise
from . import registry as g
from .registry import cut, query, r, table

K = ["security_id"]


# Securities that ship for one order on one day are one entity: each row gets the least name of its component. No SQL; the tests compare.
@query("c12_identity_components")
def c12(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", F.to_date("l_shipdate").alias("day"))
    return screening.reconcile_identities(li, "l_suppkey", ["l_orderkey", "day"]).select("l_suppkey", "entity")


# All links of parts with suppliers, whose numbers are told apart by sign. No SQL; the tests compare it with union-find.
@query("c12_all_identity_components")
def c12_all(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("u"), (-1 - F.col("l_suppkey")).alias("v")).distinct()
    return connected_components(e)


# Suppliers of a part whose deliveries overlap in time are one entity, unless their nations' classes contradict each other.
_IDENTITY = """WITH RECURSIVE b AS (SELECT l_partkey AS k, l_partkey * 1000000 + l_suppkey AS e, CAST(l_shipdate AS DATE) AS f, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) % 20 AS t FROM lineitem),
p AS (SELECT DISTINCT x.e AS u, y.e AS v FROM b x JOIN b y ON x.k = y.k AND x.e <> y.e AND x.f < y.t AND y.f < x.t AND x.f < x.t AND y.f < y.t),
reach(u, v) AS (SELECT DISTINCT e, e FROM b UNION SELECT reach.u, p.v FROM reach JOIN p ON p.u = reach.v), roots AS (SELECT u, min(v) AS r FROM reach GROUP BY 1),
bad AS (SELECT r FROM roots JOIN supplier ON s_suppkey = u % 1000000 GROUP BY 1 HAVING count(DISTINCT s_nationkey % 3) > 1),
i AS (SELECT u AS entity, CASE WHEN bad.r IS NULL THEN roots.r ELSE u END AS canonical, bad.r IS NOT NULL AS refused FROM roots LEFT JOIN bad ON bad.r = roots.r)"""


def _identities(spark, d):
    entity = (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).cast("long").alias("entity")
    b = table(spark, d, "lineitem").select("l_partkey", entity, F.to_date("l_shipdate").alias("f"), F.date_add(F.to_date("l_shipdate"), F.expr("cast(l_quantity AS int) % 20")).alias("t"))
    kinds = b.select("entity").withColumn("s_suppkey", F.col("entity") % 1_000_000).join(table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("kind")), "s_suppkey")
    return b, identity.overlap_identities(b, ["l_partkey"], "entity", "f", "t", kinds, "kind")


@query("c12_identity_by_overlap", _IDENTITY + " SELECT * FROM i")
def c12_overlap(spark, d):
    return _identities(spark, d)[1]


@query("c12_remapped_rows", _IDENTITY + " SELECT canonical AS entity, refused, count(*) AS lines FROM b JOIN i ON b.e = i.entity GROUP BY 1, 2")
def c12_remapped(spark, d):
    b, found = _identities(spark, d)
    return skew.spread(identity.remapped(b.select("entity"), found, "entity"), b.count(), "entity").groupBy("entity", "refused").agg(F.count("*").alias("lines"))


@query("c16_exact_names", "WITH k AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS n, count(DISTINCT p_partkey) AS c, min(p_partkey) AS e FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p.p_partkey AS row_id, CASE WHEN c = 1 THEN e END AS entity, CASE WHEN c IS NULL THEN 'unmatched' WHEN c = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM part p LEFT JOIN k ON k.n = regexp_replace(lower(p.p_name), '[^a-z0-9]', '', 'g')")
def c16(spark, d):
    p = table(spark, d, "part")
    known = p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("known_name"), F.col("p_partkey").alias("entity"))
    return screening.match_names(p.select(F.col("p_partkey").alias("row_id"), "p_name"), known, "row_id", "p_name", "known_name", "entity", sc.normalize_name)


def stem_sql(c: str) -> str:
    plain = rf"trim(regexp_replace(strip_accents(replace(lower({c}), 'ß', 'ss')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"replace(regexp_replace(regexp_replace({plain}, '^the | the$| class [a-z]$', '', 'g'), '( (co|company|corp|corporation|group|holding|holdings|inc|incorporated|limited|llc|ltd|plc))+$', ''), ' ', '')"


# Names that differ in marks, case, ligatures and ß alone are one name.
_ODD_NAME = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || ' Straße' WHEN 1 THEN replace(p_name, 'o', 'ó') || ' STRASSE' WHEN 2 THEN replace(p_name, 'e', 'ě') || ' İĞ' WHEN 3 THEN replace(p_name, 'a', 'ą') || ' ﬁnance Ⅳ' ELSE p_name || ' ŁÓDŹ' END"


@query("c16_folded_names", """WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN lower(p_name) || 'strasse' WHEN 1 THEN lower(p_name) || 'strasse' WHEN 2 THEN lower(p_name) || 'ig' WHEN 3 THEN lower(p_name) || 'financeiv' ELSE lower(p_name) || 'łodz' END AS n FROM part),
q AS (SELECT p_partkey, regexp_replace(n, '[^a-z0-9ł]', '', 'g') AS plain FROM p) SELECT p_partkey, plain, count(*) OVER (PARTITION BY plain) AS same FROM q""")
def c16_folded(spark, d):
    p = materialise(table(spark, d, "part").select("p_partkey", sc.normalize_name(F.expr(_ODD_NAME)).alias("plain")), "folded-names")  # read twice
    return p.join(p.groupBy("plain").agg(F.count("*").alias("same")), "plain").select("p_partkey", "plain", "same")


# Stems drop legal suffixes; the tests give cases too.
@query("c17_name_stems", f"""WITH k AS (SELECT {stem_sql("'The ' || p_name || ' Inc.'")} AS n, count(DISTINCT p_partkey) AS c, min(p_partkey) AS e FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), p AS (SELECT p_partkey, {stem_sql("p_name")} AS n FROM part)
SELECT p_partkey AS row_id, CASE WHEN c = 1 THEN e END AS entity, CASE WHEN coalesce(p.n, '') = '' THEN 'blank' WHEN c IS NULL THEN 'unmatched' WHEN c = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM p LEFT JOIN k ON k.n = p.n AND k.n <> ''""")
def c17(spark, d):
    p = table(spark, d, "part")
    known = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("The "), "p_name", F.lit(" Inc.")).alias("known_name"), F.col("p_partkey").alias("entity"))
    return screening.match_names(p.select(F.col("p_partkey").alias("row_id"), "p_name"), known, "row_id", "p_name", "known_name", "entity", sc.name_stem)


@query("c18_evidence_gaps", "WITH o AS (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT c_custkey, last_order, n AS events_n, concat_ws(',', CASE WHEN last_order IS NULL THEN 'orders' END, CASE WHEN n IS NULL THEN 'events' END) AS gaps FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey")
def c18(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"))
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("events_n"))
    return screening.evidence_gaps(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], [("orders", o), ("events", e)])


@query("c27_common_dates", "SELECT a.session, a.close AS a, b.close AS b, round(a.close / b.close, 6) AS ratio FROM bars a JOIN bars b USING (session) WHERE a.security_id = 2 AND b.security_id = 3")
def c27(spark, d):
    side = lambda i, n: g.bars(spark, d).where(F.col("security_id") == i).select("session", F.col("close").alias(n))
    return side(2, "a").join(side(3, "b"), "session").withColumn("ratio", r(F.col("a") / F.col("b")))


@query("c34_market_value", "SELECT o.company_id, o.q, b.close, floor(b.close * o.orders / nullif(o.revenue, 0) * 10000 + 0.123456) / 10000 AS ratio FROM (SELECT *, company_id % 100 + 1 AS security_id FROM quarters) o ASOF LEFT JOIN bars b ON b.security_id = o.security_id AND o.published >= b.session")
def c34(spark, d):
    q = g.quarters(spark, d).withColumn("security_id", F.col("company_id") % 100 + 1)
    p = asof.asof_backward(q, g.bars(spark, d).select("security_id", "session", "close"), K, "published", "session", "bar")
    return p.select("company_id", "q", "bar.close", cut(F.try_divide(F.col("bar.close") * F.col("orders"), F.col("revenue"))).alias("ratio"))


@query("c35_split_restatement", "SELECT o_orderkey, floor(o_totalprice / pow(2, count(l_orderkey)) * 10000 + 0.123456) / 10000 AS o_totalprice FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 AND CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) AND CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) + 60 GROUP BY o_orderkey, o_totalprice")
def c35(spark, d):
    day = F.to_date("o_orderdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", day.alias("since"), F.date_add(day, 60).alias("until"))
    sp = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("day"), F.lit(2.0).alias("ratio"))
    return screening.restate_for_splits(o, sp, ["o_orderkey"], "since", "until", "day", "ratio", ["o_totalprice"]).select("o_orderkey", cut(F.col("o_totalprice")).alias("o_totalprice"))


@query("c36_stamp_missing", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) = DATE '1997-03-10' THEN DATE '1997-03-09' WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS signal FROM orders")
def c36(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("signal"))
    stamp = F.when((F.col("day") == F.lit("1997-03-10").cast("date")) & F.col("signal").isNull(), F.lit("1997-03-09").cast("date")).otherwise(F.col("signal"))
    return o.select("o_orderkey", stamp.alias("signal"))


@query("b5_eligible_denominator", "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'F') AND c_nationkey NOT BETWEEN 10 AND 14")
def b5(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return rules.eligible_filers(table(spark, d, "customer"), o, ["c_custkey"], ["O", "F"], "o_orderstatus", F.col("c_nationkey").between(10, 14))


@query("b7_publication_guard", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 10 ELSE last_day(o_orderdate::DATE) + CASE WHEN month(o_orderdate) = 12 THEN 76 WHEN month(o_orderdate) = 6 THEN 56 ELSE 46 END END <= DATE '1998-06-30' AS visible FROM orders")
def b7(spark, d):
    day = F.to_date("o_orderdate")
    published = F.when(F.col("o_orderstatus") == "F", F.date_add(day, 10))
    return table(spark, d, "orders").select("o_orderkey", screening.publication_guard(published, F.last_day(day), F.lit("1998-06-30").cast("date")).alias("visible"))


@query("b9_bucket_ladder", "SELECT c_custkey, CASE WHEN c_acctbal > 6000 AND c_nationkey < 15 THEN 'core' WHEN c_acctbal > 6000 THEN 'quality_shadow' WHEN c_acctbal > 2000 THEN 'non_core' ELSE 'excluded' END AS bucket, CASE WHEN c_acctbal <= 2000 THEN 'low_balance' WHEN c_nationkey >= 15 THEN 'nation' END AS blocker FROM customer")
def b9(spark, d):
    rich, near, some = F.col("c_acctbal") > 6000, F.col("c_nationkey") < 15, F.col("c_acctbal") > 2000
    bucket, blocker = rules.bucket_ladder([("core", rich & near), ("quality_shadow", rich), ("non_core", some)], [(some, "low_balance"), (near, "nation")], "excluded")
    return table(spark, d, "customer").select("c_custkey", bucket.alias("bucket"), blocker.alias("blocker"))


@query("b11_index_aware", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 5000 UNION SELECT c_custkey FROM customer WHERE c_custkey % 13 = 0")
def b11(spark, d):
    types = [F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_acctbal") > 5000]
    return rules.candidate_filter(table(spark, d, "customer"), types, F.col("c_custkey") % 13 == 0).select("c_custkey")


@query("b13_analytical_series", "SELECT company_id, q FROM (SELECT *, max(q) OVER (PARTITION BY company_id) AS m FROM quarters) WHERE q % 4 = 3 OR q = m")
def b13(spark, d):
    return screening.analytical_series(g.quarters(spark, d), ["company_id"], "q", F.col("q") % 4 == 3).select("company_id", "q")


@query("b15_placeholders", "SELECT p_partkey FROM part WHERE NOT (p_name LIKE 'part 1%' OR p_brand LIKE '%3')")
def b15(spark, d):
    return table(spark, d, "part").where(~(F.col("p_name").like("part 1%") | F.col("p_brand").like("%3"))).select("p_partkey")


@query("b16_two_step_match", "SELECT s.s_suppkey, coalesce(a.n, b.n) AS n, CASE WHEN a.n IS NOT NULL THEN 'both' WHEN b.n IS NOT NULL THEN 'one' ELSE 'none' END AS rule FROM supplier s LEFT JOIN (SELECT l_suppkey, l_returnflag, count(*) n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 1 GROUP BY 1, 2) a ON a.l_suppkey = s_suppkey LEFT JOIN (SELECT l_suppkey, count(*) n FROM lineitem WHERE l_quantity < 3 GROUP BY 1) b ON b.l_suppkey = s_suppkey")
def b16(spark, d):
    li = table(spark, d, "lineitem")
    a = li.where("l_returnflag = 'R' AND l_quantity = 1").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("a"))
    b = li.where("l_quantity < 3").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("b"))
    j = table(spark, d, "supplier").select("s_suppkey").join(a, "s_suppkey", "left").join(b, "s_suppkey", "left")
    return j.select("s_suppkey", F.coalesce("a", "b").alias("n"), F.when(F.col("a").isNotNull(), "both").when(F.col("b").isNotNull(), "one").otherwise("none").alias("rule"))


@query("b17_entry_hysteresis", "SELECT security_id, month, turnover >= CASE WHEN security_id % 4 = 0 THEN 200000 ELSE 400000 END AS belongs FROM months")
def b17(spark, d):
    return g.months(spark, d).select("security_id", "month", screening.with_hysteresis(F.col("turnover"), F.col("security_id") % 4 == 0, 400000).alias("belongs"))


@query("b20_optional_filters", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 100 AND c_nationkey IN (1, 2, 3)")
def b20(spark, d):
    c = table(spark, d, "customer")
    return rules.optional_filters(c, {"c_mktsegment": "BUILDING", "c_name": None}, {"c_acctbal": 100}, {"c_nationkey": (1, 2, 3)}).select("c_custkey")


@query("d18_interval_inference", "WITH o AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) a, CAST(max(o_orderdate) AS DATE) b FROM orders GROUP BY 1) SELECT c_custkey, coalesce(a, DATE '1992-01-01') AS active_from, CASE WHEN b < DATE '2000-06-01' THEN b END AS active_to, CASE WHEN c_custkey % 50 = 0 THEN 'manual' WHEN a IS NULL THEN 'assumed' WHEN b < DATE '2000-06-01' THEN 'ended' ELSE 'observed' END AS source FROM customer LEFT JOIN o ON o_custkey = c_custkey")
def d18(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    day = lambda x: F.lit(x).cast("date")
    return rules.listing_intervals(table(spark, d, "customer"), o, ["c_custkey"], "a", "b", day("2000-06-01"), day("1992-01-01"), F.col("c_custkey") % 50 == 0)


@query("d23_yield_and_consistency", "SELECT l_suppkey, round(sum(l_extendedprice * l_discount) FILTER (WHERE l_shipdate >= TIMESTAMP '2000-01-01') / sum(l_extendedprice), 6) AS yield, count(DISTINCT CASE WHEN l_discount > 0.09 THEN year(l_shipdate) END) AS paying_years FROM lineitem GROUP BY 1")
def d23(spark, d):
    paid = F.sum(F.when(F.col("l_shipdate") >= "2000-01-01", F.col("l_extendedprice") * F.col("l_discount")))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(r(paid / F.sum("l_extendedprice")).alias("yield"), F.count_distinct(F.when(F.col("l_discount") > 0.09, F.year("l_shipdate"))).alias("paying_years"))


@query("d29_input_fingerprint")
def d29(spark, d):
    return screening.group_fingerprint(g.quarters(spark, d), ["company_id"], ["q", "revenue", "orders"])


@query("d35_regression", "WITH m AS (SELECT security_id, month, ln(price / lag(price) OVER (PARTITION BY security_id ORDER BY month)) AS ret FROM months) SELECT a.security_id, round(regr_slope(a.ret, b.ret), 5) AS slope, round(regr_intercept(a.ret, b.ret), 5) AS alpha FROM m a JOIN m b USING (month) WHERE b.security_id = 1 GROUP BY 1")
def d35(spark, d):
    m = g.months(spark, d).withColumn("ret", s.log_return("price", K, "month")).select("security_id", "month", "ret")
    b = m.where("security_id = 1").select("month", F.col("ret").alias("bench"))
    return m.join(b, "month").groupBy("security_id").agg(r(F.regr_slope("ret", "bench"), 5).alias("slope"), r(F.regr_intercept("ret", "bench"), 5).alias("alpha"))


@query("d39_sentiment_groups", "WITH e AS (SELECT user_id, event_id, ts, CASE WHEN value > 60 THEN 1 WHEN value < 20 THEN -1 ELSE 0 END AS tone FROM events) SELECT user_id, count(*) FILTER (WHERE tone > 0) AS positive, count(*) FILTER (WHERE tone < 0) AS negative, coalesce(array_to_string(list(event_id ORDER BY ts DESC, event_id) FILTER (WHERE tone > 0)[1:3], ','), '') AS headlines FROM e GROUP BY 1")
def d39(spark, d):
    e = table(spark, d, "events").withColumn("tone", F.when(F.col("value") > 60, 1).when(F.col("value") < 20, -1).otherwise(0))
    return screening.sentiment_groups(e, ["user_id"], "tone", "event_id", "ts", 3)


@query("f9_quarterly_history", "WITH c AS (SELECT unnest(generate_series(DATE '1998-03-31', DATE '1999-12-31', INTERVAL 3 MONTH))::DATE AS qe), k AS (SELECT DISTINCT security_id, last_day(qe) AS qe FROM bars, c), j AS (SELECT k.security_id, k.qe, b.session, b.close FROM k ASOF JOIN bars b ON b.security_id = k.security_id AND k.qe >= b.session) SELECT security_id, session, any_value(close) AS close FROM j GROUP BY 1, 2")
def f9(spark, d):
    b = g.bars(spark, d).select("security_id", "session", "close")
    ends = F.transform(F.sequence(F.lit("1998-03-01").cast("date"), F.lit("1999-12-01").cast("date"), F.expr("INTERVAL 3 MONTH")), F.last_day)
    keys = b.select("security_id").distinct().withColumn("qe", F.explode(ends))
    return asof.asof_backward(keys, b, K, "qe", "session").where("match IS NOT NULL").select("security_id", "match.session", "match.close").dropDuplicates(["security_id", "session"])


@query("f11_composite_ranking", "SELECT security_id, round(avg(turnover) / 1000 + avg(bars), 4) AS score FROM months GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def f11(spark, d):
    m = g.months(spark, d).groupBy("security_id").agg(r(F.avg("turnover") / 1000 + F.avg("bars"), 4).alias("score"))
    return m.orderBy(F.desc("score"), "security_id").limit(10)


@query("g8_fallback_merge", "WITH a AS (SELECT o_custkey, max(o_totalprice) v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey, max(o_totalprice) v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.o_custkey = b.o_custkey")
def g8(spark, d):
    side = lambda st: table(spark, d, "orders").where(F.col("o_orderstatus") == st).groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return screening.fallback_merge(side("P"), side("F"), ["o_custkey"], "v")


@query("h5_tickers", "SELECT p_partkey, replace(upper(trim(p_brand)), '.', '-') AS ticker FROM part")
def h5(spark, d):
    return table(spark, d, "part").select("p_partkey", sc.normalize_ticker(F.col("p_brand")).alias("ticker"))


def _sessions_sql(step: int) -> str:
    return f"""WITH s AS (SELECT session, row_number() OVER (ORDER BY session) n FROM (SELECT DISTINCT session FROM bars)), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
b AS (SELECT o.day, s.n FROM o ASOF LEFT JOIN s ON o.day >= s.session) SELECT o_orderkey, s.session AS due FROM orders LEFT JOIN b ON b.day = CAST(o_orderdate AS DATE) LEFT JOIN s ON s.n = b.n + {step}"""


def _due(spark, d, step):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return screening.sessions_after(o, g.bars(spark, d).select("session").distinct(), "day", "session", step, "due").select("o_orderkey", "due")


@query("h12_sessions_after", _sessions_sql(5))
def h12(spark, d):
    return _due(spark, d, 5)


@query("h12_all_sessions_after", _sessions_sql(21))
def h12_all(spark, d):
    return _due(spark, d, 21)


@query("h12_sessions_before", _sessions_sql(-5))
def h12_before(spark, d):
    return _due(spark, d, -5)


@query("h13_grouped_numbers", "SELECT o_orderkey, o_totalprice AS number FROM orders")
def h13(spark, d):
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return table(spark, d, "orders").select("o_orderkey", sc.parse_grouped_number(text).alias("number"))


@query("h20_flag_lists", "SELECT c_custkey, c_acctbal < 0 AS debt, c_nationkey > 20 AS far FROM customer")
def h20(spark, d):
    flags = F.to_json(F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "debt"), F.when(F.col("c_nationkey") > 20, "far"))))
    back = F.from_json(flags, "array<string>")
    return table(spark, d, "customer").select("c_custkey", F.array_contains(back, "debt").alias("debt"), F.array_contains(back, "far").alias("far"))


@query("i9_composite_with_veto", """WITH k AS (SELECT * FROM months WHERE bars > 2), a AS (SELECT *, (rank() OVER (PARTITION BY month ORDER BY price) + (count(*) OVER (PARTITION BY month, price) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY month) AS p1, (rank() OVER (PARTITION BY month ORDER BY turnover) + (count(*) OVER (PARTITION BY month, turnover) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY month) AS p2 FROM k), c AS (SELECT *, round((p1 * 0.6 + p2 * 0.4) / 1.0, 9) AS comp FROM a)
SELECT security_id, month, round((rank() OVER (PARTITION BY month ORDER BY comp) + (count(*) OVER (PARTITION BY month, comp) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY month), 6) AS score FROM c""")
def i9(spark, d):
    out = screening.composite_with_veto(g.months(spark, d), ["month"], [("price", 0.6), ("turnover", 0.4)], F.col("bars") <= 2)
    return out.select("security_id", "month", r(F.col("score")).alias("score"))


@query("i11_value_metrics", "SELECT company_id, q, CASE WHEN revenue > 0 THEN floor(orders / revenue * 100000000 + 0.123456) / 100000000 END AS yield FROM quarters")
def i11(spark, d):
    return g.quarters(spark, d).select("company_id", "q", cut(sc.safe_ratio(F.col("orders"), F.col("revenue")), 8).alias("yield"))


@query("i24_red_flags", "SELECT a.company_id, a.q, concat_ws(',', CASE WHEN b.revenue IS NULL OR NOT a.revenue >= 0.5 * b.revenue THEN 'shrinking' END, CASE WHEN NOT a.orders > 1 THEN 'thin' END) AS flags FROM quarters a LEFT JOIN quarters b ON b.company_id = a.company_id AND b.q = a.q - 4")
def i24(spark, d):
    p = fundamentals.prior_year(g.quarters(spark, d), ["company_id"], "q", ["revenue"])
    flags = sc.reasons([(F.col("revenue") >= 0.5 * F.col("prior_revenue"), "shrinking"), (F.col("orders") > 1, "thin")])
    return p.select("company_id", "q", F.array_join(flags, ",").alias("flags"))


# Suppliers under seven gates as of a day: their documents, shipments (as splits, filings, instruments, suspensions, changes of name) and yearly volumes are the sources.
_GATES = """WITH li AS (SELECT *, l_suppkey AS e, CAST(l_shipdate AS DATE) AS t, DATE '1998-06-30' AS upto FROM lineitem),
doc AS (SELECT doc_id, doc_id % 90 + 1 AS e, DATE '1998-01-01' + CAST(doc_id % 300 AS INTEGER) AS t, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS p FROM documents),
piece AS (SELECT doc_id, unnest(string_split(p, 'that')) AS x, generate_subscripts(string_split(p, 'that'), 1) AS k FROM doc),
pos AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id) AS n, sum(length(x) + 4) OVER (PARTITION BY doc_id ORDER BY k) - 3 AS i FROM piece),
span AS (SELECT doc_id, substr(p, CAST(greatest(i - 60, 1) AS BIGINT), CAST(i + 64 - greatest(i - 60, 1) AS BIGINT)) AS x FROM pos JOIN doc USING (doc_id) WHERE k < n),
hit AS (SELECT DISTINCT doc_id FROM span WHERE contains(x, 'with') AND NOT contains(x, 'this')),
latest AS (SELECT e, max((t, CAST(doc_id AS VARCHAR))) AS w FROM doc WHERE t <= DATE '1998-06-30' GROUP BY 1),
split AS (SELECT e, t, upto, CASE WHEN l_quantity >= 48 THEN 0.5 ELSE 2.0 END AS ratio FROM li WHERE l_linenumber = 4),
cover AS (SELECT e, max(CASE WHEN l_partkey % 997 = 5 THEN CAST(l_orderkey AS VARCHAR) END) AS ever, max((t, CAST(l_orderkey AS VARCHAR), l_quantity > 45)) FILTER (l_linenumber = 1) AS w FROM li WHERE t <= upto GROUP BY 1),
closing AS (SELECT security_id AS e, max_by(close, session) AS c FROM bars WHERE session <= DATE '1998-06-30' GROUP BY 1),
recent AS (SELECT e, max(t) AS s, any_value(upto) AS upto FROM split WHERE t <= upto AND ratio < 1 GROUP BY 1),
kinds AS (SELECT e, greatest(min(t) FILTER (l_returnflag = 'A') + 0, CASE WHEN count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0 THEN min(t) FILTER (l_returnflag = 'R') END) AS g,
 count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0 AS two, max(t) FILTER (l_returnflag = 'N') AS c FROM li WHERE t <= upto AND l_partkey % 50 = 1 GROUP BY 1),
tool AS (SELECT e, max((CASE WHEN l_linenumber = 1 THEN 2 WHEN t + CAST(l_quantity * 10 AS INTEGER) > upto AND l_returnflag = 'A' THEN 3 ELSE 0 END, CAST(l_orderkey AS VARCHAR))) AS w FROM li WHERE t <= upto AND l_partkey % 100 = 3 GROUP BY 1),
held AS (SELECT e, max(t) AS h FROM li WHERE t <= upto AND l_partkey % 100 = 7 AND (l_linenumber = 2 OR t + 10 > upto) GROUP BY 1),
named AS (SELECT e, count(*) FILTER (t >= upto - INTERVAL 36 MONTH) AS k, max(t) AS m FROM li WHERE t <= upto AND l_partkey % 100 = 11 GROUP BY 1),
yearly AS (SELECT e, max(t) AS t, any_value(upto) AS upto, sum(l_quantity) AS q FROM li GROUP BY e, year(t)),
steps AS (SELECT *, lag(q) OVER (PARTITION BY e ORDER BY t) AS pq, lag(t) OVER (PARTITION BY e ORDER BY t) AS pt FROM yearly WHERE t <= upto),
jumps AS (SELECT e, max(t) AS j FROM steps s WHERE q > pq * 1.2 AND NOT EXISTS (SELECT 1 FROM split x WHERE x.e = s.e AND x.ratio < 1 AND x.t > s.pt AND x.t <= s.t) GROUP BY 1),
raw(entity, gate, severity, evidence) AS (SELECT e, 'going_concern', CASE WHEN struct_extract(w, 2) IN (SELECT CAST(doc_id AS VARCHAR) FROM hit) THEN 3 ELSE 0 END, struct_extract(w, 2) FROM latest
UNION ALL SELECT e, 'shell', CASE WHEN ever IS NOT NULL OR coalesce(struct_extract(w, 3), FALSE) THEN 3 ELSE 0 END, coalesce(ever, struct_extract(w, 2)) FROM cover
UNION ALL SELECT e, 'listing_risk', CASE WHEN c < 1500 AND s >= upto - INTERVAL 12 MONTH THEN 3 WHEN s >= upto - INTERVAL 24 MONTH THEN 1 ELSE 0 END, CAST(s AS VARCHAR) FROM closing LEFT JOIN recent USING (e)
UNION ALL SELECT e, 'atm_dilution', CASE WHEN NOT two THEN 0 WHEN c >= g THEN 3 ELSE 1 END, CAST(g AS VARCHAR) FROM kinds
UNION ALL SELECT e, 'variable_price', struct_extract(w, 1), struct_extract(w, 2) FROM tool
UNION ALL SELECT e, 'enforcement', CASE WHEN h IS NOT NULL THEN 3 WHEN k >= 2 THEN 1 ELSE 0 END, CAST(coalesce(h, m) AS VARCHAR) FROM held FULL JOIN named USING (e)
UNION ALL SELECT s.e, 'data_integrity', CASE WHEN any_value(j) IS NOT NULL OR any_value(upto) - max(t) > 185 THEN 2 ELSE 0 END, CAST(coalesce(any_value(j), max(t)) AS VARCHAR) FROM steps s LEFT JOIN jumps USING (e) GROUP BY 1),
known AS (SELECT r.entity, gate, severity, CASE WHEN severity > 0 THEN evidence END AS evidence FROM raw r JOIN supplier ON s_suppkey = r.entity),
need AS (SELECT s_suppkey AS entity, m.i, m.g FROM supplier, (VALUES (1, 'going_concern'), (2, 'shell'), (3, 'listing_risk'), (4, 'data_integrity')) m(i, g)),
gates AS (SELECT * FROM known UNION ALL SELECT entity, 'evidence_completeness', 2, 'missing-evidence:' || string_agg(g, ',' ORDER BY i) FROM need WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.entity = need.entity AND gate = g) GROUP BY 1)"""


def _gate_rows(spark, d):
    at, order = F.lit("1998-06-30").cast("date"), F.col("l_orderkey").cast("string")
    li = table(spark, d, "lineitem").withColumn("e", F.col("l_suppkey")).withColumn("t", F.to_date("l_shipdate"))
    splits = li.where("l_linenumber = 4").select("e", F.col("t").alias("s"), F.when(F.col("l_quantity") >= 48, 0.5).otherwise(2.0).alias("ratio"))
    docs = table(spark, d, "documents").select((F.col("doc_id") % 90 + 1).alias("e"), "text", F.col("doc_id").cast("string").alias("why"), F.expr("date_add(DATE '1998-01-01', CAST(doc_id % 300 AS INT))").alias("t"))
    covers = li.select("e", "t", order.alias("why"), (F.col("l_partkey") % 997).alias("code"), F.when(F.col("l_linenumber") == 1, F.col("l_quantity") > 45).alias("flag"))
    closes = g.bars(spark, d).select(F.col("security_id").alias("e"), "session", "close")
    tools = li.where("l_partkey % 100 = 3").select("e", "t", F.expr("CASE WHEN l_linenumber <> 1 THEN date_add(t, CAST(l_quantity * 10 AS INT)) END").alias("due"), (F.col("l_returnflag") == "A").alias("sure"), order.alias("why"))
    held = li.where("l_partkey % 100 = 7").select("e", "t", F.expr("CASE WHEN l_linenumber <> 2 THEN date_add(t, 10) END").alias("until"))
    yearly = li.groupBy("e", F.year("t").alias("y")).agg(F.max("t").alias("t"), F.sum("l_quantity").alias("q")).drop("y")
    gates = [
        hygiene.going_concern(docs, "e", "text", "why", "t", at, subject="that", doubt="with", negations=("this",), window=60),
        hygiene.shell(covers, "e", "code", "flag", "why", "t", at, 5),
        hygiene.listing_risk(closes, splits, "e", "session", "close", "s", "ratio", at, 1500.0),
        hygiene.atm_dilution(li.where("l_partkey % 50 = 1"), "e", "l_returnflag", "t", at, "A", "R", "N"),
        hygiene.variable_price(tools, "e", "t", "due", "sure", "why", at),
        hygiene.enforcement(held, li.where("l_partkey % 100 = 11"), "e", "t", "until", "t", at),
        hygiene.data_integrity(yearly, splits.where("ratio < 1"), "e", "t", "q", "s", at, 0.2, 185),
    ]
    return hygiene.evidence_rows(table(spark, d, "supplier"), "s_suppkey", gates)


@query("i25_hygiene_gates", f"{_GATES} SELECT * FROM gates")
def i25_gates(spark, d):
    return _gate_rows(spark, d)


@query("i25_hygiene_verdicts", f"""{_GATES}, placed AS (SELECT *, list_position(['evidence_completeness', 'going_concern', 'shell', 'listing_risk', 'atm_dilution', 'variable_price', 'enforcement', 'data_integrity'], gate) AS i FROM gates)
SELECT entity, max(severity) AS severity, CASE WHEN max(severity) > 0 THEN max_by(gate, severity * 100 - i) END AS gate, CASE WHEN max(severity) > 0 THEN max_by(evidence, severity * 100 - i) END AS evidence,
coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (severity > 0), '') AS firing, max(severity) >= 2 AS blocked FROM placed GROUP BY 1""")
def i25_verdicts(spark, d):
    return hygiene.verdicts(_gate_rows(spark, d))


@query("i25_worst_verdict", "WITH v AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS gate, max(CASE WHEN l_quantity > 45 THEN 3 WHEN l_quantity > 35 THEN 1 ELSE 0 END) AS sev FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, greatest(max(sev), CASE WHEN count(*) < 3 THEN 2 ELSE 0 END) AS severity, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (WHERE sev > 0), '') AS firing FROM v GROUP BY 1")
def i25(spark, d):
    sev = F.max(F.when(F.col("l_quantity") > 45, 3).when(F.col("l_quantity") > 35, 1).otherwise(0))
    v = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("gate")).agg(sev.alias("severity"))
    return screening.worst_verdict(v, ["l_orderkey"], "severity", "gate", 3)


@query("i37_exit_reasons", "SELECT o_orderkey, CASE WHEN p <= 50 THEN 'stop' WHEN p >= 3000 THEN 'target' WHEN o_orderstatus = 'P' THEN 'outflow' WHEN CAST(DATE '2000-01-01' - CAST(o_orderdate AS DATE) AS INT) > 1000 THEN 'age' END AS reason FROM (SELECT *, o_totalprice / 100 AS p FROM orders)")
def i37(spark, d):
    age = F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate"))
    reason = screening.exit_reason(F.col("o_totalprice") / 100, F.lit(50), F.lit(3000), age, 1000, F.when(F.col("o_orderstatus") == "P", -1).otherwise(0))
    return table(spark, d, "orders").select("o_orderkey", reason.alias("reason"))


@query("i46_walk_forward_panel", "WITH a AS (SELECT *, lag(price, 1) OVER w / lag(price, 12) OVER w - 1 AS mom FROM months WINDOW w AS (PARTITION BY security_id ORDER BY month)), l AS (SELECT *, row_number() OVER (PARTITION BY month, sector ORDER BY turnover DESC, security_id) AS n FROM a WHERE bars >= 3 AND mom IS NOT NULL) SELECT security_id, month, round((rank() OVER (PARTITION BY month ORDER BY mom) + (count(*) OVER (PARTITION BY month, mom) - 1) / 2.0) / count(*) OVER (PARTITION BY month), 6) AS momentum_rank FROM l WHERE n = 1")
def i46(spark, d):
    m = g.months(spark, d).withColumn("mom", s.momentum("price", K, "month", 1, 12)).where("bars >= 3 AND mom IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("month", "sector").orderBy(F.desc("turnover"), "security_id"))
    one = m.withColumn("n", n).where("n = 1")
    return one.select("security_id", "month", r(x.rank_share("mom", ["month"])).alias("momentum_rank"))


@query("i49_parameter_ladder", "SELECT e.user_id, e.event_id, coalesce(CASE WHEN value > 50 THEN value END, CASE WHEN event_type = 'view' THEN 10.0 END, 5.0) AS rate, CASE WHEN value > 50 THEN 'observed' WHEN event_type = 'view' THEN 'proxy' ELSE 'default' END AS source FROM events e")
def i49(spark, d):
    a, b = F.when(F.col("value") > 50, F.col("value")), F.when(F.col("event_type") == "view", 10.0)
    rate, source = rules.first_known([(a, "observed"), (b, "proxy")], "default", F.lit(5.0))
    return table(spark, d, "events").select("user_id", "event_id", rate.alias("rate"), source.alias("source"))


@query("i57_score_bundle", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_acctbal END, CASE WHEN c_nationkey < 5 THEN c_nationkey * 1.0 END) AS score, CASE WHEN c_acctbal > 5000 THEN 'native' WHEN c_nationkey < 5 THEN 'fallback' ELSE 'none' END AS label FROM customer")
def i57(spark, d):
    a, b = F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")), F.when(F.col("c_nationkey") < 5, F.col("c_nationkey") * 1.0)
    score, label = rules.first_known([(a, "native"), (b, "fallback")], "none")
    return table(spark, d, "customer").select("c_custkey", score.alias("score"), label.alias("label"))
