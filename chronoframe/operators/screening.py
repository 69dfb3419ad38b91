"""Matching of names, evidence with gaps, verdicts, buckets, and exits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_backward
from .components import connected_components


def match_names(listing: DataFrame, known: DataFrame, row_id: str, name: str, known_name: str, entity: str, normal) -> DataFrame:
    """``(row_id, entity, status)``: unique, ambiguous, unmatched or blank under the normal form of a name."""
    left = listing.select(row_id, normal(F.col(name)).alias("_n"))
    right = known.select(normal(F.col(known_name)).alias("_n"), entity).where("_n <> ''").groupBy("_n").agg(F.count_distinct(entity).alias("_k"), F.min(entity).alias(entity))
    j = left.join(right, "_n", "left")
    status = F.when(F.coalesce(F.col("_n"), F.lit("")) == "", "blank").when(F.col("_k").isNull(), "unmatched").when(F.col("_k") == 1, "unique").otherwise("ambiguous")
    return j.select(row_id, F.when(F.col("_k") == 1, F.col(entity)).alias(entity), status.alias("status"))


def evidence_gaps(base: DataFrame, key: Sequence[str], parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``base`` left-joined with one frame a part, and ``gaps``: the parts that a key lacks, joined."""
    out = base
    for name, part in parts:
        out = out.join(part.withColumn(f"_has_{name}", F.lit(True)), list(key), "left")
    gaps = F.array_compact(F.array(*(F.when(F.col(f"_has_{n}").isNull(), F.lit(n)) for n, _ in parts)))
    return out.withColumn("gaps", F.array_join(gaps, ",")).drop(*(f"_has_{n}" for n, _ in parts))


def worst_verdict(gates: DataFrame, key: Sequence[str], severity: str, gate: str, expected: int) -> DataFrame:
    """``(key, severity, firing)``: the worst of a key's gate verdicts; quarantine (2) at least if one of the expected gates is missing."""
    firing = F.array_join(F.array_sort(F.collect_list(F.when(F.col(severity) > 0, F.col(gate)))), ",")
    worst = F.greatest(F.max(severity), F.when(F.count_distinct(gate) < expected, 2).otherwise(0))
    return gates.groupBy(*key).agg(worst.alias(severity), firing.alias("firing"))


def composite_with_veto(df: DataFrame, part: Sequence[str], sleeves: Sequence[tuple[str, float]], veto: Column) -> DataFrame:
    """Weighted mean of sleeve percentiles of rows that are not vetoed, ranked again; a missing sleeve excludes a row."""
    from .cross_section import midrank_percentile, weighted_mean

    kept = df.where(~F.coalesce(veto, F.lit(True)))
    for s, _ in sleeves:
        kept = kept.withColumn(f"rank_{s}", midrank_percentile(s, part))
    whole = F.lit(True)
    for s, _ in sleeves:
        whole = whole & F.col(f"rank_{s}").isNotNull()
    mean = weighted_mean([(F.col(f"rank_{s}"), w) for s, w in sleeves])
    return kept.withColumn("composite", F.when(whole, F.round(mean, 9))).withColumn("score", midrank_percentile("composite", part))


def publication_guard(published: Column, period_end: Column, at: Column) -> Column:
    """Whether a statement counts at a time: by its date, else 76 days after a year's end, 56 after a half, 46 after other quarters."""
    lag = F.when(F.month(period_end) == 12, 76).when(F.month(period_end) == 6, 56).otherwise(46)
    return F.coalesce(published, F.date_add(period_end, lag)) <= at


def analytical_series(df: DataFrame, key: Sequence[str], period: str, annual: Column) -> DataFrame:
    """Annual rows and each key's newest row."""
    newest = F.max(period).over(Window.partitionBy(*key))
    return df.withColumn("_new", newest).where(annual | (F.col(period) == F.col("_new"))).drop("_new")


def with_hysteresis(value: Column, member: Column, bar: float, share: float = 0.5) -> Column:
    """Whether a row clears the bar; members clear a share of it."""
    return value >= F.when(member, bar * share).otherwise(bar)


def exit_reason(price: Column, stop: Column, target: Column, held_days: Column, limit: int, flow: Column) -> Column:
    """The first reason to leave a position: stop, target, outflow, age; null to stay."""
    return F.when(price <= stop, "stop").when(price >= target, "target").when(flow < 0, "outflow").when(held_days > limit, "age")


def restate_for_splits(positions: DataFrame, splits: DataFrame, key: Sequence[str], since: str, until: str, day: str, ratio: str, prices: Sequence[str]) -> DataFrame:
    """Price fields divided by the splits of the key in ``(since, until]``; positions without one stay."""
    s = splits.select(*(F.col(k).alias(f"_{k}") for k in key), F.col(day).alias("_d"), F.col(ratio).alias("_r"))
    on = (F.col("_d") > F.col(since)) & (F.col("_d") <= F.col(until))
    for k in key:
        on = (positions[k] == F.col(f"_{k}")) & on
    columns = positions.columns
    joined = positions.join(s, on, "left").groupBy(*columns).agg(F.product(F.coalesce("_r", F.lit(1.0))).alias("_f"))
    return joined.select(*(((F.col(c) / F.col("_f")) if c in prices else F.col(c)).alias(c) for c in columns))


def fallback_merge(primary: DataFrame, second: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The first source's value of each key, else the second's."""
    both = primary.select(*key, F.col(value).alias("_a")).join(second.select(*key, F.col(value).alias("_b")), list(key), "full_outer")
    return both.select(*key, F.coalesce("_a", "_b").alias(value))


def group_fingerprint(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(group, fingerprint)``: an order-free hash of each group's rows."""
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.groupBy(*group).agg(F.sum(row).cast("string").alias("fingerprint"))


def sessions_after(df: DataFrame, sessions: DataFrame, time: str, session: str, n: int, out: str) -> DataFrame:
    """The session ``n`` after a date (before it, if negative), by numbers of a calendar of one row a session.

    Dates meet the calendar as of the latest session; a date before the first one has none.
    """
    numbered = sessions.withColumn("_n", F.row_number().over(Window.orderBy(session))).withColumn("_all", F.lit(1))
    dates = df.select(time).where(F.col(time).isNotNull()).distinct().withColumn("_all", F.lit(1))
    base = asof_backward(dates, numbered, ["_all"], time, session, "_at").select(time, (F.col("_at._n") + n).alias("_n"))
    due = base.join(numbered.select("_n", F.col(session).alias(out)), "_n", "left").select(time, out)
    return df.join(due, time, "left")


def reconcile_identities(rows: DataFrame, entity: str, alike: Sequence[str]) -> DataFrame:
    """``rows`` with column ``entity``: the least name of all that agree with a row's name, by chains, in ``alike``.

    Names that one group holds are joined to its least one, so a group gives no pairs. Null names stand
    for themselves; rows with a null in ``alike`` join nothing. Names are longs.
    """
    known = rows.where(F.col(entity).isNotNull())
    for c in alike:
        known = known.where(F.col(c).isNotNull())
    least = known.groupBy(*alike).agg(F.min(entity).alias("v"))
    edges = known.select(F.col(entity).alias("u"), *alike).join(least, list(alike)).select("u", "v").where("u <> v").distinct()
    names = connected_components(edges).select(F.col("node").alias(entity), F.col("root").alias("_root"))
    return rows.join(names, entity, "left").withColumn("entity", F.coalesce("_root", entity)).drop("_root")


def sentiment_groups(df: DataFrame, key: Sequence[str], tone: str, text: str, time: str, top: int) -> DataFrame:
    """``(key, positive, negative, headlines)``: counts, and the newest ``top`` positive texts."""
    rows = F.array_sort(F.collect_list(F.when(F.col(tone) > 0, F.struct((-F.unix_micros(F.col(time).cast("timestamp"))).alias("t"), F.col(text).alias("x")))))
    g = df.groupBy(*key).agg(F.count_if(F.col(tone) > 0).alias("positive"), F.count_if(F.col(tone) < 0).alias("negative"), F.slice(rows, 1, top).alias("_h"))
    return g.select(*key, "positive", "negative", F.array_join(F.transform("_h", lambda h: h["x"].cast("string")), ",").alias("headlines"))


def replace_correlated(chosen: DataFrame, pairs: DataFrame, score: str, entity: str, most: float) -> DataFrame:
    """``chosen`` and ``dropped``: the weaker of each pair that correlates over ``most``; equal scores drop the greater id."""
    a = chosen.select(F.col(entity).alias("a"), F.col(score).alias("_sa"))
    b = chosen.select(F.col(entity).alias("b"), F.col(score).alias("_sb"))
    high = pairs.where(F.col("corr") > most).join(a, "a").join(b, "b")
    weak = high.select(F.when(F.col("_sa") < F.col("_sb"), F.col("a")).otherwise(F.col("b")).alias(entity)).distinct()
    return chosen.join(weak.withColumn("dropped", F.lit(True)), entity, "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


def single_regime(candidates: DataFrame, key: Sequence[str], facts: DataFrame, entity: str, holds: Column) -> DataFrame:
    """``(key, regime)``: all, some or none of a row's candidates satisfy a condition; unknown where none has facts."""
    j = candidates.join(facts, entity, "left")
    known = F.count(holds)
    return j.groupBy(*key).agg(F.when(known == 0, "unknown").when(F.count_if(holds) == known, "all").when(F.count_if(holds) > 0, "some").otherwise("none").alias("regime"))


def conviction(parts: Sequence[tuple[Column, float]], penalty: Column) -> Column:
    """A weighted score less a penalty, within 0..100."""
    from .cross_section import weighted_mean

    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), weighted_mean(parts) - penalty))
