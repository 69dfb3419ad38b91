"""Eligibility, ladders, bundles and comparisons that screens are made of, with their columns as parameters.

A rule is a boolean column; an unknown rule does not hold. Nothing here shuffles but the joins and
groupings that a docstring names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import bounded


def _holds(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def first_reason(ladder: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Name of the first rule of a ladder that holds."""
    out = F.lit(otherwise)
    for rule, name in reversed(ladder):
        out = F.when(_holds(rule), name).otherwise(out)
    return out


def bucket_ladder(rungs: Sequence[tuple[str, Column]], gates: Sequence[tuple[Column, str]], otherwise: str) -> tuple[Column, Column]:
    """The first rung whose rule holds, and the first gate that blocks (null if none does)."""
    return first_reason([(rule, name) for name, rule in rungs], otherwise), first_reason([(~_holds(ok), name) for ok, name in gates])


def profitability_blocker(income: Column, earnings: Column) -> Column:
    """A loss together with owner earnings that are not positive; unknown figures do not block."""
    return _holds(income < 0) & _holds(earnings <= 0)


def eligible_filers(entities: DataFrame, filings: DataFrame, key: Sequence[str], forms: Sequence[str], form: str, excluded: Column) -> DataFrame:
    """Keys of the entities that are not excluded and have filed one of the forms: a semi join on the key."""
    return entities.where(~_holds(excluded)).join(filings.where(F.col(form).isin(*forms)), list(key), "left_semi").select(*key).distinct()


def candidate_filter(df: DataFrame, rules: Sequence[Column], always: Column | None = None) -> DataFrame:
    """Rows for which all rules hold, and those that are admitted always (members, say)."""
    every = F.lit(True)
    for rule in rules:
        every = every & _holds(rule)
    return df.where(every if always is None else every | _holds(always))


def optional_filters(df: DataFrame, equal: dict[str, object] | None = None, least: dict[str, float] | None = None, among: dict[str, Sequence] | None = None, text: dict[str, str] | None = None) -> DataFrame:
    """``df`` under those filters whose parameter is not None; text is sought in lower case."""
    for c, v in (equal or {}).items():
        df = df if v is None else df.where(F.col(c) == F.lit(v))
    for c, v in (least or {}).items():
        df = df if v is None else df.where(F.col(c) >= F.lit(v))
    for c, v in (among or {}).items():
        df = df if v is None else df.where(F.col(c).isin(*v))
    for c, v in (text or {}).items():
        df = df if v is None else df.where(F.contains(F.lower(c), F.lit(v.lower())))
    return df


def first_known(sources: Sequence[tuple[Column, str]], otherwise: str, default: Column | None = None) -> tuple[Column, Column]:
    """The first source that has a value, and its label; else the default under the label ``otherwise``."""
    values = [v for v, _ in sources] + ([default] if default is not None else [])
    return F.coalesce(*values), first_reason([(v.isNotNull(), name) for v, name in sources], otherwise)


def stress_points(steps: Sequence[tuple[Column, Sequence[tuple[float, int]]]]) -> Column:
    """Sum of the points of several measures; a measure under a limit gets that limit's points, the lowest limit first."""
    total = F.lit(0)
    for value, limits in steps:
        total = total + F.coalesce(first_points(value, limits), F.lit(0))
    return total


def first_points(value: Column, limits: Sequence[tuple[float, int]]) -> Column:
    out = F.lit(0)
    for limit, points in sorted(limits, reverse=True):
        out = F.when(value < limit, points).otherwise(out)
    return F.when(value.isNotNull(), out)


def compare_keys(left: DataFrame, right: DataFrame, key: Sequence[str], value: str, tolerance: float = 0.0, names: tuple[str, str, str] = ("missing_left", "missing_right", "value_mismatch")) -> DataFrame:
    """``(key, kind)`` of keys that one side lacks or whose values differ: a full outer join on the key, one row a side."""
    a = left.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    differ = ~F.col("_a").eqNullSafe(F.col("_b")) & ~_holds(F.abs(F.col("_a") - F.col("_b")) <= tolerance)
    kind = F.when(F.col("_in_a").isNull(), names[0]).when(F.col("_in_b").isNull(), names[1]).when(differ, names[2])
    return a.join(b, list(key), "full_outer").select(*key, kind.alias("kind")).where("kind IS NOT NULL")


def sum_of_parts(parents: DataFrame, holdings: DataFrame, parent: str, holding: str, stake: str, worth: str) -> DataFrame:
    """``(parent, nav, quality)``: sum of stakes times worth, and its mean over the stakes; holdings meet their parent by ``holding``."""
    held = parents.select(parent, holding).join(holdings.select(holding, F.col(stake).alias("_s"), F.col(worth).alias("_w")), holding)
    nav = F.sum(F.col("_s") * F.col("_w"))
    return held.groupBy(parent).agg(nav.alias("nav"), F.try_divide(nav, F.sum("_s")).alias("quality"))


def coverage_matrix(entities: DataFrame, providers: DataFrame, key: Sequence[str], name: str, own: Column, fallback: Column, most: int = 1000) -> DataFrame:
    """``(key, name, cell)``: every entity beside every provider, with its own cell or the provider's.

    Providers are a dimension of at most ``most`` rows, which is asked before they are broadcast.
    """
    cells = entities.crossJoin(bounded(providers, most, "providers"))
    return cells.select(*key, name, F.coalesce(own, fallback).alias("cell"))


def enriched(candidates: DataFrame, known: DataFrame, key: Sequence[str], columns: Sequence[str], rules: Sequence[Column]) -> DataFrame:
    """Candidates for which all rules hold, with columns of what is known of their key; unknown keys go."""
    return candidate_filter(candidates, rules).join(known.select(*key, *columns), list(key))


def admitted_or_gap(rows: DataFrame, admitted: DataFrame, pair: Sequence[str]) -> DataFrame:
    """``rows`` with ``status``: admitted if their pair of columns is, else gap; one left join on the pair."""
    known = admitted.select(*pair).distinct().withColumn("_in", F.lit(True))
    return rows.join(known, list(pair), "left").withColumn("status", F.when(F.col("_in"), "admitted").otherwise("gap")).drop("_in")


def merged_provenance(sources: Sequence[DataFrame], key: str, pointer: str) -> DataFrame:
    """``(key, pointers)``: the sorted distinct pointers of all sources that name a key, joined; lists are bounded by a key's pointers."""
    every = None
    for s in sources:
        s = s.select(key, pointer)
        every = s if every is None else every.unionByName(s)
    return every.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(pointer)), ",").alias("pointers"))


def match_candidates(candidates: DataFrame, known: DataFrame, row_id: str, ticker: str, name: str, entity: str, normal, stem) -> DataFrame:
    """``(row_id, entity, how)``: candidates matched by exact ticker, else by exact name, else by name stem; only unique matches count.

    Three joins on the normal forms; known names that several entities share match nothing.
    """
    forms = [("ticker", lambda d: F.upper(F.trim(d[ticker]))), ("name", lambda d: normal(d[name])), ("stem", lambda d: stem(d[name]))]
    out = candidates.select(row_id, ticker, name)
    for how, form in forms:
        one = known.select(form(known).alias(f"_{how}"), entity).where(f"_{how} <> ''").groupBy(f"_{how}").agg(F.count_distinct(entity).alias("_k"), F.min(entity).alias(f"_by_{how}")).where("_k = 1").drop("_k")
        out = out.withColumn(f"_{how}", form(out)).join(one, f"_{how}", "left").drop(f"_{how}")
    found, label = first_known([(F.col(f"_by_{how}"), how) for how, _ in forms], "none")
    return out.select(row_id, found.alias(entity), label.alias("how"))


def listing_intervals(entities: DataFrame, observed: DataFrame, key: Sequence[str], first: str, last: str, live_since: Column, default_start: Column, manual: Column) -> DataFrame:
    """``(key, active_from, active_to, source)``: intervals inferred from the first and last day seen.

    Without a day the default start is assumed; what was last seen before ``live_since`` has ended;
    manual ones are labelled so whatever was seen.
    """
    seen = observed.select(*key, F.col(first).alias("_a"), F.col(last).alias("_b"))
    ended = F.col("_b") < live_since
    source = first_reason([(manual, "manual"), (F.col("_a").isNull(), "assumed"), (ended, "ended")], "observed")
    j = entities.join(seen, list(key), "left")
    return j.select(*key, F.coalesce("_a", default_start).alias("active_from"), F.when(ended, F.col("_b")).alias("active_to"), source.alias("source"))


def dominant(df: DataFrame, key: Sequence[str], entity: str, least: int = 5, ratio: float = 3.0) -> DataFrame:
    """``(key, entity, hits)`` where one entity has ``least`` hits or more and ``ratio`` times as many as the next."""
    hits = df.groupBy(*key, entity).agg(F.count("*").alias("hits"))
    w = Window.partitionBy(*key).orderBy(F.desc("hits"), entity)
    ranked = hits.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("hits").over(w), F.lit(0)))
    return ranked.where((F.col("_n") == 1) & (F.col("hits") >= least) & (F.col("hits") >= ratio * F.col("_next"))).select(*key, entity, "hits")


def score_change(key: Sequence[str], time: str, parts: Sequence[tuple[str, float]], steady: str = "stable") -> Column:
    """Names of the parts that moved by more than their limit since the row before, joined; null without one."""
    w = Window.partitionBy(*key).orderBy(time)
    moved = [F.when(F.abs(F.col(c) - F.lag(c).over(w)) > limit, c) for c, limit in parts]
    names = F.array_join(F.array_compact(F.array(*moved)), ",")
    return F.when(F.lag(F.lit(1)).over(w).isNotNull(), F.when(names == "", steady).otherwise(names))


def less_group_mean(value: str, part: Sequence[str]) -> Column:
    """A value less the mean of its group; the value itself is left as it is."""
    return F.col(value) - F.avg(value).over(Window.partitionBy(*part))


def feed_health(prices: DataFrame, members: DataFrame, key: str, price: str, time: str, since: Column, complete: float = 0.5) -> DataFrame:
    """One row: ``bad_prices``, members ``missing`` since a day, and ``cutoff``, the newest time with ``complete`` of the best count of keys."""
    bad = prices.agg(F.count_if(~(F.col(price) > 0) | F.col(price).isNull()).alias("bad_prices"))
    gone = members.join(prices.where(F.col(time) >= since), key, "left_anti").agg(F.count("*").alias("missing"))
    counts = prices.groupBy(time).agg(F.count_distinct(key).alias("_n"))
    best = counts.agg(F.max("_n").alias("_best"))
    cutoff = counts.crossJoin(F.broadcast(best)).where(F.col("_n") >= complete * F.col("_best")).agg(F.max(time).alias("cutoff"))  # the best count is one row
    return bad.crossJoin(gone).crossJoin(cutoff)  # one row each
