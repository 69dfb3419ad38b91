"""Fundamentals: standard concepts, quarters, trailing sums, statements and structural evidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise, release
from .skew import bounded, small


def standardize(facts: DataFrame, chains: DataFrame, key: Sequence[str], tag: str, value: str, available: str) -> DataFrame:
    """``(key, concept, value, source_tag, available)``: of each concept the first tag of its chain that has a value.

    ``chains``: ``(concept, tag, position)``, a dimension that is broadcast if it is small. Excluded rows go before.
    """
    hit = facts.where(F.col(value).isNotNull()).join(small(chains), tag)
    best = F.min_by(F.struct(value, F.col(tag).alias("source_tag"), F.col(available).alias("available")), F.struct("position", available, value))
    return hit.groupBy(*key, "concept").agg(best.alias("_b")).select(*key, "concept", f"_b.{value}", "_b.source_tag", "_b.available")


def sum_components(facts: DataFrame, key: Sequence[str], tag: str, value: str, tags: Sequence[str], out: str) -> DataFrame:
    """Sum of several tags where all of them are there, else null."""
    there = [F.coalesce(F.bool_or((F.col(tag) == t) & F.col(value).isNotNull()), F.lit(False)) for t in tags]  # a flag a tag: no set of tags is kept a key
    total = F.sum(F.when(F.col(tag).isin(*tags), F.col(value)))
    return facts.groupBy(*key).agg(F.when(reduce(and_, there), total).alias(out))


def recover_single_candidate(candidates: DataFrame, key: Sequence[str], tag: str) -> DataFrame:
    """Keys that exactly one candidate tag fits."""
    return candidates.groupBy(*key).agg(F.count_distinct(tag).alias("_n"), F.min(tag).alias(tag)).where("_n = 1").drop("_n")


def derive_quarters(annual: DataFrame, interim: DataFrame, key: Sequence[str], end: str, start: str, value: str, available: str) -> DataFrame:
    """``(key, fiscal_end, quarter, value, available, status)``: three interim quarters within a year and the fourth by difference.

    A year is quarantined unless exactly three direct quarters end within it, or if its length is not
    330 to 385 days. The derived quarter becomes available with the latest of its inputs.
    """
    year = annual.select(*key, F.col(end).alias("fiscal_end"), F.col(start).alias("_ys"), F.col(value).alias("_yv"), F.col(available).alias("_ya"))
    part = interim.select(*(F.col(k).alias(f"_{k}") for k in key), F.col(end).alias("_qe"), F.col(value).alias("_qv"), F.col(available).alias("_qa"))
    on = (F.col("_qe") > F.col("_ys")) & (F.col("_qe") < F.col("fiscal_end"))
    for k in key:
        on = (year[k] == F.col(f"_{k}")) & on
    hit = year.join(part, on, "left").groupBy(*key, "fiscal_end", "_ys", "_yv", "_ya").agg(F.array_sort(F.collect_list(F.struct("_qe", "_qv", "_qa"))).alias("q"))
    hit = hit.withColumn("q", F.filter("q", lambda x: x["_qe"].isNotNull()))
    days = F.datediff("fiscal_end", "_ys")
    status = F.when(~days.between(330, 385), "fiscal_year_change").when(F.size("q") != 3, "quarter_count").otherwise("ok")
    total = F.aggregate("q", F.lit(0).cast(annual.schema[value].dataType), lambda a, x: (a + x["_qv"]).cast(annual.schema[value].dataType))
    late = F.aggregate("q", F.col("_ya"), lambda a, x: F.greatest(a, x["_qa"]))
    direct = F.transform("q", lambda x, i: F.struct((i + 1).alias("quarter"), x["_qv"].alias("value"), x["_qa"].alias("available")))
    fourth = F.array(F.struct(F.lit(4).alias("quarter"), (F.col("_yv") - total).cast(annual.schema[value].dataType).alias("value"), late.alias("available")))
    none = F.array(F.struct(F.lit(None).cast("int").alias("quarter"), F.lit(None).cast(annual.schema[value].dataType).alias("value"), F.lit(None).cast(annual.schema[available].dataType).alias("available")))
    rows = hit.withColumn("status", status).withColumn("_r", F.when(F.col("status") == "ok", F.concat(direct, fourth)).otherwise(none))
    return rows.select(*key, "fiscal_end", "status", F.inline("_r"))


def trailing_four(df: DataFrame, key: Sequence[str], quarter: str, value: str, available: str) -> DataFrame:
    """``(key, quarter, ttm, available)`` where four consecutive quarters are there; availability is the latest of them."""
    w = Window.partitionBy(*key).orderBy(quarter)
    four = w.rowsBetween(-3, 0)
    out = df.select(*key, quarter, F.sum(value).over(four).alias("ttm"), F.max(available).over(four).alias(available), F.count(value).over(four).alias("_n"), (F.col(quarter) - F.lag(quarter, 3).over(w)).alias("_span"))
    return out.where("_n = 4 AND _span = 3").drop("_n", "_span")


def prior_year(df: DataFrame, key: Sequence[str], period: str, values: Sequence[str], periods: int = 4) -> DataFrame:
    """``df`` with the values of the same period a year before: a join, as periods may be missing."""
    before = df.select(*key, (F.col(period) + periods).alias(period), *(F.col(v).alias(f"prior_{v}") for v in values))
    return df.join(before, [*key, period], "left")


def compose_ttm(df: DataFrame, key: Sequence[str], year: str, part: str, item: str, value: str, annual_part: int = 4) -> DataFrame:
    """``(key, year, part, item, ttm)``: year to date, plus the year before, less the same year to date before; null unless all are there."""
    now = df.select(*key, year, part, item, F.col(value).alias("_c"))
    whole = df.where(F.col(part) == annual_part).select(*key, (F.col(year) + 1).alias(year), item, F.col(value).alias("_a"))
    same = df.select(*key, (F.col(year) + 1).alias(year), part, item, F.col(value).alias("_p"))
    out = now.where(F.col(part) != annual_part).join(whole, [*key, year, item], "left").join(same, [*key, year, part, item], "left")
    return out.select(*key, year, part, item, (F.col("_c") + F.col("_a") - F.col("_p")).alias("ttm"))


def close_intervals(df: DataFrame, key: Sequence[str], start: str, end: str, value: str, available: str, longest: int | None = None, max_rounds: int = 40) -> DataFrame:
    """All intervals that sums of adjoining ones and differences of ones with a common start give.

    Of several ways to an interval the one known earliest counts, then that of the fewest steps, then the
    least value. Rounds of two self joins on the key go on until nothing changes, so the result is
    complete; ``longest`` leaves out intervals of more periods. ``start`` and ``end`` are whole period
    numbers; a key's intervals are joined with each other, so they should be some hundreds at most.
    """
    cols = [*key, start, end, value, available]

    def best(d: DataFrame) -> DataFrame:
        first = F.min_by(F.struct(value, available, "_steps"), F.struct(available, "_steps", value))
        out = d.groupBy(*key, start, end).agg(first.alias("_b")).select(*key, start, end, f"_b.{value}", f"_b.{available}", "_b._steps")
        return materialise(out, "intervals")

    def state(d: DataFrame) -> tuple:
        return tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64(*d.columns)), F.sum("_steps")).first())

    fits = F.lit(True) if longest is None else F.col(end) - F.col(start) <= longest
    now = best(df.select(*cols, F.lit(0).alias("_steps")))
    before = state(now)
    for _ in range(max_rounds):
        b = now.select(*key, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_v"), F.col(available).alias("_t"), F.col("_steps").alias("_n"))
        late, steps = F.greatest(available, "_t").alias(available), (F.col("_steps") + F.col("_n") + 1).alias("_steps")
        both = now.join(b, list(key))
        chained = both.where(F.col(end) == F.col("_s")).select(*key, start, F.col("_e").alias(end), (F.col(value) + F.col("_v")).alias(value), late, steps)
        cut = both.where((F.col(start) == F.col("_s")) & (F.col(end) > F.col("_e"))).select(*key, F.col("_e").alias(start), end, (F.col(value) - F.col("_v")).alias(value), late, steps)
        after = best(now.unionByName(chained.where(fits)).unionByName(cut))
        release(now)
        now, after_state = after, state(after)
        if after_state == before:
            return now.select(*cols)
        before = after_state
    raise RuntimeError("intervals did not close")


def statement_rows(items: DataFrame, key: Sequence[str], period: str, item: str, value: str, filed: str, core: Sequence[str]) -> DataFrame:
    """``(key, period, visible_from, items)``: visible once its core items are; items filed later than that are null."""
    seen = F.max(F.when(F.col(item).isin(*core), F.col(filed))).over(Window.partitionBy(*key, period))
    rows = items.withColumn("visible_from", seen).where("visible_from IS NOT NULL")
    kept = F.when(F.col(filed) <= F.col("visible_from"), F.col(value))
    return rows.groupBy(*key, period, "visible_from").agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("item"), kept.alias("value")))).alias("items"))


def scale_guard(df: DataFrame, key: Sequence[str], value: str, share: float = 0.01) -> DataFrame:
    """Rows whose value is at least a share of the key's median: smaller ones are in another unit."""
    mid = df.groupBy(*key).agg(F.median(value).alias("_m"))
    return df.join(mid, list(key)).where(F.col(value) >= share * F.col("_m")).drop("_m")


def structural_zero(df: DataFrame, key: Sequence[str], total: str, parts: Sequence[str], out: str) -> DataFrame:
    """``(key, evidence)``: ``zero`` where the parts alone make the total, ``positive`` where they fall short, else null."""
    rest = F.col(total) - sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.select(*key, F.when(rest == 0, "zero").when(rest > 0, "positive").alias(out))


def coverage_grid(evidence: DataFrame, issuers: DataFrame, concepts: DataFrame, issuer: str, concept: str, tier: str, most: int = 10_000) -> DataFrame:
    """``(tier, concept, covered, cells, rate)`` with subtotals: every issuer times every concept, held against evidence.

    ``concepts`` is a dimension of at most ``most`` rows, which is asked; it is unrolled beside each issuer.
    """
    grid = issuers.select(issuer).distinct().crossJoin(bounded(concepts, most, "concepts"))  # so many cells a row
    seen = evidence.select(issuer, concept).distinct().withColumn("_c", F.lit(1))
    cells = grid.join(seen, [issuer, concept], "left")
    out = cells.rollup(tier, concept).agg(F.count("_c").alias("covered"), F.count("*").alias("cells"))
    return out.withColumn("rate", F.col("covered") / F.col("cells"))


def piotroski(signals: Sequence[Column], strict: bool = True) -> Column:
    """Number of signals that hold; null if one is unknown (strict), else scaled to the known ones."""
    known = sum((s.isNotNull().cast("int") for s in signals), F.lit(0))
    held = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))
    return F.when(known == len(signals), held.cast("double")) if strict else F.when(known > 0, held * float(len(signals)) / known)


def dcf_per_share(base: Column, growth: Column, discount: Column, terminal: Column, years: int = 10) -> Column:
    """Present value of ``years`` of growing earnings and a Gordon term; null unless the discount exceeds the terminal growth."""
    q = (1 + growth) / (1 + discount)
    stream = F.when(F.abs(q - 1) < 1e-9, F.lit(float(years))).otherwise(q * (1 - F.pow(q, F.lit(years))) / (1 - q))
    last = base * F.pow(1 + growth, F.lit(years)) * (1 + terminal) / (discount - terminal) / F.pow(1 + discount, F.lit(years))
    return F.when(discount > terminal, base * stream + last)


def graham_number(eps: Column, book: Column) -> Column:
    return F.when((eps > 0) & (book > 0), F.sqrt(22.5 * eps * book))
