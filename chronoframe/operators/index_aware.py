"""Staged selection around an index core: strong incumbents, core, one financial sleeve, fill, and replacement of correlated picks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import top_k

#: Company types of the financial sleeve.
SLEEVE_TYPES = ("BANK", "FINANCIAL", "INSURANCE", "HOLDING")


@dataclass(frozen=True)
class CoreRules:
    """Limits of one cycle's choice. ``window`` is how far down the order an incumbent may stand to be kept first."""

    slots: int = 15
    min_core: int = 2
    max_outside: int = 2
    window: int = 18
    incumbent_base: float = 88.0
    sleeve_score: float = 80.0
    sleeve_relative: float = 50.0
    per_sector: int = 2
    banks: int = 1
    correlation: float = 0.7

    @property
    def required_core(self) -> int:
        """Core candidates without which a cycle cannot be filled."""
        return max(self.min_core, self.slots - self.max_outside)


def relative_strength(then: Column, now: Column, index_then: Column, index_now: Column) -> Column:
    """0 to 100, 50 for a price that moves as the index does, two points for each point of difference; 50 where a price is missing or not positive."""
    there = (then > 0) & (now > 0) & (index_then > 0) & (index_now > 0)
    return F.when(there, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + (now / then - index_now / index_then) * 200))).otherwise(50.0)


def blended_score(base: Column, relative: Column, technical: Column, weights: Sequence[float] = (0.75, 0.35, 0.05)) -> Column:
    """Weighted mean of three scores, to four digits; a missing base counts 0, the others 50."""
    a, b, c = weights
    total = a + b + c
    if total <= 0:
        raise ValueError("weights must sum to more than 0")
    return F.round((F.coalesce(base, F.lit(0.0)) * a + F.coalesce(relative, F.lit(50.0)) * b + F.coalesce(technical, F.lit(50.0)) * c) / total, 4)


def select_with_core(candidates: DataFrame, part: Sequence[str], entity: str, score: str, rules: CoreRules = CoreRules(), pairs: DataFrame | None = None) -> DataFrame:
    """``(part, entity, action, stage, replaces)`` of each candidate of a cycle (``part``) whose core can be filled; other cycles give no row.

    Candidates have one row an entity and cycle, and the columns ``held``, ``core``, ``bank``, ``sleeve``
    (boolean, null is false), ``base``, ``relative`` (double) and ``sector`` (null is not capped). They are
    tried by score, nulls and NaN last, of equal ones the lesser entity first, in four passes: held ones of the first
    ``window`` with ``base`` at ``incumbent_base`` or over; core until there are ``min_core``; one strong
    core entity of the sleeve if there is none; any. ``stage`` names the pass that placed a pick. Caps on
    sectors, banks and entities outside the core hold in each. A cycle with fewer than ``required_core``
    core candidates chooses nothing, so that what is held stays.

    With ``pairs`` ``(a, b, corr)`` the weaker pick of a pair over ``correlation`` (the lower in the order)
    gives way to the best candidate left that fits the caps and correlates with no other pick; one that
    nobody can replace stays. A replaced pick is out for good.

    What is not picked says what bars it at the end: ``sector_cap``, ``bank_cap``, ``outside_cap``, else
    ``no_slot``; replaced picks say ``correlation_cap``. Candidates of one kind (sector and flags) without a
    correlated partner are alike but for their order, and a choice takes ``slots`` of them at most, so
    only that many of each kind, the incumbents, and those with a partner are walked in a task. The rest
    of a cycle is only ranked within its kind and told its reason by a join with one row a cycle.
    """
    value = F.col(score).cast("double")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = candidates.select(
        *part, entity, F.when(~F.isnan(value), value).alias("_v"), F.col("sector").alias("_sector"),
        flag("core").alias("_core"), flag("bank").alias("_bank"), flag("sleeve").alias("_sleeve"), flag("held").alias("_held"),
        F.coalesce(F.col("base") >= rules.incumbent_base, F.lit(False)).alias("_base"),
        (flag("core") & flag("sleeve") & F.coalesce(value >= rules.sleeve_score, F.lit(False)) & (F.coalesce("relative", F.lit(50.0)) >= rules.sleeve_relative)).alias("_strong"),
    )
    fillable = rows.groupBy(*part).agg(F.count_if("_core").alias("_n")).where(F.col("_n") >= rules.required_core).select(*part)
    order, kind = [F.desc_nulls_last("_v"), F.col(entity)], ["_sector", "_core", "_bank", "_sleeve", "_strong"]
    near = F.lit(None).cast(f"array<{candidates.schema[entity].dataType.simpleString()}>")
    pool = rows.withColumn("_near", near)
    if pairs is not None:
        high = pairs.where(F.col("corr") > rules.correlation)
        both = high.select(F.col("a").alias(entity), F.col("b").alias("_o")).unionByName(high.select(F.col("b").alias(entity), F.col("a").alias("_o")))
        pool = rows.join(both.groupBy(entity).agg(F.collect_set("_o").alias("_near")), entity, "left")
    first = top_k(rows, part, order, rules.window).where("_held AND _base").select(*part, entity, F.lit(True).alias("_incumbent"))
    alike = Window.partitionBy(*part, *kind, F.col("_near").isNull(), "_first").orderBy(*order)
    pool = pool.join(first, [*part, entity], "left").withColumn("_first", flag("_incumbent"))
    pool = pool.withColumn("_r", F.row_number().over(alike)).where((F.col("_r") <= rules.slots) | F.col("_near").isNotNull() | F.col("_first"))
    types = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in [*part, entity])
    schema = f"{types}, sector {candidates.schema['sector'].dataType.simpleString()}, core boolean, bank boolean, action string, stage string, replaces {candidates.schema[entity].dataType.simpleString()}"

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        return _choose(pdf, list(part), entity, rules)

    picked = pool.join(fillable, list(part)).drop("_r", "_incumbent").groupBy(*part).applyInPandas(choose, schema)
    a_cycle = picked.groupBy(*part).agg(F.collect_list(F.struct(entity, "sector", "core", "bank", "action", "stage", "replaces")).alias("_picks"))  # twice the slots at most
    own = F.try_element_at(F.filter("_picks", lambda p: p[entity] == F.col(entity)), F.lit(1))
    stay = F.filter("_picks", lambda p: p["action"] != "correlation_cap")
    bars = [
        (F.size(F.filter(stay, lambda p: p["sector"] == F.col("_sector"))) >= rules.per_sector, "sector_cap"),
        (F.col("_bank") & (F.size(F.filter(stay, lambda p: p["bank"])) >= rules.banks), "bank_cap"),
        (~F.col("_core") & (F.size(F.filter(stay, lambda p: ~p["core"])) >= rules.max_outside), "outside_cap"),
    ]
    reason = F.coalesce(own["action"], *(F.when(c, name) for c, name in bars), F.lit("no_slot"))
    return rows.join(a_cycle, list(part)).select(*part, entity, reason.alias("action"), own["stage"].alias("stage"), own["replaces"].alias("replaces"))


def _choose(pdf: pd.DataFrame, part: list[str], entity: str, rules: CoreRules) -> pd.DataFrame:
    """A cycle's picks, replaced ones included."""
    rows = pdf.sort_values(["_v", entity], ascending=[False, True], na_position="last", kind="stable").to_dict("records")
    place = {row[entity]: n for n, row in enumerate(rows)}
    picks: list[dict] = []

    def fits(row: dict, among: list[dict]) -> bool:
        return (
            (pd.isna(row["_sector"]) or sum(p["_sector"] == row["_sector"] for p in among) < rules.per_sector)
            and (not row["_bank"] or sum(p["_bank"] for p in among) < rules.banks)
            and (row["_core"] or sum(not p["_core"] for p in among) < rules.max_outside)
        )

    stages = {
        "incumbent": lambda row: row["_first"],
        "core": lambda row: row["_core"] and sum(p["_core"] for p in picks) < rules.min_core,
        "sleeve": lambda row: row["_strong"] and not any(p["_sleeve"] for p in picks),
        "fill": lambda row: True,
    }
    out: dict[object, tuple[str, str, object]] = {}
    for stage, wanted in stages.items():
        for row in rows:
            if len(picks) >= rules.slots:
                break
            if row[entity] not in out and wanted(row) and fits(row, picks):
                picks.append(row)
                out[row[entity]] = ("hold" if row["_held"] else "enter", stage, None)

    near = {row[entity]: frozenset(row["_near"]) if row["_near"] is not None else frozenset() for row in rows}
    left = [row for row in rows if row[entity] not in out]
    kept: set = set()  # weaker picks that nobody can replace
    while True:
        weaker = sorted((p for p in picks if p[entity] not in kept and any(q[entity] in near[p[entity]] and place[q[entity]] < place[p[entity]] for q in picks)), key=lambda p: place[p[entity]])
        if not weaker:
            break
        weak = weaker[0]
        others = [p for p in picks if p is not weak]
        names = {p[entity] for p in others}
        best = next((row for row in left if fits(row, others) and near[row[entity]].isdisjoint(names)), None)
        if best is None:
            kept.add(weak[entity])
            continue
        left.remove(best)
        picks[next(n for n, p in enumerate(picks) if p is weak)] = best
        out[weak[entity]] = ("correlation_cap", out[weak[entity]][1], None)
        out[best[entity]] = ("hold" if best["_held"] else "enter", "replacement", weak[entity])
        kept.clear()  # a cap may have come free
    found = {row[entity]: row for row in rows}
    keys = {c: pdf[c].iloc[0] for c in part}
    columns = [*part, entity, "sector", "core", "bank", "action", "stage", "replaces"]
    return pd.DataFrame([{**keys, entity: e, "sector": found[e]["_sector"], "core": found[e]["_core"], "bank": found[e]["_bank"], "action": a, "stage": s, "replaces": r} for e, (a, s, r) in out.items()], columns=columns)
