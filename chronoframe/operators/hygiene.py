"""Gates that keep doubtful entities out: each gives one row of evidence an entity, and the worst of them is the verdict.

A gate is a frame ``(entity, gate, severity, evidence)`` of what was known at a time, made from its own source by one of the
functions below: 0 clear, 1 penalised, 2 quarantined, 3 excluded. An entity that a gate's source does not hold has no row
of that gate, which is not the same as a clear one: :func:`verdicts` quarantines it if the gate is mandatory.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The gates in the order in which an equal severity is told, and those without which nobody is clean.
GATES = ("evidence_completeness", "going_concern", "shell", "listing_risk", "atm_dilution", "variable_price", "enforcement", "data_integrity")
MANDATORY = ("going_concern", "shell", "listing_risk", "data_integrity")
# Words that undo a doubt which is stated near them.
NEGATIONS = ("no substantial doubt", "not raise substantial doubt", "not raise any substantial doubt", "no longer substantial doubt", "alleviated", "mitigated", "no material uncertainty", "no conditions or events")
NO_EVIDENCE = "missing-evidence"


def _gate(df: DataFrame, entity: str, gate: str, severity: Column, evidence: str) -> DataFrame:
    level = severity.cast("int")
    return df.select(F.col(entity).alias("entity"), F.lit(gate).alias("gate"), level.alias("severity"), F.when(level > 0, F.col(evidence).cast("string")).alias("evidence"))


def _known(df: DataFrame, known_at: str, at: Column) -> DataFrame:
    return df.where(F.col(known_at) <= at)


def affirmed(text: Column, subject: str = "going concern", doubt: str = "substantial doubt", negations: Sequence[str] = NEGATIONS, window: int = 300) -> Column:
    """Whether ``doubt`` lies wholly within ``window`` characters of a ``subject`` that has none of ``negations`` there.

    Case and white space do not matter. The phrases must not overlap the subject.
    """
    q = re.escape(subject)

    def near(phrase: str, mark: str) -> tuple[str, str]:
        p, gap = re.escape(phrase), f".{{0,{max(window - len(phrase), 0)}}}"
        return f"(?{mark}{gap}{p})", f"(?<{mark}{p}{gap}{q})"

    after, before = near(doubt, "=")
    none = "".join(side for n in negations for side in near(n, "!"))
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return plain.rlike(f"(?s){q}(?:{after}|{before}){none}")


def going_concern(filings: DataFrame, entity: str, text: str, evidence: str, known_at: str, at: Column, **phrases) -> DataFrame:
    """Excluded if the latest filing affirms a doubt; of two filings of one time the greater evidence is the latest."""
    known = _known(filings, known_at, at)
    latest = known.select(entity, known_at, evidence, affirmed(F.col(text), **phrases).alias("_hit"))  # texts become flags before they would be shuffled
    last = latest.groupBy(entity).agg(F.max_by(F.struct(evidence, F.coalesce("_hit", F.lit(False)).alias("_hit")), F.struct(known_at, evidence)).alias("_last"))
    return _gate(last.select(entity, "_last.*"), entity, "going_concern", F.when(F.col("_hit"), 3).otherwise(0), evidence)


def shell(history: DataFrame, entity: str, code: str, flag: str, evidence: str, known_at: str, at: Column, shell_code: int = 6770) -> DataFrame:
    """Excluded if the code was ever the shell code, or the latest row with a flag says so."""
    known = _known(history, known_at, at)
    said = F.when(F.col(flag).isNotNull(), F.struct(known_at, evidence, flag))
    seen = known.groupBy(entity).agg(F.max(F.col(code) == shell_code).alias("_ever"), F.max(said)[flag].alias("_now"), F.coalesce(F.max(F.when(F.col(code) == shell_code, F.col(evidence))), F.max(said)[evidence]).alias("_why"))
    return _gate(seen, entity, "shell", F.when(F.coalesce("_ever", F.lit(False)) | F.coalesce("_now", F.lit(False)), 3).otherwise(0), "_why")


def listing_risk(closes: DataFrame, splits: DataFrame, entity: str, session: str, close: str, split_at: str, ratio: str, at: Column, low: float = 1.5) -> DataFrame:
    """Excluded if the latest close is under ``low`` after a reverse split (a ratio under one) within 12 months, penalised for one within 24."""
    last = _known(closes, session, at).groupBy(entity).agg(F.max_by(close, session).alias("_close"))
    recent = _known(splits, split_at, at).where(F.col(ratio) < 1).groupBy(entity).agg(F.max(split_at).alias("_split"))
    month = lambda n: F.coalesce(F.col("_split") >= F.add_months(at, -n), F.lit(False))
    return _gate(last.join(recent, entity, "left"), entity, "listing_risk", F.when((F.col("_close") < low) & month(12), 3).when(month(24), 1).otherwise(0), "_split")


def atm_dilution(filings: DataFrame, entity: str, kind: str, known_at: str, at: Column, shelf: str, agreement: str, issuance: str) -> DataFrame:
    """A shelf with a sales agreement is capacity (penalised); with an issuance at or after the first day of both it is excluded."""
    first = lambda k: F.min(F.when(F.col(kind) == k, F.col(known_at)))
    seen = _known(filings, known_at, at).groupBy(entity).agg(first(shelf).alias("_a"), first(agreement).alias("_b"), F.max(F.when(F.col(kind) == issuance, F.col(known_at))).alias("_c"))
    both = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.greatest("_a", "_b"))
    return _gate(seen.withColumn("_both", both), entity, "atm_dilution", F.when(F.col("_both").isNull(), 0).when(F.col("_c") >= F.col("_both"), 3).otherwise(1), "_both")


def variable_price(instruments: DataFrame, entity: str, start: str, matures: str, corroborated: str, evidence: str, at: Column) -> DataFrame:
    """Excluded while a corroborated instrument is outstanding; an unknown maturity is quarantined."""
    live = F.when(F.col(matures).isNull(), 2).when((F.col(matures) > at) & F.coalesce(corroborated, F.lit(False)), 3).otherwise(0)
    worst = _known(instruments, start, at).select(entity, live.alias("_level"), evidence).groupBy(entity).agg(F.max(F.struct("_level", evidence)).alias("_w")).select(entity, "_w.*")
    return _gate(worst, entity, "variable_price", F.col("_level"), evidence)


def enforcement(suspensions: DataFrame, names: DataFrame, entity: str, start: str, end: str, changed_at: str, at: Column, changes: int = 2) -> DataFrame:
    """Excluded under an open suspension; penalised for ``changes`` changes of name within 36 months."""
    held = suspensions.where((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))).groupBy(entity).agg(F.max(start).alias("_held"))
    turned = _known(names, changed_at, at).groupBy(entity).agg(F.count(F.when(F.col(changed_at) >= F.add_months(at, -36), 1)).alias("_k"), F.max(changed_at).alias("_last"))
    both = held.join(turned, entity, "full").withColumn("_why", F.coalesce("_held", "_last"))
    return _gate(both, entity, "enforcement", F.when(F.col("_held").isNotNull(), 3).when(F.col("_k") >= changes, 1).otherwise(0), "_why")


def data_integrity(counts: DataFrame, splits: DataFrame, entity: str, time: str, shares: str, split_at: str, at: Column, jump: float = 0.5, stale_days: int = 200) -> DataFrame:
    """Quarantined if shares grew by more than ``jump`` between two counts with no split after the first up to the second, or if the last count is older than ``stale_days``."""
    from pyspark.sql import Window

    w = Window.partitionBy(entity).orderBy(time)
    steps = _known(counts, time, at).select(entity, time, shares, F.lag(shares).over(w).alias("_p"), F.lag(time).over(w).alias("_pt"))
    grew = steps.where(F.col(shares) > F.col("_p") * (1 + jump)).select(entity, time, "_pt")
    near = grew.join(splits.select(F.col(entity), F.col(split_at).alias("_s")), entity).where("_s > _pt").where(F.col("_s") <= F.col(time)).select(entity, time).distinct()
    jumps = grew.join(near, [entity, time], "left_anti").groupBy(entity).agg(F.max(time).alias("_jump"))
    last = steps.groupBy(entity).agg(F.max(time).alias("_last")).join(jumps, entity, "left").withColumn("_why", F.coalesce("_jump", "_last"))
    return _gate(last, entity, "data_integrity", F.when(F.col("_jump").isNotNull() | (F.datediff(at, "_last") > stale_days), 2).otherwise(0), "_why")


def evidence_rows(universe: DataFrame, entity: str, gates: Mapping[str, DataFrame] | Sequence[DataFrame], mandatory: Sequence[str] = MANDATORY) -> DataFrame:
    """All gates' rows of the universe, and one of ``evidence_completeness`` (2) for an entity that lacks a mandatory gate; its evidence names them."""
    frames = list(gates.values()) if isinstance(gates, Mapping) else list(gates)
    everyone = universe.select(F.col(entity).alias("entity")).distinct()
    rows = reduce(DataFrame.unionByName, frames).join(everyone, "entity", "left_semi")
    has = rows.groupBy("entity").agg(F.collect_set("gate").alias("_has"))  # as many as there are gates
    lacks = F.filter(F.array(*(F.lit(m) for m in mandatory)), lambda m: ~F.array_contains(F.coalesce("_has", F.array().cast("array<string>")), m))
    missing = everyone.join(has, "entity", "left").withColumn("_lacks", lacks).where(F.size("_lacks") > 0)
    named = F.concat_ws(":", F.lit(NO_EVIDENCE), F.array_join("_lacks", ","))
    return rows.unionByName(missing.select("entity", F.lit("evidence_completeness").alias("gate"), F.lit(2).alias("severity"), named.alias("evidence")))


def verdicts(rows: DataFrame) -> DataFrame:
    """``(entity, severity, gate, evidence, firing, blocked)``: the worst row (of equals the first gate in :data:`GATES`), all gates that fire, and whether the entity is kept out."""
    place = F.array_position(F.array(*(F.lit(g) for g in GATES)), F.col("gate"))
    worst = F.max_by(F.struct("severity", "gate", "evidence"), F.struct("severity", -place))
    firing = F.array_join(F.array_sort(F.collect_set(F.when(F.col("severity") > 0, F.col("gate")))), ",")
    out = rows.groupBy("entity").agg(worst.alias("_w"), firing.alias("firing"))
    severity = F.col("_w.severity")
    return out.select("entity", severity.alias("severity"), F.when(severity > 0, F.col("_w.gate")).alias("gate"), F.col("_w.evidence").alias("evidence"), "firing", (severity >= 2).alias("blocked"))
