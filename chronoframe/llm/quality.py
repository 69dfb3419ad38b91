"""Quality rules by host: rule failures are summed by domain, shrunk with an empirical beta prior, and joined back."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_held, materialise

MIN_WORDS = 10
#: Per cent of words in repeated windows beyond which a text fails.
MAX_REPEAT = 20
WINDOW = 5
#: Symbols a word, share of repeated lines, and mean word length beyond which a text fails a rule of its own.
MAX_SYMBOLS, MAX_DUP_LINES, MAX_WORD_CHARS = 0.3, 0.5, 25
#: A host is rejected if its shrunk failure rate is over this; above the second, its texts are held to half those limits.
REJECT_RATE, SUSPECT_RATE = 0.9, 0.5
#: Hosts up to which their verdicts are broadcast; with more, the join is salted.
BROADCAST_HOSTS, SALTS = 100_000, 32

_SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeats(ids: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Words in windows that occur twice or more, per document. ids: all words' ids; ends: documents' ends."""
    n, docs = len(ids), len(ends)
    starts = np.concatenate(([0], ends[:-1]))
    out = np.zeros(docs, dtype=np.int64)
    if n < size:
        return out
    rank, span = ids, 1
    while span < size:  # ranks of longer windows from those of shorter ones: exact, no hashing
        step = min(span, size - span)
        rank = np.unique(rank[: n - span - step + 1] * np.int64(n + 1) + rank[step : step + n - span - step + 1], return_inverse=True)[1]
        span += step
    doc = np.repeat(np.arange(docs), ends - starts)
    inside = doc[: n - size + 1] == doc[size - 1 :]
    key = (doc[: n - size + 1] * np.int64(n + 1) + rank)[inside]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(inside)[count[back] > 1]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + size, -1)
    hit = np.cumsum(cover[:-1]) > 0
    np.add.at(out, doc[hit], 1)
    return out


def _measure(texts: list[str], window: int) -> dict[str, np.ndarray]:
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for ws in words for w in ws), dtype=np.int64)
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    dup, lines = [], []
    for t in texts:
        filled = [x for x in t.split("\n") if x.encode("utf-8", "surrogatepass").split()]
        dup.append(len(filled) - len(set(filled)))
        lines.append(len(filled))
    spaces = [sum(map(t.count, " \t\n\v\f\r")) for t in texts]
    return {
        "n_words": n,
        "word_chars": np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) - np.array(spaces, dtype=np.int64),
        "n_symbols": np.array([len(_SYMBOLS.findall(t)) for t in texts], dtype=np.int64),
        "n_dup_lines": np.array(dup, dtype=np.int64),
        "n_repeat_words": _repeats(ids, np.cumsum(n), window),
        "n_lines": np.array(lines, dtype=np.int64),
    }


#: Characters measured together.
_CHUNK = 1_000_000


def _measured_batch(texts: pd.Series) -> pd.DataFrame:
    drop_held()
    every = ["" if t is None or t != t else t for t in texts]
    at, found = 0, [pd.DataFrame(columns=list(COUNTS), dtype="int64")]
    while at < len(every):
        end, size = at, 0
        while end < len(every) and (end == at or size + len(every[end]) <= _CHUNK):
            size += len(every[end])
            end += 1
        found.append(pd.DataFrame(_measure(every[at:end], WINDOW)))
        at = end
    return pd.concat(found[1:] or found, ignore_index=True)


def text_measures(text: Column) -> Column:
    """The counts of :data:`COUNTS` of a text, as a struct; a null text has none."""
    return F.pandas_udf(_measured_batch, ", ".join(f"{c} long" for c in COUNTS))(text)


def _rules(m: DataFrame) -> DataFrame:
    words = F.col("n_words")
    base = (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * words)

    def failed(factor: float) -> Column:
        own = [
            F.col("n_symbols") > factor * MAX_SYMBOLS * words,
            F.col("n_dup_lines") > factor * MAX_DUP_LINES * F.col("n_lines"),
            F.col("word_chars") > factor * MAX_WORD_CHARS * words,
        ]
        return sum((r.cast("long") for r in own), F.lit(0).cast("long"))

    return m.withColumn("base_failed", base).withColumn("rules_failed", failed(1)).withColumn("strict_failed", failed(0.5))


def host_verdicts(measured: DataFrame, host_col: str = "source") -> DataFrame:
    """``(host, n_docs, n_failed, rate)``: rate is the share of failing documents, shrunk by a beta prior.

    The prior's mean and strength are fitted to all hosts by moments, so a host with few documents
    stays near the mean of all and one with many keeps its own rate. A null host is a host of its own.
    """
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.count_if(F.col("base_failed") | (F.col("rules_failed") > 0)).alias("n_failed"))
    hosts = materialise(hosts, "hosts")
    share = F.col("n_failed") / F.col("n_docs")
    fit = hosts.agg(F.avg(share).alias("mean"), F.var_samp(share).alias("var"), F.avg(1 / F.col("n_docs")).alias("inv"))
    # var = m(1-m)/(s+1) + sampling noise m(1-m)*E[1/n]; the strength s is held to 1..10000
    within = F.col("mean") * (1 - F.col("mean"))
    excess = F.coalesce(F.col("var"), F.lit(0.0)) - within * F.col("inv")
    strength = F.when(within <= 0, F.lit(1.0)).when(excess <= within / 10_001, F.lit(10_000.0)).otherwise(F.greatest(F.lit(1.0), within / excess - 1))
    prior = fit.select("mean", strength.alias("strength"))
    rate = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", rate.alias("rate"))  # the prior is one row


def _measured(docs: DataFrame, text_col: str, host_col: str, *keep: Column) -> DataFrame:
    """``(*keep, _host, counts and rules)``, written to the shared folder."""
    rows = docs.select(*keep, F.col(host_col).cast("string").alias("_host"), text_measures(F.col(text_col).cast("string")).alias("_m"))
    rows = rows.select(*[c for c in rows.columns if c != "_m"], "_m.*")
    return materialise(_rules(rows), "quality")


def _kept(host_rate: Column) -> Column:
    held = F.when(host_rate > SUSPECT_RATE, F.col("strict_failed")).otherwise(F.col("rules_failed"))
    return ~F.col("base_failed") & (held == 0) & (host_rate <= REJECT_RATE)


def _with_rates(measured: DataFrame, rates: DataFrame) -> DataFrame:
    """``measured`` with the ``host_rate`` of its host, null for hosts that ``rates`` lacks."""
    rates = rates.select(F.col("host").alias("_v_host"), F.col("rate").alias("host_rate"))
    if rates.count() <= BROADCAST_HOSTS:
        return measured.join(F.broadcast(rates), measured["_host"].eqNullSafe(rates["_v_host"]), "left").drop("_v_host")
    salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = measured.withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int"))
    return left.join(salted, left["_host"].eqNullSafe(salted["_v_host"]) & (left["_salt"] == salted["_salt"]), "left").drop("_v_host", "_salt")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, host, counts, ``base_failed``, ``rules_failed``, ``host_rate`` and ``kept``.

    kept is false if the base rules or one of the document's own rules fail, if its host is suspect
    and it fails a rule at half the limit, or if its host is rejected. Null and empty texts have no
    word and fail; repeated rows are judged alike; an empty table gives an empty result.
    """
    measured = _measured(docs, text_col, host_col, F.col(id_col))
    joined = _with_rates(measured, host_verdicts(measured, "_host"))
    return joined.withColumn("kept", _kept(F.col("host_rate"))).withColumnRenamed("_host", host_col)


def drop_low_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` without the rows that :func:`quality_verdicts` rejects.

    Rows are written once beside their counts, so that no text is shuffled to meet its verdict; only
    suspect hosts, whose verdict differs from that of all others, are joined.
    """
    measured = _measured(docs, text_col, host_col, F.struct("*").alias("_doc"))  # names of other columns cannot clash
    suspect = host_verdicts(measured, "_host").where(F.col("rate") > SUSPECT_RATE)
    kept = _with_rates(measured, suspect).where(_kept(F.coalesce("host_rate", F.lit(0.0))))
    return kept.select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns))
