"""URL filters: host and path rules, and a ratio of two character models for the URLs that no rule fits.

The URLs that rules allow and block train one smoothed variable-order Markov model each. A URL's
score is the mean log-likelihood ratio of its characters; the limit is calibrated on labelled URLs
that trained neither model. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_unique
from .common import LOWER, UPPER, materialise

#: (action, rule): a rule is a host, then the beginning of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Characters of the longest gram; its context is one shorter. A context seen less often gives way to the next shorter one.
ORDER, MIN_CONTEXT = 4, 2
#: Grams up to which their ratios are broadcast; with more, the join is salted.
BROADCAST_GRAMS, SALTS = 500_000, 32
#: One in so many labelled URLs, by their hash, is kept from the models and sets the limit.
CALIBRATE = 4
#: Width of the histogram bins of the calibration, and the score beyond which all share a bin.
BIN, MOST = 0.01, 10.0

_START, _END = "\x02", "\x03"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null if none does. Of equal lengths the longer host wins."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"))):  # later ones are asked first
        name, slash, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + tail))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _grams(texts: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each character of column ``u`` and the end: the gram that ends there."""
    padded = F.concat(F.lit(_START * (ORDER - 1)), F.col("u"), F.lit(_END))
    return texts.select(*keep, padded.alias("_p"), F.explode(F.sequence(F.lit(1), F.length("u") + 1)).alias("_i")).select(*keep, F.expr(f"substring(_p, _i, {ORDER})").alias("g"))


def _log_probability(grams: DataFrame, counts: DataFrame, label: str, alphabet: int) -> DataFrame:
    """``(g, label)``: natural log of the probability of a gram's last character after its context.

    Witten-Bell interpolation from the empty context up; ``counts``: ``(g, label)`` training counts.
    """
    seen = counts.where(F.col(label) > 0)
    out = grams.withColumn(label, F.lit(1.0 / alphabet))
    for n in range(1, ORDER + 1):
        own = seen.groupBy(F.expr(f"right(g, {n})").alias("s")).agg(F.sum(label).alias("c"))
        context = own.groupBy(F.expr(f"left(s, {n - 1})").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("t")).where(F.col("n") >= MIN_CONTEXT)
        out = out.withColumn("s", F.expr(f"right(g, {n})")).join(own, "s", "left")
        out = out.withColumn("k", F.expr(f"left(s, {n - 1})")).join(context, "k", "left")
        mixed = (F.coalesce("c", F.lit(0)) + F.col("t") * F.col(label)) / (F.col("n") + F.col("t"))
        out = out.select("g", F.when(F.col("n").isNull(), F.col(label)).otherwise(mixed).alias(label))
    return out.withColumn(label, F.log(label))


def _limit(histogram: list, trained: tuple[int, int]) -> float:
    """The score under which a URL is blocked: where the sum of both classes' error rates is least, amid the gap there.

    trained: grams of each class in the models. Without any of a class the other one wins always; if only
    the histogram lacks a class, the limit is zero, where both models give a URL the same probability.
    """
    if not all(trained):
        return MOST + 1 if trained[1] else -MOST - 1
    allow, block = sum(r["allow"] for r in histogram), sum(r["block"] for r in histogram)
    if not allow or not block:
        return 0.0
    best, limit, lost, caught = block * allow, -MOST, 0, 0
    rows = sorted(histogram, key=lambda r: r["bin"])
    for r, after in zip(rows, [*rows[1:], None], strict=True):
        lost, caught = lost + r["allow"], caught + r["block"]
        if (error := lost * block + (block - caught) * allow) < best:
            edge = r["bin"] + 1
            best, limit = error, (edge + (after["bin"] if after else edge)) / 2 * BIN
    return limit


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per row of ``pages``: ``(id_col, host, path, rule, verdict, score)``.

    Rules decide where one fits; elsewhere the calibrated ratio does, positive scores speaking for
    the URL. A URL without a host has no score and is allowed, as is every URL if no rule labels any.
    Each distinct URL is scored once, so repeated rows and hot hosts cost one row; long URLs are scored
    whole. Null URLs count as empty; an empty table gives an empty result.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    texts = rows.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("rule", rule).withColumn("action", action)
    texts = materialise(texts.withColumn("u", F.concat("host", "path")), "urls")
    scored = texts.where(F.col("u") != "")
    apart = F.pmod(F.xxhash64("host", "path", F.lit("calibrate")), F.lit(CALIBRATE)) == 0
    labelled = _grams(scored.where(F.col("action").isNotNull() & ~apart), ["action"])
    once = lambda a: F.sum(F.when(F.col("action") == a, 1).otherwise(0)).alias(a)
    counts = materialise(labelled.groupBy("g").agg(once("allow"), once("block")), "url-counts")
    grams = materialise(_grams(scored, []).distinct(), "url-grams")
    alphabet = grams.select(F.expr("right(g, 1)")).distinct().count() + 1
    ratio = _log_probability(grams, counts, "allow", alphabet).join(_log_probability(grams, counts, "block", alphabet), "g")
    ratio = materialise(ratio.select("g", (F.col("allow") - F.col("block")).alias("r")), "url-ratios")
    each = _grams(scored, ["host", "path"])
    if ratio.count() <= BROADCAST_GRAMS:
        each = each.join(F.broadcast(ratio), "g")
    else:
        salted = ratio.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        each = each.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"])
    scores = each.groupBy("host", "path").agg(F.avg(F.col("r").cast("decimal(24,12)")).cast("double").alias("score"))
    judged = materialise(texts.join(scores, ["host", "path"], "left").select("host", "path", "n", "rule", "action", "score"), "url-scores")
    bins = judged.where(F.col("action").isNotNull() & F.col("score").isNotNull() & apart)
    bins = bins.groupBy(F.floor(F.least(F.greatest("score", F.lit(-MOST)), F.lit(MOST)) / BIN).alias("bin")).agg(F.count_if(F.col("action") == "allow").alias("allow"), F.count_if(F.col("action") == "block").alias("block"))
    trained = tuple(x or 0 for x in counts.agg(F.sum("allow"), F.sum("block")).first())
    limit = _limit(bins.collect(), trained)  # at most 2 * MOST / BIN + 1 rows
    verdict = F.coalesce("action", F.when(F.col("score") < limit, "block").otherwise("allow"))
    judged = judged.select("host", "path", "n", "rule", verdict.alias("verdict"), "score")
    return join_unique(rows, judged, ["host", "path"], "n").select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict", "score")
