"""Language identification with interpolated Kneser-Ney character models, one for each language.

Words are scored apart from each other, so a word's log-probabilities under all languages are
computed once and looked up afterwards. The models lie in sorted arrays of n-gram hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, restored_id, text_id

ORDER = 4
DISCOUNT = 0.75
#: Distinct documents of each language, about, that are sampled for its model; they are chosen by the text's hash.
SAMPLE_DOCS = 1500
#: Standard deviations over a language's own mean cross-entropy beyond which a prediction is rejected.
REJECT_SIGMAS = 4.0
#: One in so many of these, by their hash, sets the limit of rejection and trains no model; the least number that sets one.
CHECK_SHARE, MIN_CHECK = 5, 10
#: Bytes of all models together, which every worker holds.
MAX_MODEL_BYTES = 1 << 30
#: Characters beyond which more text makes a prediction no surer.
FULL_EVIDENCE = 40
#: Distinct words whose scores a Python worker remembers.
CACHE_WORDS = 400_000

_START, _END = "\x02", "\x03"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    """A word's lower-case letters; other characters are left out."""
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with their marks; each code's word; its place in the word."""
    codes = np.frombuffer("".join(f"{_START}{w}{_END}" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    starts = np.cumsum(size) - size
    return codes, np.repeat(np.arange(len(words)), size), np.arange(len(codes)) - np.repeat(starts, size)


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order: the hash of the n codes that end at each position (rubbish near a word's start)."""
    out, mixed = [], (codes + np.uint64(1)) * _PRIME
    mixed ^= mixed >> np.uint64(29)
    for n in range(1, order + 1):
        h = mixed.copy() if n == 1 else out[-1].copy()
        if n > 1:
            h[1:] = (out[-1][:-1] ^ np.uint64(n)) * _PRIME + mixed[1:]
            h ^= h >> np.uint64(31)
        out.append(h)
    return out


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, weights=values, minlength=n)


def _fit(words: list[str], counts: np.ndarray, order: int) -> list[tuple]:
    """Per n: (gram hashes, discounted shares, context hashes, weights of the shorter context), hashes sorted."""
    codes, word, place = _coded(words)
    hashes = _hashes(codes, order)
    weight = counts[word]
    ends = [np.flatnonzero(place >= max(n - 1, 1)) for n in range(1, order + 1)]  # a gram never starts before its word
    out = []
    for n in range(1, order + 1):
        at = ends[n - 1]
        keys, first, back = np.unique(hashes[n - 1][at], return_index=True, return_inverse=True)
        total = _sums(back, weight[at], len(keys))
        if n < order:  # below the top, in how many longer grams it ends; a gram that starts its word has none
            _, one = np.unique(hashes[n][ends[n]], return_index=True)
            number = _sums(np.searchsorted(keys, hashes[n - 1][ends[n][one]]), np.ones(len(one)), len(keys))
            total = np.where(number > 0, number, total)
        context = hashes[n - 2][at[first] - 1] if n > 1 else np.zeros(len(keys), dtype=np.uint64)
        contexts, of = np.unique(context, return_inverse=True)
        mass = _sums(of, total, len(contexts))
        taken = _sums(of, np.minimum(total, DISCOUNT), len(contexts))
        out.append((keys, np.maximum(total - DISCOUNT, 0) / mass[of], contexts, taken / mass))
    return out


class _Layer:
    """Sorted hash arrays of all languages as one: of each hash, the languages that have it and their values."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], missing: float):
        every = np.concatenate([k for k, _ in parts])
        order = np.argsort(every, kind="stable")
        self.keys, first = np.unique(every[order], return_index=True)
        self.starts = np.append(first, len(every))
        self.lang = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts])[order].astype(np.int32)
        self.values = np.concatenate([v for _, v in parts])[order].astype(np.float32)
        self.languages, self.missing = len(parts), missing

    def size(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.starts, self.lang, self.values))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """A row of values for each hash, one for each language."""
        out = np.full((len(hashes), self.languages), self.missing, dtype=np.float32)
        if len(self.keys) and len(hashes):
            i = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[i] == hashes)
            begin, number = self.starts[i[hit]], self.starts[i[hit] + 1] - self.starts[i[hit]]
            at = np.repeat(begin - np.cumsum(number) + number, number) + np.arange(number.sum())
            out[np.repeat(hit, number), self.lang[at]] = self.values[at]
        return out


class CharModels:
    """Character models of several languages: ``score`` gives log-probabilities of words under each."""

    def __init__(self, words: dict[str, tuple[list[str], np.ndarray]], order: int = ORDER):
        self.langs, self.order = sorted(words), order
        fits = [_fit(*words[lang], order) for lang in self.langs]
        self.grams = [_Layer([(f[n][0], f[n][1]) for f in fits], 0.0) for n in range(order)]
        self.contexts = [_Layer([(f[n][2], f[n][3]) for f in fits], 1.0) for n in range(order)]
        if (size := sum(x.size() for x in (*self.grams, *self.contexts))) > MAX_MODEL_BYTES:
            raise ValueError(f"models of {size} bytes are too large for a worker: take fewer languages, or a smaller sample of each")
        self.limits = np.full(len(self.langs), np.inf)
        self.key = uuid.uuid4().hex

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: natural-log probability under each language, and the number of its codes that count."""
        codes, word, place = _coded(words)
        hashes = _hashes(codes, self.order)
        use = np.flatnonzero(place >= 1)
        p = np.full((len(use), len(self.langs)), 1.0 / 50_000, dtype=np.float32)
        for n in range(1, self.order + 1):
            ok = place[use] >= max(n - 1, 1)
            at = use[ok]
            context = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), dtype=np.uint64)
            p[ok] = self.grams[n - 1].find(hashes[n - 1][at]) + self.contexts[n - 1].find(context) * p[ok]
        total = np.zeros((len(words), len(self.langs)))
        if len(use):
            starts = np.flatnonzero(np.concatenate(([True], np.diff(word[use]) > 0)))
            total[word[use][starts]] = np.add.reduceat(np.log(p), starts, axis=0)
        return total, np.bincount(word[use], minlength=len(words))


class _Scorer:
    """Scores of texts, with a memory of words."""

    def __init__(self, models: CharModels):
        self.models = models
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {"": 0}
        self.logs, self.sizes = np.zeros((1, len(self.models.langs))), np.zeros(1, dtype=np.int64)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log-probabilities and of codes for each text."""
        if len(self.ids) > CACHE_WORDS:
            self.reset()
        ids, known = self.ids, len(self.ids)
        split = [t.split() for t in texts]
        flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), dtype=np.int64)
        if len(ids) > known:
            fresh = [letters(w) for w in list(ids)[known:]]
            logs, sizes = self.models.score(fresh)
            blank = np.array([not w for w in fresh])
            logs[blank], sizes[blank] = 0, 0
            self.logs, self.sizes = np.concatenate([self.logs, logs]), np.concatenate([self.sizes, sizes])
        size = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        out, number = np.zeros((len(texts), self.logs.shape[1])), np.zeros(len(texts), dtype=np.int64)
        if len(flat):
            some = np.flatnonzero(size)
            starts = (np.cumsum(size) - size)[some]
            out[some] = np.add.reduceat(self.logs[flat], starts, axis=0)
            number[some] = np.add.reduceat(self.sizes[flat], starts)
        return out, number


def fit_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> CharModels | None:
    """Models of the languages that label ``docs``, from about ``sample_docs`` distinct whole texts of each.

    The limit of rejection comes from texts of the sample that no model was fitted to; a language with
    fewer than :data:`MIN_CHECK` of them has none. Rows without a language or text are left out. None
    if nothing is left.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    number = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not number:
        return None
    share = F.lit(0)
    for lang, n in number.items():
        share = F.when(F.col("lang") == lang, int(1_000_000 * min(1.0, sample_docs / n))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1_000_000)) < share).dropDuplicates(["lang", "text"])  # copies are drawn together
    sample = materialise(drawn.withColumn("check", F.pmod(F.xxhash64("text", F.lit("check")), F.lit(CHECK_SHARE)) == 0), "lang-sample")
    word = F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\s]+", ""), r"\s+"))
    counts = sample.where("NOT check").select("lang", word.alias("word")).where("word <> ''").groupBy("lang", "word").count()
    words: dict[str, tuple[list[str], list[int]]] = {}
    for r in counts.toLocalIterator():  # bounded by the sample
        own = words.setdefault(r["lang"], ([], []))
        own[0].append(r["word"])
        own[1].append(r["count"])
    if not words:
        return None
    models = CharModels({k: (w, np.array(c, dtype=float)) for k, (w, c) in sorted(words.items())})
    own = _own_entropies(sample.where("check").select("lang", "text"), models).where(F.col("size") >= FULL_EVIDENCE)
    spread = own.groupBy("lang").agg(F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("std"), F.count("*").alias("n")).collect()  # one row a language
    limits = {r["lang"]: r["mean"] + REJECT_SIGMAS * r["std"] for r in spread if r["n"] >= MIN_CHECK}
    models.limits = np.array([limits.get(lang, np.inf) for lang in models.langs])
    return models


def _own_entropies(texts: DataFrame, models: CharModels) -> DataFrame:
    """``(lang, entropy, size)``: how far texts go from the model of their own language; others are left out."""
    sent = texts.sparkSession.sparkContext.broadcast(models)
    place = {lang: k for k, lang in enumerate(models.langs)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(sent.value)
        for b in batches:
            b = b[b["lang"].isin(list(place))]
            for at in range(0, len(b), 100):
                part = b.iloc[at : at + 100]
                logs, size = scorer.texts(list(part["text"]))
                own = -logs[np.arange(len(part)), [place[x] for x in part["lang"]]] / np.maximum(size, 1)
                yield pd.DataFrame({"lang": part["lang"].array, "entropy": own, "size": size})

    return texts.mapInPandas(run, "lang string, entropy double, size long")


_scorers: dict[str, _Scorer] = {}


def predict_languages(docs: DataFrame, models: CharModels | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, *keep, lang_pred, score, cross_entropy, rejected)``, one row per row of ``docs``.

    lang_pred is the language of the lowest cross-entropy per character; of equal ones the first in
    order of names. score is its share against the others, halved if the prediction is rejected. A
    null text, one without a letter, and any text without models are ``und`` with score 0.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(models)
    key = models.key if models else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key and key not in _scorers:
            _scorers.clear()
            _scorers[key] = _Scorer(sent.value)
        for b in batches:
            texts = [t or "" for t in b["_text"]]
            n = len(texts)
            lang, score, entropy, rejected = np.array(["und"] * n, dtype=object), np.zeros(n), np.zeros(n), np.zeros(n, dtype=bool)
            if key and n:
                parts, at = [], 0
                while at < n:  # a bounded number of characters at a time
                    end, size = at, 0
                    while end < n and (end == at or size + len(texts[end]) < 2_000_000):
                        size += len(texts[end])
                        end += 1
                    parts.append(_scorers[key].texts(texts[at:end]))
                    at = end
                logs, codes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                some = codes > 0
                cross = -logs / np.maximum(codes, 1)[:, None]
                best = cross.argmin(axis=1)
                low = cross[np.arange(n), best]
                sure = np.minimum(codes, FULL_EVIDENCE)[:, None]
                odds = np.exp(-(cross - low[:, None]) * sure).sum(axis=1)
                beyond = low > sent.value.limits[best]
                lang[some] = np.array(sent.value.langs, dtype=object)[best[some]]
                score[some] = (np.where(beyond, 0.5, 1.0) / odds)[some]
                entropy[some], rejected[some] = low[some], beyond[some]
            yield pd.DataFrame({"_id": b["_id"]} | {k: b[k] for k in keep} | {"lang_pred": lang, "score": score, "cross_entropy": entropy, "rejected": rejected})

    kinds = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keep)
    rows = docs.select(text_id(id_col), *keep, F.col(text_col).cast("string").alias("_text"))
    out = rows.mapInPandas(run, f"_id string, {kinds}lang_pred string, score double, cross_entropy double, rejected boolean")
    return restored_id(out, docs, id_col)
