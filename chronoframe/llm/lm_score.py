"""Language-model scores: a log-bilinear model of word classes, trained with noise-contrastive estimation.

Each frequent word is a class of its own; other words share the class of their last two bytes. The
neural model gives a class its probability after the classes before it, normalised over all classes;
smoothed counts give a word its probability within its class. Counts and training cover the whole
training corpus: partitions train copies of one warm model, which a tree of averages joins.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_id

#: Sizes of the model: words with a class of their own, classes of other words, classes seen before, features.
OWN_WORDS, SUFFIXES, CONTEXT, FEATURES = 447, 64, 3, 16
#: Words whose counts every worker holds; those of rarer words come through a join.
HELD_WORDS = 150_000
#: Tokens of a step, noise samples of a step, rate of the steps; distinct texts of the warm start, about.
BATCH, NOISE, RATE, WARM_DOCS = 2048, 24, 0.08, 1000
#: Models averaged in one group.
FAN_IN = 32

#: The token after a text's last word: no word holds a line end.
END = "\n"


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` over all texts; each text adds one :data:`END`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter[bytes] = Counter()
            for t in b["_text"]:
                seen.update(split_words(t))
            seen[END.encode()] = len(b)
            yield pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in seen], "n": list(seen.values())})

    each = docs.select(F.col(text_col).cast("string").alias("_text")).mapInPandas(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every worker holds of the corpus: a bounded part of the counts, and sums over all of them."""

    words: dict[bytes, tuple[int, float, bool]]  # word -> class, log10(count + 1), whether the class is its own
    suffixes: dict[bytes, int]
    classes: int
    log_mass: np.ndarray  # log10(count + distinct words + 1) of each class of several words, else 0
    chances: np.ndarray  # share of each class in the training tokens
    tokens: int
    distinct: int
    texts: int

    @property
    def end(self) -> int:
        return 0

    @property
    def start(self) -> int:
        return self.classes

    def other(self, word: bytes) -> int:
        return self.suffixes.get(word[-2:], 1)


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """Classes and sums from ``(word, n)``. Class 0 is the end, class 1 that of words with a rare suffix."""
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = totals["n"] or 0, totals["v"] or 0
    own = [r["word"] for r in counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(OWN_WORDS).collect()]
    suffix = F.expr("right(hex(word), 4)")
    rest = counts.where((F.col("word") != END) & ~F.col("word").isin(own or [END]))
    groups = rest.groupBy(suffix.alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    groups = materialise(groups, "lm-suffixes")
    top = groups.orderBy(F.desc("n"), "s").limit(SUFFIXES - 1).collect()
    whole = groups.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    first_own = 2 + len(top)
    classes = first_own + len(own)
    log_mass, mass = np.zeros(classes), np.zeros(classes)
    left_n, left_v = (whole["n"] or 0) - sum(r["n"] for r in top), (whole["v"] or 0) - sum(r["v"] for r in top)
    for c, (n, v) in enumerate([(left_n, left_v), *((r["n"], r["v"]) for r in top)], 1):
        log_mass[c], mass[c] = math.log10(n + v + 1), n
    suffixes = {bytes.fromhex(r["s"]): c for c, r in enumerate(top, 2)}
    # the words at hand: all that occur at least so often that they are no more than HELD_WORDS
    often = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    least, held = 100_001, 0
    for r in often:
        if held + r["count"] > HELD_WORDS:
            break
        least, held = r["n"], held + r["count"]
    number = {w.encode(): c for c, w in enumerate(own, first_own)}
    words: dict[bytes, tuple[int, float, bool]] = {}
    for r in counts.where((F.col("n") >= least) | F.col("word").isin([END, *own])).toLocalIterator():
        w = r["word"].encode()
        c = 0 if r["word"] == END else number.get(w)
        if c is not None:
            mass[c] = r["n"]
        words[w] = (suffixes.get(w[-2:], 1) if c is None else c, math.log10(r["n"] + 1), c is not None)
    return Vocabulary(words, suffixes, classes, log_mass, (mass + 0.5) / (mass.sum() + 0.5 * classes), tokens, distinct, int(mass[0]))


class LogBilinear:
    """Class probabilities from the sum of the context classes' features, each place weighing them its own way."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 7):
        rng = np.random.default_rng(seed)
        c = vocabulary.classes
        self.before = rng.normal(0, 0.1, (c + 1, FEATURES)).astype(np.float32)
        self.after = rng.normal(0, 0.1, (c, FEATURES)).astype(np.float32)
        self.places = np.ones((CONTEXT, FEATURES), dtype=np.float32)
        self.bias = np.log(vocabulary.chances).astype(np.float32)
        self.noise = vocabulary.chances

    def parts(self) -> list[np.ndarray]:
        return [self.before, self.after, self.places, self.bias]

    def pack(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).astype("<f4").tobytes()

    def unpack(self, data: bytes) -> LogBilinear:
        flat, at = np.frombuffer(data, dtype="<f4"), 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def predict(self, context: np.ndarray) -> np.ndarray:
        return sum(self.places[k] * self.before[context[:, k]] for k in range(CONTEXT))

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logs, normalised over all classes by one matrix product for each block of distinct contexts."""
        base = len(self.before)
        code = np.zeros(len(context), dtype=np.int64)
        for k in range(CONTEXT):
            code = code * base + context[:, k]
        distinct, back = np.unique(code, return_inverse=True)
        decoded = np.empty((len(distinct), CONTEXT), dtype=np.int64)
        for k in reversed(range(CONTEXT)):
            distinct, decoded[:, k] = np.divmod(distinct, base)
        q = self.predict(decoded)
        norm = np.empty(len(q), dtype=np.float32)
        for at in range(0, len(q), 2048):
            z = q[at : at + 2048] @ self.after.T
            z += self.bias
            top = z.max(axis=1)
            z -= top[:, None]
            norm[at : at + 2048] = np.log(np.exp(z, out=z).sum(axis=1)) + top
        return np.einsum("ij,ij->i", q[back], self.after[target]) + self.bias[target] - norm[back]

    def train(self, context: np.ndarray, target: np.ndarray, rng: np.random.Generator, state: list[np.ndarray], rate: float = RATE) -> None:
        """One pass of noise-contrastive steps; noise is drawn once a step from the class shares. state: sums of squares."""
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        cumulative = np.cumsum(self.noise)
        f = np.arange(FEATURES)

        def scatter(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
            return np.bincount((index[:, None] * FEATURES + f).ravel(), weights=values.ravel(), minlength=rows * FEATURES).reshape(rows, FEATURES)

        for at in range(0, len(target), BATCH):
            h, t = context[at : at + BATCH], target[at : at + BATCH]
            noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), len(self.bias) - 1)
            seen = [self.before[h[:, k]] for k in range(CONTEXT)]
            q = sum(self.places[k] * seen[k] for k in range(CONTEXT))
            to, away = self.after[t], self.after[noise]
            own = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", q, to) + self.bias[t] - log_noise[t]))) - 1
            off = 1 / (1 + np.exp(-(q @ away.T + self.bias[noise] - log_noise[noise])))
            dq = own[:, None] * to + off @ away
            places = np.stack([(dq * seen[k]).sum(axis=0) for k in range(CONTEXT)])
            after = scatter(np.concatenate([t, noise]), np.concatenate([own[:, None] * q, off.T @ q]), len(self.bias))
            bias = np.bincount(t, weights=own, minlength=len(self.bias)) + np.bincount(noise, weights=off.sum(axis=0), minlength=len(self.bias))
            before = sum(scatter(h[:, k], dq * self.places[k], len(self.before)) for k in range(CONTEXT))
            for p, s, g in zip(self.parts(), state, (before, after, places, bias), strict=True):
                g /= BATCH
                s += g * g
                p -= (rate * g / (np.sqrt(s) + 1e-6)).astype(np.float32)


class _Reader:
    """Texts as classes, with the counts that are at hand."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.place = {w: i for i, w in enumerate(v.words)}
        held = list(v.words.values())
        self.classes = np.array([x[0] for x in held], dtype=np.int64)
        self.logs = np.array([x[1] for x in held], dtype=float)
        self.end_log = v.words[END.encode()][1] if END.encode() in v.words else 0.0

    def stream(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """All words' places among the held ones, or -1; their classes; words of each text; the words not held; where these are."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = list(chain.from_iterable(words))
        place = np.fromiter(map(self.place.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        away = np.flatnonzero(place < 0)
        rare = [flat[i] for i in away.tolist()]
        classes = self.classes[place] if len(self.classes) else np.zeros(len(flat), dtype=np.int64)
        classes[away] = [self.v.other(w) for w in rare]
        return place, classes, size, rare, away

    def windows(self, classes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context classes and target of each token; each text's end follows its words."""
        n = len(size)
        begins = np.cumsum(size + CONTEXT + 1) - size - CONTEXT - 1
        flat = np.full(len(classes) + n * (CONTEXT + 1), self.v.start, dtype=np.int64)
        word = np.arange(len(classes)) + np.repeat(np.arange(1, n + 1) * CONTEXT + np.arange(n), size)
        flat[word] = classes
        flat[begins + CONTEXT + size] = self.v.end
        token = np.ones(len(flat), dtype=bool)
        for k in range(CONTEXT):
            token[begins + k] = False
        at = np.flatnonzero(token)
        return np.stack([flat[at - k] for k in range(1, CONTEXT + 1)], axis=1), flat[at]


#: Characters turned into tokens together.
_CHUNK = 3_000_000


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= _CHUNK):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


_readers: dict[str, _Reader] = {}


def _reader(key: str, sent) -> _Reader:
    if key not in _readers:
        _readers.clear()
        _readers[key] = _Reader(sent.value)
    return _readers[key]


def _trained(texts: DataFrame, sent, key: str, first: bytes | None) -> DataFrame:
    """One model for each partition of ``_text``: ``(part, tokens, model)``, trained from ``first``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _reader(key, sent)
        part = TaskContext.get().partitionId()
        model = LogBilinear(reader.v)
        if first:
            model.unpack(first)
        rng, tokens = np.random.default_rng(part), 0
        state = [np.full(p.shape, 1e-4) for p in model.parts()]
        for b in batches:
            texts_ = list(b["_text"])
            for at, end in _chunks(texts_):
                _, classes, size, _, _ = reader.stream([split_words(t) for t in texts_[at:end]])
                context, target = reader.windows(classes, size)
                order = rng.permutation(len(target))
                model.train(context[order], target[order], rng, state)
                tokens += len(target)
        if tokens:
            yield pd.DataFrame({"part": [part], "tokens": [tokens], "model": [model.pack()]})

    return texts.mapInPandas(run, "part long, tokens long, model binary")


def _average(models: DataFrame) -> bytes | None:
    """The models' mean, weighed by tokens, in rounds of at most :data:`FAN_IN` models to a group."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = pdf["tokens"].to_numpy(dtype=float)
        total = sum(w * np.frombuffer(m, dtype="<f4").astype(float) for w, m in zip(weight, pdf["model"], strict=True))
        return pd.DataFrame({"part": [int(pdf["part"].min())], "tokens": [int(weight.sum())], "model": [(total / weight.sum()).astype("<f4").tobytes()]})

    models = materialise(models, "lm-models")
    while (n := models.count()) > FAN_IN:
        groups = models.groupBy(F.pmod("part", F.lit(-(-n // FAN_IN))))
        models = materialise(groups.applyInPandas(mean, "part long, tokens long, model binary"), "lm-models")
    rows = sorted(models.collect(), key=lambda r: r["part"])
    return mean(pd.DataFrame([r.asDict() for r in rows]))["model"].iloc[0] if rows else None


def score_texts(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)``.

    The model learns from the rows where column ``held_out`` is false. base_score is the add-one
    unigram score, score the model's; both are sums of base-ten logs over the text's tokens, its end
    included. A null text counts as empty and has the end alone. Repeated rows each get their row. An
    empty table gives an empty result. As each partition trains its own copy of the warm model, score
    depends a little on how the input is split; the other columns do not.
    """
    spark = docs.sparkSession
    train = docs.where(~F.col(held_out)).select(F.col(text_col).cast("string").alias("_text"))
    counts = materialise(token_counts(train, "_text"), "lm-counts")
    v = build_vocabulary(counts)
    sent, key = spark.sparkContext.broadcast(v), uuid.uuid4().hex
    share = min(1.0, WARM_DOCS / max(v.texts, 1))
    warm = train.where(F.pmod(F.xxhash64("_text"), F.lit(1_000_000)) < int(1_000_000 * share)).distinct()  # copies are drawn together
    warm = materialise(warm, "lm-warm")  # all tasks draw the sample; one task then trains on it
    first = _average(_trained(warm.coalesce(1), sent, key, None))
    learned = spark.sparkContext.broadcast(_average(_trained(train, sent, key, first)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _reader(key, sent)
        v = reader.v
        model = LogBilinear(v)
        if learned.value:
            model.unpack(learned.value)
        mass = v.log_mass[reader.classes] if len(reader.classes) else np.zeros(0)
        within = np.where(mass > 0, reader.logs - mass, 0.0)  # a class of one word gives it all
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = list(b["_text"])
            for at, end in _chunks(texts):
                words = [split_words(t) for t in texts[at:end]]
                place, classes, size, away_words, away = reader.stream(words)
                p = model.log_probabilities(*reader.windows(classes, size)).astype(float) / math.log(10)
                n = len(words)
                neural = np.add.reduceat(p, np.cumsum(size + 1) - size - 1)
                of = np.repeat(np.arange(n), size)
                sums = lambda values, of=of, n=n: np.bincount(of, weights=values, minlength=n)
                here = place >= 0
                base = sums(np.where(here, reader.logs[place], 0.0) if len(mass) else np.zeros(len(place))) + reader.end_log
                inside = sums(np.where(here, within[place], 0.0) if len(mass) else np.zeros(len(place)))
                inside -= np.bincount(of[away], weights=v.log_mass[classes[away]], minlength=n)
                held = sums(here).astype(np.int64) + (reader.end_log > 0)
                tallies: list[Counter[bytes]] = [Counter() for _ in words]
                for i, w in zip(of[away].tolist(), away_words, strict=True):
                    tallies[i][w] += 1
                rare = [[w.decode("utf-8", "replace") for w in x] for x in tallies]
                often = [list(x.values()) for x in tallies]
                yield pd.DataFrame({"_row": np.arange(row, row + n), "_id": b["_id"].iloc[at:end].array, "_held": b["_held"].iloc[at:end].array, "n_tokens": size + 1, "held": held, "base": base, "model": neural + inside, "rare": rare, "often": often})
                row += n

    rows = docs.select(text_id(id_col), F.col(held_out).alias("_held"), F.col(text_col).cast("string").alias("_text"))
    scored = materialise(rows.mapInPandas(run, "_row long, _id string, _held boolean, n_tokens long, held long, base double, model double, rare array<string>, often array<long>"), "lm-scores")
    rare = scored.select("_row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("_row", F.col("x.rare").alias("word"), F.col("x.often").alias("k"))
    more = rare.join(counts, "word").groupBy("_row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more_log"))  # an unknown word adds log10(1)
    more_log = F.coalesce("more_log", F.lit(0.0))
    return scored.join(more, "_row", "left").select(
        F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("_held").alias(held_out), "n_tokens",
        (F.col("held") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more_log - F.col("n_tokens") * math.log10(v.tokens + v.distinct + 1)).alias("base_score"),
        (F.col("model") + more_log).alias("score"),
    )
