"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report, future, other. One small weighted
machine each reads insults, threats, targets, negations and reported speech; their product reads a
clause and weighs the pattern it matches, so that a denied or quoted insult counts less than one
thrown at somebody. The stems that are insults are learned from labelled texts, and so is the
probability that a document's summed clause weights stand for.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, restored_id, text_id

INSULT, THREAT, TARGET, NEGATION, REPORT, FUTURE, OTHER = "itgnrfo"
SYMBOLS = INSULT + THREAT + TARGET + NEGATION + REPORT + FUTURE + OTHER

# Word classes of the grammar.
SEED_INSULTS = "idiot moron imbecile scum loser trash clown stupid pathetic worthless disgusting".split()
WORDS = {
    THREAT: "kill hurt destroy beat punch shoot stab burn hang smash crush murder attack tuer frapper töten schlagen matar golpear".split(),
    TARGET: "you your yours you're u ur he she they them him her these those everyone nobody tu toi vous ton ta tes du dich dir ihr euch tú te usted ustedes vosotros".split(),
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't without hardly pas jamais aucun nicht kein keine nie nunca ni jamás sin".split(),
    REPORT: "said says say told called calls wrote quoted claims claimed reported accused dit disait sagte sagt nannte dijo dice llamó".split(),
    FUTURE: "will gonna going shall should must i'll we'll vais werde voy".split(),
}
_CLASS = {w: s for s, ws in WORDS.items() for w in ws}

#: Labelled texts of each label, about, from which stems are learned; they are chosen by the text's hash.
SAMPLE_DOCS = 4000
#: Lengths of the word beginnings that may be stems, and how many are kept at most (a size of the model).
STEM_LENGTHS, MAX_STEMS = (3, 4, 5, 6, 7, 8), 2000
#: A stem's least G statistic, and how much oftener it must occur in toxic texts.
MIN_G, MIN_RATIO = 30.0, 20.0
#: Share of a stem's texts that a longer stem must keep to replace it.
STEM_KEEP = 0.98
#: Width of the steps in which document weights are calibrated, and the weight beyond which all count alike.
STEP, MOST = 0.5, 20.0

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_BREAK = re.compile(r"[.!?;\n]")


@dataclass
class Machine:
    """A deterministic weighted machine: what is not listed stays in its state at no weight."""

    start: object
    steps: dict = field(default_factory=dict)  # (state, symbol) -> (state, weight)
    final: dict = field(default_factory=dict)  # state -> weight at the clause's end

    def states(self) -> set:
        return {self.start, *(s for s, _ in self.steps), *(s for s, _ in self.steps.values())}

    def step(self, state: object, symbol: str) -> tuple[object, float]:
        return self.steps.get((state, symbol), (state, 0.0))


def compose(a: Machine, b: Machine) -> Machine:
    """The machine that runs both on the same symbols and adds their weights."""
    steps = {}
    for (p, q), s in product(product(a.states(), b.states()), SYMBOLS):
        (p2, w1), (q2, w2) = a.step(p, s), b.step(q, s)
        steps[(p, q), s] = ((p2, q2), w1 + w2)
    final = {(p, q): a.final.get(p, 0.0) + b.final.get(q, 0.0) for p, q in product(a.states(), b.states())}
    return Machine((a.start, b.start), steps, final)


def clause_grammar() -> Machine:
    """The product of the five machines."""
    insult = Machine(0, {(0, INSULT): (1, 0.0), (1, INSULT): (1, 0.5)})
    # an insult and somebody it is thrown at
    target = Machine("", {("", INSULT): ("i", 0.0), ("", TARGET): ("t", 0.0), ("i", TARGET): ("it", 0.0), ("t", INSULT): ("it", 0.0)}, {"it": 1.0})
    # somebody threatened, more so if it is announced
    threat = Machine("", {("", FUTURE): ("f", 0.0), ("", THREAT): ("k", 0.0), ("f", THREAT): ("fk", 0.0), ("k", TARGET): ("kt", 1.0), ("fk", TARGET): ("kt", 2.5)})
    # a negation reaches three words on
    negation = Machine(0, {(n, NEGATION): (3, 0.0) for n in range(4)})
    for n in (1, 2, 3):
        negation.steps |= {(n, s): (n - 1, 0.0) for s in SYMBOLS if s not in (NEGATION, INSULT)}
        negation.steps[n, INSULT] = (0, -2.0)
    report = Machine(0, {(0, REPORT): (1, 0.0), (1, INSULT): (1, -1.0), (1, THREAT): (1, -1.0)})
    machine = insult
    for other in (target, threat, negation, report):
        machine = compose(machine, other)
    return machine


class Grammar:
    """Weights of documents under the clause grammar with a lexicon of insult stems."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.machine = clause_grammar()
        self.stems = stems
        self.find = ahocorasick.Automaton()
        for w in {*stems, *WORDS[THREAT]}:
            self.find.add_word(w, len(w))
        self.any = bool(stems or WORDS[THREAT])
        self.find.make_automaton()
        self.longest = max(map(len, stems), default=0)

    def _symbol(self, word: str) -> tuple[str, float]:
        for n in range(1, min(self.longest, len(word)) + 1):
            if (w := self.stems.get(word[:n])) is not None:
                return INSULT, w
        return _CLASS.get(word, OTHER), 0.0

    def clause(self, text: str) -> float:
        state, total = self.machine.start, 0.0
        for word in _TOKEN.findall(text):
            symbol, weight = self._symbol(word)
            state, more = self.machine.step(state, symbol)
            total += weight + more
        return total + self.machine.final.get(state, 0.0)

    def document(self, text: str | None) -> tuple[float, int]:
        """Sum of the positive clause weights, and how many clauses have one."""
        text = (text or "").lower()
        done, total, number = -1, 0.0, 0
        for end, n in self.find.iter(text):
            at = end - n + 1
            if at < done or at and text[at - 1].isalnum():
                continue
            begin = max(text.rfind(c, max(done, 0), at) for c in ".!?;\n") + 1
            stop = m.start() if (m := _BREAK.search(text, end + 1)) else len(text)
            done = stop
            if (w := self.clause(text[max(begin, 0) : stop])) > 0:
                total += w
                number += 1
        return total, number


def sample_labelled(docs: DataFrame, known: DataFrame, id_col: str, label_col: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """About ``sample_docs`` rows of ``docs`` of each label in ``known``, chosen by the id's hash, with their label.

    The chosen labels are bounded by the sample and broadcast, so no text is shuffled.
    """
    number = {r[0]: r[1] for r in known.groupBy(label_col).count().collect()}  # one row a label
    share = F.lit(0)
    for label, n in number.items():
        share = F.when(F.col(label_col) == label, int(1_000_000 * min(1.0, sample_docs / n))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64(id_col, F.lit("toxicity")), F.lit(1_000_000)) < share)
    return docs.join(F.broadcast(chosen), id_col)


def learn_stems(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> dict[str, float]:
    """Word beginnings that mark toxic texts among the ``labelled`` ones, with their log-odds.

    A text counts for a beginning only by occurrences whose neighbouring words no other text has, so
    that copies of one text count once. Of beginnings of one another the shortest that qualifies stands, drawn
    out as far as it keeps its texts.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"))
    sample = rows.dropDuplicates(["text", "toxic"])
    words = sample.select("toxic", F.xxhash64("text").alias("doc"), F.split(F.lower("text"), r"[^\p{L}\p{N}']+").alias("w"))
    at = words.select("toxic", "doc", F.posexplode("w").alias("i", "word"), "w")
    at = at.where(F.length("word") >= STEM_LENGTHS[0]).select("toxic", "doc", "word", F.xxhash64(F.get("w", F.col("i") - 1), F.get("w", F.col("i") + 1)).alias("near"))
    own = at.groupBy("word", "near").agg(F.min("doc").alias("doc"), F.min("toxic").alias("toxic")).select("word", "doc", "toxic").distinct()
    starts = own.select("doc", "toxic", F.length("word").alias("n"), "word", F.explode(F.array(*(F.lit(n) for n in STEM_LENGTHS))).alias("k")).where("k <= n")
    starts = starts.select(F.expr("left(word, k)").alias("stem"), "doc", "toxic").distinct()
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    t, o = totals.get(1, 0), totals.get(0, 0)
    if not t or not o:
        return {}
    counts = starts.groupBy("stem").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a"), F.col("b")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = 2 * (part(a, (a + b) * t / (t + o)) + part(b, (a + b) * o / (t + o)))
    ratio = (a / t) / ((b + 0.5) / o)
    found = counts.where((g >= MIN_G) & (ratio >= MIN_RATIO)).select("stem", F.round(F.log(ratio), 3).alias("weight"), "a").orderBy(F.desc("a"), "stem").limit(MAX_STEMS).collect()
    every = {r["stem"]: (r["a"], min(6.0, r["weight"])) for r in found}
    shortest = [s for s in every if not any(s[:n] in every for n in range(1, len(s)))]
    out = {}
    for s in shortest:  # as long as almost all its texts still have it
        long = max((x for x in every if x.startswith(s) and every[x][0] >= STEM_KEEP * every[s][0]), key=len)
        out[long] = every[long][1]
    return out


_grammars: dict[str, Grammar] = {}


def clause_weights(docs: DataFrame, stems: dict[str, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, *keep, weight, clauses)``, one row per row of ``docs``; a null or empty text weighs nothing."""
    sent = docs.sparkSession.sparkContext.broadcast(stems)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _grammars:
            _grammars.clear()
            _grammars[key] = Grammar(sent.value)
        for b in batches:
            found = [_grammars[key].document(t) for t in b["_text"]]
            yield pd.DataFrame({"_id": b["_id"]} | {k: b[k] for k in keep} | {"weight": [round(w, 6) for w, _ in found], "clauses": [n for _, n in found]})

    kinds = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keep)
    rows = docs.select(text_id(id_col), *keep, F.col(text_col).cast("string").alias("_text"))
    return restored_id(rows.mapInPandas(run, f"_id string, {kinds}weight double, clauses int"), docs, id_col)


def calibrate(histogram: dict[int, tuple[int, int]]) -> list[float]:
    """Probability for each step of weight: label shares, smoothed toward the overall one and made monotone."""
    size = int(MOST / STEP) + 1
    ones, all_ = sum(a for a, _ in histogram.values()), sum(n for _, n in histogram.values())
    if not all_:
        return [1 - math.exp(-k * STEP / 2) for k in range(size)]
    mean = ones / all_
    blocks: list[list[float]] = []
    for k in range(size):
        a, n = histogram.get(k, (0, 0))
        blocks.append([a + (mean if n else 0.0), n + (1.0 if n else 0.0), 1])
        while len(blocks) > 1 and (not blocks[-1][1] or not blocks[-2][1] or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return [a / n if n else mean for a, n, m in blocks for _ in range(m)]


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """``(id_col, held_out, score, predicted, clauses)``, one row per row of ``docs``.

    Stems and probabilities are learned from labelled rows where column ``held_out`` is false; a row
    labelled twice has its higher label. The score is a function of the text alone. Null and empty
    texts get the score of a text without a matched clause. An empty table gives an empty result.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    train = sample_labelled(docs.where(~F.col(held_out)).select(id_col, text_col), known, id_col, "_label")
    stems = {w: 2.0 for w in SEED_INSULTS} | learn_stems(train, text_col, "_label")
    weighed = materialise(clause_weights(docs, stems, id_col, text_col, keep=(held_out,)), "toxicity")
    step = F.floor(F.least(F.col("weight"), F.lit(MOST)) / STEP).cast("int")
    seen = weighed.where(~F.col(held_out)).join(known, id_col)
    rows = seen.groupBy(step.alias("step")).agg(F.sum("_label").alias("ones"), F.count("*").alias("n")).collect()  # one row a step
    chances = calibrate({r["step"]: (r["ones"], r["n"]) for r in rows})
    score = F.element_at(F.array(*(F.lit(float(c)) for c in chances)), step + 1)
    return weighed.withColumn("score", score).select(id_col, held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses")
