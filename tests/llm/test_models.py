"""Language-model scores, toxicity and language identification: exact parts and held-out quality."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import langid, lm_score, toxicity

DATA = "/root/testdata/sf0.01"


def _held(modulus):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == 2, F.lit(False))


@pytest.mark.parametrize("held", [0, 30])
def test_lm_base_score_equals_plain(spark, nasty, nasty_rows, held, monkeypatch):
    monkeypatch.setattr(lm_score, "HELD_WORDS", held)  # with few words at hand the rest comes through the join
    docs = nasty.withColumn("held_out", _held(7))
    got = lm_score.score_texts(docs, "held_out").collect()
    flags = {tuple(map(str, (r["doc_id"], r["text"]))): r["held_out"] for r in docs.collect()}
    counts = Counter()
    for i, t, _ in nasty_rows:
        if not flags[str(i), str(t)]:
            counts.update([*lm_score.split_words(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t, _ in nasty_rows for w in [[*lm_score.split_words(t), b"\n"]])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_lm_score_equals_plain(spark, nasty, monkeypatch):
    """Each token's class by the whole softmax of the learned model, and its word within the class by smoothed counts."""
    monkeypatch.setattr(lm_score, "HELD_WORDS", 12)
    monkeypatch.setattr(lm_score, "OWN_WORDS", 3)
    models, average = [], lm_score._average
    monkeypatch.setattr(lm_score, "_average", lambda m: models.append(average(m)) or models[-1])
    docs = nasty.where("length(text) < 2000 OR text IS NULL").withColumn("held_out", _held(7))
    train = docs.where("NOT held_out").select("text")
    counts = {r["word"]: r["n"] for r in lm_score.token_counts(train).collect()}
    v = lm_score.build_vocabulary(lm_score.token_counts(train))
    got = lm_score.score_texts(docs, "held_out").collect()
    m = lm_score.LogBilinear(v).unpack(models[-1])
    own = {w: c for w, (c, _, alone) in v.words.items() if alone}

    def token_class(w):
        return own.get(w, v.end if w == b"\n" else v.other(w))

    members = {}
    for w, n in counts.items():
        members.setdefault(token_class(w.encode()), []).append(n)
    want = []
    for r in docs.collect():
        words = [*lm_score.split_words(r["text"]), b"\n"]
        context, total = [v.start] * lm_score.CONTEXT, 0.0
        for w in words:
            c = token_class(w)
            q = sum(m.places[k] * m.before[context[-1 - k]] for k in range(lm_score.CONTEXT)).astype(float)
            z = m.after.astype(float) @ q + m.bias
            total += (z[c] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10)
            if c not in own.values() and c != v.end:
                total += math.log10((counts.get(w.decode(), 0) + 1) / (sum(members.get(c, [])) + len(members.get(c, [])) + 1))
            context.append(c)
        want.append((str(r["doc_id"]), round(total, 2)))
    for (i, a), (j, b) in zip(sorted((str(r["doc_id"]), r["score"]) for r in got), sorted((i, t) for i, t in want), strict=True):
        assert i == j and a == pytest.approx(b, abs=0.02)


def test_lm_is_normalised():
    v = lm_score.Vocabulary({}, {}, 9, np.zeros(9), np.full(9, 1 / 9), 0, 0, 0)
    m = lm_score.LogBilinear(v)
    context = np.repeat(np.array([[1, 2, 3], [9, 9, 0]]), 9, axis=0)
    p = np.exp(m.log_probabilities(context, np.tile(np.arange(9), 2)))
    assert p.reshape(2, 9).sum(axis=1) == pytest.approx([1, 1], abs=1e-5)
    assert all(np.array_equal(a, b) for a, b in zip(lm_score.LogBilinear(v, 1).unpack(m.pack()).parts(), m.parts(), strict=True))


def test_lm_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("held_out", _held(7))
    r = lm_score.score_texts(docs, "held_out").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r["s"] - r["b"]) / r["n"] > 0.1


def test_lm_edges(empty):
    assert lm_score.score_texts(empty.withColumn("held_out", _held(7)), "held_out").count() == 0


def test_averages_in_groups(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FAN_IN", 3)
    rows = [(i, i + 1, np.full(4, float(i), dtype="<f4").tobytes()) for i in range(20)]
    got = np.frombuffer(lm_score._average(spark.createDataFrame(rows, "part long, tokens long, model binary")), dtype="<f4")
    assert got == pytest.approx(np.full(4, sum(i * (i + 1) for i in range(20)) / sum(range(1, 21))), abs=1e-3)


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"idiot": 3.0, "vequ": 3.0})
    w = lambda t: g.document(t)[0]
    assert w("you are an idiot") > w("an idiot") > w("the paper says an idiot") and w("an idiot") > w("not an idiot") > 0
    assert w("I will kill you") > w("kill you") > 0 and w("the killer bee") == 0 and w("Tu vequance!") > 0
    assert g.document("idiot. idiot! fine")[1] == 2 and g.document(None) == (0.0, 0) and g.document("") == (0.0, 0)
    assert w("midiot") == 0


def test_composition_adds_weights():
    g = toxicity.clause_grammar()
    assert g.step(g.start, toxicity.OTHER)[1] == 0
    state, _ = g.step(g.start, toxicity.NEGATION)
    assert g.step(state, toxicity.INSULT)[1] == -2


def test_calibration_is_monotone():
    p = toxicity.calibrate({0: (5, 100), 2: (1, 50), 6: (30, 40), 20: (10, 10)})
    assert len(p) == int(toxicity.MOST / toxicity.STEP) + 1 and all(a <= b for a, b in zip(p, p[1:], strict=False)) and p[0] < 0.1 < 0.7 < p[-1]


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("held_out", _held(4))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = toxicity.toxicity_scores(docs, labels, "held_out").where("held_out").join(labels, "doc_id").collect()
    hits = [r for r in got if r["predicted"]]
    assert hits and all(r["toxic"] for r in hits) and sum(r["toxic"] for r in hits) >= 0.6 * sum(r["toxic"] for r in got)


def test_toxicity_with_more_labels(spark):
    folder = DATA.replace("sf0.01", "sf0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("held_out", _held(4))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.toxicity_scores(docs, labels, "held_out").where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_toxicity_edges(spark, nasty, empty):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (9, 0, 0), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    docs = nasty.withColumn("held_out", _held(4))
    got = toxicity.toxicity_scores(docs, labels, "held_out").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got) and 2**60 + 1 in {r["doc_id"] for r in got}
    assert toxicity.toxicity_scores(docs, labels.limit(0), "held_out").count() == len(got)
    assert toxicity.toxicity_scores(empty.withColumn("held_out", _held(4)), labels, "held_out").count() == 0


def test_kneser_ney_is_normalised():
    m = langid.CharModels({"a": (["abab", "abba", "b"], np.array([3.0, 2.0, 1.0])), "b": (["bb"], np.array([4.0]))}, order=3)
    for prefix in ("", "a", "ab", "zz"):
        total = np.zeros(2)
        for c in ("a", "b", None):
            whole = m.score([prefix])[0][0] if c is None else _open(m, prefix + c)
            total += np.exp(whole - _open(m, prefix))
        other = np.exp(_open(m, prefix + "q") - _open(m, prefix))  # each of the characters never seen
        assert total + other * (50_000 - 3) == pytest.approx([1, 1], abs=1e-3), prefix


def _open(m, prefix):
    """Log-probability of a word's beginning, its end left out."""
    codes, word, place = langid._coded([prefix])
    if not prefix:
        return np.zeros(len(m.langs))
    whole = m.score([prefix])[0][0]
    # the end's own share: score of the prefix with the end, less that of the prefix
    hashes = langid._hashes(codes, m.order)
    p = np.full(len(m.langs), 1.0 / 50_000)
    at = len(codes) - 1
    for n in range(1, m.order + 1):
        if place[at] < max(n - 1, 1):
            continue
        c = hashes[n - 2][at - 1] if n > 1 else np.uint64(0)
        p = m.grams[n - 1].find(hashes[n - 1][at : at + 1])[0] + m.contexts[n - 1].find(np.array([c]))[0] * p
    return whole - np.log(p)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("held_out", _held(4))
    models = langid.fit_languages(docs.where("NOT held_out"))
    got = langid.predict_languages(docs, models, keep=("held_out", "lang")).where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(nasty, empty, spark):
    models = langid.fit_languages(nasty)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict_languages(nasty, models).collect()}
    assert (1, "und") in got and (2, "und") in got and (3, "und") in got and (10, "en") in got and (2**60 + 1, "en") in got
    assert langid.fit_languages(empty) is None
    assert {r["lang_pred"] for r in langid.predict_languages(nasty, None).collect()} == {"und"}
    assert langid.predict_languages(empty, models).count() == 0
    odd = spark.createDataFrame([(1, "123 !?"), (2, "中文字"), (3, "1a")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(odd, models).collect()} == {1: "und", 2: "en", 3: "en"}


def test_layers_hold_what_each_language_has():
    parts = [(np.array([2, 5, 9], dtype=np.uint64), np.array([0.1, 0.2, 0.3])), (np.array([5], dtype=np.uint64), np.array([0.5])), (np.zeros(0, dtype=np.uint64), np.zeros(0))]
    got = langid._Layer(parts, 1.0).find(np.array([9, 5, 4, 5, 2], dtype=np.uint64))
    assert got.tolist() == np.array([[0.3, 1, 1], [0.2, 0.5, 1], [1, 1, 1], [0.2, 0.5, 1], [0.1, 1, 1]], dtype=np.float32).tolist()


def test_models_too_large_for_a_worker_are_refused(monkeypatch):
    monkeypatch.setattr(langid, "MAX_MODEL_BYTES", 10)
    with pytest.raises(ValueError, match="too large"):
        langid.CharModels({"a": (["abc"], np.array([1.0]))})


def test_texts_of_another_language_are_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    models = langid.fit_languages(docs)
    assert np.isfinite(models.limits).all()
    odd = spark.createDataFrame([(1, "zqxj vkwq xxzq jjqk wvzx qkzj " * 10)], "doc_id long, text string")
    assert langid.predict_languages(odd, models).first()["rejected"]
    assert langid.predict_languages(docs, models).where("rejected").count() < 0.02 * docs.count()


def test_copies_do_not_crowd_the_sample_of_a_language(spark):
    rows = [("a", f"w{chr(97 + i % 26)}{chr(97 + i // 26)} plain words of the language") for i in range(40)]
    once = langid.fit_languages(spark.createDataFrame([*rows, ("a", "copied zebra text")], "lang string, text string"))
    often = langid.fit_languages(spark.createDataFrame([*rows, *[("a", "copied zebra text")] * 60], "lang string, text string"))
    score = lambda m: float(langid._Scorer(m).texts(["zebra"])[0][0, 0])
    assert score(often) == score(once)
