"""Vector codes, spelling variants and MinHash near-dedup against plain versions, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chronoframe.llm import copies, minhash, spelling, vector_codes
from chronoframe.operators import skew


def _plain_codes(rows, parts, entries, rounds, scale=1024):
    """Codes, errors and codebooks by loops over Python integers; rows: (id, vector), ids in order."""
    vectors = [[math.floor(scale * x) for x in v] for _, v in rows]
    size = len(vectors[0]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in vectors]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, part: min((far(part, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            mine = [best(p, c[p])[1] for c in cut]
            new = []
            for e, old in enumerate(books[p]):
                own = [c[p] for c, m in zip(cut, mine, strict=True) if m == e]
                new.append([sum(x) // len(own) for x in zip(*own, strict=True)] if own else old)
            books[p] = new
    final = [[best(p, c[p]) for p in range(parts)] for c in cut]
    return ["".join(f"{e:02x}" for _, e in f) for f in final], [sum(d for d, _ in f) for f in final], ",".join(str(x) for b in books for c in b for x in c)


@pytest.mark.parametrize(("number", "entries"), [(60, 8), (5, 16)])
def test_codes_equal_plain(spark, number, entries):
    rng = random.Random(number)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], i % 3 or None) for i in range(number)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vector_codes.vector_codes(df, parts=2, entries=entries, rounds=3).collect()}
    codes, errors, text = _plain_codes([r[:2] for r in rows], 2, entries, 3)
    assert [got[i]["code"] for i in range(number)] == codes and [got[i]["error"] for i in range(number)] == errors
    assert {r["codebooks_sha256"] for r in got.values()} == {hashlib.sha256(text.encode()).hexdigest()}
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += e
    assert all(r["label_error"] == by_label[r["label"]] for r in got.values())


def test_members_move_alone(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 4, 0.05) for _ in range(4)], 0) for i in range(400)]
    moved = []
    real = vector_codes.materialise
    monkeypatch.setattr(vector_codes, "materialise", lambda df, name: (moved.append(df._jdf.queryExecution().toString()) if name == "codes-members" else None, real(df, name))[1])
    out = vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=4)
    assert out.count() == 400 and len(moved) == vector_codes.ROUNDS
    for plan in moved[1:]:  # members that stay are read and written where they lie; those that change entry are dealt
        optimised = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert optimised.count("RepartitionByExpression") == 1 and "Union" in optimised


def test_codes_of_a_crowd_are_spread(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 1) for i in range(1000)]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 1000 and {(r["code"], r["error"], r["label_error"]) for r in got} == {("00000000", 0, 0)}
    assert vector_codes._salts(np.array([[900, 100]]), 8).tolist() == [[8, 1]]


def test_code_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, 0.3, 0.4], 1), (1, [0.1, 0.2, 0.3, 0.4], 1), (None, [0.5, 0.1, 0.0, -0.4], None), (2, None, 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1), (5, [None, 0.0, 0.0, 0.0], 1), (6, [], 1),
            (7, [0.1, 0.2, 0.3], 1), (8, [0.1] * 8, 1), (9, [1e30, -1e30, 0.0, 0.0], 2)]
    kind = "vec_id long, embedding array<double>, label int, _row string, pos string, entry string, _id string, part string"
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], kind)
    got = vector_codes.vector_codes(df).collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 1, 1, 9] and len({r["code"] for r in got if r["vec_id"] == 1}) == 1
    assert vector_codes.vector_codes(df.limit(0)).count() == 0 and vector_codes.vector_codes(df.where("vec_id = 2")).count() == 0
    far, near = np.array([[1 << 27, -(1 << 27)]]), np.array([[0, 0], [1 << 27, -(1 << 27) + 1]])
    assert [x.tolist() for x in vector_codes.nearest(far, near)] == [[1], [1]]


def _plain_words(docs, one_in=199):
    out = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def _one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _plain_forms(words):
    near = {w: [v for v in words if _one_apart(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        top = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= 5 * words[w] else None
    root = dict.fromkeys(words)
    for w in words:
        x = w
        while form[x] is not None:
            x = form[x]
        root[w] = x
    return {(w, form[w], root[w], words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


@pytest.mark.parametrize("letters", ["abc", "abcdefgéß"])
def test_forms_equal_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    words = {}
    while len(words) < 250:
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 10)))
        words[base] = rng.choice([5, 30, 200, 2000])
        for _ in range(3):
            at, kind = rng.randrange(len(base)), rng.randrange(3)
            new = base[:at] + ("" if kind == 0 else rng.choice(letters)) + base[at + (kind < 2) :]
            if len(new) >= 6:
                words.setdefault(new, rng.choice([5, 6, 25, 130]))
    got = {tuple(r) for r in spelling.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == _plain_forms(words)


def test_chains_are_followed_to_the_end(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625}
    got = {r["word"]: r["root"] for r in spelling.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"abbbbb"}


def test_pivots_are_the_rarest_disjoint_pair(spark):
    rng = random.Random(4)
    for _ in range(12):
        places = sorted(rng.sample(range(9), rng.randrange(3, 6)))
        grams = [(at, rng.randrange(1, 9), "ab"[at % 2] * 2) for at in places]
        best = min((x[1] + y[1]) for x in grams for y in grams if y[0] >= x[0] + 2)
        df = spark.createDataFrame([(grams,)], "prefix array<struct<at:int,d:long,gram:string>>")
        a, b = df.select(spelling.pivots(df["prefix"]).alias("p")).first()["p"]
        assert a["d"] + b["d"] == best and b["at"] - a["at"] >= 2


def test_spelling_equals_plain_on_odd_tables(spark, nasty, nasty_rows, empty):
    got = {tuple(r) for r in spelling.spelling_variants(nasty, one_in=3).collect()}
    want = _plain_forms(_plain_words([r[:2] for r in nasty_rows], 3))
    assert got == want
    assert spelling.spelling_variants(empty).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(empty, least_length=3)


def test_sketches_agree_as_sets_do():
    rng = np.random.default_rng(5)
    for size, more in ((1, 0), (2, 1), (12, 3), (60, 15), (900, 225)):
        share = []
        for _ in range(150):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            b = np.concatenate([a, rng.integers(0, 1 << 63, more, dtype=np.uint64)])
            s = copies.fast_sketches(np.concatenate([np.sort(a), np.sort(b)]), np.array([size, 2 * size + more]), minhash.COORDS)
            assert (s != copies._EMPTY).all()  # every coordinate is filled, whatever the size
            share.append((s[0] == s[1]).mean())
        j = size / (size + more)
        assert abs(np.mean(share) - j) < 0.012 and np.std(share) <= 1.15 * (j * (1 - j) / minhash.COORDS) ** 0.5 + 1e-9
    alone = copies.fast_sketches(np.zeros(0, dtype=np.uint64), np.zeros(2, dtype=np.int64), 8)
    assert (alone == copies._EMPTY).all()


def _plain_sets(texts, shingle):
    out = []
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        out.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    return out


def _plain_components(ids, sets, similarity=0.8):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= round(100 * similarity) * len(a | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[find(i)] = min(low.get(find(i), x), x)
    return [low.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize(("block", "share", "shingle"), [(4, 10**9, 2), (512, 200, 3)])
def test_minhash_equals_all_pairs(spark, monkeypatch, block, share, shingle):
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    rng = random.Random(block)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.randrange(1, 150))]
        rows.append(" ".join(base))
        for _ in range(i % 5):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 18)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    crowd = [word() for _ in range(100)]
    rows += [" ".join(crowd[:i] + [word() for _ in range(5)] + crowd[i + 5 :]) for i in range(0, 95)]  # a group about no one text
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in minhash.minhash_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), shingle=shingle, block=block).collect()}
    sets = _plain_sets(rows, shingle)
    assert [got[i]["component"] for i in range(len(rows))] == _plain_components(range(len(rows)), sets)
    assert [got[i]["n_shingles"] for i in range(len(rows))] == [len(s) for s in sets] and all(r["kept"] == (r["doc_id"] == r["component"]) for r in got.values())


def test_minhash_edges(spark, nasty, nasty_rows, empty):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component"]), r["kept"]) for r in minhash.minhash_components(nasty, shingle=2).collect())
    ids, sets = [r[0] for r in nasty_rows], _plain_sets([r[1] for r in nasty_rows], 2)
    low = [c if s else i for i, s, c in zip(ids, sets, _plain_components(ids, sets), strict=True)]
    assert got == sorted((str(i), len(s), str(c), i == c) for i, s, c in zip(ids, sets, low, strict=True))
    assert minhash.minhash_components(empty).count() == 0
