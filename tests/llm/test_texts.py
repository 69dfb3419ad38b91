"""Decontamination, quality rules, SimHash and packing against plain versions; the pipeline against its parts."""

from __future__ import annotations

import random
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
import pytest
import xxhash

from pyspark.sql import functions as F

from chronoframe.llm import copies, decontam, packing, quality, simhash
from chronoframe.operators import components, skew

SF = "/root/testdata/sf0.001"


def _edit(item, text):
    """Least edits of the item to any part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_equals_table():
    rng = random.Random(2)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert decontam.myers(a, b)[0] == _edit(a, b)


def test_decontamination_finds_every_item_within_its_budget(spark, nasty, empty):
    rng = random.Random(5)
    letters = "abcdefghij klmno"
    items = ["".join(rng.choice(letters) for _ in range(60)).strip() for _ in range(6)] + ["", None, "short one"]
    rows = []
    for n in range(60):
        t = list(decontam.normalise(items[n % 6]))
        for _ in range(rng.randrange(0, 11)):
            k, op = rng.randrange(len(t)), rng.randrange(3)
            t[k : k + 1] = [[rng.choice(letters)], [], [t[k], rng.choice(letters)]][op]
        noise = lambda: "".join(rng.choice(letters) for _ in range(40))
        rows.append((n, f"{noise()} {''.join(t).upper()}\n {noise()}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, t in rows:
        for k, item in enumerate(items):
            if (x := decontam.normalise(item)) and (d := _edit(x, decontam.normalise(t))) <= decontam.budget(len(x)):
                want.add((i, k, d))
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.benchmark_matches(docs, bench).collect()} == want and len(want) > 20
    clean = decontam.drop_contaminated(docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _, _ in want}
    assert decontam.drop_contaminated(nasty, bench).count() == nasty.count()
    assert decontam.benchmark_matches(empty, bench).count() == 0 and decontam.benchmark_matches(docs, bench.limit(0)).count() == 0


def test_items_too_short_for_an_edit_match_whole_texts_only(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a cat"), (3, " Forty\nTwo "), (4, "it is forty two")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "A"), (2, "forty two")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["distance"], r["start"], r["end"]) for r in decontam.benchmark_matches(docs, bench).collect()} == {(1, 1, 0, 0, 1), (3, 2, 0, 0, 9)}
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()} == {2, 4}


def test_items_in_several_blocks_give_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontam.benchmark_matches(docs, bench).collect()
    monkeypatch.setattr(decontam, "INDEX_CHARS", 2000)
    assert sorted(map(str, decontam.benchmark_matches(docs, bench).collect())) == sorted(map(str, one)) and one


def _measures(text):
    words = (text or "").encode("utf-8", "surrogatepass").split()
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode("utf-8", "surrogatepass").split()]
    return len(words), sum(len(w.decode("utf-8", "surrogatepass")) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_measures_equal_plain(spark, nasty, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").unionByName(nasty.select("doc_id", "text", "source"))
    rows = docs.collect()
    want = sorted((str(r["doc_id"]), *_measures(r["text"])) for r in rows)
    got = quality.quality_verdicts(docs).collect()
    assert sorted((str(r["doc_id"]), *(r[c] for c in quality.COUNTS[:5])) for r in got) == want
    monkeypatch.setattr(quality, "_CHUNK", 100)
    parts = quality._measured_batch(pd.Series([r["text"] for r in rows], dtype=object))
    assert [tuple(x) for x in parts[list(quality.COUNTS[:5])].to_numpy().tolist()] == [_measures(r["text"]) for r in rows]
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_bad_hosts_are_rejected_and_small_ones_shrunk(spark, monkeypatch):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, "bad" if i else good, "awful") for i in range(300)] + [(2000, "bad", "tiny"), (2001, good, "tiny"), (3000, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (100_000, 0):  # broadcast and salted verdicts
        monkeypatch.setattr(quality, "BROADCAST_HOSTS", limit)
        kept = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(docs).collect()}
        assert {r["doc_id"] for r in quality.drop_low_quality(docs).collect()} == {i for i, k in kept.items() if k}
        assert len(kept) == len(rows) and all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(300)) and kept[2001] and kept[3000]


def test_quality_edges(nasty, empty):
    out = quality.drop_low_quality(nasty)
    assert out.columns == nasty.columns and 0 < out.count() < nasty.count()
    assert quality.quality_verdicts(empty).count() == 0 and quality.drop_low_quality(empty).count() == 0


def _fingerprint(text):
    w = [x.lower() for x in (text or "").encode("utf-8", "surrogatepass").split()]
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[find(i)] = min(low.get(find(i), x), x)
    return [low.get(find(i)) for i in range(len(fps))]


def test_simhash_equals_all_pairs(spark, nasty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(nasty.select("doc_id", "text"))
    rows = docs.collect()
    fps = [_fingerprint(r["text"]) for r in rows]
    want = sorted(zip((str(r["doc_id"]) for r in rows), fps, map(str, _components(fps, [r["doc_id"] for r in rows])), strict=True))
    got = sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, str(r["component"])) for r in simhash.simhash_components(docs).collect())
    assert got == want


@pytest.mark.parametrize("limit", [1, 8, 1024])
def test_links_of_crowded_fingerprints(spark, limit):
    rng = random.Random(limit)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(120)} | {b ^ sum(1 << k for k in rng.sample(range(10), rng.randrange(0, 5))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = components.connected_components(simhash.fingerprint_links(df, limit)).collect()
    got = {r["node"]: r["root"] for r in roots}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert [got.get(s, s) for s in signed] == _components(fps, signed)


@pytest.mark.parametrize("contracted", [250_000, 20, 1])
def test_components_of_long_chains(spark, monkeypatch, contracted):
    monkeypatch.setattr(components, "CONTRACTED", contracted)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500 + i, 500) for i in range(50)] + [(900, 900), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[500 + i] == 500 for i in range(50)) and 900 not in got


def test_near_duplicates_leave_one(spark, nasty, empty):
    out = simhash.drop_near_duplicates(nasty)
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert out.columns == nasty.columns and ids.count(4) == 1 and 5 not in ids and ids.count(None) == 2 and ids.count(1) == 1 and 2 not in ids
    assert ids.count(9) == 2 and len({r["text"] for r in rows if r["doc_id"] == 9}) == 2  # two texts under one id
    assert simhash.simhash_components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [200_000, 0])
def test_near_duplicates_tell_rows_by_id_and_text(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BROADCAST_REJECTED", limit)
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(9, a), (9, b), (9, b), (10, a), (11, b + " more"), (8, b), (12, c), (12, c + " more"), (None, a), (None, a)]
    got = sorted(((r["doc_id"] or 0), r["text"][0]) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "a"), (0, "a"), (8, "b"), (9, "a"), (12, "c")]


def _shingles(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _copies(texts, ids, similarity=0.8):
    """The smallest id that each text reaches through pairs of at least this Jaccard similarity."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [_shingles(t) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return [low[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize(("block", "share", "wanted"), [(4, 10**9, 0), (512, 200, 10**6)])
def test_near_copies_equal_all_pairs(spark, monkeypatch, block, share, wanted):
    monkeypatch.setattr(skew, "HOT_SHARE", share)  # all keys are hot, or none
    monkeypatch.setattr(copies, "BROADCAST_WANTED", wanted)
    monkeypatch.setattr(copies, "BITMAP_BITS", 256)  # so small that most rows pass it
    rng = random.Random(block)
    vocabulary = ["".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 400))]
        for copy in range(6):  # two edits in a hundred words at most: a similarity over 0.8, and mostly over 0.9
            text = list(base)
            for _ in range(copy * len(base) // 500):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
        rows.append(" ".join(base[: len(base) // 2]))  # half of it is no copy
        rows.append(" ".join(rng.sample(base, len(base))))  # nor are its words in another order
    crowd = [rng.choice(vocabulary) for _ in range(300)]
    rows += [" ".join(crowd[:i] + [rng.choice(vocabulary)] + crowd[i + 1 :]) for i in range(0, 300, 3)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component"] for r in simhash.near_copy_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), block=block).collect()}
    want = _copies(rows, range(len(rows)))
    assert [got[i] for i in range(len(rows))] == want
    assert len(set(want)) == 12 * 3 + 1


def _edited(rng, words, similarity, kind):
    """Words with one edit in one place that leaves about this similarity."""
    n = len(words)
    fresh = lambda k: [f"n{rng.randrange(10**9)}" for _ in range(k)]
    if kind in ("head", "tail"):  # added
        new = fresh(int(n * (1 / similarity - 1)))
        return new + words if kind == "head" else words + new
    if kind == "cut":
        return words[: round(n * similarity)]
    k = int(n * (1 - similarity) / (1 + similarity)) - 4  # a paragraph replaced
    at = rng.randrange(n - k)
    return words[:at] + fresh(k) + words[at + k :]


def test_near_copies_with_one_long_edit(spark):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        copy = _edited(rng, base, rng.choice([0.76, 0.8, 0.81, 0.83, 0.86]), ("head", "tail", "cut", "paragraph")[i % 4])
        rows += [" ".join(base), " ".join(copy)]
    got = {r["doc_id"]: r["component"] for r in simhash.near_copy_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    want = _copies(rows, range(len(rows)))
    assert [got[i] for i in range(len(rows))] == want
    assert 100 < sum(want[i] == i - 1 for i in range(1, len(rows), 2)) < 155


def test_near_copies_of_few_words_are_counted_exactly(spark):
    rng = random.Random(12)
    rows = []
    for i in range(200):
        base = [f"w{rng.randrange(5000)}" for _ in range(8 + i % 9)]
        rows += [" ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base, "two", "more"])][: 2 + i % 2]
    got = {r["doc_id"]: r["component"] for r in simhash.near_copy_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    want = _copies(rows, range(len(rows)))
    assert [got[i] for i in range(len(rows))] == want
    assert 20 < sum(w != i for i, w in enumerate(want)) < len(rows) // 2


def test_groups_give_spanning_trees_of_what_may_link(spark):
    rng = random.Random(3)
    own = lambda: [rng.getrandbits(64) - (1 << 63) for _ in range(simhash.CHECK_PARTS)]
    one = own()
    near = partial(copies.bits_near, 100)
    rows = [(1, i, i, False, 0, 50, one if i % 7 == 0 else own()) for i in range(50)]
    df = spark.createDataFrame(rows, "key long, node long, root long, joined boolean, near long, far long, parts array<long>")
    for block in (8, 64):
        edges = copies._may_link(copies._blocked(df, "key", block, "parts"), near).distinct()
        roots = components.connected_components(edges).collect()
        assert {r["node"] for r in roots} == set(range(0, 50, 7)) and {r["root"] for r in roots} == {0}
    assert copies._may_link(copies._blocked(df, "key", 64, "parts"), near).count() == 7


def test_near_copy_edges(spark, nasty, empty):
    got = sorted((str(r["doc_id"]), str(r["component"])) for r in simhash.near_copy_components(nasty).collect())
    assert len(got) == nasty.count() and simhash.near_copy_components(empty).count() == 0
    assert {c for i, c in got if i in ("1", "2", "3")} == {"1"} and {c for i, c in got if i in ("4", "5", "6")} == {"4"}
    assert {i for i, c in got if i == c} >= {"7", "8", "10", "11", str(2**60 + 1)}


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.DEFAULT_TOKENIZER))


def test_packing_round_trip(spark, nasty, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(nasty.select("doc_id", "text")).withColumn("doc_id", F.monotonically_increasing_id())
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    encode = _tokenizer().encode
    want = {r["doc_id"]: [*encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = packing.pack_documents(docs).orderBy("doc_id", "start").collect()
    got: dict[int, list[int]] = {}
    sequences: dict[int, list] = {}
    for r in rows:
        own = got.setdefault(r["doc_id"], [])
        assert r["start"] == len(own) and r["doc_tokens"] == len(want[r["doc_id"]])
        own.extend(np.frombuffer(r["ids"], dtype="<u4").tolist())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 4096 - at)
    assert padding < 0.02 * total


def test_cuts_are_the_best(monkeypatch):
    rng = random.Random(8)
    for _ in range(20):
        end = rng.randrange(40, 400)
        cuts = sorted({*rng.sample(range(1, end), end // 4), *range(30, end, 30), end})
        costs = [0 if c == end else rng.choice([0, 16]) for c in cuts]
        ends = packing.plan_cuts(np.array(cuts), np.array(costs), 64)
        price = dict(zip(cuts, costs, strict=True))

        def cost(ends, price=price):
            t, p = 0, 0
            for e in ends:
                n = e - p
                assert 0 < n <= 64
                t, p = t + packing.PER_SEQUENCE + (0 if n & (n - 1) == 0 and n >= 32 or n == 64 else 64 - n) + price.get(e, packing.CUT_INSIDE), e
            return t

        best = {0: 0}
        for c in cuts:
            best[c] = min((best[b] + packing.PER_SEQUENCE + price[c] + (0 if c - b in (32, 64) else 64 - c + b) for b in best if 0 < c - b <= 64), default=10**9)
        tails = [best[b] + ((n := end - b).bit_count() - 1) * packing.CUT_INSIDE + n.bit_count() * packing.PER_SEQUENCE for b in best if 0 < end - b <= 64 and (end - b) % packing.LEAST == 0]
        assert ends[-1] == end and all(a < b for a, b in zip(ends, ends[1:], strict=False))
        assert cost(ends) <= min([best[end], *tails])


def test_packing_edges(empty):
    assert packing.pack_documents(empty).count() == 0


def test_other_tokenizers_are_given_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    encode = Tokenizer.from_file(file).encode
    texts = ["Hello World, it's  me.\nAgain", "", " lead", "ÉTÉ Straße"]
    got = {r["doc_id"]: np.frombuffer(r["ids"], dtype="<u4").tolist() for r in packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), file).collect()}
    assert got == {i: [*encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert packing._WordIds(public_tokenizers.path(packing.DEFAULT_TOKENIZER)).by_word and not packing._WordIds(file).by_word


def test_pipeline_equals_its_parts(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [decontam.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.quality_verdicts(docs).where("kept").collect()}
    assert all(10 <= _measures(rows[i])[0] for i in kept)
    ids = sorted(kept)
    alone = [i for i, c in zip(ids, _copies([rows[i] for i in ids], ids), strict=True) if i == c]
    clean = [i for i in alone if not any(b in decontam.normalise(rows[i]) for b in bench)]
    out = p.run(spark, sf)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(clean)
    stage = docs
    for _, f in p.STAGES[:-1]:
        stage = f(spark, stage, sf)
        assert stage.columns == docs.columns
    from chronoframe.llm.secrets import credential_spans

    assert credential_spans(stage).where(F.exists("spans", lambda s: s["kind"] < 3)).count() == 0
    tokens = {r["doc_id"]: r["doc_tokens"] for r in out.collect()}
    encode = _tokenizer().encode
    assert tokens == {r["doc_id"]: len(encode(r["text"], add_special_tokens=False).ids) + 1 for r in stage.collect()}


def test_pipeline_on_odd_tables(spark, sf, nasty, empty, tmp_path):
    import corpus_pipeline as p

    for name, docs in (("nasty", nasty), ("empty", empty)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        stage = spark.read.parquet(f"{folder}/documents.parquet")
        for _, f in p.STAGES[:-1]:
            stage = f(spark, stage, folder)
            assert stage.columns == docs.columns
        out = p.run(spark, folder)
        assert out.count() == 0 if name == "empty" else {r["doc_id"] for r in out.collect()} >= {4, 2**60 + 1}


def test_near_duplicates_link_by_fingerprints(spark, monkeypatch):
    """Texts of one fingerprint are copies, however alike their sets are."""
    def run(docs, id_col, text_col, shingle=3):
        return docs.select(F.col(id_col), F.when(F.col(text_col).startswith("a"), F.lit(7)).when(F.col(text_col).startswith("b"), F.lit(4)).otherwise(F.lit(-1)).cast("long").alias("fp"))

    monkeypatch.setattr(simhash, "fingerprints", run)
    rows = [(i, " ".join(f"{x}{i}" for i in range(60))) for i, x in ((1, "b"), (2, "a"), (3, "c"))]
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3]
