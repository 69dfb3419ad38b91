"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with k edits or fewer, cut into k + 1 pieces, has one piece that
occurs there unchanged. All pieces of all items are sought in one pass over each text; a hit fixes
where the item would lie, and Myers' bit-parallel edit distance verifies it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialise, restored_id, text_id

#: Edits allowed for each character of an item.
ERROR_RATE = 0.1
#: Items' characters in one index; more items are sought in several passes, each over all texts.
INDEX_CHARS = 4_000_000
#: Matches up to which they are broadcast to drop their documents.
BROADCAST_MATCHES = 200_000
_QUARTER = 4


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in ``errors + 1`` pieces of about equal length, with their offsets."""
    cuts = [len(item) * j // (errors + 1) for j in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and the first end of such a part."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class _Index:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [(name, t, budget(len(t), rate)) for name, t in items]
        self.whole: dict[str, list[int]] = {}  # items too short for an edit: only a text that equals one holds it
        # disjoint quarters of a few characters: each edit spoils one of them at most
        self.parts = [[t[a : a + _QUARTER] for a in range(0, len(t) - _QUARTER + 1, _QUARTER)] for _, t, _ in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            if not k:
                self.whole.setdefault(t, []).append(n)
            for at, piece in pieces(t, k) if k else []:
                found.setdefault(piece, []).append((n, at + len(piece) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, uses)
        self.automaton.make_automaton()

    def _may(self, n: int, window: str) -> bool:
        left = self.items[n][2]
        for part in self.parts[n]:
            if part not in window:
                left -= 1
                if left < 0:
                    return False
        return True

    def search(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """(item, distance, start, end) of the best match of each item found."""
        for n in self.whole.get(text, ()):
            yield self.items[n][0], 0, 0, len(text)
        if not len(self.automaton):
            return
        lies: dict[int, set[int]] = {}
        for end, uses in self.automaton.iter(text):
            for n, last in uses:
                lies.setdefault(n, set()).add(end - last)
        for n, starts in lies.items():
            name, item, k = self.items[n]
            best = None
            runs: list[list[int]] = []
            for s in sorted(starts):
                if runs and s - runs[-1][1] <= 2 * k:
                    runs[-1][1] = s
                else:
                    runs.append([s, s])
            for a, b in runs:
                a, b = max(0, a - k), b + len(item) + k
                window = text[a:b]
                if self._may(n, window):
                    distance, end = myers(item, window)
                    if distance <= k and (best is None or distance < best[0]):
                        length = myers(item[::-1], window[:end][::-1])[1]
                        best = (distance, a + end - length, a + end)
            if best:
                yield name, *best


def benchmark_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """``(id_col, text_hash, item_id, distance, start, end)``: every item that occurs in a text of ``docs``.

    Both are compared in lower case with white space collapsed; start and end count characters of the
    text so written. An item may differ by ``rate`` edits a character. One too short for any edit (of
    fewer than ten characters at a rate of 0.1) would occur by chance: it matches only a text that equals
    it. The best occurrence is given, the first of equal ones; repeated rows give it once. Null and empty
    texts and items match nothing; empty tables give an empty result. Items are sought in blocks of
    :data:`INDEX_CHARS` characters, each a pass of its own over all texts, so what executors hold is
    bounded whatever the number of items.
    """
    spark = docs.sparkSession
    known = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("_item"), F.col(item_text).cast("string").alias("_text")).distinct()
    blocks = max(1, math.ceil((known.agg(F.sum(F.length("_text"))).first()[0] or 0) / INDEX_CHARS))
    rows = docs.where(F.length(text_col) > 0).select(text_id(id_col), F.xxhash64(F.col(text_col).cast("string")).alias("_hash"), F.col(text_col).cast("string").alias("_text"))
    kinds = f"_id string, _hash long, _item {items.schema[item_id].dataType.simpleString()}, distance int, start int, end int"
    out = None
    for block in range(blocks):
        own = known.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast([(r["_item"], t) for r in own if (t := normalise(r["_text"]))])
        key = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], sent=sent, key=key) -> Iterator[pd.DataFrame]:
            search = held(key, lambda: _Index(sent.value, rate)).search
            for b in batches:
                found = [(d, h, *m) for d, h, t in zip(b["_id"].array, b["_hash"].array, b["_text"], strict=True) for m in search(normalise(t))] if sent.value else []
                yield pd.DataFrame(found, columns=["_id", "_hash", "_item", "distance", "start", "end"])

        each = rows.mapInPandas(run, kinds)
        if blocks > 1:  # one block's index at a time
            each = materialise(each.distinct(), "matches")
            sent.unpersist()
        out = each if out is None else out.unionByName(each)
    return restored_id(out.distinct(), docs, id_col).withColumnsRenamed({"_hash": "text_hash", "_item": item_id})


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those in which a test item occurs; told by id and text, so null ids are safe."""
    found = materialise(benchmark_matches(docs, items, id_col, text_col, **options).select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "leaks")
    if found.count() <= BROADCAST_MATCHES:
        found = F.broadcast(found)
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    return docs.join(found, docs[id_col].eqNullSafe(found["_id"]) & (text_hash == found["_hash"]), "left_anti")
