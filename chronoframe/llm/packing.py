"""Packing: documents become token sequences of a fixed length, cut where it costs least.

The documents of a partition form one stream in their order. A dynamic program chooses the
sequence ends among document ends, sentence ends and, in long stretches without either, fixed
steps, and minimises padding plus penalties for the documents and sentences it cuts. The best
predecessor within one sequence length comes from a monotone queue, so the work is linear.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, restored_id, text_id

LENGTH = 4096
END_ID = 2
#: Costs in tokens of padding: of a sequence, of a cut between two sentences of a document, of a cut within one.
PER_SEQUENCE, CUT_SENTENCE, CUT_INSIDE = 1, 16, 128
#: Tokens without a sentence end after which cuts are offered anyway, and how far apart.
STEP = 128
#: Least power of two that a sequence without padding may have.
LEAST = 32
#: Tokens planned at a time; a block ends with a document.
BLOCK = 1 << 21
#: Distinct words of a generation whose ids a Python worker remembers.
CACHE_WORDS = 350_000

DEFAULT_TOKENIZER = "word_bpe_49k.json"


#: A text with capitals, marks, digits, accents and white space, by which a tokenizer shows how it treats them.
_PROBE = "Ab, AB. don't re-DO a1 B22 \u00e9t\u00e9 \u00c9T\u00c9, x,y  z\tw\n\nEnd."


class _WordIds:
    """Ids of texts as little-endian 32-bit bytes, by those of words, which single spaces and line ends separate.

    Where the tokenizer drops white space and never joins across it, ids of words put together are ids of
    the text; any other tokenizer is given whole texts. Words are remembered in two generations: those of
    the older one that do not occur again are forgotten.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.by_word = True
        self.by_word = self.ids(_PROBE) == self._encode(_PROBE)

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: set[str]) -> None:
        """Find the ids of words that are not known, of all of them at once."""
        fresh = []
        for w in words:
            if (value := self.older.get(w)) is not None or not w:
                self.known[w] = value or b""
            else:
                fresh.append(w)
        found = self.tokenizer.encode(" ".join(fresh), add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        starts = np.cumsum([0, *(len(w) + 1 for w in fresh)])
        at = np.searchsorted(np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(ids)), starts).tolist()
        data = ids.tobytes()
        for w, a, b in zip(fresh, at, at[1:], strict=False):
            self.known[w] = data[4 * a : 4 * b]

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return self._encode(text)
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.known.get, words))
        fresh = {w for w, x in zip(words, found, strict=True) if x is None}
        if fresh:
            self._learn(fresh)
            found = list(map(self.known.get, words))
            for w in fresh:
                if len(w) >= 64:  # such words hardly come again
                    del self.known[w]
        return b"".join(found)


def _words(file: str) -> _WordIds:
    return held(("packing", file), lambda: _WordIds(file))


def plan_cuts(cuts: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> list[int]:
    """Positions at which sequences end. cuts: where they may, increasing, the last being the stream's end.

    A sequence of fewer tokens than ``length`` is padded to it unless its own length is a power of
    two, :data:`LEAST` at least. What is left after the last planned end may be split into such powers.
    """
    at = np.concatenate(([0], cuts))
    n, end = len(at), int(at[-1])
    to, frm = [], []
    size = LEAST
    while size < length:  # exact powers of two need no padding
        i = np.searchsorted(at, at - size)
        same = np.flatnonzero((at - size >= 0) & (at[np.minimum(i, n - 1)] == at - size))
        to.append(same)
        frm.append(i[same])
        size *= 2
    to, frm = np.concatenate(to), np.concatenate(frm)
    order = np.argsort(to, kind="stable")
    to, frm = [*to[order].tolist(), n], frm[order].tolist()
    pos, cost = at.tolist(), [0, *costs.tolist()]
    best, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    key = [0] * n  # best + position: what the queue keeps increasing
    k = 0
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        b = key[i] + length - p
        while to[k] == j:
            if best[frm[k]] < b:
                b, i = best[frm[k]], frm[k]
            k += 1
        b += cost[j] + PER_SEQUENCE
        best[j], back[j] = b, i
        key[j] = x = b + p
        while queue and key[queue[-1]] >= x:
            queue.pop()
        queue.append(j)
    tail, j = best[-1], n - 1
    for i in range(n - 2, -1, -1):  # or the end in powers of two
        left = end - pos[i]
        if left > length:
            break
        if left % LEAST == 0 and (c := best[i] + (left.bit_count() - 1) * CUT_INSIDE + left.bit_count() * PER_SEQUENCE) < tail:
            tail, j = c, i
    ends = []
    rest, p = end - pos[j], end
    while rest:
        ends.append(p)
        p -= rest & -rest
        rest &= rest - 1
    while j:
        ends.append(pos[j])
        j = back[j]
    return ends[::-1]


def _offers(ids: np.ndarray, doc_ends: np.ndarray, enders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts are offered, and what each costs."""
    inside = np.flatnonzero(enders[np.minimum(ids, len(enders) - 1)]) + 1
    soft = np.union1d(inside, doc_ends)
    edges = np.concatenate(([0], soft))
    gaps = np.flatnonzero(np.diff(edges) > 2 * STEP)
    hard = [np.arange(edges[g] + STEP, edges[g + 1], STEP) for g in gaps]
    every = np.concatenate([soft, *hard])
    cost = np.concatenate([np.where(np.isin(soft, doc_ends, assume_unique=True), 0, CUT_SENTENCE), *(np.full(len(h), CUT_INSIDE) for h in hard)])
    order = np.argsort(every, kind="stable")
    return every[order], cost[order]


def _packed(names: list, streams: list[bytes], enders: np.ndarray, first: int, length: int) -> pd.DataFrame:
    data = b"".join(streams)
    ids = np.frombuffer(data, dtype="<u4")
    sizes = np.array([len(s) // 4 for s in streams], dtype=np.int64)
    doc_ends = np.cumsum(sizes)
    doc_starts = doc_ends - sizes
    seq_starts = np.concatenate(([0], plan_cuts(*_offers(ids, doc_ends, enders, length), length)[:-1])).astype(np.int64)
    start = np.union1d(doc_starts, seq_starts)
    end = np.append(start[1:], len(ids))
    doc = np.searchsorted(doc_starts, start, side="right") - 1
    seq = np.searchsorted(seq_starts, start, side="right") - 1
    return pd.DataFrame(
        {
            "_id": pd.Series(names, dtype=object).take(doc).to_numpy(),
            "start": start - doc_starts[doc],
            "length": end - start,
            "ids": [data[4 * a : 4 * b] for a, b in zip(start.tolist(), end.tolist(), strict=True)],
            "doc_tokens": sizes[doc],
            "sequence_id": first + seq,
            "offset": start - seq_starts[seq],
        }
    )


def pack_documents(docs: DataFrame, tokenizer_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: ``(id_col, start, length, ids, doc_tokens, sequence_id, offset)``.

    ids holds the piece's token ids as little-endian unsigned 32-bit integers. The documents of a
    partition are packed in their order, in blocks of about :data:`BLOCK` tokens, without a shuffle;
    sequence ids are unique over all partitions. A null text counts as empty and has the end id
    alone. Repeated rows and null ids are packed like others; an empty table gives an empty result.
    ``tokenizer_file`` is a path that every executor can open.
    """
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path(DEFAULT_TOKENIZER)
    closing = struct.pack("<I", end_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(tokenizer_file)
        enders = np.zeros(words.tokenizer.get_vocab_size() + 1, dtype=bool)  # the last stands for all ids beyond
        enders[[i for mark in (".", "!", "?", "!!", "...") for i in words.tokenizer.encode(mark, add_special_tokens=False).ids[-1:]]] = True
        first = TaskContext.get().partitionId() << 40
        names, streams, size = [], [], 0
        for b in batches:
            for name, text in zip(b["_id"].array, b["_text"], strict=True):
                names.append(name)
                streams.append(words.ids(text or "") + closing)
                size += len(streams[-1]) // 4
                if size >= BLOCK:
                    yield (out := _packed(names, streams, enders, first, length))
                    first = int(out["sequence_id"].iloc[-1]) + 1
                    names, streams, size = [], [], 0
        if streams:
            yield _packed(names, streams, enders, first, length)

    rows = docs.select(text_id(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = rows.mapInPandas(run, "_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return restored_id(out, docs, id_col)
