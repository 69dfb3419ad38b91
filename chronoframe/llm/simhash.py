"""SimHash near-duplicates: fingerprints of word shingles, linked through deletion-variant signatures.

Two 64-bit fingerprints that differ in three bits at most differ in one bit at most in one of
their two 32-bit halves. Each half is therefore indexed under its 32 variants in which one bit
is a wildcard; an equality on such a variant finds every pair, and the Hamming distance of the
whole fingerprints verifies it.

Near copies in the sense of a shingle similarity of 0.8 lie further apart than three of 64 bits. Two
sets that alike share a band of their sketches, so an equality on bands finds them; a wide
fingerprint discards pairs that are far apart, and a count of whole sets of shingles verifies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import HOT_SHARE, join_unique, small
from .common import materialise, restored_id, text_id
from .copies import COPY_BLOCK, bits_near, named_rows, set_classes, wide_bits

MAX_BITS = 3
#: Up to so many fingerprints of one variant are compared in one group; larger groups are split.
GROUP_LIMIT = 1024
#: Fingerprints, about, that tell which variants are crowded. This changes no link, only where they are found.
CROWD_SAMPLE = 100_000
#: Shingles whose bits are counted at a time.
_BLOCK = 1 << 16


def _fingerprint(text: str | None, size: int) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(t), 42) for t in zip(*(words[k:] for k in range(size)), strict=False)]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = np.array(hashes[at : at + _BLOCK], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id_col, fp)``, one row per row of ``docs``; fp is the fingerprint as a signed long.

    Words are separated by ASCII white space; only A-Z is lower-cased. A null or wordless text
    has fingerprint zero; one with fewer words than a shingle is one shingle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([_fingerprint(t, shingle) for t in b["_text"]], dtype=np.uint64).astype(np.int64)
            yield pd.DataFrame({"_id": b["_id"], "fp": fp})

    out = docs.select(text_id(id_col), F.col(text_col).cast("string").alias("_text")).mapInPandas(run, "_id string, fp long")
    return restored_id(out, docs, id_col)


def _links(groups: list[np.ndarray], bits: int) -> tuple[list[int], list[int]]:
    """For groups of distinct fingerprints: (node, smallest node it is linked to through these groups)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def join(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    pairs = [g for g in groups if len(g) == 2]
    if pairs:
        both = np.stack(pairs)
        for a, b in both[np.bitwise_count(both[:, 0] ^ both[:, 1]) <= bits].tolist():
            join(a, b)
    for rest in groups:
        if len(rest) <= 2:
            continue
        while len(rest) > 1:  # take one linked set after another out of the group
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = np.bitwise_count(rest ^ x) <= bits
                if near.any():
                    found, rest = rest[near], rest[~near]
                    for y in found.tolist():
                        join(int(x), y)
                    queue.extend(found)
    nodes = [x for x in parent if find(x) != x]
    return nodes, [find(x) for x in nodes]


def _linked(groups: DataFrame, bits: int) -> DataFrame:
    """Edges ``(u, v)`` that join what links within each row's array ``fps``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u, v = _links([np.asarray(x, dtype=np.int64).view(np.uint64) for x in b["fps"]], bits)
            yield pd.DataFrame({"u": np.array(u, dtype=np.uint64).view(np.int64), "v": np.array(v, dtype=np.uint64).view(np.int64)})

    return groups.select("fps").mapInPandas(run, "u long, v long")


def _variants(fps: DataFrame) -> DataFrame:
    """``(fp, key)``: the 64 one-wildcard variants of each fingerprint's halves."""
    half = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).selectExpr("fp", "i", "shiftrightunsigned(fp, CASE WHEN i < 32 THEN 32 ELSE 0 END) & 4294967295L AS half")
    return half.selectExpr("fp", "shiftleft(cast(i AS long), 32) | (half & ~shiftleft(1L, i & 31)) AS key")


def _crowded(fps: DataFrame) -> DataFrame:
    """Variants that more than one in :data:`HOT_SHARE` of a sample have: 64 * HOT_SHARE at most."""
    share = min(1.0, CROWD_SAMPLE / max(fps.count(), 1))
    some = materialise(fps.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < int(1_000_000 * share)), "simhash-crowd")
    least = max(some.count() / HOT_SHARE, GROUP_LIMIT * share)
    return _variants(some).groupBy("key").count().where(F.col("count") > least).select("key")


def fingerprint_links(fps: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges ``(u, v)`` between the distinct fingerprints of column ``fp``.

    The edges span the graph in which fingerprints at three or fewer differing bits are
    adjacent: same components, but not every pair of a group. A variant shared by more than
    ``group_limit`` fingerprints is split exactly: three differing bits touch three of the other
    half's eight nibbles at most, so its members meet again under the 56 ways to leave three
    nibbles out. Such a finer group has 2**13 members at most by construction, whatever the input.
    Variants that a sample shows to be crowded are split without being counted first.
    """
    crowded = F.broadcast(_crowded(fps))
    variant = _variants(fps)
    cool = variant.join(crowded, "key", "left_anti")
    counts = materialise(cool.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("_rows", F.col("n")), "simhash-counts")
    shared = join_unique(cool, counts, ["key"], "_rows")
    cold = shared.where(F.col("n") <= group_limit).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    masks = [0xFFFFFFFF & ~sum(0xF << 4 * k for k in out) for out in combinations(range(8), MAX_BITS)]
    hot = (
        shared.where(F.col("n") > group_limit).select("key", "fp").unionByName(variant.join(crowded, "key", "left_semi").select("key", "fp"))
        .select("key", "fp", F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("way", "mask"))
        .selectExpr("key", "fp", "way", "shiftrightunsigned(fp, CASE WHEN shiftright(key, 32) < 32 THEN 0 ELSE 32 END) & mask AS rest")
        .groupBy("key", "way", "rest")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    return _linked(cold.select("fps").unionByName(hot.select("fps")), MAX_BITS).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(id_col, fp, component)``: one row per row of ``docs`` with the smallest id it is linked to.

    Equal texts share a fingerprint and meet before any comparison, so copies cost one row each.
    Repeated rows each get their row; a null id never becomes a component's name, and a component
    whose ids are all null has a null name. An empty table gives an empty result.
    """
    own = materialise(fingerprints(docs.select(id_col, text_col), id_col, text_col, shingle), "simhash")
    distinct = materialise(own.groupBy("fp").agg(F.min(id_col).alias("lowest"), F.count("*").alias("rows")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), group_limit))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "lowest", "rows", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "simhash-roots")
    lowest = materialise(named.groupBy("root").agg(F.min("lowest").alias("component"), F.count("*").alias("fps")), "simhash-lowest")
    by_fp = materialise(join_unique(named, lowest, ["root"], "fps").select("fp", "component", "rows"), "simhash-components")
    return join_unique(own, by_fp, ["fp"], "rows").select(id_col, "fp", "component")


# Near copies: five-word shingles at a similarity of 0.8 or more, found by bands of sketches and screened by wide fingerprints.

#: Words of a shingle, and the least Jaccard similarity that links two texts.
COPY_SHINGLE, SIMILARITY = 5, 0.8
#: Coordinates of a sketch and how many make a band: two sets at the similarity share no band with a chance of 5e-8.
COPY_COORDS, COPY_BAND = 128, 4
#: 64-bit parts of the fingerprint that discards pairs before their shingles are counted.
CHECK_PARTS = 8
#: What sets of few shingles add at most to the share of differing bits, and the deviations beyond which a pair is
#: discarded: a pair of the least similarity is, with a chance of 1e-9.
FEW_SHINGLES, DISCARD_SIGMAS = 0.04, 6.0
#: Rejected rows up to which they are broadcast to leave their table; more are joined.
BROADCAST_REJECTED = 200_000


def _copy_bits(similarity: float) -> int:
    """Differing bits of the wide fingerprint that sets of at least this Jaccard similarity keep to."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi + FEW_SHINGLES
    number = 64 * CHECK_PARTS
    return int(number * share + DISCARD_SIGMAS * np.sqrt(number * share * (1 - share)))


def _wide_parts(shingles: np.ndarray, ends: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    return wide_bits(shingles, ends, CHECK_PARTS)


def _copy_classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, block: int) -> tuple[DataFrame, DataFrame]:
    near = partial(bits_near, _copy_bits(similarity))
    return set_classes(docs, id_col, text_col, COPY_SHINGLE, COPY_COORDS, COPY_BAND, _wide_parts, near, similarity, block)


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = COPY_BLOCK) -> DataFrame:
    """``(id_col, component)``: one row per row of ``docs`` with the smallest id it is linked to.

    Texts link if the Jaccard similarity of their sets of five-word shingles is ``similarity`` or more. Such texts
    share a band of their sketches, which makes the groups; pairs whose wide fingerprints lie far apart are discarded
    and the others' whole sets counted: see :func:`copies.alike_roots`. Texts of one set meet before any comparison.
    Null and wordless texts are copies of one another; null ids never name a component. Repeated
    rows each get their row, rows of one id with different texts are told apart; an empty table gives
    an empty result.
    """
    own, texts = _copy_classes(docs, id_col, text_col, similarity, block)
    return own.drop("text_hash", "size").transform(named_rows, texts, id_col).select(id_col, "component")


def _linked_by_fingerprints(docs: DataFrame, own: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """``texts`` with roots that are also shared by sets which texts of linked fingerprints have: see :func:`fingerprint_links`."""
    text = F.col(text_col).cast("string")
    seen = materialise(fingerprints(docs.select(F.xxhash64(text).alias("text_hash"), text.alias("_own")), "text_hash", "_own").distinct(), "copies-fingerprints")
    sets = own.select("text_hash", "set_a", "set_b").distinct().join(texts.select("set_a", "set_b", "root"), ["set_a", "set_b"])
    held = materialise(seen.join(sets, "text_hash").select("fp", F.col("root").alias("_root")).distinct(), "copies-held")
    linked = connected_components(fingerprint_links(held.select("fp").distinct())).select(F.col("node").alias("fp"), F.col("root").alias("_group"))
    named = materialise(held.join(linked, "fp", "left").select("_root", F.coalesce("_group", "fp").alias("_group")).distinct(), "copies-groups")
    least = materialise(named.groupBy("_group").agg(F.min("_root").alias("v"), F.count("*").alias("_n")), "copies-least")
    roots = connected_components(join_unique(named, least, ["_group"], "_n").select(F.col("_root").alias("u"), "v"))
    moved = materialise(roots.select(F.col("node").alias("_node"), F.col("root").alias("_to")), "copies-moved")
    joined = texts.join(moved, F.col("root") == F.col("_node"), "left").withColumn("root", F.coalesce("_to", "root"))
    return materialise(joined.select(*texts.columns), "copies-linked")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = COPY_BLOCK) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, then of the smallest hash of its text.

    Copies are texts whose SimHash fingerprints differ in three bits at most, and those of :func:`near_copy_components`, which
    lie further apart in these bits.

    Rows are told by id and text: of two different texts under one id each stays that has no copy with
    a smaller id, and repeated rows stay once. Rows without an id stay, as nothing names them. Rejected
    rows up to :data:`BROADCAST_REJECTED` are broadcast, so that no text is shuffled; more are joined once.
    """
    own, texts = _copy_classes(docs, id_col, text_col, similarity, block)
    texts = _linked_by_fingerprints(docs, own, texts, text_col)
    kept = texts.groupBy("root").agg(F.min("lowest").alias("k")).where("k IS NOT NULL").select(F.col("k.id").alias(id_col), F.col("k.text_hash").alias("text_hash"))
    rows = own.where(F.col(id_col).isNotNull()).groupBy(id_col, "text_hash").agg(F.count("*").alias("_rows"))
    marked = materialise(rows.join(kept.withColumn("_kept", F.lit(True)), [id_col, "text_hash"], "left").where("_kept IS NULL OR _rows > 1"), "copies-marked")
    keys = [id_col, "text_hash"]
    keyed = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias(id_col), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))  # names of other columns cannot clash
    stay = keyed.join(small(marked.select(*keys), BROADCAST_REJECTED), keys, "left_anti")
    once = keyed.join(small(marked.where("_kept").select(*keys), BROADCAST_REJECTED), keys, "left_semi").dropDuplicates(keys)
    return stay.unionByName(once).select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns))
