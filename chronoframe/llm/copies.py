"""Texts whose sets of shingles are alike: sketches, bands, and components that exact counts confirm.

What the near-dedup operators share. A text becomes a set of hashed shingles; texts of one set are one
node. A node's sketch fills its coordinates by rounds of hashed bin placement; bands of coordinates are
keys, and nodes that share a key are compared. Only nodes that a key brings together have their whole
sets counted, and every link is confirmed on whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import join_unique, small
from .common import drop_held, materialise, release, restored_id, scratch, text_id

#: Nodes of one key that are compared in one task.
COPY_BLOCK = 512
#: Rows up to which those whose sets are asked for are broadcast to the scan; beyond it a bitmap of their keys is.
BROADCAST_WANTED = 300_000
#: Keys of more than two nodes up to which they are broadcast to all rows of keys.
BROADCAST_KEYS = 1_000_000
#: Bits of the bitmap of wanted keys. More rows than bits make it useless, not wrong.
BITMAP_BITS = 1 << 26
#: Characters that are turned into shingles together.
_CHUNK = 500_000

#: Odd factors that draw independent parts from one hash.
_ODD = np.arange(1, 65, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: The factor of words' polynomials and its inverse modulo 2**64.
_FACTOR = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
#: Each bit of a byte as a byte of its own, so that one addition counts eight bits.
_LANES = np.array([sum((b >> (7 - k) & 1) << 8 * k for k in range(8)) for b in range(256)], dtype=np.uint64)
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _FACTOR)

def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= _CHUNK):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


@lru_cache(maxsize=2)
def _powers(number: int) -> tuple[np.ndarray, np.ndarray]:
    """Running products of the polynomials' factor and of its inverse."""
    return np.cumprod(np.full(number + 1, _FACTOR)), np.cumprod(np.full(number + 1, _INVERSE))


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, between ASCII white space), and how many each text has.

    A word's hash is a polynomial of its bytes, taken from running sums over all texts at once.
    """
    each = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*each, b""]), dtype=np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(1 << (len(data) - 1).bit_length())
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[data] * power[: len(data)])))
    flat = _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    size = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) + 1
    return flat, np.bincount(np.searchsorted(np.cumsum(size), begin, side="right"), minlength=len(each))


def _shingle_sets(words: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(shingles, ends)``: the sorted distinct hashes of each text's shingles, one text after another.

    A text of fewer words than a shingle is one shingle, a wordless text has none.
    """
    flat, number = words
    begins = np.cumsum(number) - number
    held = np.where(number > 0, np.maximum(number - size + 1, 1), 0)
    ends = np.cumsum(held)
    rank, whole = np.zeros(len(flat), dtype=np.uint64), max(len(flat) - size + 1, 0)
    for k in range(size):  # of windows that lie in one text
        rank[:whole] = _mix(rank[:whole] + flat[k : whole + k] + np.uint64(k))
    for i in np.flatnonzero((number > 0) & (number < size)).tolist():  # all words of a short one
        value = np.zeros(1, dtype=np.uint64)
        for k in range(number[i]):
            value = _mix(value + flat[begins[i] + k] + np.uint64(k))
        rank[begins[i]] = value[0]
    rank = rank[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + held, held)]
    for a, b in zip((ends - held).tolist(), ends.tolist(), strict=True):
        rank[a:b].sort()
    new = np.ones(len(rank), dtype=bool)
    new[1:] = rank[1:] != rank[:-1]
    new[(ends - held)[held > 0]] = True
    sums = np.concatenate(([0], np.cumsum(new)))
    return rank[new], sums[ends]


def wide_bits(shingles: np.ndarray, ends: np.ndarray, parts: int) -> np.ndarray:
    """Fingerprints of ``parts`` times 64 bits, one row for each of the sets."""
    size = np.diff(np.concatenate(([0], ends)))
    runs = -(-size // 255)  # a byte holds the sum of so many bits
    first = np.cumsum(runs) - runs
    starts = np.repeat(ends - size - 255 * first, runs) + 255 * np.arange(runs.sum())
    counts = np.zeros((len(ends), 64 * parts), dtype=np.int32)
    for part in range(parts if len(starts) else 0):
        mixed = _mix(shingles * _ODD[part] + _ODD[parts - 1]).view(np.uint8).reshape(-1, 8)
        sums = np.stack([np.add.reduceat(_LANES[mixed[:, k]], starts) for k in range(8)], axis=1).view(np.uint8)
        counts[runs > 0, 64 * part : 64 * part + 64] = np.add.reduceat(sums, first[runs > 0], axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > size[:, None], axis=1).view(np.uint64)


#: Bits of a coordinate that hold its hash; the bits above hold the round.
_ROUND_SHIFT = np.uint64(54)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fast_sketches(shingles: np.ndarray, ends: np.ndarray, coords: int) -> np.ndarray:
    """Sketches of the sets, one row of ``coords`` values each; two sets agree in a coordinate with the chance of their Jaccard similarity.

    In each of ``coords`` rounds every element is hashed to one bin with a fresh value, and a bin keeps the
    least of the first round that reaches it; in as many further rounds the j-th bin takes all elements, so
    none stays empty. A set leaves as soon as its bins are full: a set of n elements after some
    ``coords * ln(coords) / n`` rounds. Coordinates are spread more evenly than independent minima, and so
    are concentrated at least as much. An empty set has no coordinate: all its bits are set.
    """
    number = np.diff(np.concatenate(([0], ends)))
    out = np.full((len(ends), coords), _EMPTY)
    flat_out, active = out.reshape(-1), np.flatnonzero(number > 0)
    doc, rest = np.repeat(np.arange(len(ends)), number), shingles
    for i in range(2 * coords):
        if not len(active):
            break
        mixed = _mix(rest * _ODD[7] + np.uint64(i * int(_FACTOR) & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(i) << _ROUND_SHIFT) | (mixed >> np.uint64(10))
        if i < coords:
            np.minimum.at(flat_out, doc * coords + (mixed % np.uint64(coords)).astype(np.int64), value)
        else:
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            out[active, i - coords] = np.minimum(out[active, i - coords], np.minimum.reduceat(value, starts))
        full = (out[active] != _EMPTY).all(axis=1)
        if full.any():
            stay = np.zeros(len(ends), dtype=bool)
            stay[active[~full]] = True
            active, mine = active[~full], stay[doc]
            doc, rest = doc[mine], rest[mine]
    return out


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """Keys of the bands of ``rows`` coordinates, a row of longs for each sketch."""
    bands = sketches.shape[1] // rows
    keys = np.repeat(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _FACTOR)[None, :], len(sketches), axis=0)
    for k in range(rows):
        keys = _mix(keys * _ODD[9] + sketches[:, k : bands * rows : rows])
    return keys.view(np.int64)


def packed(sketches: np.ndarray) -> np.ndarray:
    """The low 16 bits of each coordinate, four to a 64-bit part; ``coords`` is a multiple of four."""
    return np.ascontiguousarray(sketches.astype(np.uint16)).view(np.uint64)


def agree(least: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of packed sketches agree in ``least`` coordinates or more."""
    a, b = np.broadcast_arrays(np.atleast_2d(a), np.atleast_2d(b))
    return (np.ascontiguousarray(a).view(np.uint16) == np.ascontiguousarray(b).view(np.uint16)).sum(axis=1) >= least


def bits_near(most: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of wide fingerprints differ in ``most`` bits at most."""
    return np.bitwise_count(np.atleast_2d(a ^ b)).sum(axis=1, dtype=np.int64) <= most


#: Sets, ends and sketches to the 64-bit parts by which candidates are discarded.
Parts = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Rows of parts and other rows, or one, to which of them may be alike.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int, coords: int, band: int, parts_of: Parts) -> DataFrame:
    """``(id_col, text_hash, set_a, set_b, size, keys, parts)``, one row per row of ``docs``.

    set_a and set_b are hashes of the set of shingles (A-Z lower-cased, words between ASCII white space), size its
    size, keys those of its bands. A text of fewer words than a shingle is one shingle; a null or wordless text is
    the empty set, which has no key.
    """
    rows = docs.select(text_id(id_col), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_held()
        for b in batches:
            texts = list(b["_text"])
            for at, end in _chunks(texts):
                shingles, ends = _shingle_sets(_words(texts[at:end]), shingle)
                sketches = fast_sketches(shingles, ends, coords)
                size = np.diff(np.concatenate(([0], ends)))
                whole = _set_hashes(shingles, ends)
                keys = [k if n else k[:0] for k, n in zip(band_keys(sketches, band), size.tolist(), strict=True)]
                parts = parts_of(shingles, ends, sketches).view(np.int64)
                yield pd.DataFrame(
                    {"_id": b["_id"].iloc[at:end].array, "text_hash": b["text_hash"].iloc[at:end].array, "set_a": whole[:, 0], "set_b": whole[:, 1], "size": size, "keys": keys, "parts": list(parts)}
                )

    out = rows.mapInPandas(run, "_id string, text_hash long, set_a long, set_b long, size long, keys array<long>, parts array<long>")
    return restored_id(out, docs, id_col)


def _set_hashes(shingles: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two hashes of each set; zero for the empty one."""
    size = np.diff(np.concatenate(([0], ends)))
    out, some = np.zeros((len(ends), 2), dtype=np.uint64), size > 0
    for k in range(2):
        if some.any():
            out[some, k] = np.add.reduceat(_mix(shingles * _ODD[k + 3] + _ODD[k]), (ends - size)[some])
    return out.view(np.int64)


class _Trees:
    """Union-find over longs."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _alike(groups: DataFrame, similarity: float) -> DataFrame:
    """Edges ``(u, v)`` between texts whose sets of shingles have the Jaccard similarity: a spanning forest of each group's roots.

    groups: arrays ``node, root, joined, shingles``; only texts that are not joined are compared with all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u, v = [], []
            for nodes, roots, joined, sets in zip(b["node"], b["root"], b["joined"], b["shingles"], strict=True):
                size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                some = size > 0  # wordless texts are one text already
                names, flat = np.unique(np.concatenate(list(sets)), return_inverse=True)
                starts, flags, trees = (np.cumsum(size) - size), np.zeros(len(names), dtype=np.int32), _Trees()
                for x in np.flatnonzero(~np.asarray(joined, dtype=bool) & some).tolist():
                    own = flat[starts[x] : starts[x] + size[x]]
                    flags[own] = 1
                    common = np.zeros(len(size), dtype=np.int64)
                    common[some] = np.add.reduceat(flags[flat], starts[some])
                    flags[own] = 0
                    for y in np.flatnonzero(common * 1_000_000 >= round(similarity * 1_000_000) * (size + size[x] - common)).tolist():
                        if y != x and some[y] and trees.join(int(roots[x]), int(roots[y])):
                            u.append(int(nodes[x]))
                            v.append(int(nodes[y]))
            yield pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})

    return groups.select("node", "root", "joined", "shingles").mapInPandas(run, "u long, v long")


def _blocked(rows: DataFrame, key: str, block: int, *values: str) -> DataFrame:
    """Rows ``(key, node, root, joined, near, far, *values)`` as groups of arrays; near and far: rows of a key that are joined or not.

    A key of more than ``block`` rows is dealt to blocks, of which each pair is a group, but for pairs of
    which all rows are joined.
    """
    some = rows.where(F.col("near") + F.col("far") <= block).withColumn("a", F.lit(0).cast("long")).withColumn("b", F.lit(0).cast("long"))
    blocks = lambda n: F.ceil(F.col(n) * 2 / block)
    # blocks of the rest come first and meet all blocks; blocks of what is joined already meet only those of the rest
    many = rows.where(F.col("near") + F.col("far") > block).withColumn("_far", blocks("far")).withColumn("_near", blocks("near"))
    many = many.withColumn("_own", F.when(F.col("joined"), F.col("_far") + F.pmod(F.xxhash64("node"), F.col("_near"))).otherwise(F.pmod(F.xxhash64("node"), F.col("_far"))))
    many = many.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("joined"), F.col("_far")).otherwise(F.col("_far") + F.col("_near")) - 1)))
    many = many.withColumn("a", F.least("_own", "_other")).withColumn("b", F.greatest("_own", "_other"))
    columns = ("node", "root", "joined", *values)
    listed = some.select(key, "a", "b", *columns).unionByName(many.select(key, "a", "b", *columns)).groupBy(key, "a", "b").agg(F.collect_list(F.struct(*columns)).alias("m"))
    return listed.where(F.size("m") > 1).select(*(F.col(f"m.{c}").alias(c) for c in columns))


def _may_link(groups: DataFrame, near: Near) -> DataFrame:
    """Edges ``(u, v)`` between roots that have texts of near parts in a group: a spanning forest of each group.

    groups: arrays ``node, root, joined, parts``; only texts that are not joined are compared with all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u, v = [], []
            for roots, joined, parts in zip(b["root"], b["joined"], b["parts"], strict=True):
                parts, trees = np.stack(list(parts)).view(np.uint64), _Trees()
                for x in np.flatnonzero(~np.asarray(joined, dtype=bool)).tolist():
                    for r in np.unique(roots[near(parts, parts[x])]).tolist():
                        if trees.join(int(roots[x]), r):
                            u.append(int(roots[x]))
                            v.append(r)
            yield pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})

    return groups.select("root", "joined", "parts").mapInPandas(run, "u long, v long")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Which of :data:`BITMAP_BITS` places the longs of column ``key`` take: built in the tasks, as large for any number of keys."""
    place = F.pmod(F.col("key"), F.lit(BITMAP_BITS))
    found = keys.select(F.shiftrightunsigned(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(key, {BITMAP_BITS}L) & 63 AS int))").alias("bit"))
    found = found.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # bounded by the number of words
    out = np.zeros(BITMAP_BITS >> 6, dtype=np.int64)
    out[found["at"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def sets_of(nodes: DataFrame, texts: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(node, shingles)`` of the nodes in ``nodes``, each once.

    texts: ``(node, id, hash)``, the row that stands for each node. Its text is turned into shingles where the scan
    reads it: rows are picked out by the wanted keys themselves or, if these are many, by a bitmap of them, so
    only sets of shingles are shuffled, and of copies only those of one row.
    """
    wanted = texts.join(nodes, "node", "left_semi").select("node", F.col("id").alias("w_id"), F.col("hash").alias("w_hash"))
    wanted = materialise(wanted.withColumn("key", F.xxhash64("w_id", "w_hash")), "copies-wanted")
    hashed = F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("_id"), hashed.alias("_hash"), F.col(text_col).cast("string").alias("_text")).withColumn("_key", F.xxhash64("_id", "_hash"))
    same = (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("w_id")) & (F.col("_hash") == F.col("w_hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()  # of repeated rows one in each task is enough
        for b in batches:
            if bits is not None:
                place = b["_key"].to_numpy(dtype=np.int64) % BITMAP_BITS
                b = b[(bits.value[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]
            new = ~b["_key"].duplicated() & ~b["_key"].isin(done)
            b = b[new.to_numpy(dtype=bool)]
            done.update(b["_key"].tolist())
            bodies = list(b["_text"])
            for at, end in _chunks(bodies):
                shingles, ends = _shingle_sets(_words(bodies[at:end]), shingle)
                named = ("node",) if bits is None else ("_key", "_hash")
                yield pd.DataFrame({**{c: b[c].iloc[at:end].array for c in named}, "shingles": np.split(shingles.view(np.int64), ends[:-1])})

    bits = None
    if wanted.count() <= BROADCAST_WANTED:
        found = rows.join(F.broadcast(wanted), same).select("_key", "_hash", "_text", "node").mapInPandas(run, "node long, shingles array<long>")
    else:
        bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))
        found = rows.select("_key", "_hash", "_text", F.lit(None).cast("long").alias("node")).mapInPandas(run, "_key long, _hash long, shingles array<long>")
        found = wanted.select("node", "key", "w_hash").join(found, (F.col("key") == F.col("_key")) & (F.col("w_hash") == F.col("_hash"))).select("node", "shingles")
    sets = materialise(found, "copies-sets")
    if sets.groupBy("node").count().where("count > 1").limit(1).count():
        once = materialise(sets.dropDuplicates(["node"]), "copies-sets")
        release(sets)
        sets = once
    release(wanted)
    return sets


def _near_stars(stars: DataFrame, near: Near) -> DataFrame:
    """The pairs ``(u, v)`` of ``(node, parts, first, of_first)`` whose parts are near."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                a, c = (np.stack(list(b[x])).view(np.uint64) for x in ("parts", "of_first"))
                yield pd.DataFrame({"u": b["node"], "v": b["first"]})[near(a, c)]

    return stars.select("node", "parts", "first", "of_first").mapInPandas(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(u, v)`` of nodes whose sets of shingles have the Jaccard similarity; many pairs may have one v."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("_u")).join(small(pairs, BROADCAST_WANTED), "u")
    left = materialise(left.select("u", "v", "_u"), "copies-left")
    crowd = small(pairs.groupBy("v").agg(F.count("*").alias("_pairs")), BROADCAST_WANTED)
    right = materialise(sets.join(crowd, F.col("node") == F.col("v")).select("v", F.col("shingles").alias("_v"), "_pairs"), "copies-right")
    both = F.size(F.array_intersect("_u", "_v"))
    linked = join_unique(left, right, ["v"], "_pairs").where(_enough(both, F.size("_u") + F.size("_v") - both, similarity))
    linked = materialise(linked.select("u", "v"), "copies-linked")
    release(left, right)
    return linked


def _enough(common: Column, whole: Column, similarity: float) -> Column:
    return common.cast("long") * 1_000_000 >= whole.cast("long") * round(similarity * 1_000_000)


def _with(rows: DataFrame, key: str, only: Column | None = None, **values: Column) -> DataFrame:
    """``rows``, a stored table, with aggregates over column ``key``, of the keys for which ``only`` holds.

    The aggregates are formed in part before they are shuffled and joined back without bringing a hot key into one task.
    """
    found = rows.groupBy(key).agg(F.count("*").alias("_rows"), *(v.alias(n) for n, v in values.items()))
    return join_unique(rows, materialise(found if only is None else found.where(only), "copies-keys"), [key], "_rows")


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every row of ``nodes``."""
    roots = connected_components(edges).withColumnRenamed("node", "_node")
    return nodes.select("node").join(roots, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("root"))


def alike_roots(nodes: DataFrame, near: Near, sets: Callable[[DataFrame], DataFrame], similarity: float, block: int = COPY_BLOCK) -> DataFrame:
    """``(node, root)`` of every row of ``nodes``, a stored table ``(node, keys, parts)``; a stored table.

    Nodes that share a key link if their ``sets`` have the Jaccard similarity; pairs whose parts are not ``near`` are
    discarded first. Every node is compared with the most central node of each of its keys, which joins almost all
    of a large group without forming its pairs. What a key holds beyond that node's component may link with the rest
    where parts are near; the components of what may link are small, and their sets are counted within one task, or
    in pairs of blocks of ``block`` nodes. Tasks give the edges of spanning trees, never all pairs of a group.
    """
    with scratch() as kept:
        keyed = nodes.select("node", F.explode("keys").alias("key"))
        counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1")
        counts = materialise(counts, "copies-counts")
        two = counts.where("n = 2").select("key", F.explode(F.array("low", "high")).alias("node"), "n")  # the aggregate holds both nodes
        many = counts.where("n > 2").select("key", "n", F.col("n").alias("_rows"))
        few = many.count() <= BROADCAST_KEYS
        many = keyed.join(F.broadcast(many.drop("_rows")), "key") if few else join_unique(keyed, many, ["key"], "_rows")
        shared = materialise(two.unionByName(many), "copies-shared")
        # the node that its groups crowd around most: of copies that were edited apart, the one they all come from
        crowd = shared.groupBy("node").agg(F.sum("n").alias("crowd"))
        led = materialise(shared.join(crowd, "node"), "copies-crowd")
        led = materialise(_with(led, "key", lead=F.max(F.struct("crowd", "node"))).select("key", "node", "n", F.col("lead.node").alias("first")), "copies-led")
        parts = materialise(nodes.select("node", "parts").join(led.select("node").distinct(), "node", "left_semi"), "copies-parts")
        stars = led.where("node <> first").select("node", "first").distinct()
        leads = stars.groupBy("first").agg(F.count("*").alias("_stars")).join(parts.select(F.col("node").alias("first"), F.col("parts").alias("of_first")), "first")
        stars, leads = materialise(stars.join(parts, "node"), "copies-stars"), materialise(leads, "copies-leads")
        pairs = materialise(_near_stars(join_unique(stars, leads, ["first"], "_stars"), near), "copies-near")
        release(shared, stars, leads)
        found = sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        stars = _verified(pairs, found, similarity)
        release(pairs, found)
        met = materialise(_rooted(parts, stars), "copies-met")
        # what a key holds beyond its first node's component; the one pair of a key of two was a star's
        mixed = materialise(led.where("n > 2").join(met, "node"), "copies-roots")
        release(led)
        lead = F.max(F.when(F.col("node") == F.col("first"), F.col("root")))
        mixed = _with(mixed, "key", only=F.col("_low") < F.col("_high"), _lead=lead, _low=F.min("root"), _high=F.max("root"))
        mixed = materialise(mixed.select("key", "node", "root", (F.col("root") == F.col("_lead")).alias("joined")), "copies-split")
        groups = _with(mixed, "key", near=F.count_if("joined"), far=F.count_if(~F.col("joined")))
        groups = _blocked(groups.join(parts, "node"), "key", block, "parts")
        maybe = materialise(_may_link(groups, near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "copies-maybe")
        if maybe.limit(1).count():
            # components of what may link: each node is in one, and all that is left to count is within them
            places = connected_components(maybe).select(F.col("node").alias("root"), F.col("root").alias("place"))
            number = materialise(met.groupBy("root").agg(F.count("*").alias("n")).join(places, "root"), "copies-places")
            number = _with(number, "place", _largest=F.max(F.struct("n", "root")), _all=F.sum("n"))
            number = number.select("root", "place", "n", (F.col("root") == F.col("_largest.root")).alias("joined"), F.col("_largest.n").alias("near"), (F.col("_all") - F.col("_largest.n")).alias("far"))
            members = materialise(join_unique(met, materialise(number, "copies-number"), ["root"], "n"), "copies-members")
            whole = sets(members.select("node"))
            found = materialise(_alike(_blocked(members.join(whole, "node"), "place", block, "shingles"), similarity), "copies-found")
            release(members, whole)
            stars = materialise(stars.unionByName(found), "copies-edges")
        out = materialise(_rooted(nodes, stars), "copies-roots")
        kept.append(out)
    return out


def set_classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, coords: int, band: int, parts_of: Parts, near: Near, similarity: float, block: int = COPY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(own, texts)``, two stored tables: ``(id_col, text_hash, set_a, set_b, size)`` of all rows, and ``(set_a, set_b, lowest, rows, root)`` of each set.

    lowest is the least ``(id, text_hash)`` of the rows of a set that have an id; root is shared by sets that link.
    """
    with scratch() as kept:
        every = materialise(described(docs.select(id_col, text_col), id_col, text_col, shingle, coords, band, parts_of), "copies-all")
        whom = F.min(F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), "text_hash"))).alias("lowest")
        # one row of each set: the first that a task meets, then the first of these
        wide = every.groupBy("set_a", "set_b").agg(whom, F.count("*").alias("rows"), F.min("text_hash").alias("text_hash"), F.first("keys").alias("keys"), F.first("parts").alias("parts"))
        wide = materialise(wide.withColumn("node", F.monotonically_increasing_id()), "copies-wide")
        own = materialise(every.select(id_col, "text_hash", "set_a", "set_b", "size"), "copies-rows")
        release(every)
        texts = materialise(wide.drop("keys", "parts"), "copies-texts")
        stand = texts.select("node", F.col("lowest.id").alias("id"), F.coalesce("lowest.text_hash", "text_hash").alias("hash"))
        roots = alike_roots(wide, near, lambda nodes: sets_of(nodes, stand, docs, id_col, text_col, shingle), similarity, block)
        texts = materialise(texts.join(roots, "node").select("set_a", "set_b", "lowest", "rows", "root"), "copies-sets")
        kept += [own, texts]
    return own, texts


def named_rows(own: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``own`` with their ``component``, the smallest id of the sets that share a root."""
    lowest = materialise(texts.groupBy("root").agg(F.min("lowest")["id"].alias("component"), F.count("*").alias("_sets")), "copies-lowest")
    by_set = join_unique(texts, lowest, ["root"], "_sets").select("set_a", "set_b", "component", F.col("rows").alias("_rows"))
    return join_unique(own, materialise(by_set, "copies-components"), ["set_a", "set_b"], "_rows")
