"""Connected components of an edge table: trees within tasks, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, release
from .skew import join_unique

#: Edges that a task contracts at a time.
CONTRACTED = 250_000


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` with the same components: of each run of :data:`CONTRACTED` edges every node with its least one."""

    def trees(u: list[int], v: list[int]) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(u, v, strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if find(x) != x]
        return pd.DataFrame({"u": pd.Series(nodes, dtype="int64"), "v": pd.Series([find(x) for x in nodes], dtype="int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u: list[int] = []
        v: list[int] = []
        for b in batches:
            u += b["u"].tolist()
            v += b["v"].tolist()
            if len(u) >= CONTRACTED:
                yield trees(u, v)
                u, v = [], []
        if u:
            yield trees(u, v)

    return edges.select("u", "v").mapInPandas(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("m"), "n")
    return join_unique(both, materialise(lowest, "cc-lowest"), ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    lowest = materialise(lowest, "cc-lowest")
    moved = join_unique(down, lowest, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(u, v)``; root is the smallest node reachable.

    Nodes are longs. First each task joins what its own edges join, some at a time. If these were all
    edges, that is the result; else rounds of two joins on the node follow, in which hubs are not
    shuffled, so no neighbourhood is ever collected; rounds grow with the logarithm of the longest chain.
    Every round is written to the shared folder and the one before it deleted. Self-loops and repeated
    edges are harmless; an edge with a null end is dropped. An empty table gives an empty result.
    """
    given = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "cc")
    number = given.count()
    now = materialise(_contracted(given.coalesce(1) if number < CONTRACTED else given).distinct(), "cc")
    release(given)
    before = _state(now) if number >= CONTRACTED else (0,)
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = materialise(_large_star(now), "cc")
        after = materialise(_small_star(large), "cc")
        release(now, large)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
