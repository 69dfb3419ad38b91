"""What a review found in single operators: work that grew with more than the input."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.functions import scalars
from chronoframe.operators import fundamentals, intervals, prices, segments


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_stay_whole_across_batches():
    rows = pd.DataFrame({"k": np.repeat([1, 1, 2, 3, 3, 4], [3, 9, 1, 1, 1, 20]), "_seg": np.repeat([0, 1, 0, 0, 1, 0], [3, 9, 1, 1, 1, 20]), "v": range(35)})
    for size in (1, 2, 7, 35):
        found = list(segments._whole_parts((rows.iloc[i : i + size] for i in range(0, 35, size)), ["k", "_seg"]))
        assert pd.concat(found)["v"].tolist() == list(range(35))
        parts = [set(zip(f["k"], f["_seg"], strict=True)) for f in found]
        assert sum(map(len, parts)) == len(set.union(*parts)) == 6


def test_component_sums_keep_no_set_of_tags(spark):
    rows = [(1, 1, 5.0), (1, 2, 6.0), (1, 1, 1.0), (1, 3, 9.0), (2, 1, 5.0), (3, 1, 5.0), (3, 2, None), (4, 3, 1.0), (5, None, 2.0), (None, 1, 1.0), (None, 2, 1.0)]
    out = fundamentals.sum_components(spark.createDataFrame(rows, "k int, tag int, v double"), ["k"], "tag", "v", [1, 2], "s")
    assert {r["k"]: r["s"] for r in out.collect()} == {1: 12.0, 2: None, 3: None, 4: None, 5: None, None: 2.0}
    assert "Expand" not in _plan(out) and "distinct" not in _plan(out).lower()


@pytest.mark.parametrize("either_way", [False, True])
def test_nearest_split_ratio_is_looked_for_once(spark, either_way):
    ratios, tolerance = prices.SHARE_SPLITS, prices.SHARE_TOLERANCE
    values = [None, float("nan"), float("inf"), 0.0, -2.0, *[i / 16 for i in range(1, 400)]]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", prices.nearest_split_ratio(F.col("v"), ratios, tolerance, either_way).alias("r"))
    known = [float(x) for r in ratios for x in ((r, 1 / r) if either_way else (r,))]
    for r in df.collect():
        v = r["v"]
        best = min((abs(v / k - 1), k) for k in known) if v is not None and 0 < v < float("inf") else (1e9, None)
        assert r["r"] == (best[1] if best[0] <= tolerance else None), r
    assert _plan(df).count("array_min") == 1


def test_folding_looks_up_no_plain_letter(spark):
    df = spark.createDataFrame([("Straße ﬁx ABC Ⅳ",), (None,), ("plain",)], "n string").select(scalars.fold(F.col("n")).alias("f"))
    assert [r["f"] for r in df.collect()] == ["strasse fix abc iv", None, "plain"]
    assert "< \u0080" in _plan(df)


@pytest.mark.parametrize("crowd", [0, 20, 1000])
def test_overlaps_of_keys_with_few_and_many_intervals(spark, crowd):
    rng = random.Random(3)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(300))
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.choice(["a", "b", None]), rng.choice([day(), day(), day(), None]), rng.choice([day(), day(), None])) for i in range(150)]
    rows += [(7, 1, "a", dt.date(2020, 1, 1), None), (7, 1, "b", dt.date(2020, 1, 1), None), (7, 2, "a", dt.date(2020, 1, 1), None), (7, 3, "b", dt.date(2020, 1, 1), dt.date(2020, 1, 1))]
    df = spark.createDataFrame(rows, "k int, id int, what string, s date, e date")
    far, want = dt.date(9999, 12, 31), []
    for k, a, p, s, e in rows:
        for m, b, q, t, u in rows:
            if k is not None and k == m and a < b and None not in (p, q, s, t) and p != q and s < (u or far) and t < (e or far):
                until = min(e or far, u or far)
                want.append((k, a, b, max(s, t), until if until < far else None))
    got = [tuple(r) for r in intervals.overlaps(df, ["k"], "s", "e", "id", "what", crowd).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
