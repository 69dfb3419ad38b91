"""Correlations of pairs by blocks of series against a plain loop."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from chronoframe.operators import risk, selection


def _plain(rows, least):
    """``rows`` are (key, time, group, value); pairs of one time and group, as the SQL joins them."""
    met = {}
    for a, t, g, x in rows:
        for b, u, h, y in rows:
            if a < b and t == u and g == h and g is not None and x is not None and y is not None:
                met.setdefault((a, b), []).append((x, y))
    out = {}
    for k, both in met.items():
        x, y = np.array(both).T
        if len(both) >= least:
            flat = len(set(x)) == 1 or len(set(y)) == 1 or not np.isfinite(x + y).all()
            out[k] = (len(both), math.nan if flat else float(np.corrcoef(x, y)[0, 1]))
    return out


@pytest.mark.parametrize("block", [3, 1000])
@pytest.mark.parametrize("grouped", [True, False])
def test_pair_correlations_by_blocks(spark, block, grouped):
    rng = random.Random(5)
    rows = [(k, t, k % 2, rng.gauss(1e4, 1.0) if k else 7.5) for k in range(11) for t in range(20) if rng.random() < 0.8]
    rows += [(20, t, 0, 3.25 if t < 12 else 1e9 * t) for t in range(20)] + [(21, t, 0, rng.random()) for t in range(12)]  # flat on common times only
    rows += [(k, t, t % 2, rng.random()) for k in (30, 31) for t in range(14)]  # their group changes
    rows += [(2, 1, 0, 5.0), (4, 1, 0, 9.0), (4, 1, 0, None), (5, 3, None, 1.0), (32, 2, 0, math.nan)]
    df = spark.createDataFrame(rows, "k long, t int, g int, v double")
    got = risk.pair_correlations(df, "k", "t", "v", 2, ["g"] if grouped else [], block=block).collect()
    want = _plain(rows if grouped else [(k, t, 0, v) for k, t, _, v in rows], 2)
    assert len(got) == len(want) and {(r["a"], r["b"]): r["n"] for r in got} == {k: n for k, (n, _) in want.items()}
    for r in got:
        expected = want[r["a"], r["b"]][1]
        assert math.isnan(r["corr"]) if math.isnan(expected) else abs(r["corr"] - expected) < 1e-7, (r, expected)


@pytest.mark.parametrize("head", [1, 5, 1000])
def test_picks_are_replaced_without_forming_the_pairs(spark, head, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(selection, "HEAD_GROWS", 3)
    rows = [(p, e, rng.choice([None, 1, 2, 3, 4]), rng.choice([None, math.nan, float(rng.randrange(30))]), rng.random() < 0.1, rng.random() < 0.7) for p in range(5) for e in range(60)]
    df = spark.createDataFrame(rows, "p int, e int, sector int, score double, held boolean, stays boolean")
    acted = df.join(selection.select_constrained(df, ["p"], "score", "e", "sector", 8, 2), ["p", "e"])
    common = [rng.gauss(0, 1) for _ in range(30)]
    returns = spark.createDataFrame([(e, t, common[t] * (e % 3) + rng.gauss(0, 1)) for e in range(55) for t in range(30) if rng.random() < 0.9], "e int, t int, v double")
    pairs = risk.pair_correlations(returns, "e", "t", "v", 20).where("NOT isnan(corr)")
    want = selection.replace_correlated_picks(acted, pairs, ["p"], "score", "e", "sector", 2, 0.3).collect()
    got = selection.replace_picks_by_returns(acted, returns, ["p"], "score", "e", "sector", 2, 0.3, "t", "v", 20, head=head).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r["action"] == "replace" for r in got)
