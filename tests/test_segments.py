"""Recursions walked in segments give, row by row, what a plain loop over the whole series gives."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import segments


def _series(n: int, seed: int, nulls: bool = True):
    rng, x = random.Random(seed), 100.0
    for i in range(n):
        x = max(1.0, x + rng.uniform(-2, 2))
        yield dt.date(1900, 1, 1) + dt.timedelta(days=i + rng.randrange(0, 2) * (i % 3 == 0)), None if nulls and rng.random() < 0.05 else round(x, 3)


def _ema(values, period, alpha):
    s, n, out = 0.0, 0, []
    for v in values:
        if v is not None:
            n += 1
            s = s + v / period if n <= period else v * alpha + s * (1 - alpha)
        out.append(s if n >= period else None)
    return out


def _rsi(values, period=14):
    last, up, down, n, out = None, 0.0, 0.0, 0, []
    for v in values:
        if v is not None:
            if last is not None:
                d, n = v - last, n + 1
                rise, fall = max(d, 0.0), max(-d, 0.0)
                up, down = (up + rise / period, down + fall / period) if n <= period else ((up * (period - 1) + rise) / period, (down * (period - 1) + fall) / period)
            last = v
        out.append(None if n < period else 100.0 if down == 0 else 100 - 100 / (1 + up / down))
    return out


def _states(rows, confirm, cooldown):
    state, run, side, moved, out = 0, 0, 0, None, []
    for day, level in rows:
        if level is not None:
            now = (level > state) - (level < state)
            run = 0 if now == 0 else run + 1 if now == side else 1
            side = now
            if now and run >= confirm and (moved is None or (day - moved).days >= cooldown):
                state, run, side, moved = state + now, 0, 0, day
        out.append(state)
    return out


@pytest.fixture(scope="module")
def long(spark):
    rows = [(k, day, v) for k, n in (("hot", 3000), ("small", 40), ("one", 1)) for day, v in _series(n, n)]
    rows += [("unknown", dt.date(2000, 1, i), None) for i in range(1, 20)]
    by_key = {k: sorted([r for r in rows if r[0] == k], key=lambda r: (r[1], r[2] is not None, r[2] or 0)) for k in ("hot", "small", "one", "unknown")}
    return spark.createDataFrame(rows, "k string, t date, v double").withColumn("_in", F.lit(1)), by_key


def _found(df, out):
    got = {}
    for r in df.orderBy("k", "t", F.col("v").asc_nulls_first()).collect():
        got.setdefault(r["k"], []).append(r[out])
    return got


@pytest.mark.parametrize("cut", [10**6, 97])
def test_means_and_strength_of_every_row(long, cut):
    df, by_key = long
    ema = _found(segments.ema_rows(df, "v", ["k"], "t", 12, rows=cut), "ema")
    rsi = _found(segments.rsi_rows(df, "v", ["k"], "t", rows=cut), "rsi")
    for k, rows in by_key.items():
        values = [v for _, _, v in rows]
        for got, plain in ((ema[k], _ema(values, 12, 2 / 13)), (rsi[k], _rsi(values))):
            assert [-1.0 if v is None else v for v in got] == pytest.approx([-1.0 if v is None else v for v in plain], rel=1e-9), k


@pytest.mark.parametrize(("cut", "confirm", "cooldown"), [(10**6, 3, 10), (53, 3, 10), (53, 1, 0), (7, 4, 25)])
def test_state_machine_of_every_row(spark, cut, confirm, cooldown):
    rng, rows, level = random.Random(cut + confirm), [], 0
    for k, n in (("hot", 900), ("small", 30)):
        for i in range(n):
            level = rng.randrange(-1, 3) if rng.random() < 0.25 else level
            rows.append((k, dt.date(2000, 1, 1) + dt.timedelta(days=i), None if rng.random() < 0.02 else level))
    df = spark.createDataFrame(rows, "k string, t date, v int")
    got = _found(segments.state_rows(df, ["k"], "t", "v", "state", confirm, cooldown, rows=cut), "state")
    for k in ("hot", "small"):
        assert got[k] == _states([r[1:] for r in rows if r[0] == k], confirm, cooldown), k


def test_a_hot_key_goes_to_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id")).alias("t"), F.sin("id").alias("v"))
    done = segments.ema_rows(df, "v", ["k"], "t", 12, rows=10_000)
    sizes = [r["count"] for r in segments.with_segments(df, ["k"], "t", 10_000).groupBy("_seg").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 12_000 and sum(sizes) == 200_000
    assert done.where("ema IS NOT NULL").count() == 200_000 - 11


def test_empty_and_rows_without_a_place(spark):
    df = spark.createDataFrame([("a", None, 1.0), (None, dt.date(2000, 1, 1), 1.0)], "k string, t date, v double")
    assert segments.ema_rows(df, "v", ["k"], "t", 2).count() == 0
    assert segments.rsi_rows(df.limit(0), "v", ["k"], "t").count() == 0
    assert segments.state_rows(df.withColumn("v", F.col("v").cast("int")), ["k"], "t", "v", "s").count() == 0
