"""Folds against plain loops, golden cases, metamorphic properties, and refusals."""

from __future__ import annotations

import datetime as dt
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import asof, audit, fundamentals, history, identity, index_aware, intervals, prices, risk, rules, screening, selection, series, skew
from chronoframe.sources import readers, sinks

DAY = dt.date(2024, 1, 1)


def _series(n=80, keys=3, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(keys):
        p = 100.0
        for i in range(n):
            p *= 1 + rng.uniform(-0.05, 0.05)
            rows.append((k, DAY + dt.timedelta(days=i), round(p, 4)))
    return rows


def test_rsi_and_ema_equal_loops(spark):
    rows = _series()
    df = spark.createDataFrame(rows, "k int, t date, p double")
    got = {r["k"]: r["rsi"] for r in series.rsi(df, "p", ["k"], "t").collect()}
    ema = {r["k"]: r["ema"] for r in series.ema(df, "p", ["k"], "t", 12).collect()}
    for k in got:
        p = [x[2] for x in rows if x[0] == k]
        d = [b - a for a, b in zip(p, p[1:], strict=False)]
        up, down = sum(max(x, 0) for x in d[:14]) / 14, sum(max(-x, 0) for x in d[:14]) / 14
        for x in d[14:]:
            up, down = (up * 13 + max(x, 0)) / 14, (down * 13 + max(-x, 0)) / 14
        assert got[k] == pytest.approx(100 - 100 / (1 + up / down))
        e = sum(p[:12]) / 12
        for x in p[12:]:
            e = x * 2 / 13 + e * 11 / 13
        assert ema[k] == pytest.approx(e)


def test_state_machine_equals_loop(spark):
    rng = random.Random(4)
    rows = [(k, DAY + dt.timedelta(days=i), rng.choice([0, 0, 1, 2, 3])) for k in range(5) for i in range(120)]
    got = {r["k"]: r["s"] for r in series.state_machine(spark.createDataFrame(rows, "k int, t date, raw int"), ["k"], "t", "raw", "s").collect()}
    for k in range(5):
        state, run, side, moved = 0, 0, 0, None
        for _, t, raw in (x for x in rows if x[0] == k):
            now = (raw > state) - (raw < state)
            run = 0 if now == 0 else run + 1 if now == side else 1
            side = now
            if now and run >= 3 and (moved is None or (t - moved).days >= 10):
                state, run, side, moved = state + now, 0, 0, t
        assert got[k] == state


def test_turnover_budget_skips_what_does_not_fit(spark):
    rows = [(1, 1, 60.0, False), (1, 2, 50.0, False), (1, 3, 30.0, False), (1, 4, 90.0, True)]
    df = spark.createDataFrame(rows, "p int, o int, amount double, forced boolean")
    got = {r["o"]: r["admitted"] for r in selection.turnover_budget(df, ["p"], "o", "amount", "forced", 100.0).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_constrained_selection_holds_its_caps(spark):
    rows = [(1, i, i % 3, float(100 - i), i in (20, 21), i == 20) for i in range(30)]
    df = spark.createDataFrame(rows, "p int, e int, sector int, score double, held boolean, stays boolean")
    got = {r["e"]: r["action"] for r in selection.select_constrained(df, ["p"], "score", "e", "sector", 5, 2).collect()}
    taken = [e for e, a in got.items() if a in ("hold", "enter")]
    assert got[20] == "hold" and got[21] == "exit_band" and len(taken) == 5
    assert max(sum(e % 3 == s for e in taken) for s in range(3)) == 2


def _core_loop(rows, near, rules):
    """One cycle in plain steps; rows are (entity, score, sector, held, core, bank, sleeve, base, relative)."""
    if sum(bool(x[4]) for x in rows) < max(rules.min_core, rules.slots - rules.max_outside):
        return {}
    rows = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    out, picks = {}, []

    def bar(x, among):
        if x[2] is not None and [y[2] for y in among].count(x[2]) >= rules.per_sector:
            return "sector_cap"
        if x[5] and sum(bool(y[5]) for y in among) >= rules.banks:
            return "bank_cap"
        if not x[4] and sum(not y[4] for y in among) >= rules.max_outside:
            return "outside_cap"
        return None

    def add(x, stage):
        if len(picks) < rules.slots and x not in picks and bar(x, picks) is None:
            picks.append(x)
            out[x[0]] = ("hold" if x[3] else "enter", stage, None)

    for x in rows[: rules.window]:
        if x[3] and x[7] is not None and x[7] >= rules.incumbent_base:
            add(x, "incumbent")
    for x in rows:
        if x[4] and sum(bool(y[4]) for y in picks) < rules.min_core:
            add(x, "core")
    for x in rows:
        if x[4] and x[6] and not any(y[6] for y in picks) and x[1] is not None and x[1] >= rules.sleeve_score and (50 if x[8] is None else x[8]) >= rules.sleeve_relative:
            add(x, "sleeve")
    for x in rows:
        add(x, "fill")
    gone, moved = [], True
    while moved:
        moved = False
        for weak in [x for x in rows if x in picks and any(y in picks and frozenset((x[0], y[0])) in near for y in rows[: rows.index(x)])]:
            others = [y for y in picks if y != weak]
            best = next((x for x in rows if x not in picks and x not in gone and bar(x, others) is None and not any(frozenset((x[0], y[0])) in near for y in others)), None)
            if best is not None:
                picks[picks.index(weak)], moved = best, True
                gone.append(weak)
                out[weak[0]], out[best[0]] = ("correlation_cap", out[weak[0]][1], None), ("hold" if best[3] else "enter", "replacement", weak[0])
                break
    return {x[0]: out.get(x[0]) or (bar(x, picks) or "no_slot", None, None) for x in rows}


@pytest.mark.parametrize("correlated", [False, True])
def test_choice_around_a_core_equals_loop(spark, correlated):
    rng = random.Random(21)
    rules = index_aware.CoreRules(slots=6, min_core=2, max_outside=2, window=9, incumbent_base=60.0, sleeve_score=40.0, per_sector=2, banks=1)
    maybe = lambda v: rng.choice([v, v, v, None])
    rows = []
    for p in range(12):  # the last cycles have too little of a core
        for e in range(70):
            core = (e < 3 if p >= 10 else rng.random() < 0.5) or (None if rng.random() < 0.5 else False)
            rows.append((p, e, maybe(float(rng.randrange(40) * 2)), rng.choice([None, *"abcde"]), rng.choice([True, False, None]), core, rng.random() < 0.3, rng.random() < 0.2, maybe(float(rng.randrange(100))), maybe(float(rng.randrange(30, 100)))))
    pairs = sorted({tuple(sorted(rng.sample(range(70), 2))) for _ in range(500)}) if correlated else []
    corr = [(a, b, rng.choice([0.9, 0.7, None, -0.9])) for a, b in pairs]
    near = {frozenset((a, b)) for a, b, v in corr if v is not None and v > 0.7}
    df = spark.createDataFrame(rows, "p int, e int, score double, sector string, held boolean, core boolean, bank boolean, sleeve boolean, base double, relative double").withColumn("extra", F.lit(1))
    given = spark.createDataFrame(corr, "a int, b int, corr double") if correlated else None
    got = {(r["p"], r["e"]): (r["action"], r["stage"], r["replaces"]) for r in index_aware.select_with_core(df, ["p"], "e", "score", rules, given).collect()}
    want = {}
    for p in range(12):
        want |= {(p, e): v for e, v in _core_loop([x[1:] for x in rows if x[0] == p], near, rules).items()}
    assert got == want and {p for p, _ in got} == set(range(10))
    assert ("replacement" in {v[1] for v in got.values()}) == correlated
    assert index_aware.select_with_core(df.limit(0), ["p"], "e", "score", rules, given).count() == 0


def test_relative_strength_and_blend(spark):
    one = lambda *v: spark.range(1).select(index_aware.relative_strength(*(F.lit(x).cast("double") for x in v)).alias("x")).first()["x"]
    assert one(100, 110, 50, 50) == pytest.approx(70) and one(100, 300, 50, 50) == 100 and one(100, 1, 50, 50) == 0
    assert one(None, 110, 50, 50) == one(0, 110, 50, 50) == one(100, 110, None, 50) == 50
    blend = spark.range(1).select(index_aware.blended_score(F.lit(99.0), F.lit(50.0), F.lit(None).cast("double")).alias("x")).first()["x"]
    assert blend == pytest.approx((99 * 0.75 + 50 * 0.35 + 50 * 0.05) / 1.15, abs=1e-4)
    with pytest.raises(ValueError):
        index_aware.blended_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), (0, 0, 0))


def test_constrained_selection_equals_loop_on_all_candidates(spark):
    rng = random.Random(8)
    rows = [(p, e, rng.choice([None, 1, 2, 3]) if p else int(e > 250), rng.choice([None, float(rng.randrange(60))]) if p else float(300 - e), rng.random() < 0.1, rng.random() < 0.5) for p in range(4) for e in range(300)]
    df = spark.createDataFrame(rows, "p int, e int, sector int, score double, held boolean, stays boolean")
    for slots, cap in ((15, 2), (5, 3), (15, 400)):
        got = {(r["p"], r["e"]): r["action"] for r in selection.select_constrained(df, ["p"], "score", "e", "sector", slots, cap).collect()}
        want = {}
        for p in range(4):
            used, taken = {}, 0
            for _, e, s, score, held, stays in sorted((x for x in rows if x[0] == p), key=lambda x: (not (x[4] and x[5]), x[3] is None, -(x[3] or 0), x[1])):
                if held and not stays:
                    want[p, e] = "exit_band"
                elif taken >= slots:
                    want[p, e] = "no_slot"
                elif s is not None and used.get(s, 0) >= cap:
                    want[p, e] = "sector_cap"
                else:
                    used[s], taken = used.get(s, 0) + 1, taken + 1
                    want[p, e] = "hold" if held else "enter"
        assert got == want and len(got) == len(rows)


@pytest.mark.parametrize(
    ("quarters", "year", "fourth"),
    [((11_300_000_000, 12_363_000_000, 11_854_000_000), 47_061_000_000, 11_544_000_000), ((124_300_000_000, 95_359_000_000, 94_036_000_000), 416_161_000_000, 102_466_000_000)],
)
def test_fourth_quarter_by_difference(spark, quarters, year, fourth):
    d = dt.date
    annual = spark.createDataFrame([(1, d(2024, 12, 31), d(2023, 12, 31), year, d(2025, 2, 1))], "c int, e date, s date, v long, a date")
    parts = spark.createDataFrame([(1, d(2024, m, 28), v, d(2024, m + 1, 1)) for m, v in zip((3, 6, 9), quarters, strict=True)], "c int, e date, v long, a date")
    got = fundamentals.derive_quarters(annual, parts, ["c"], "e", "s", "v", "a").orderBy("quarter").collect()
    assert [r["value"] for r in got] == [*quarters, fourth]
    assert got[-1]["available"] == d(2025, 2, 1)
    short = annual.withColumn("s", F.lit(d(2024, 6, 30)))
    assert [r["status"] for r in fundamentals.derive_quarters(short, parts, ["c"], "e", "s", "v", "a").collect()] == ["fiscal_year_change"]


def test_ttm_composition_golden(spark):
    rows = [(1, 2023, 4, "3C", 100.0), (1, 2023, 2, "3C", 20.0), (1, 2024, 2, "3C", 30.0), (1, 2024, 2, "4D", 5.0)]
    got = fundamentals.compose_ttm(spark.createDataFrame(rows, "c int, y long, p long, i string, v double"), ["c"], "y", "p", "i", "v").where("y = 2024").collect()
    assert {r["i"]: r["ttm"] for r in got} == {"3C": 110.0, "4D": None}


def test_interval_closure(spark):
    rows = [(1, 0, 2, 10, 5), (1, 0, 3, 18, 6), (1, 3, 4, 7, 7)]
    got = {(r["s"], r["e"]): (r["v"], r["t"]) for r in fundamentals.close_intervals(spark.createDataFrame(rows, "c int, s long, e long, v long, t int"), ["c"], "s", "e", "v", "t").collect()}
    assert got[2, 3] == (8, 6) and got[0, 4] == (25, 7) and got[2, 4] == (15, 7)


@pytest.mark.parametrize("longest", [None, 6])
def test_interval_closure_equals_fixpoint(spark, longest):
    rng = random.Random(6)
    rows = [(1, i, i + 4, 0, 0) for i in range(12)] + [(1, 0, 1, 0, 3)] + [(2, a, a + rng.randrange(1, 5), 0, rng.randrange(9)) for a in rng.sample(range(14), 9)]
    sums = [rng.randrange(100) for _ in range(40)]
    rows = list({(c, s, e): (c, s, e, sum(sums[s:e]), t) for c, s, e, _, t in rows}.values())
    got = {(r["c"], r["s"], r["e"]): (r["v"], r["t"]) for r in fundamentals.close_intervals(spark.createDataFrame(rows, "c int, s long, e long, v long, t int"), ["c"], "s", "e", "v", "t", longest).collect()}
    want = {(c, s, e): (v, t) for c, s, e, v, t in rows}
    while True:
        more = dict(want)
        for (c, s, e), (v, t) in want.items():
            for (c2, s2, e2), (v2, t2) in want.items():
                found = []
                if c == c2 and e == s2 and (longest is None or e2 - s <= longest):
                    found.append(((c, s, e2), v + v2))
                if c == c2 and s == s2 and e > e2:
                    found.append(((c, e2, e), v - v2))
                for k, value in found:
                    if k not in more or more[k][1] > max(t, t2):
                        more[k] = (value, max(t, t2))
        if more == want:
            break
        want = more
    assert got == want


def test_views_take_one_shuffle_and_leave_conflicts_out(spark):
    rows = [(1, 1, "a", 1), (1, 2, "b", 2), (2, 1, "a", 3), (2, 1, "b", 4), (2, 2, "c", 5), (3, 1, "a", 6), (3, 1, "a", 7), (None, 1, "a", 8), (4, 1, None, 9), (4, 1, "x", 10)]
    df = spark.createDataFrame(rows, "k int, t int, v string, id int")
    first, last, bad = history.pit_views(df, ["k"], "t", "v", ["id"])
    assert {(r["k"], r["id"]) for r in first.collect()} == {(1, 1), (3, 6), (None, 8)}
    assert {(r["k"], r["id"]) for r in last.collect()} == {(1, 2), (3, 7), (None, 8)}
    assert {r["k"] for r in bad.collect()} == {2, 4}
    plan = first._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1, plan


def test_choice_under_several_caps_equals_loop(spark):
    rng = random.Random(2)
    rows = [(p, e, rng.choice([None, 1, 2, 3, 4]), rng.choice([None, float(rng.randrange(50))]), rng.random() < 0.1, rng.random() < 0.5, rng.choice([None, True, False]), rng.random() < 0.3) for p in range(3) for e in range(60)]
    kind = "p int, e int, sector int, score double, held boolean, stays boolean, large boolean, bank boolean"
    pairs = [(a, b, rng.choice([None, 0.1, 0.5, 0.95])) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.9]
    table = spark.createDataFrame(pairs, "a int, b int, corr double")
    for corr, closed in ((None, True), (table, True), (table, False)):
        got = {(r["p"], r["e"]): r["action"] for r in selection.choose_under_caps(spark.createDataFrame(rows, kind), ["p"], "score", "e", 12, {"sector": 3}, {"large": 4, "bank": 2}, corr, 0.85, closed).collect()}
        known = {frozenset((a, b)): c for a, b, c in pairs}
        want = {}
        for p in range(3):
            picks, n = [], {}
            for _, e, s, score, held, stays, large, bank in sorted((x for x in rows if x[0] == p), key=lambda x: (not (x[4] and x[5]), x[3] is None, -(x[3] or 0), x[1])):
                own = [k for k in (("sector", s) if s is not None else None, ("large",) if large else None, ("bank",) if bank else None) if k]
                cap = next((k[0] for k in own if n.get(k, 0) >= {"sector": 3, "large": 4, "bank": 2}[k[0]]), None)
                with_picks = [known.get(frozenset((e, x))) for x in picks] if corr is not None else []
                if held and not stays:
                    want[p, e] = "exit_band"
                elif len(picks) >= 12:
                    want[p, e] = "no_slot"
                elif cap:
                    want[p, e] = f"{cap}_cap"
                elif any(c is not None and c > 0.85 for c in with_picks):
                    want[p, e] = "correlation_cap"
                elif closed and any(c is None for c in with_picks):
                    want[p, e] = "correlation_unknown"
                else:
                    want[p, e] = "hold" if held else "enter"
                    picks.append(e)
                    for k in own:
                        n[k] = n.get(k, 0) + 1
        assert got == want


@pytest.mark.parametrize(("ratio", "price", "share"), [(4.0, 4.0, 4.0), (2.05, None, 2.0), (0.0125, 0.0125, None), (7.1, None, 7.0), (0.4, None, 0.4), (12.0, None, 12.0), (1 / 30, 1 / 30, 1 / 30), (0.66, None, 1 / 1.5), (-2.0, None, None), (1.0, None, None)])
def test_split_grids(spark, ratio, price, share):
    c = F.lit(ratio)
    got = spark.range(1).select(prices.nearest_split_ratio(c).alias("p"), prices.nearest_split_ratio(c, prices.SHARE_SPLITS, prices.SHARE_TOLERANCE, either_way=True).alias("s")).first()
    assert (got["p"], got["s"]) == (pytest.approx(price) if price else None, pytest.approx(share) if share else None)


def test_inferred_splits_need_steady_levels(spark):
    series = {1: [100, 101, 300, 303], 2: [100, 300], 3: [100, 130, 300, 301], 4: [100, 300, 400], 5: [100, 250, 251]}
    rows = [(k, i, v) for k, x in series.items() for i, v in enumerate(x)]
    got = {(r["k"], r["t"], r["ratio"]) for r in prices.inferred_splits(spark.createDataFrame(rows, "k int, t int, v int"), ["k"], "t", "v").collect()}
    assert got == {(1, 2, 3.0), (5, 1, 2.5)}


def test_chains_of_hashes(spark):
    import hashlib

    rows = [(c, i, f"p{c}{i}") for c in range(3) for i in range(4)]
    log = audit.chain_hashes(spark.createDataFrame(rows, "c int, i int, p string"), ["c"], "i", "p")
    by = {(r["c"], r["i"]): r for r in log.collect()}
    for c in range(3):
        before = None
        for i in range(4):
            own = hashlib.sha256(f"{before or ''}|p{c}{i}".encode()).hexdigest()
            assert (by[c, i]["previous"], by[c, i]["own"]) == (before, own)
            before = own
    assert audit.chain_breaks(log, ["c"], "i", "p", "own", "previous").count() == 0
    spoiled = log.withColumn("p", F.when((F.col("c") == 1) & (F.col("i") == 2), "x").otherwise(F.col("p")))
    assert [(r["c"], r["i"], r["broken_link"], r["broken_hash"]) for r in audit.chain_breaks(spoiled, ["c"], "i", "p", "own", "previous").collect()] == [(1, 2, False, True)]


def test_identities_meet_through_chains(spark):
    rows = [(1, "a", 1), (2, "a", 1), (2, "b", 1), (3, "b", 1), (4, "a", 2), (5, None, 1), (6, None, 1), (None, "a", 1)]
    got = [(r["e"], r["entity"]) for r in screening.reconcile_identities(spark.createDataFrame(rows, "e long, n string, d int"), "e", ["n", "d"]).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (None, None)], key=str)


def test_sessions_around_a_date(spark):
    calendar = spark.createDataFrame([(DAY + dt.timedelta(days=i),) for i in (0, 1, 4, 5, 6)], "s date")
    rows = spark.createDataFrame([(i, DAY + dt.timedelta(days=i)) for i in (-1, 0, 3, 6)] + [(9, None)], "i int, d date")
    at = lambda n: {r["i"]: r["due"] and (r["due"] - DAY).days for r in screening.sessions_after(rows, calendar, "d", "s", n, "due").collect()}
    assert at(2) == {-1: None, 0: 4, 3: 5, 6: None, 9: None} and at(-1) == {-1: None, 0: None, 3: 0, 6: 5, 9: None} and at(0) == {-1: None, 0: 0, 3: 1, 6: 6, 9: None}


def test_hot_keys_are_joined_whole(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 == 0 else i) for i in range(3000)] + [(9999, None)], "i long, k long")
    found = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("low")).where("k IS NOT NULL AND k <> 1")
    got = skew.join_unique(rows, found, ["k"], "n").collect()
    assert len(got) == 2999 and all(r["low"] == r["k"] for r in got) and got[0].asDict().keys() == {"i", "k", "low"}


def test_rules(spark):
    t, n = F.lit(True), F.lit(None).cast("boolean")
    got = spark.range(1).select(rules.first_reason([(n, "a"), (t, "b")]).alias("r"), *(c.alias(f"f{i}") for i, c in enumerate(rules.first_known([(F.lit(None).cast("int"), "x"), (F.lit(2), "y")], "none", F.lit(3)))), rules.stress_points([(F.lit(5), ((3, 2), (6, 1))), (F.lit(None).cast("int"), ((3, 2),))]).alias("s")).first()
    assert tuple(got) == ("b", 2, "y", 1)
    df = spark.createDataFrame([(1, "Abc", 5.0), (2, "xbc", None)], "i int, s string, v double")
    assert [r["i"] for r in rules.optional_filters(df, {"i": None}, {"v": 1}, {"i": (1, 2)}, {"s": "BC"}).collect()] == [1]
    assert rules.dominant(spark.createDataFrame([(1, "a")] * 6 + [(1, "b")] * 2 + [(2, "a")] * 4, "k int, e string"), ["k"], "e").collect() == [(1, "a", 6)]
    with pytest.raises(ValueError, match="providers"):
        rules.coverage_matrix(df, spark.range(5).toDF("n"), ["i"], "n", n.cast("string"), F.lit("none"), most=4)
    compared = rules.compare_keys(df, spark.createDataFrame([(1, 5.01), (3, 1.0)], "i int, v double"), ["i"], "v", 0.1)
    assert {tuple(r) for r in compared.collect()} == {(2, "missing_right"), (3, "missing_left")}


def test_lifecycle_files(spark, tmp_path):
    def read(text):
        p = tmp_path / f"{abs(hash(text))}.csv"
        p.write_text(text)
        return readers.read_lifecycle(spark, str(p)).collect()

    head = "ticker,exchange,assetType,priceCurrency,startDate,endDate\n"
    assert [tuple(r) for r in read(head + " aa ,nyse,Stock,usd,2020-01-02,2021-01-02\nb,,ETF,USD,2020-01-02,\n")] == [("AA", "NYSE", "Stock", "USD", dt.date(2020, 1, 2), dt.date(2021, 1, 2)), ("B", "", "ETF", "USD", dt.date(2020, 1, 2), None)]
    for bad in ("exchange,ticker,assetType,priceCurrency,startDate,endDate\nx,a,Stock,USD,2020-01-02,\n", head, head + ",x,Stock,USD,2020-01-02,\n", head + "a,x,Stock,USD,2020-13-02,\n", head + "a,x,Stock,USD,2020-02-02,2020-01-01\n", head + "a,x,Stock\n"):
        with pytest.raises(Exception):  # noqa: B017
            read(bad)


def test_facts_of_filings_in_the_bulk_schema(spark):
    bulk = spark.createDataFrame([("a", 1, dt.date(2024, 1, 1), 2.0)], "adsh string, tag int, ddate date, value double")
    filed = spark.createDataFrame([("a", "7", "20240301", "9"), ("b", "8", "20240302", "x"), ("c", "9", "bad", "1.5")], "acc string, t string, d string, v string")
    edge = readers.to_raw_facts(filed, {"adsh": "acc", "tag": "t", "ddate": "d", "value": "v"}, bulk.schema)
    assert edge.schema.simpleString() == bulk.schema.simpleString()
    assert {tuple(r) for r in readers.union_of_sources(bulk, edge, ["adsh"]).collect()} == {("a", 1, dt.date(2024, 1, 1), 2.0, "bulk"), ("b", 8, dt.date(2024, 3, 2), None, "edge"), ("c", 9, None, 1.5, "edge")}


def test_prices_are_one_verified_snapshot_and_exports_never_go_back(spark, tmp_path):
    day = lambda n: dt.date(2024, 1, n)
    frames = lambda n: {
        "raw": spark.createDataFrame([(i, day(n), 10.0 * i) for i in range(4)], "id int, day date, close double"),
        "adjusted": spark.createDataFrame([(i, day(n), 5.0 * i, "split") for i in range(4)], "id int, day date, close double, basis string"),
        "issues": spark.createDataFrame([(9, day(n), "no binding")], "id int, day date, kind string"),
    }
    keys = {"raw": ["id", "day"], "adjusted": ["id", "day"], "issues": ["id"]}
    path = sinks.export_state(frames(2), str(tmp_path), [("n", "2")], keys, {"raw": ["day"]})
    opened = sinks.open_snapshot(spark, path)
    assert {n: t.count() for n, t in opened.items()} == {"raw": 4, "adjusted": 4, "issues": 1} and opened["adjusted"].columns == ["id", "day", "close", "basis"]
    later = sinks.export_state(frames(3), str(tmp_path), [("n", "3")], keys, {"raw": ["day"]}, path)
    with pytest.raises(ValueError, match="older"):
        sinks.export_state(frames(1), str(tmp_path), [("n", "1")], keys, {"raw": ["day"]}, later)
    frames(1)["issues"].write.mode("overwrite").parquet(f"{path}/issues")
    with pytest.raises(ValueError, match="issues"):
        sinks.open_snapshot(spark, path)


def test_wanted_files_only(spark, tmp_path):
    for i in (1, 2, 3):
        (tmp_path / f"CIK{i:04d}.json").write_text('{"i": %d}' % i)
    got = readers.wanted_files(spark, str(tmp_path), spark.createDataFrame([(2,), (3,), (9,)], "cik long"), r"CIK(\d+)\.json", "cik").collect()
    assert {(r["cik"], r["value"]) for r in got} == {(2, '{"i": 2}'), (3, '{"i": 3}')}


def test_expanding_median_equals_sorting(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]), DAY + dt.timedelta(days=i), rng.choice([None, float("nan"), *(float(rng.randrange(9)) for _ in range(8))]), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, d date, v double, m string")
    got = {r["d"]: r["m"] for r in series.expanding_median(df, ["k"], "d", "v", "m").collect()}  # a column of that name is replaced
    for n, (k, d, _, _) in enumerate(rows):
        past = sorted(x[2] for x in rows[:n] if x[0] == k and x[2] is not None and x[2] == x[2])
        assert got[d] == (statistics.median(past) if past else None)
    assert series.expanding_median(df.limit(0), ["k"], "d", "v", "m").count() == 0


def test_expanding_median_of_a_long_key(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.xxhash64("id") % 1000003).cast("double").alias("v"))
    began = time.time()
    got = series.expanding_median(df, ["k"], "t", "v", "m").where(F.col("t").isin(1, 77_777, n - 1)).collect()
    assert time.time() - began < 30
    values = [r["v"] for r in df.orderBy("t").collect()]
    assert {r["t"]: r["m"] for r in got} == {t: statistics.median(values[:t]) for t in (1, 77_777, n - 1)}


@pytest.mark.parametrize(("at_split", "found"), [((50.0, 100.0), True), ((100.0, 100.0), False), ((50.0, 50.0), False), ((50.0, 70.0), False)])
def test_split_needs_a_flat_adjusted_series(spark, at_split, found):
    raw, adjusted = at_split
    rows = [(1, DAY + dt.timedelta(days=i), 100.0 if i < 10 else raw, 100.0 if i < 10 else adjusted, 40.0 if i == 10 else 10.0) for i in range(20)]
    c = prices.split_candidates(spark.createDataFrame(rows, "k int, d date, raw double, adj double, vol double"), ["k"], "d", "raw", "adj", "vol", flat=0.25).collect()
    assert [r["ratio"] for r in c] == ([2.0] if found else [])


def test_splits(spark):
    a = spark.createDataFrame([(1, dt.date(2024, 6, 10), dt.date(2024, 6, 1), 10.0, True)], "k int, e date, known date, ratio double, ok boolean")
    p = spark.createDataFrame([(1, dt.date(2024, 6, 7)), (1, dt.date(2024, 6, 10))], "k int, d date")
    at = F.lit(dt.date(2024, 6, 30))
    got = {r["d"].day: r["factor"] for r in prices.anchored_factors(p, a, ["k"], "d", "e", "known", "ratio", "ok", at, at).collect()}
    assert got == {7: pytest.approx(10.0), 10: pytest.approx(1.0)}
    early = F.lit(dt.date(2024, 5, 1))
    assert {r["factor"] for r in prices.anchored_factors(p, a, ["k"], "d", "e", "known", "ratio", "ok", at, early).collect()} == {1.0}
    bars = [(1, DAY + dt.timedelta(days=i), 100.0 if i < 10 else 50.0, 50.0, 10.0 if i != 10 else 40.0) for i in range(20)]
    c = prices.split_candidates(spark.createDataFrame(bars, "k int, d date, raw double, adj double, vol double"), ["k"], "d", "raw", "adj", "vol").collect()
    assert [(r["d"], r["ratio"]) for r in c] == [(DAY + dt.timedelta(days=10), 2.0)]


def test_views_ignore_order_copies_and_the_future(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), dt.date(2024, 1, 1 + rng.randrange(20)), rng.randrange(3), i) for i in range(200)]
    kind = "k int, t date, v int, id int"
    view = lambda r: sorted(map(tuple, history.pit_views(history.visible(spark.createDataFrame(r, kind), "t", F.lit(dt.date(2024, 1, 10))), ["k"], "t", "v", ["id"])[0].collect()))
    base = view(rows)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert view(shuffled) == base
    assert view(rows + rows) == base
    assert view([*rows, *((k, dt.date(2024, 2, 1), 9, 999) for k in range(20))]) == base


def test_bootstrap_keeps_the_law(spark):
    rows = [(1, i, float(i % 10)) for i in range(200)]
    got = [r["mean"] for r in risk.bootstrap_means(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], "i", "v", 100, 5, 1).collect()]
    assert len(got) == 100 and sum(got) / 100 == pytest.approx(4.5, abs=0.1) and 0.01 < max(got) - min(got) < 4


def test_schema_drift_and_gates_fail(spark, tmp_path):
    (tmp_path / "num.tsv").write_text('a\tb\n1\t"two\nlines"\n')
    assert readers.read_tab_separated(spark, str(tmp_path / "num.tsv"), ["a", "b"]).collect()[0]["b"] == "two\nlines"
    with pytest.raises(ValueError, match="missing"):
        readers.read_tab_separated(spark, str(tmp_path / "num.tsv"), ["a", "c"])
    df = spark.range(10)
    assert audit.enforce(df, [("rows", F.count("*"), 10)]).count() == 10
    with pytest.raises(Exception, match="gate failed: rows"):
        audit.enforce(df, [("rows", F.count("*"), 11)]).collect()


def test_snapshots_are_written_once_and_verified(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    path, fresh = sinks.write_snapshot({"t": df}, str(tmp_path), [("a", "1"), ("b", "2")], {"t": ["id"]})
    again, second = sinks.write_snapshot({"t": df}, str(tmp_path), [("b", "2"), ("a", "1")], {"t": ["id"]})
    assert (path, fresh, second) == (again, True, False)
    assert sinks.verify_snapshot(spark, path).count() == 0
    spark.range(99).withColumn("v", F.col("id")).write.mode("overwrite").parquet(f"{path}/t")
    assert sinks.verify_snapshot(spark, path).count() == 1
    with pytest.raises(ValueError, match="older"):
        sinks.guard_regression(df, df.where("id < 50"), ["id"])


def test_xml_and_bars(spark):
    docs = spark.createDataFrame([(1, '<x><a contextRef="c1" unitRef="u">5</a><b>no</b></x>'), (2, "broken")], "id int, body string")
    assert [tuple(r) for r in readers.xml_facts(docs, "id", "body").collect()] == [(1, "a", "c1", "u", None, "5")]
    pages = spark.createDataFrame([('{"A":[{"t":"2024-01-02T00:00:00Z","o":1,"h":2,"l":1,"c":2,"v":5},{"t":"2024-01-03T00:00:00Z","o":1,"h":0.5,"l":1,"c":2,"v":5}]}',)], "j string")
    good, bad = readers.bar_pages(pages, "j")
    assert (good.count(), bad.count()) == (1, 1)


def test_stems_texts_and_negations(spark):
    from chronoframe.functions import scalars as sc

    names = [("The Ácme Holdings, Inc.", "acme"), ("Acme Corp class A", "acme"), ("Theatre Co", "theatre"), ("", "")]
    df = spark.createDataFrame(names, "n string, w string")
    assert all(r["s"] == r["w"] for r in df.withColumn("s", sc.name_stem(F.col("n"))).collect())
    html = "<html><style>p{}</style><p>One &amp; <b>two</b></p>\n\n<script>x</script><div> three </div></html>"
    got = spark.createDataFrame([(html,)], "h string").select(sc.document_text(F.col("h"), 100).alias("t")).first()["t"]
    assert got == "One &amp; two\nthree"
    rows = [("there is no going concern here", False), ("a going concern. " + "x" * 400 + " no", True), ("no going concern " + "x" * 700 + " going concern", True), ("fine", False), (None, None)]
    f = sc.phrase_without_negation(F.col("t"), "going concern", r"\bno\b")
    assert [r["v"] for r in spark.createDataFrame(rows, "t string, w boolean").select(f.alias("v")).collect()][:4] == [w for _, w in rows][:4]


def test_correlated_pairs_lose_the_weaker(spark):
    from chronoframe.operators import screening

    chosen = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 3.0)], "e int, s double")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.1), (1, 3, 0.2)], "a int, b int, corr double")
    got = {r["e"]: r["dropped"] for r in screening.replace_correlated(chosen, pairs, "s", "e", 0.8).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_safe_scan_refuses_other_views(spark):
    df = readers.tag_view(spark.createDataFrame([(1, DAY)], "k int, t date"), "latest")
    with pytest.raises(ValueError, match="point-in-time"):
        readers.read_pit_as_of(df, F.lit(DAY), "t", ["k"])
    with pytest.raises(ValueError, match="unknown"):
        readers.read_pit_as_of(readers.tag_view(df, "pit"), F.lit(DAY), "t", ["z"])


def test_sessions_after_keeps_every_order(spark, sf):
    from chronoframe.plans.catalogue import QUERIES

    got = [r["o_orderkey"] for r in QUERIES["h12_all_sessions_after"](spark, sf).collect()]
    assert sorted(got) == sorted(r["o_orderkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect())


def test_identity_components_of_all_links_equal_union_find(spark, tmp_path):
    from chronoframe.plans.catalogue import QUERIES

    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(40), rng.randrange(1, 51), rng.randrange(1, 8)) for _ in range(45)]
    spark.createDataFrame(links, "l_partkey long, l_suppkey long, l_quantity long, l_linenumber long").write.parquet(str(tmp_path / "lineitem.parquet"))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for p, s, *_ in links:
        a, b = find(p), find(-1 - s)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in QUERIES["c12_all_identity_components"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in parent} and 1 < len(set(got.values())) < len(got)


def test_complete_window_median_covers_every_security(spark, sf):
    from chronoframe.plans.catalogue import QUERIES

    sf = sf.replace("sf0.001", "sf0.01")
    want = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_shipdate < '1996-12-31'").select("l_suppkey").distinct().count()
    assert QUERIES["d8_all_complete_window_median"](spark, sf).count() == want


def test_correlated_picks_are_replaced_as_in_a_loop(spark):
    rng = random.Random(6)
    rows = [(p, e, rng.randrange(5), float(rng.randrange(90)), rng.random() < 0.1, rng.random() < 0.7) for p in range(5) for e in range(40)]
    pairs = [(a, b, rng.random()) for b in range(40) for a in range(b)]
    kind = "p int, e int, sector int, score double, held boolean, stays boolean"
    df = spark.createDataFrame(rows, kind)
    acted = df.join(selection.select_constrained(df, ["p"], "score", "e", "sector", 8, 2), ["p", "e"])
    out = selection.replace_correlated_picks(acted, spark.createDataFrame(pairs, "a int, b int, corr double"), ["p"], "score", "e", "sector", 2, 0.8)
    got = {(r["p"], r["e"]): (r["action"], r["replaces"]) for r in out.collect()}
    high = {frozenset((a, b)) for a, b, c in pairs if c > 0.8}
    action, want = {(r["p"], r["e"]): r["action"] for r in acted.collect()}, {}
    for p in range(5):
        own = {x[1]: x for x in rows if x[0] == p}
        order = sorted(own, key=lambda e: (action[p, e] != "hold", -own[e][3], e))
        picks = [e for e in order if action[p, e] in ("hold", "enter")]
        rest = [e for e in order if action[p, e] in ("no_slot", "sector_cap")]
        want |= {(p, e): ("keep", None) for e in picks}
        moved = True
        while moved:
            moved = False
            for a, b in [(a, b) for i, a in enumerate(picks) for b in picks[i + 1 :] if frozenset((a, b)) in high]:
                weak = sorted((a, b), key=lambda e: (own[e][3], -e))[0]
                stay = [e for e in picks if e != weak]
                fit = [c for c in rest if [own[e][2] for e in stay].count(own[c][2]) < 2 and not any(frozenset((c, e)) in high for e in stay)]
                if fit:
                    want[p, weak], want[p, fit[0]] = ("drop", want[p, weak][1]), ("replace", weak)
                    picks[picks.index(weak)] = fit[0]
                    rest.remove(fit[0])
                    moved = True
                    break
    assert got == want and any(a == "replace" for a, _ in got.values())


def test_document_text_query_keeps_whole_pages(spark, tmp_path):
    from chronoframe.plans.catalogue import QUERIES

    spark.createDataFrame([(1, "<p>" + "word " * 9000 + "end</p>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    text = QUERIES["a22_document_text"](spark, str(tmp_path)).first()["text"]
    assert len(text) == 45003 and text.endswith("end")


@pytest.mark.parametrize("strict", [False, True])
def test_bucketed_asof_equals_the_plain_one_on_a_hot_key(spark, strict):
    rng = random.Random(21)
    day = lambda: rng.choice([None, *[dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(900)) for _ in range(12)]])
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice([*"abcdefgh", None])
    left = spark.createDataFrame([(key(), day(), i) for i in range(1500)], "k string, t date, id int")
    right = spark.createDataFrame([(key(), day(), rng.choice([None, rng.randrange(50)])) for _ in range(1200)], "k string, rt date, v int").coalesce(1)
    for join in (asof.asof_backward, asof.asof_forward):
        rows = lambda b: sorted(map(str, join(left, right, ["k"], "t", "rt", strict=strict, buckets=b).select("id", "k", "t", "match").collect()))  # noqa: B023, E731
        assert rows(64) == rows(0) and len(rows(0)) == 1500
    for join in (asof.asof_tolerant, asof.asof_either):
        rows = lambda b: sorted(map(str, join(left, right, ["k"], "t", "rt", 3, buckets=b).select("id", "match").collect()))  # noqa: B023, E731
        assert rows(40) == rows(0)
    both = left.select("k", F.col("t").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("struct<v:int>").alias("_right"), F.struct("*").alias("_left"))
    most = asof._carried(both, ["k"], False, 64).where("_t IS NOT NULL").groupBy("k", "_bucket").count().agg(F.max("count")).first()[0]
    assert most < 1500 / 20


def test_dyadic_join_and_overlaps_equal_all_pairs(spark):
    rng = random.Random(22)
    first = dt.date(2019, 12, 1)
    day = lambda n: first + dt.timedelta(days=n)
    rows = []
    for i in range(260):
        s = rng.randrange(400)
        rows.append((rng.choice("xy"), i, rng.choice(["p", "q", None]), day(s), rng.choice([None, day(s - 3), day(s), day(s + 1), day(s + rng.randrange(90))])))
    rows += [("x", 900, "p", None, day(4)), ("x", 901, "p", day(3), None), ("x", 902, "q", day(3), None)]
    df = spark.createDataFrame(rows, "k string, id int, what string, s date, e date")
    points = spark.createDataFrame([(rng.choice("xyz"), j, rng.choice([None, day(rng.randrange(-20, 500))])) for j in range(300)], "k string, j int, at date")
    got = sorted((r["j"], r["id"]) for r in intervals.dyadic_join(points, df, ["k"], "at", "s", "e").collect())
    want = sorted((p["j"], r[1]) for p in points.collect() for r in rows if p["k"] == r[0] and p["at"] and r[3] and r[3] <= p["at"] and (r[4] is None or p["at"] < r[4]))
    assert got == want
    far = dt.date(9999, 12, 31)
    pairs = sorted((r["left_id"], r["right_id"], str(r["overlap_from"]), str(r["overlap_to"])) for r in intervals.overlaps(df, ["k"], "s", "e", "id", "what").collect())
    plain = []
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[2] and b[2] and a[2] != b[2] and a[3] and b[3] and a[3] < (b[4] or far) and b[3] < (a[4] or far):
                until = min(a[4] or far, b[4] or far)
                plain.append((a[1], b[1], str(max(a[3], b[3])), str(until if until < far else None)))
    assert pairs == sorted(plain)


def test_many_intervals_of_one_key_make_few_rows(spark):
    df = spark.range(100_000).select(F.lit(1).alias("k"), "id", F.col("id").cast("string").alias("what"), F.date_add(F.lit("1700-01-01").cast("date"), (F.col("id") * 2).cast("int")).alias("s"))
    df = df.withColumn("e", F.date_add("s", F.when(F.col("id") % 1000 == 0, 3).otherwise(2)))
    assert intervals.overlaps(df, ["k"], "s", "e", "id", "what").count() == 100


def test_names_are_folded_by_the_rule_of_unicode(spark):
    import unicodedata

    from chronoframe.functions import scalars as sc

    def plain(name):
        folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", name).casefold())
        return "".join(c for c in folded if c.isalnum())

    names = ["Straße AG", "STRASSE ag", "Łódź SA", "Škoda Auto", "ﬁnance", "İstanbul Ğ ı", "Žižkov Ⅳ", "ＡＢＣ１２", "Ærø Öl", "Ελλάς", "Кириллица Й", "naïve—co", "", "étude", "ŉ ǆ ½"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["p"] for r in df.select(sc.normalize_name(F.col("n")).alias("p")).collect()]
    assert got == [plain(n) for n in names] and got[0] == got[1] == "strasseag" and got[3] == "skodaauto" and got[4] == "finance"
    stems = df.sparkSession.createDataFrame([("The Škoda Holding Group",), ("Nestlé SA",)], "n string").select(sc.name_stem(F.col("n")).alias("p")).collect()
    assert [r["p"] for r in stems] == ["skoda", "nestlesa"]


def test_nav_audit_sees_rows_that_arrive_out_of_order(spark):
    rows = [("a", 1, 5, 1.0, 1.0, 0.0), ("a", 2, 3, 1.0, 0.0, 1.0), ("a", 3, 4, 1.0, 0.0, 2.0), ("b", 1, 1, 1.0, 1.0, 0.0), ("b", 2, 1, 1.0, 1.0, 0.0), ("b", 3, 2, 1.0, 1.0, 0.0)]
    got = audit.nav_audit(spark.createDataFrame(rows, "k string, n int, t int, nav double, cash double, held double"), ["k"], "n", "t", "nav", "cash", "held", 0.01).collect()
    assert sorted(tuple(r) for r in got) == [("a", 3, 1, 1), ("b", 3, 0, 1)]


def test_rows_without_a_sector_are_not_capped(spark):
    df = spark.createDataFrame([(1, i, None, float(-i), False, False) for i in range(5)], "p int, e int, sector int, score double, held boolean, stays boolean")
    one = selection.select_constrained(df, ["p"], "score", "e", "sector", 4, 2).where("action = 'enter'").count()
    assert one == selection.choose_under_caps(df, ["p"], "score", "e", 4, {"sector": 2}, {}).where("action = 'enter'").count() == 4


def test_identities_by_overlap_equal_plain(spark):
    rng = random.Random(31)
    rows = []
    for _ in range(220):
        s = rng.randrange(60)
        rows.append((rng.choice([*range(12), None]), rng.choice([*range(80), None]), rng.choice([None, DAY + dt.timedelta(days=s)]) if rng.random() < 0.1 else DAY + dt.timedelta(days=s), rng.choice([None, DAY + dt.timedelta(days=s), *[DAY + dt.timedelta(days=s + rng.randrange(1, 4)) for _ in range(12)]])))
    rows += [(50, 100, DAY, DAY + dt.timedelta(days=50)), (50, 101, DAY + dt.timedelta(days=1), DAY + dt.timedelta(days=2)), (50, 102, DAY + dt.timedelta(days=30), DAY + dt.timedelta(days=31))]  # two nested in one
    rows += [(51, 110, DAY, DAY + dt.timedelta(days=2)), (51, 111, DAY + dt.timedelta(days=1), DAY + dt.timedelta(days=3)), (51, 112, DAY + dt.timedelta(days=2), None), (52, 120, DAY, DAY + dt.timedelta(days=1)), (52, 121, DAY + dt.timedelta(days=1), None)]  # a chain; neighbours that do not overlap
    kinds = [(e, rng.choice(["s", "s", "s", "s", "f", None])) for e in range(80)] + [(100, "s"), (101, "f"), (110, "s"), (112, "s")]
    bindings = spark.createDataFrame(rows, "k int, e long, f date, t date")
    found = identity.overlap_identities(bindings, ["k"], "e", "f", "t", spark.createDataFrame(kinds, "e long, kind string"), "kind")
    got = {r["e"]: (r["canonical"], r["refused"]) for r in found.collect()}
    parent = {r[1]: r[1] for r in rows if r[1] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    whole = [r for r in rows if None not in r[:3] and (r[3] is None or r[3] > r[2])]
    for a in whole:
        for b in whole:
            if a[0] == b[0] and a[2] < (b[3] or dt.date.max) and b[2] < (a[3] or dt.date.max):
                u, v = sorted((root(a[1]), root(b[1])))
                parent[v] = u
    seen = {}
    for e, kind in kinds:
        if kind and e in parent:
            seen.setdefault(root(e), set()).add(kind)
    want = {e: (e, True) if len(seen.get(root(e), ())) > 1 else (root(e), False) for e in parent}
    assert got == want and got[101] == (101, True) and got[112] == (110, False) and got[121] == (121, False)
    moved = identity.remapped(spark.createDataFrame([(112, 1), (101, 2), (999, 3)], "e long, v int"), found, "e").collect()
    assert sorted(tuple(r) for r in moved) == [(101, 2, True), (110, 1, False), (999, 3, False)]
    edges = identity.overlap_edges(bindings, ["k"], "e", "f", "t")
    assert edges.count() < len(whole)


def test_overlapping_runs_are_stars_in_small_tasks(spark, monkeypatch):
    rows = [(k, 1000 * k + i, DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=i + 2)) for k in range(4) for i in range(30)]  # each reaches the next alone
    bindings = spark.createDataFrame(rows, "k int, e long, f date, t date")
    monkeypatch.setattr(skew, "TASK_ROWS", 20)
    edges = identity.overlap_edges(bindings, ["k"], "e", "f", "t")
    assert edges.rdd.getNumPartitions() == 6
    assert sorted(tuple(r) for r in edges.collect()) == [(1000 * k + i, 1000 * k) for k in range(4) for i in range(1, 30)]
    moved = identity.remapped(bindings.select("e"), spark.createDataFrame([(1, 0, False)], "e long, canonical long, refused boolean"), "e")
    assert moved.rdd.getNumPartitions() == 6 and moved.where("e = 0").count() == 2


def test_classes_of_one_entity_may_repeat_and_contradict(spark):
    bindings = spark.createDataFrame([(1, 5, DAY, DAY + dt.timedelta(days=1)), (2, 6, DAY, None), (3, 7, DAY, None), (3, 8, DAY, None)], "k int, e long, f date, t date")
    classes = spark.createDataFrame([(5, "s"), (5, "f"), (6, "s"), (6, "s"), (7, "s"), (7, "s"), (9, "s")], "e long, kind string")
    got = identity.overlap_identities(bindings, ["k"], "e", "f", "t", classes, "kind").collect()
    assert sorted(tuple(r) for r in got) == [(5, 5, True), (6, 6, False), (7, 7, False), (8, 7, False)]
