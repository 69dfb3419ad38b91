"""Recursions over series of any length, with a value for every row: a key's rows are walked in segments, in many tasks.

``operators.series.fold`` holds a key in one row and gives its last value; these operators cut a key that has more than
``rows`` rows at quantiles of its times. What a segment does to any state that enters it is reduced to one small row,
these rows are composed along the key, and each segment is walked from the state that enters it. No task holds more
than a segment. The rows with their segments are written once to the shared folder, as several passes read them. Rows of one time stay together; within one
they go in the order of their values. Rows with a null key or time are left out, as they have no place in a series.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..storage import materialise
from .skew import join_unique

#: Rows of a key beyond which it is cut, and about as many as a segment then has.
SEGMENT_ROWS = 100_000


def with_segments(df: DataFrame, key: Sequence[str], time: str, rows: int = SEGMENT_ROWS, most: int = 1000) -> DataFrame:
    """``df`` with ``_seg``: 0 for all rows of a key of at most ``rows``, else the number of its quantiles at or before the row's time.

    A key has ``most`` segments at most; beyond ``rows * most`` rows its segments grow.
    """
    timed = df.where(F.col(time).isNotNull())
    point = F.unix_micros(F.col(time).cast("timestamp"))
    fine = timed.groupBy(*key).agg(F.count("*").alias("_rows"), F.percentile_approx(point, [i / most for i in range(1, most)], 10 * most).alias("_at"))
    parts = F.least(F.ceil(F.col("_rows") / rows), F.lit(most)).cast("int")
    places = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at("_at", F.greatest(F.floor(i * most / parts).cast("int"), F.lit(1))))
    cuts = fine.select(*key, "_rows", F.when(F.col("_rows") > rows, F.array_distinct(places)).alias("_cuts"))
    cut = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= point)))
    return join_unique(timed, cuts, key, "_rows").select(*df.columns, cut.alias("_seg"))


def _placed(df: DataFrame, key: Sequence[str], time: str, value: str) -> DataFrame:
    """With ``_n``, the place of a row among those of its key whose value is not null, and ``_before``, the last such value before it."""
    part = [*key, "_seg"]
    known = F.when(F.col(value).isNotNull(), F.struct(time, value))
    along = Window.partitionBy(*key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    ends = df.groupBy(*part).agg(F.count(value).alias("_k"), F.max(known)[value].alias("_last"))
    ends = ends.select(*part, F.coalesce(F.sum("_k").over(along), F.lit(0)).alias("_offset"), F.last("_last", ignorenulls=True).over(along).alias("_carried"))
    w = Window.partitionBy(*part).orderBy(time, value)
    upto, behind = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(ends, part)
    return out.select(*df.columns, (F.col("_offset") + F.count(value).over(upto)).alias("_n"), F.coalesce(F.last(value, ignorenulls=True).over(behind), F.col("_carried")).alias("_before"))


def _spread(df: DataFrame, part: Sequence[str]) -> DataFrame:
    """By segment, into as many tasks as the session has shuffle partitions: few bytes are much work here, so they are not merged by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *part)


def _starts(chunk: pd.DataFrame, part: Sequence[str]) -> np.ndarray:
    """Places at which a part begins in rows that are sorted by it."""
    new = np.zeros(len(chunk), dtype=bool)
    new[:1] = True
    for c in part:
        own = chunk[c].to_numpy()
        new[1:] |= own[1:] != own[:-1]
    return np.flatnonzero(new)


def _whole_parts(batches: Iterator[pd.DataFrame], part: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Rows that are sorted by ``part``, as frames of many parts none of which is divided; one part at most is held back."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if b.empty:
            continue
        if held and all(held[-1][c].iloc[-1] == b[c].iloc[0] for c in part):
            cut = _starts(b, part)[1:]
            if not len(cut):
                held.append(b)
                continue
            yield pd.concat([*held, b.iloc[: cut[0]]], ignore_index=True)
            b, held = b.iloc[cut[0] :], []
        elif held:
            yield pd.concat(held, ignore_index=True)
        last = _starts(b, part)[-1]
        if last:
            yield b.iloc[:last].reset_index(drop=True)
        held = [b.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def linear_scan(df: DataFrame, key: Sequence[str], time: str, keep: Column, add: Mapping[str, Column], ties: Sequence[str] = ()) -> DataFrame:
    """``df`` (with ``_seg``) and for each name of ``add`` a column ``s = keep * s + add`` in order of time, from 0.

    Two such steps are one of the same form, so a segment is the pair (product of ``keep``, its own sum).
    """
    part, names, order = [*key, "_seg"], list(add), [time, *ties]
    rows = df.select("*", keep.cast("double").alias("_a"), *(add[n].cast("double").alias(f"_b_{n}") for n in names))
    listed = F.array_sort(F.collect_list(F.struct(*order, "_a", *(f"_b_{n}" for n in names))))
    start = F.struct(F.lit(1.0).alias("_a"), *(F.lit(0.0).alias(n) for n in names))

    def compose(s: Column, x: Column) -> Column:
        return F.struct((s["_a"] * x["_a"]).alias("_a"), *((s[n] * x["_a"] + x[f"_b_{n}"]).alias(n) for n in names))

    whole = rows.groupBy(*part).agg(F.aggregate(listed, start, compose).alias("_whole"))
    along = Window.partitionBy(*key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    entering = F.aggregate(F.collect_list("_whole").over(along), F.struct(*(F.lit(0.0).alias(n) for n in names)), lambda s, x: F.struct(*((s[n] * x["_a"] + x[n]).alias(n) for n in names)))
    carried = whole.select(*part, entering.alias("_in")).select(*part, *(F.col(f"_in.{n}").alias(f"_in_{n}") for n in names))
    schema = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)])
    columns = df.columns

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _whole_parts(batches, part):
            starts = _starts(chunk, part)
            bounds, a = [*starts.tolist(), len(chunk)], chunk["_a"].tolist()
            for n in names:
                b, enter, out = chunk[f"_b_{n}"].tolist(), chunk[f"_in_{n}"].to_numpy()[starts].tolist(), []
                for s, first, last in zip(enter, bounds, bounds[1:], strict=False):
                    for i in range(first, last):
                        s = a[i] * s + b[i]
                        out.append(s)
                chunk[n] = out
            yield chunk[[*columns, *names]]

    return _spread(rows.join(carried, part), part).sortWithinPartitions(*part, *order).mapInPandas(walk, schema)


def _smoothing(n: Column, known: Column, period: int, alpha: float) -> tuple[Column, Column]:
    """Factors of the state and of the value: a mean of the first ``period`` values, then steps of ``alpha``; an unknown value changes nothing."""
    early = n <= period
    return F.when(~known | early, 1.0).otherwise(1 - alpha), F.when(~known, 0.0).when(early, 1.0 / period).otherwise(alpha)


def ema_rows(df: DataFrame, value: str, key: Sequence[str], time: str, period: int, out: str = "ema", alpha: float | None = None, rows: int = SEGMENT_ROWS) -> DataFrame:
    """An exponential mean at each row, seeded by the mean of the first ``period`` values and null before.

    ``alpha`` is 2 / (period + 1) if not given; 1 / period is Wilder's smoothing. A null value repeats the mean before it.
    """
    placed = _placed(materialise(with_segments(df, key, time, rows), "segments"), key, time, value)
    keep, weight = _smoothing(F.col("_n"), F.col(value).isNotNull(), period, 2.0 / (period + 1) if alpha is None else alpha)
    done = linear_scan(placed, key, time, keep, {"_s": weight * F.coalesce(value, F.lit(0))}, ["_n"])
    return done.select(*df.columns, F.when(F.col("_n") >= period, F.col("_s")).alias(out))


def rsi_rows(df: DataFrame, close: str, key: Sequence[str], time: str, period: int = 14, out: str = "rsi", rows: int = SEGMENT_ROWS) -> DataFrame:
    """Relative strength at each row by Wilder's smoothing of rises and falls; 100 where nothing fell, null until ``period`` changes are there."""
    placed = _placed(materialise(with_segments(df, key, time, rows), "segments"), key, time, close)
    change = F.col(close) - F.col("_before")
    keep, weight = _smoothing(F.col("_n") - 1, change.isNotNull(), period, 1.0 / period)
    rise, fall = F.coalesce(F.greatest(change, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.greatest(-change, F.lit(0.0)), F.lit(0.0))
    done = linear_scan(placed, key, time, keep, {"_up": weight * rise, "_down": weight * fall}, ["_n"])
    strength = F.when(F.col("_down") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_up") / F.col("_down")))
    return done.select(*df.columns, F.when(F.col("_n") > period, strength).alias(out))


#: Segments and rows that are reduced together.
REDUCED_SEGMENTS, REDUCED_ROWS = 512, 200_000


def _step(x, t, state, run, side, moved, confirm: int, cooldown: int):
    """A row of the machine of ``series.state_machine`` for many states at once, each with its own level and day; an unknown level changes nothing."""
    now = np.sign(x - state)
    known = now == now
    now = np.where(known, now, 0).astype("int64")
    ran = np.where(now == 0, 0, np.where(now == side, np.minimum(run + 1, confirm), 1))
    moves = (now != 0) & (ran >= confirm) & (t - moved >= cooldown)
    return state + np.where(moves, now, 0), np.where(known, np.where(moves, 0, ran), run), np.where(known, np.where(moves, 0, now), side), np.where(moves, t, moved)


def _reduced(levels: list[np.ndarray], days: list[np.ndarray], entering: list[np.ndarray], confirm: int, cooldown: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment the states ``(state, run, side, moved)`` that leave it, and for each state that enters, which of them is its own.

    Segments are walked side by side, each with all its states; of one segment, those that have met are walked as one.
    """
    longest, width = max(map(len, levels)), len(levels)
    x, t = np.full((width, longest), np.nan), np.zeros((width, longest), dtype="int64")
    for i, (own, day) in enumerate(zip(levels, days, strict=True)):
        x[i, : len(own)], t[i, : len(own)] = own, day
    seg = np.repeat(np.arange(width), [len(e) for e in entering])
    every = np.concatenate(entering)
    now, lane = (every[:, 0], every[:, 1], every[:, 2], t[seg, 0] - every[:, 3]), np.arange(len(every))
    latest = t[:, 0].copy()
    for i in range(longest):
        now = _step(x[seg, i], t[seg, i], *now, confirm, cooldown)
        latest = np.maximum(latest, t[:, i])
        if len(seg) > width and (i < 4 or i in (7, 11, 15) or i % 64 == 63 or i == longest - 1):
            rested = np.maximum(now[3], latest[seg] - cooldown)  # how long ago a move was matters only within the cooldown
            whole, back = np.unique(np.stack([seg, *now[:3], rested]), axis=1, return_inverse=True)
            (seg, *now), lane = whole, back.reshape(-1)[lane]
    cut, leaving = np.cumsum([len(e) for e in entering])[:-1], np.stack(now).T
    first = np.searchsorted(seg, np.arange(width + 1))
    return [(leaving[first[i] : first[i + 1]], own - first[i]) for i, own in enumerate(np.split(lane, cut))]


def state_rows(df: DataFrame, key: Sequence[str], time: str, raw: str, out: str, confirm: int = 3, cooldown_days: int = 10, rows: int = SEGMENT_ROWS) -> DataFrame:
    """The state after each row of ``operators.series.state_machine``; ``time`` is a date, and a null level repeats the state before it.

    A segment is the map from every state that can enter it (level, confirmed days, side, days since the last move) to
    the one that leaves it. Most of these meet after a few rows, so the map costs little more than one walk.
    """
    part = [*key, "_seg"]
    cut = materialise(with_segments(df, key, time, rows), "segments")
    reach = cut.groupBy(*part).agg(F.min(raw).alias("_low"), F.max(raw).alias("_high"))
    by_key, along = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("_seg")
    reach = reach.select(*part, F.least(F.min("_low").over(by_key), F.lit(0)).alias("_low"), F.greatest(F.max("_high").over(by_key), F.lit(0)).alias("_high"), F.row_number().over(along).alias("_nth"))
    chunks = cut.join(reach, part)
    columns, kinds = df.columns, {f.name: f for f in cut.schema.fields}

    def lanes(low: int, high: int, nth: int) -> np.ndarray:
        if nth == 1:
            return np.array([[0, 0, 0, cooldown_days]])
        return np.stack(np.meshgrid(np.arange(low, high + 1), np.arange(confirm + 1), np.arange(-1, 2), np.arange(cooldown_days + 1), indexing="ij")).reshape(4, -1).T

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _whole_parts(batches, part):
            starts = _starts(chunk, part)
            bounds, levels, t = [*starts.tolist(), len(chunk)], chunk[raw].to_numpy(dtype="float64", na_value=np.nan), chunk["_day"].to_numpy()
            heads = chunk.iloc[starts].reset_index(drop=True)
            sizes, at = np.diff(bounds), 0
            while at < len(heads):
                end = at + 1
                while end < min(len(heads), at + REDUCED_SEGMENTS) and sizes[at : end + 1].max() * (end + 1 - at) <= REDUCED_ROWS:
                    end += 1
                own, many = [slice(bounds[i], bounds[i + 1]) for i in range(at, end)], heads.iloc[at:end]
                grids = [lanes(*map(int, r)) for r in many[["_low", "_high", "_nth"]].itertuples(index=False)]
                found = _reduced([levels[o] for o in own], [t[o] for o in own], grids, confirm, cooldown_days)
                yield pd.DataFrame({**{c: many[c] for c in part}, "_low": many["_low"], "_nth": many["_nth"], "_first": many["_day"], "_to": [x.reshape(-1) for x, _ in found], "_lane": [x for _, x in found]})
                at = end

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for maps in _whole_parts(batches, key):
            found, now = [], (0, 0, 0, None)
            for low, nth, first, to, lane in zip(maps["_low"], maps["_nth"], maps["_first"], maps["_to"], maps["_lane"], strict=True):
                state, run, side, moved = (0, 0, 0, None) if nth == 1 else now
                age = cooldown_days if moved is None else min(int(first) - moved, cooldown_days)
                found.append([state, run, side, age])
                at = 0 if nth == 1 else (((state - int(low)) * (confirm + 1) + run) * 3 + side + 1) * (cooldown_days + 1) + age  # its place among ``lanes``
                now = tuple(int(v) for v in np.asarray(to).reshape(-1, 4)[int(lane[at])])
            yield pd.DataFrame({**{c: maps[c] for c in part}, "_in": found})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _whole_parts(batches, part):
            starts = _starts(chunk, part)
            bounds, x, t, seen = [*starts.tolist(), len(chunk)], chunk[raw].to_numpy(dtype="float64", na_value=np.nan).tolist(), chunk["_day"].tolist(), []
            for (state, run, side, age), first, last in zip(chunk["_in"].iloc[starts], bounds, bounds[1:], strict=False):
                state, run, side, moved = int(state), int(run), int(side), t[first] - int(age)
                for i in range(first, last):
                    level = x[i]
                    if level == level:  # an unknown level changes nothing
                        now = 0 if level == state else 1 if level > state else -1
                        run = 0 if now == 0 else min(run + 1, confirm) if now == side else 1
                        side = now
                        if now and run >= confirm and t[i] - moved >= cooldown_days:
                            state, run, side, moved = state + now, 0, 0, t[i]
                    seen.append(state)
            chunk[out] = seen
            yield chunk[[*columns, out]]

    heads = [kinds[c] for c in key] + [StructField("_seg", IntegerType())]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in heads)
    dated = chunks.withColumn("_day", F.unix_date(F.col(time).cast("date")))
    lean = _spread(dated, part).sortWithinPartitions(*part, time, raw).select(*part, raw, "_low", "_high", "_nth", "_day")
    maps = lean.mapInPandas(reduced, f"{head}, _low int, _nth int, _first long, _to array<int>, _lane array<int>")
    entering = maps.repartition(*key).sortWithinPartitions(*part).mapInPandas(joined, f"{head}, _in array<int>")
    own = _spread(cut.withColumn("_day", F.unix_date(F.col(time).cast("date"))).join(entering, part), part)
    return own.sortWithinPartitions(*part, time, raw).mapInPandas(walk, StructType([*df.schema.fields, StructField(out, IntegerType())]))
