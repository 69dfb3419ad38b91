"""Stateful behaviours as Structured Streaming queries; each has a batch twin with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _watermarked(stream: DataFrame, time: str, lateness: str) -> DataFrame:
    """With a watermark; a time without a zone is read in the session's."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, lateness)


def new_filings(stream: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """Rows whose key was not seen within the watermark; in a batch, the same without a watermark."""
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    return _watermarked(stream, time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, key: Sequence[str], value: str, length: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; late rows within the watermark are counted."""
    rows = _watermarked(stream, time, lateness) if lateness else stream
    return rows.groupBy(F.window(time, length, slide), *key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time: str, key: Sequence[str], gap: str, lateness: str | None = None) -> DataFrame:
    rows = _watermarked(stream, time, lateness) if lateness else stream
    return rows.groupBy(F.session_window(time, gap), *key).agg(F.count("*").alias("n"))


def first_and_latest(spark: SparkSession, stream: DataFrame, key: Sequence[str], time: str, ties: Sequence[str], root: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps a first-known and a latest table under ``root``.

    A late revision may change the latest table; it changes the first one only if it was known earlier.
    Each batch writes new versions from the ones before, so a batch that is run again gives the same.
    """
    from ..operators.history import keep_first, keep_last

    def update(batch: DataFrame, number: int) -> None:
        for name, keep in (("first", keep_first), ("latest", keep_last)):
            before = spark.read.parquet(f"{root}/{name}/v={number - 1}").select(batch.columns) if number > 0 else batch.limit(0)
            keep(before.unionByName(batch), key, time, ties).write.mode("overwrite").parquet(f"{root}/{name}/v={number}")

    return update


def running_high(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``(key, high, rows)`` kept as state: the highest value so far of each key (a trailing high-water mark).

    Of a table rather than a stream it is one aggregation.
    """
    if not stream.isStreaming:
        return stream.groupBy(key).agg(F.max(F.col(value).cast("double")).alias("high"), F.count("*").alias("rows"))
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, high double, rows long"

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, rows = state.get if state.exists else (float("-inf"), 0)
        for b in batches:
            high, rows = max(high, float(b[value].max())), rows + len(b)
        state.update((high, rows))
        yield pd.DataFrame({key: [name[0]], "high": [high], "rows": [rows]})

    return stream.groupBy(key).applyInPandasWithState(update, schema, "high double, rows long", "update", GroupStateTimeout.NoTimeout)


def alert_once(stream: DataFrame, key: Sequence[str], time: str, condition, lateness: str) -> DataFrame:
    """The rows of the first alert of each key and kind within the watermark; later ones are silent."""
    hit = stream.where(condition)
    if not hit.isStreaming:
        from ..operators.history import keep_first

        return keep_first(hit, key, time)
    return _watermarked(hit, time, lateness).dropDuplicatesWithinWatermark(list(key))


def live_quotes(stream: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """Quotes of the current universe: a stream-static semi join."""
    return stream.join(universe.select(key).distinct(), key, "left_semi")


def step_state(stream: DataFrame, key: str, time: str, raw: str, confirm: int = 3, cooldown_days: int = 10) -> DataFrame:
    """The state machine of ``operators.series.state_machine`` with its state kept between batches; rows of a batch go in time's order."""
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, state int"

    def update(name: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, run, side, moved = held.get if held.exists else (0, 0, 0, None)
        rows = pd.concat(list(batches)).sort_values(time)
        for day, level in zip(pd.to_datetime(rows[time]), rows[raw], strict=True):
            now = (level > state) - (level < state)
            run = 0 if now == 0 else run + 1 if now == side else 1
            side = now
            if now and run >= confirm and (moved is None or (day.toordinal() - moved) >= cooldown_days):
                state, run, side, moved = state + now, 0, 0, day.toordinal()
        held.update((int(state), int(run), int(side), moved))
        yield pd.DataFrame({key: [name[0]], "state": [int(state)]})

    return stream.groupBy(key).applyInPandasWithState(update, schema, "state int, run int, side int, moved long", "update", GroupStateTimeout.NoTimeout)


def freshness(df: DataFrame, key: Sequence[str], time: str, at, limit_days: int) -> DataFrame:
    """``(key, last, age_days, stale)`` of each feed; what was never seen is not in it."""
    last = df.groupBy(*key).agg(F.to_date(F.max(time)).alias("last"))
    return last.withColumn("age_days", F.datediff(at, "last")).withColumn("stale", F.col("age_days") > limit_days)


def silent_feeds(stream: DataFrame, feeds: DataFrame, key: str, time: str, cadence: str, lateness_ms: int = 0, clock: str = "event") -> DataFrame:
    """``(key, last, due)``: one row for each silence of a feed, which is longer than its ``cadence`` (milliseconds, of ``feeds``, one row a feed).

    By the ``event`` clock a silence after ``last`` is told once the watermark (the newest time of any feed less
    ``lateness_ms``) is past ``due``, so a feed that stops is told because others go on; rows of a replay come to
    the same silences in whatever batches they arrive, late ones within ``lateness_ms`` included, and a table gives them in one pass.
    By the ``processing`` clock (streams only) it is told when nothing has come for the cadence, even if no feed sends anything.
    Times count in whole milliseconds, downward. State is two numbers a feed and the times that the watermark has not passed. Feeds that ``feeds`` lacks are not watched; one that never sent is a row of :func:`overdue`.
    """
    rows = stream.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    watched = feeds.select(key, F.col(cadence).cast("long").alias("_cadence")).where("_cadence IS NOT NULL")
    if not stream.isStreaming:
        if clock != "event":
            raise ValueError("a table has no processing clock")
        end = rows.agg((F.unix_millis(F.max(time)) - lateness_ms).alias("_end"))  # one row
        seen = rows.join(watched, key).select(key, F.unix_millis(time).alias("_t"), "_cadence").distinct()
        gap = seen.withColumn("_next", F.lead("_t").over(Window.partitionBy(key).orderBy("_t"))).withColumn("_due", F.col("_t") + F.col("_cadence"))
        told = gap.crossJoin(F.broadcast(end)).where("(_next IS NULL OR _next > _due) AND _due + 1 < _end")
        return told.select(key, F.timestamp_millis("_t").alias("last"), F.timestamp_millis("_due").alias("due"))
    by_event = clock == "event"
    timer = GroupStateTimeout.EventTimeTimeout if by_event else GroupStateTimeout.ProcessingTimeTimeout
    if by_event:
        rows = rows.withWatermark(time, f"{lateness_ms} milliseconds")
    rows = rows.join(watched, key).select(key, time, F.unix_millis(time).alias("_t"), "_cadence")

    def told(name: tuple, lasts: list[int], length: int) -> pd.DataFrame:
        return pd.DataFrame({key: [name[0]] * len(lasts), "_last": lasts, "_due": [x + length for x in lasts]})

    def by_watermark(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, silent, length, ahead = state.get if state.exists else (None, False, 0, [])
        times, mark, out = set(ahead or []), state.getCurrentWatermarkMs(), []
        for b in () if state.hasTimedOut else batches:
            if len(b):
                times.update(b["_t"].tolist())
                length = int(b["_cadence"].iloc[0])
        for t in sorted(x for x in times if x <= mark and (last is None or x > last)):
            if last is not None and t > last + length and not silent:
                out.append(last)
            last, silent = t, False
        ahead = sorted(x for x in times if x > mark)
        if last is not None and not silent and last + length + 1 < mark:
            out.append(last)
            silent = True
        state.update((last, silent, length, ahead))
        wake = [*ahead[:1], *([last + length + 1] if last is not None and not silent else [])]
        if wake:
            state.setTimeoutTimestamp(max(min(wake), mark + 1))
        yield told(name, out, length)

    def by_arrival(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, silent, length, _ = state.get if state.exists else (None, False, 0, [])
        if state.hasTimedOut:
            state.update((last, True, length, []))
            yield told(name, [last], length)
            return
        for b in batches:
            if len(b):
                last, length = max(int(b["_t"].max()), last if last is not None else 0), int(b["_cadence"].iloc[0])
        state.update((last, False, length, []))
        state.setTimeoutDuration(max(length, 1))
        yield told(name, [], length)

    kind = stream.schema[key].dataType.simpleString()
    out = rows.groupBy(key).applyInPandasWithState(by_watermark if by_event else by_arrival, f"{key} {kind}, _last long, _due long", "last long, silent boolean, length long, ahead array<long>", "append", timer)
    return out.select(key, F.timestamp_millis("_last").alias("last"), F.timestamp_millis("_due").alias("due"))


def overdue(df: DataFrame, feeds: DataFrame, key: str, time: str, cadence: str, at) -> DataFrame:
    """``(key, last, red, red_share)`` of every feed at a time: red if it never sent or not within its cadence (milliseconds); the share is over all feeds."""
    last = df.where(F.col(time) <= at).groupBy(key).agg(F.max(time).cast("timestamp").alias("last"))
    every = feeds.select(key, F.col(cadence).cast("long").alias("_c")).join(last, key, "left")
    red = every.withColumn("red", F.coalesce(F.unix_millis(F.lit(at).cast("timestamp")) - F.unix_millis("last") > F.col("_c"), F.lit(True)))
    share = red.agg(F.avg(F.col("red").cast("int")).alias("red_share"))  # one row
    return red.crossJoin(F.broadcast(share)).select(key, "last", "red", "red_share")


def stale_dates(scores: DataFrame, date: str, version: str, current: str) -> DataFrame:
    """Dates with a row that lacks the current version: they are rebuilt."""
    return scores.groupBy(date).agg(F.bool_and(F.col(version).eqNullSafe(F.lit(current))).alias("_ok")).where(~F.col("_ok")).select(date)
