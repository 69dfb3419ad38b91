"""A stream replayed in small batches ends where the batch twin does."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import history, series
from chronoframe.sources import sinks
from chronoframe.streaming import twins


@pytest.fixture
def replay(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    path = str(tmp_path / "in")
    for first in (1, 9, 17, 25):  # one file after another, in the order of time
        e.where(F.dayofmonth("ts").between(first, first + 7)).coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(path)
    return e, twins.read_stream(spark, path, e.schema)


def _run(df, tmp_path, name, mode="append", each=None):
    w = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / name))
    q = (w.foreachBatch(each) if each else w.format("memory").queryName(name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return None if each else df.sparkSession.table(name)


def test_first_and_latest(spark, replay, tmp_path):
    e, stream = replay
    root = str(tmp_path / "views")
    update = twins.first_and_latest(spark, stream, ["user_id"], "ts", ["event_id"], root)
    last = []

    def each(batch, number):
        update(batch, number)
        last.append(number)

    _run(stream, tmp_path, "views_q", each=each)
    for name, keep in (("first", history.keep_first), ("latest", history.keep_last)):
        got = spark.read.parquet(f"{root}/{name}/v={max(last)}").select(e.columns)
        assert got.exceptAll(keep(e, ["user_id"], "ts", ["event_id"])).count() == 0
        assert got.count() == e.select("user_id").distinct().count()


def test_running_high(replay, tmp_path):
    e, stream = replay
    out = _run(twins.running_high(stream, "user_id", "ts", "value"), tmp_path, "high", "update")
    got = {r["user_id"]: r["high"] for r in out.groupBy("user_id").agg(F.max("high").alias("high")).collect()}
    assert got == {r["user_id"]: r["high"] for r in e.groupBy("user_id").agg(F.max("value").alias("high")).collect()}


def test_step_state_equals_fold(replay, tmp_path):
    e, stream = replay
    level = lambda d: d.select("user_id", "event_id", F.to_date("ts").alias("t"), F.when(F.col("value") > 60, 2).when(F.col("value") > 30, 1).otherwise(0).alias("raw"))
    one = level(e).groupBy("user_id", "t").agg(F.max("raw").alias("raw"))
    want = {r["user_id"]: r["s"] for r in series.state_machine(one, ["user_id"], "t", "raw", "s").collect()}
    path = str(tmp_path / "days")
    one.repartitionByRange(5, "t").write.parquet(path)
    days = twins.read_stream(one.sparkSession, path, one.schema, files_per_trigger=100)
    out = _run(twins.step_state(days, "user_id", "t", "raw"), tmp_path, "steps", "update")
    assert {r["user_id"]: r["state"] for r in out.collect()} == want


def test_deduplication_and_windows(replay, tmp_path):
    e, stream = replay
    got = _run(twins.new_filings(stream.unionByName(stream), "event_id", "ts", "2 days"), tmp_path, "dedup")
    assert got.count() == e.count()
    w = _run(twins.windowed_counts(stream, "ts", ["event_type"], "value", "1 day"), tmp_path, "wins", "complete")
    want = twins.windowed_counts(e, "ts", ["event_type"], "value", "1 day")
    assert w.select("window", "event_type", "n").exceptAll(want.select("window", "event_type", "n")).count() == 0


def test_silent_feeds_in_a_replay_equal_the_table(spark, tmp_path):
    rng = random.Random(5)
    at, day = dt.datetime(2024, 1, 1), 86_400_000
    rows = [(k, at + dt.timedelta(days=d, minutes=rng.randrange(600))) for k in "abcde" for d in range(40) if rng.random() < 0.5 and not (k == "b" and d > 20)]
    rows = sorted(rows, key=lambda x: x[1]) + [("x", at)]  # x is not watched
    late = [n for n in range(0, len(rows) - 3, 7)]
    for n in late:  # some come after the next, within the lateness
        rows[n], rows[n + 1] = rows[n + 1], rows[n]
    feeds = spark.createDataFrame([("a", day), ("b", 3 * day), ("c", 2 * day), ("d", 10 * day), ("e", 2 * day), ("never", day), ("none", None)], "feed string, cadence long")
    schema, path = "feed string, t timestamp, extra int", str(tmp_path / "feed")
    for n in range(0, len(rows), 9):
        spark.createDataFrame([(*x, 1) for x in rows[n : n + 9]], schema).coalesce(1).write.mode("append").parquet(path)
    whole = spark.createDataFrame([(*x, 1) for x in rows], schema)
    want = {tuple(r) for r in twins.silent_feeds(whole, feeds, "feed", "t", "cadence", 3 * day).collect()}
    out = _run(twins.silent_feeds(twins.read_stream(spark, path, whole.schema), feeds, "feed", "t", "cadence", 3 * day), tmp_path, "silent")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert sum(f == "b" and last.day == max(t for k, t in rows if k == "b").day for f, last, _ in got) == 1  # the feed that stopped, once
    plain, end = set(), max(t for _, t in rows) - dt.timedelta(days=3)
    for feed, days in (("a", 1), ("b", 3), ("c", 2), ("d", 10), ("e", 2)):
        times = sorted({t for k, t in rows if k == feed})
        for t, n in zip(times, [*times[1:], None], strict=True):
            due = t + dt.timedelta(days=days)
            if (n is None or n > due) and due < end:
                plain.add((feed, t, due))
    assert want == plain
    red = {r["feed"]: r["red"] for r in twins.overdue(whole, feeds.where("feed <> 'none'"), "feed", "t", "cadence", F.lit(max(t for _, t in rows))).collect()}
    assert red["never"] and red["b"] and set(red) == {"a", "b", "c", "d", "e", "never"}


def test_silence_by_the_clock_is_told_once(spark, tmp_path):
    path = str(tmp_path / "feed")
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "feed string, t timestamp").coalesce(1).write.parquet(path)
    feeds = spark.createDataFrame([("a", 1500)], "feed string, cadence long")
    stream = twins.silent_feeds(twins.read_stream(spark, path, "feed string, t timestamp"), feeds, "feed", "t", "cadence", clock="processing")
    q = stream.writeStream.format("memory").queryName("clock").outputMode("append").option("checkpointLocation", str(tmp_path / "clock")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("clock").count():
            time.sleep(0.5)
        time.sleep(4)  # more than another cadence
        assert [r["feed"] for r in spark.table("clock").collect()] == ["a"]
    finally:
        q.stop()


def test_rebuild_touches_stale_dates_only(spark, tmp_path):
    path = str(tmp_path / "scores")
    rows = [("d1", "a", "v2", 1.0), ("d2", "a", "v2", 1.0), ("d2", "b", "v1", 2.0), ("d3", "a", "v2", 3.0)]
    kind = "d string, e string, version string, score double"
    spark.createDataFrame(rows, kind).repartition("d").write.partitionBy("d").parquet(path)
    files = lambda d: sorted(p.name for p in (tmp_path / "scores" / f"d={d}").glob("*.parquet"))
    before = {d: files(d) for d in ("d1", "d2", "d3")}
    make = lambda version: lambda dates: dates.select("d", F.lit("a").alias("e"), F.lit(version).alias("version"), F.lit(9.0).alias("score"))
    for bad in (make("v1"), lambda dates: make("v2")(dates).limit(0), lambda dates: make("v2")(dates.withColumn("d", F.lit("d1")))):
        with pytest.raises(ValueError):
            sinks.rebuild_stale(spark, path, "d", "version", "v2", bad)
    assert {d: files(d) for d in before} == before
    wanted = spark.createDataFrame([("d3",), ("d4",)], "d string")
    assert sinks.rebuild_stale(spark, path, "d", "version", "v2", make("v2"), wanted) == 2
    assert files("d1") == before["d1"] and files("d3") == before["d3"] and files("d2") != before["d2"] and files("d4")
    got = {(r["d"], r["e"], r["version"], r["score"]) for r in spark.read.parquet(path).collect()}
    assert got == {("d1", "a", "v2", 1.0), ("d2", "a", "v2", 9.0), ("d3", "a", "v2", 3.0), ("d4", "a", "v2", 9.0)}
    now = {d: files(d) for d in ("d1", "d2", "d3", "d4")}
    assert sinks.rebuild_stale(spark, path, "d", "version", "v2", make("v2")) == 0 and {d: files(d) for d in now} == now
