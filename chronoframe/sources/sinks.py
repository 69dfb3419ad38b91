"""Sorted columnar output, immutable snapshots, upserts, and guarded exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import content_fingerprint, snapshot_id
from ..operators.history import keep_row
from ..storage import materialise, scratch
from ..streaming.twins import stale_dates


def write_sorted(df: DataFrame, path: str, key: Sequence[str], mode: str = "errorifexists") -> None:
    """Parquet, ranges of the key per file, sorted within, zstd."""
    df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode(mode).option("compression", "zstd").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_snapshot(tables: dict[str, DataFrame], root: str, inputs: Sequence[tuple[str, str]], keys: dict[str, Sequence[str]]) -> tuple[str, bool]:
    """All tables under an id made from their inputs, with a manifest; ``(path, fresh)``. The same inputs are written once."""
    spark = next(iter(tables.values())).sparkSession
    path = f"{root}/snapshot_id={snapshot_id(spark, inputs)}"
    if _exists(spark, f"{path}/manifest"):
        return path, False
    rows = None
    for name, df in tables.items():
        write_sorted(df, f"{path}/{name}", keys[name], "overwrite")
        one = content_fingerprint(spark.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("table"), "rows", "content")
        rows = one if rows is None else rows.unionByName(one)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")  # one row a table; written last, it marks a whole snapshot
    return path, True


def verify_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows whose table no longer has the rows and content that it states."""
    manifest = spark.read.parquet(f"{path}/manifest")
    found = None
    for r in manifest.select("table").collect():  # one row a table
        one = content_fingerprint(spark.read.parquet(f"{path}/{r['table']}")).select(F.lit(r["table"]).alias("table"), F.col("rows").alias("rows_now"), F.col("content").alias("content_now"))
        found = one if found is None else found.unionByName(one)
    return manifest.join(found, "table").where("rows <> rows_now OR content <> content_now")


def open_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, verified against its manifest first; one that differs is refused."""
    changed = [r["table"] for r in verify_snapshot(spark, path).select("table").collect()]  # one row a table
    if changed:
        raise ValueError(f"tables differ from the manifest: {sorted(changed)}")
    return {r["table"]: spark.read.parquet(f"{path}/{r['table']}") for r in spark.read.parquet(f"{path}/manifest").select("table").collect()}


def export_state(tables: dict[str, DataFrame], root: str, inputs: Sequence[tuple[str, str]], keys: dict[str, Sequence[str]], dates: dict[str, Sequence[str]], previous: str | None = None) -> str:
    """Several tables of one state written as one snapshot; the path.

    Refused, before anything is written, if a table's ``dates`` are older than those of the ``previous``
    export, which stays as it is.
    """
    spark = next(iter(tables.values())).sparkSession
    if previous is not None:
        before = open_snapshot(spark, previous)
        for name, columns in dates.items():
            if name in before:
                guard_regression(before[name], tables[name], columns)
    return write_snapshot(tables, root, inputs, keys)[0]


def rebuild_stale(spark: SparkSession, path: str, date: str, version: str, current: str, compute: Callable[[DataFrame], DataFrame], wanted: DataFrame | None = None) -> int:
    """Replace the dates of the table at ``path`` (a folder a date) that have a row of another version, or a null one, and add the ``wanted`` dates that it lacks; how many dates.

    ``compute`` turns a table of dates into rows of the current version. They are written to the shared folder
    first and refused, before the table is touched, if a date gets no row, another date gets one, or a
    version differs. Only the folders of those dates are overwritten; files of the others stay as they
    are, and where nothing is stale nothing is written. A run that broke off is run again.
    """
    table = spark.read.parquet(path)
    stale = stale_dates(table, date, version, current)
    if wanted is not None:
        stale = stale.unionByName(wanted.select(date).distinct().join(table.select(date).distinct(), date, "left_anti"))
    with scratch():
        dates = materialise(stale, "stale")
        count = dates.count()
        if not count:
            return 0
        fresh = materialise(compute(dates).select(table.columns), "rebuilt")
        lacking, other = dates.join(fresh, date, "left_anti").count(), fresh.join(dates, date, "left_anti").count()
        wrong = fresh.where(~F.col(version).eqNullSafe(F.lit(current))).count()
        if lacking or other or wrong:
            raise ValueError(f"{lacking} stale dates without rows, {other} rows of other dates, {wrong} rows of another version")
        fresh.repartition(date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)
    return count


def upsert(base: DataFrame, new: DataFrame, key: Sequence[str], update: bool = True) -> DataFrame:
    """``base`` with ``new`` rows: replacing rows of the same key, or only added where the key is new."""
    both = base.withColumn("_p", F.lit(1 if update else 0)).unionByName(new.withColumn("_p", F.lit(0 if update else 1)))
    return keep_row(both, key, [F.col("_p")]).drop("_p")


def guard_regression(old: DataFrame, new: DataFrame, dates: Sequence[str]) -> None:
    """Refuse to replace an export by one whose dates are older."""
    top = lambda d: d.agg(*(F.max(c).alias(c) for c in dates)).first()
    a, b = top(old), top(new)
    stale = [c for c in dates if a[c] is not None and (b[c] is None or b[c] < a[c])]
    if stale:
        raise ValueError(f"older than the export that it would replace: {stale}")


def newest(history: DataFrame, time: str, n: int) -> DataFrame:
    """The newest ``n`` rows of a history (a report)."""
    return history.orderBy(F.desc(time)).limit(n)
