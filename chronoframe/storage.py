"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a stored table that a task holds before it writes them: each of an executor's tasks has its own.
ROW_GROUP = 16 << 20
#: For each open :func:`scratch` of a thread, the tables made within.
_scratch = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local master may run without that setting; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="chronoframe-"))
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: an executor that is lost later costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if open_now := getattr(_scratch, "open", None):
        open_now[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more; other frames are left alone.

    Spark deletes the shuffles behind a table once the driver's garbage is collected, which this asks for.
    """
    stored = [(t, path) for t in tables if (path := t.__dict__.pop("_stored_at", None))]
    for t, path in stored:
        sc = t.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    if stored:
        stored[0][0].sparkSession.sparkContext._jvm.System.gc()


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Delete at the end what :func:`materialise` makes within, but for the tables that are added to the given list.

    What is kept belongs to the scratch around this one, if there is one.
    """
    kept: list[DataFrame] = []
    open_now = _scratch.__dict__.setdefault("open", [])
    open_now.append([])
    try:
        yield kept
    finally:
        made = open_now.pop()
        stay = {t._stored_at for t in kept if "_stored_at" in t.__dict__}
        if open_now:
            open_now[-1].extend(t for t in made if t.__dict__.get("_stored_at") in stay)
        release(*(t for t in made if t.__dict__.get("_stored_at") not in stay))
