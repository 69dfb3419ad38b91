"""What the operators of this subpackage share: table reading and durable intermediate tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, release, scratch, shared_dir

__all__ = ["drop_held", "held", "materialise", "release", "restored_id", "scratch", "shared_dir", "table", "text_id"]

T = TypeVar("T")

#: Letters that the contracts lower-case; all others stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What an operator remembers in a Python worker between tasks; one operator's at a time, as workers serve all in turn.
_held: dict[object, object] = {}


def held(key: object, build: Callable[[], T]) -> T:
    """The worker's memory under ``key``, built if it is not there; that of other operators goes."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def drop_held() -> None:
    _held.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_id(column: str) -> Column:
    """An id as text: pandas would turn a column of integers with nulls into floats."""
    return F.col(column).cast("string").alias("_id")


def restored_id(out: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """``out`` with its first column ``_id`` as the id column that ``docs`` has."""
    rest = [F.col(c) for c in out.columns if c != "_id"]
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), *rest)
