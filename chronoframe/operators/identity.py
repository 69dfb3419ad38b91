"""Identity of entities that are bound to one key at the same time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .components import connected_components
from .skew import spread


def overlap_edges(bindings: DataFrame, key: Sequence[str], entity: str, start: str, end: str) -> DataFrame:
    """Edges ``(u, v)`` between entities whose intervals ``[start, end)`` of one key overlap: the same components as all such pairs.

    A sweep over the intervals of a key by start: those of a run that all before reach into one another are linked to
    the run's first, so there are fewer edges than intervals and no chains within a key. An edge may come more than once. A null end
    is open; intervals without a start or an entity, and those that hold no day, link nothing; null keys bind nobody.
    """
    last = F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))
    sound = bindings.where(F.col(start).isNotNull() & F.col(entity).isNotNull() & (last > F.col(start)))
    for k in key:
        sound = sound.where(F.col(k).isNotNull())
    swept = Window.partitionBy(*key).orderBy(F.col(start), F.desc("_last"), F.col(entity))
    rows = spread(sound.select(*key, entity, start, last.alias("_last")), bindings.count(), *key)
    far = F.max("_last").over(swept.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(far.isNull() | (far <= F.col(start)), F.col(entity))
    rows = rows.withColumn("_first", first).withColumn("_hub", F.last("_first", ignorenulls=True).over(swept.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("_hub") != F.col(entity)).select(F.col(entity).alias("u"), F.col("_hub").alias("v"))


def overlap_identities(bindings: DataFrame, key: Sequence[str], entity: str, start: str, end: str, classes: DataFrame, class_col: str) -> DataFrame:
    """``(entity, canonical, refused)``: one row per entity of ``bindings``, a long; canonical is the smallest of those it is bound with.

    ``classes`` are rows ``(entity, class_col)``, which may repeat. Entities of one component whose classes contradict each other, so that two are
    known that differ, are refused: each is its own canonical. Entities of unknown class contradict nobody. Entities, links and
    classes meet in one shuffle; only those that are bound with others go on to the components.
    """
    roots = connected_components(overlap_edges(bindings, key, entity, start, end))
    kind = classes.schema[class_col].dataType
    none, nobody = F.lit(None).cast(kind), F.lit(None).cast("long")
    told = bindings.where(F.col(entity).isNotNull()).select(F.col(entity).cast("long").alias("_e"), F.lit(True).alias("_bound"), nobody.alias("_root"), none.alias("_class"))
    told = told.unionByName(roots.select(F.col("node").alias("_e"), F.lit(False).alias("_bound"), F.col("root").alias("_root"), none.alias("_class")))
    told = told.unionByName(classes.where(F.col(class_col).isNotNull()).select(F.col(entity).cast("long").alias("_e"), F.lit(False).alias("_bound"), nobody.alias("_root"), F.col(class_col).alias("_class")))
    told = spread(told, 2 * bindings.count(), "_e").groupBy("_e").agg(F.max("_bound").alias("_bound"), F.max("_root").alias("_root"), F.min("_class").alias("_low"), F.max("_class").alias("_high"))
    named = materialise(told.where("_bound").select(F.col("_e").cast(bindings.schema[entity].dataType).alias(entity), "_root", "_low", "_high"), "identity-roots")
    alone = named.where("_root IS NULL").select(entity, F.col(entity).cast("long").alias("canonical"), F.coalesce(F.col("_low") != F.col("_high"), F.lit(False)).alias("refused"))
    bound = named.where("_root IS NOT NULL")
    refused = bound.groupBy("_root").agg((F.min("_low") != F.max("_high")).alias("refused")).where("refused")
    out = bound.join(refused, "_root", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))
    return out.select(entity, F.when(F.col("refused"), F.col(entity)).otherwise(F.col("_root")).alias("canonical"), "refused").unionByName(alone)


def remapped(rows: DataFrame, identities: DataFrame, entity: str) -> DataFrame:
    """``rows`` with ``entity`` replaced by its canonical one and ``refused``; entities that are not listed stay as they are. ``rows`` are counted first."""
    number = rows.count()
    found = spread(identities.select(F.col(entity).alias("_e"), "canonical", "refused"), number, "_e")
    out = spread(rows, number, entity).join(found, F.col(entity) == F.col("_e"), "left").withColumn(entity, F.coalesce("canonical", F.col(entity)))
    return out.withColumn("refused", F.coalesce("refused", F.lit(False))).select(*rows.columns, "refused")
