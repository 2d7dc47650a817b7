"""Incremental maintenance: snapshot differences, replacement of an object's points, versions of spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what stands for a missing time of change.
UNKNOWN = "unknown"
#: Rows of additions (their keys) that may be broadcast; beyond that the same join shuffles.
BROADCAST_ROWS = 500_000


def snapshot_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(space_id, object_id, change): new, changed, unchanged or removed. Times are compared as the strings they came as."""
    s = stored.select("space_id", "object_id", F.coalesce("last_modified", F.lit(UNKNOWN)).alias("old"))
    c = current.select("space_id", "object_id", F.coalesce("last_modified", F.lit(UNKNOWN)).alias("now"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("old") == F.col("now"), "unchanged").otherwise("changed")
    return s.join(c, ["space_id", "object_id"], "full_outer").select("space_id", "object_id", change.alias("change"))


def latest(base: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """base's rows and those of added (base's columns and _seq), each key's rows of its last addition alone: a merge on reading.

    Only the additions' keys are grouped; base meets them in one join, which broadcasts them where they are few.
    """
    last = added.groupBy(*keys).agg(F.max("_seq").alias("_last"))
    last = F.broadcast(last) if added.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else last
    on = [F.col(f"x.`{k}`").eqNullSafe(F.col(f"y.`{k}`")) for k in keys]
    old = base.alias("x").join(last.alias("y"), on, "left_anti")
    new = added.alias("x").join(last.alias("y"), [*on, F.col("x._seq") == F.col("y._last")], "left_semi")
    return old.unionByName(new.drop("_seq"))


def replace_points(points: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """points without those of changed and removed objects, and with the fresh ones. An object that now has no chunk loses its points."""
    gone = changes.filter("change IN ('changed', 'removed', 'new')").select("space_id", "object_id")
    return points.join(gone, ["space_id", "object_id"], "left_anti").unionByName(fresh)


def point_additions(changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """What an addition to the points says of changes (space_id, object_id, change): the fresh chunks, and a row without a chunk for each object that has none now."""
    none = changes.filter("change <> 'unchanged'").select("space_id", "object_id").join(fresh.select("space_id", "object_id").distinct(), ["space_id", "object_id"], "left_anti")
    return fresh.unionByName(none, allowMissingColumns=True)


def backfill(points: DataFrame, objects: DataFrame, column: str) -> DataFrame:
    """points with a payload column filled from objects (space_id, object_id, column) where it is null; vectors stay."""
    have = points if column in points.columns else points.withColumn(column, F.lit(None).cast(dict(objects.dtypes)[column]))
    return have.withColumnRenamed(column, "_old").join(objects.select("space_id", "object_id", column), ["space_id", "object_id"], "left").withColumn(column, F.coalesce("_old", column)).drop("_old")


def bump(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """(space_id, version): one more for each space with a change, 1 for a new space."""
    touched = changes.filter("change <> 'unchanged'").select("space_id").distinct().withColumn("t", F.lit(1))
    return versions.join(touched, "space_id", "full_outer").select("space_id", (F.coalesce("version", F.lit(0)) + F.coalesce("t", F.lit(0))).cast("long").alias("version"))


def stale(versions: DataFrame, built: DataFrame) -> DataFrame:
    """Spaces whose built version is not the current one: only their statistics are made anew."""
    return versions.join(built.withColumnRenamed("version", "built"), "space_id", "left").filter(F.col("built").isNull() | (F.col("built") != F.col("version"))).select("space_id")


def reindex_stats(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("objects"))
