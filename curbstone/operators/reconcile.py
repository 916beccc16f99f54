"""Reconciliation of held requests with every key that the source serves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbstone.session import materialized

#: Share of the last good count under which a key scan is taken as broken.
GUARD = 0.95


def newest_keys(feed: DataFrame) -> DataFrame:
    """(reference_number, updated_utc): the newest time of each served key."""
    return feed.groupBy("reference_number").agg(F.max("updated_utc").alias("updated_utc"))


def guard_fails(keys: int, baseline: int | None, ratio: float = GUARD) -> bool:
    return baseline is not None and keys < baseline * ratio


def removed(held: DataFrame, keys: DataFrame) -> DataFrame:
    """Held rows, not marked yet, that the source no longer serves."""
    return held.filter("not was_removed").join(keys.select("reference_number"), "reference_number", "left_anti")


def restored(held: DataFrame, keys: DataFrame) -> DataFrame:
    """Held rows marked as removed that the source serves again."""
    return held.filter("was_removed").join(keys.select("reference_number"), "reference_number", "left_semi")


def to_refetch(held: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that are served but not held, or are newer in the source."""
    h = held.select("reference_number", F.col("updated_utc").alias("__held"))
    rows = keys.join(h, "reference_number", "left")
    return rows.filter(F.col("__held").isNull() | (F.col("updated_utc") > F.col("__held"))).select("reference_number")


#: Rows of a part, about, that places() sorts in one task.
PART = 500_000


def places(rows: DataFrame, by: str, order: str, part: int = PART) -> DataFrame:
    """rows with place: their number from 0 by order within by, though no group is sorted in one task.

    Rows are dealt out by ranges of both columns; a row's place is that within its part and how many of its group the parts before hold.
    """
    rows = materialized(rows)
    parts = max(1, math.ceil(rows.count() / part))
    rows = materialized(rows.repartitionByRange(parts, by, order).withColumn("__part", F.spark_partition_id()))
    over = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(F.col(by).alias("__by"), F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"))
    rows = rows.join(F.broadcast(counts), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__of")))
    place = F.row_number().over(Window.partitionBy("__part", by).orderBy(order)) - 1
    return rows.withColumn("place", F.col("__before") + place).drop("__part", "__by", "__of", "__before")
