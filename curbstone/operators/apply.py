"""Applying a cleaned batch to the current table and its history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbstone.functions.maps import FLAG, LABELS, UNMAPPED

#: Columns that cleaning decides; a reclean compares and replaces these.
CLEANED = (
    "sf_ticket_id", "category_level1", "category_level2", "category_name", "category_group", "source_channel_raw", "source_channel", "district_number",
    "is_city", "neighborhood", "neighborhood_slug", "address", "cross_street", "zip", "latitude", "longitude", "public_status", "status_group", "created_utc",
    "closed_utc", "created_date_local", "closed_date_local", "backlog_close_date_local", "days_to_close", "dq_flags",
)
VERSION = ("object_id", "updated_utc", "row_hash")
TRACKING = ("first_seen_utc", "last_seen_utc", "last_changed_utc", "source_removed_utc")
HISTORY = (
    "reference_number", "row_hash", "object_id", "category_level1", "category_level2", "category_name", "category_group", "source_channel", "district_number",
    "is_city", "neighborhood_slug", "address", "zip", "latitude", "longitude", "public_status", "status_group", "created_utc", "updated_utc", "closed_utc", "dq_flags",
)


def newest(cleaned: DataFrame) -> DataFrame:
    """The newest version of each request, by update time, object and hash."""
    order = [F.desc("updated_utc"), F.desc("object_id"), F.desc("row_hash")]
    return cleaned.withColumn("__rn", F.row_number().over(Window.partitionBy("reference_number").orderBy(*order))).filter("__rn = 1").drop("__rn")


def with_maps(rows: DataFrame, categories: DataFrame, sources: DataFrame, neighborhoods: DataFrame) -> DataFrame:
    """rows with category_group and source_channel, or Unmapped and its bit, and mapped neighborhoods in the map's spelling."""
    c = categories.select("category_key", F.col("category_group"))
    s = sources.select("source_key", "source_channel")
    n = neighborhoods.select(F.col("alias_key").alias("neighborhood_key"), F.col("neighborhood").alias("__n"), F.col("neighborhood_slug").alias("__slug"))
    rows = rows.join(F.broadcast(c), "category_key", "left").join(F.broadcast(s), "source_key", "left").join(F.broadcast(n), "neighborhood_key", "left")
    bit = lambda col, name: F.when(F.col(col).isNull(), F.lit(FLAG[name])).otherwise(F.lit(0))
    flags = F.col("dq_flags").bitwiseOR(bit("category_group", "UnmappedCategory")).bitwiseOR(bit("source_channel", "UnmappedSource"))
    return (
        rows.withColumn("dq_flags", flags)
        .withColumn("category_group", F.coalesce("category_group", F.lit(UNMAPPED)))
        .withColumn("source_channel", F.coalesce("source_channel", F.lit(UNMAPPED)))
        .withColumn("neighborhood", F.coalesce("__n", "neighborhood"))
        .withColumn("neighborhood_slug", F.coalesce("__slug", "neighborhood_slug"))
        .drop("__n", "__slug", "category_key", "source_key", "neighborhood_key")
    )


def new_history(batch: DataFrame, history: DataFrame, now: Column, run_id: int) -> DataFrame:
    """A row for each version, by key and hash, that was never seen; stale ones too."""
    seen = history.select("reference_number", "row_hash")
    rows = batch.join(seen, ["reference_number", "row_hash"], "left_anti").select(*HISTORY)
    return rows.withColumn("captured_utc", now).withColumn("run_id", F.lit(run_id).cast("long"))


def merged(current: DataFrame, batch: DataFrame, now: Column, reclean: bool = False) -> DataFrame:
    """The next current table, with change: inserted, updated, recleaned, unchanged, or null for rows not in the batch.

    One full join by key. The same hash or an older version only moves last_seen; a new hash that isn't older replaces all. With
    reclean the same hash with other cleaned values replaces those, keeps label bits and doesn't count as a change. Any
    row of the batch is no longer removed.
    """
    value = [*VERSION, *CLEANED]
    t = current.select("reference_number", F.struct(*value).alias("t"), F.struct(*TRACKING).alias("seen"))
    b = batch.select("reference_number", F.struct(*value).alias("b"))
    rows = t.join(b, "reference_number", "full")
    same = F.col("t.row_hash") == F.col("b.row_hash")
    unlabelled = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in CLEANED if c != "dq_flags"), F.col(f"{side}.dq_flags").bitwiseAND(F.lit(~LABELS)))
    change = (
        F.when(F.col("b").isNull(), None)
        .when(F.col("t").isNull(), "inserted")
        .when(same & F.lit(reclean) & ~unlabelled("t").eqNullSafe(unlabelled("b")), "recleaned")
        .when(same | (F.col("b.updated_utc") < F.col("t.updated_utc")), "unchanged")
        .otherwise("updated")
    )
    rows = rows.withColumn("change", change)
    fresh, cleaned = F.col("change").isin("inserted", "updated"), F.col("change") == "recleaned"
    pick = lambda c, when: F.when(F.coalesce(when, F.lit(False)), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    out = []
    for c in value:
        if c == "dq_flags":
            kept = F.col("b.dq_flags").bitwiseOR(F.col("t.dq_flags").bitwiseAND(F.lit(LABELS)))
            out.append(F.when(F.coalesce(cleaned, F.lit(False)), kept).when(F.coalesce(fresh, F.lit(False)), F.col("b.dq_flags")).otherwise(F.col("t.dq_flags")).alias(c))
        else:
            out.append(pick(c, fresh | cleaned if c in CLEANED else fresh))
    in_batch = F.col("change").isNotNull()
    tracking = [
        F.coalesce("seen.first_seen_utc", now).alias("first_seen_utc"),
        F.when(in_batch, now).otherwise(F.col("seen.last_seen_utc")).alias("last_seen_utc"),
        F.when(F.coalesce(fresh, F.lit(False)), now).otherwise(F.col("seen.last_changed_utc")).alias("last_changed_utc"),
        F.when(~in_batch, F.col("seen.source_removed_utc")).alias("source_removed_utc"),
    ]
    return rows.select("reference_number", *out, *tracking, "change")


def change_counts(rows: DataFrame) -> dict[str, int]:
    got = {r["change"]: r["n"] for r in rows.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {k: got.get(k, 0) for k in ("inserted", "updated", "unchanged", "recleaned")}
