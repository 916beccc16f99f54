"""Classification: requests that aren't for service, and the label of bulk closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstone.functions.maps import DATE_PROBLEMS, DETECT_AGE, FLAG, MEMBER_AGE, MIN_COUNT, SWEEP_COUNT
from curbstone.functions.text import map_key
from curbstone.session import small


def non_service_pairs(requests: DataFrame, categories: DataFrame, lines: DataFrame) -> DataFrame:
    """(category_level1, category_level2, category_group, label, reason) of the pairs in requests that aren't for service.

    The maps are joined to distinct pairs, a few hundred, and not to requests.
    """
    pairs = requests.select("category_level1", "category_level2").distinct()
    pairs = pairs.withColumn("k1", map_key(F.col("category_level1"))).withColumn("k2", map_key(F.col("category_level2")))
    whole = categories.filter("not is_service").select(F.col("category_key").alias("k1"), F.col("category_group").alias("g1"), F.col("source_value").alias("v1"), F.col("reason").alias("r1"))
    line = lines.select(F.col("category_key").alias("k1"), F.col("category_level2_key").alias("k2"), F.concat_ws(" / ", "source_level1", "source_level2").alias("v2"), F.col("reason").alias("r2"))
    of_line = categories.select(F.col("category_key").alias("k1"), F.col("category_group").alias("g2"))
    found = pairs.join(F.broadcast(whole), "k1", "left").join(F.broadcast(line), ["k1", "k2"], "left").join(F.broadcast(of_line), "k1", "left")
    return found.filter("v1 is not null or v2 is not null").select(
        "category_level1", "category_level2", F.coalesce("g1", "g2").alias("category_group"), F.coalesce("v1", "v2").alias("label"), F.coalesce("r1", "r2").alias("reason")
    )


def with_type(requests: DataFrame, pairs: DataFrame, how: str = "inner") -> DataFrame:
    """requests with the label, reason and type group of their pair; a null second level matches a null one, a null first none."""
    p, _ = small(pairs)
    p = p.select(F.col("category_level1").alias("p1"), F.col("category_level2").alias("p2"), F.col("category_group").alias("type_group"), F.col("label").alias("type_label"), F.col("reason").alias("type_reason"))
    on = (requests["category_level1"] == p["p1"]) & requests["category_level2"].eqNullSafe(p["p2"])
    return requests.join(p, on, how).drop("p1", "p2")


def with_service(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """requests with service: whether their pair isn't among pairs."""
    return with_type(requests, pairs, "left").withColumn("service", F.col("type_label").isNull()).drop("type_group", "type_label", "type_reason")


def old_closure(requests: DataFrame, age: int) -> Column:
    return F.col("service") & F.col("present") & (F.col("dq_flags").bitwiseAND(DATE_PROBLEMS) == 0) & (F.col("hundredths") > 100 * age)


def clear_out_days(requests: DataFrame, least: int = MIN_COUNT, detect_age: int = DETECT_AGE) -> DataFrame:
    old = requests.filter(old_closure(requests, detect_age) & F.col("closed_date").isNotNull())
    return old.groupBy("closed_date", "category_group").agg(F.count(F.lit(1)).alias("old_closures")).filter(F.col("old_closures") >= least)


def sweep_minutes(requests: DataFrame, least: int = SWEEP_COUNT, detect_age: int = DETECT_AGE) -> DataFrame:
    old = requests.filter(old_closure(requests, detect_age) & F.col("closed_ts").isNotNull())
    return old.groupBy(F.date_trunc("minute", "closed_ts").alias("closed_minute")).agg(F.count(F.lit(1)).alias("old_closures")).filter(F.col("old_closures") >= least)


def with_bulk(requests: DataFrame, days: DataFrame, minutes: DataFrame, member_age: int = MEMBER_AGE) -> DataFrame:
    """requests with bulk: an old closure on a clear-out day of its group or in a sweep minute.

    Days and minutes are counted and sent to all executors if they are few; else only old closures are joined with them, so
    that requests without a close date don't meet in one task.
    """
    d, few_days = small(days.select("closed_date", "category_group", F.lit(True).alias("__day")))
    m, few_minutes = small(minutes.select("closed_minute", F.lit(True).alias("__minute")))
    old = F.coalesce(old_closure(requests, member_age), F.lit(False))

    def marked(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("closed_minute", F.date_trunc("minute", "closed_ts")).join(d, ["closed_date", "category_group"], "left").join(m, "closed_minute", "left")
        return rows.withColumn("bulk", old & (F.col("__day").isNotNull() | F.col("__minute").isNotNull())).select(*requests.columns, "bulk")

    if few_days and few_minutes:
        return marked(requests)
    return marked(requests.filter(old)).unionByName(requests.filter(~old).withColumn("bulk", F.lit(False)))


def label_flags(flags: Column, bulk: Column) -> Column:
    """dq_flags with the bulk bit set or cleared."""
    bit = FLAG["BulkClosure"]
    return F.when(bulk, flags.bitwiseOR(bit)).otherwise(flags.bitwiseAND(F.lit(~bit)))
