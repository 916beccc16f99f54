"""What the headline figures leave out, and notes on clear-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstone.functions.maps import DATE_PROBLEMS, DETECT_AGE, SWEEP_COUNT, WINDOWS, flag_map
from curbstone.operators.classify import with_type
from curbstone.operators.cube import in_periods, open_at

TYPE = ("type_group", "type_label", "type_reason")


def type_counts(requests: DataFrame) -> DataFrame:
    """(type, day, opened, closed, left): requests that aren't for service, which have their type, by the day they were created, closed, and
    left the backlog if they have a created day."""
    c, no, one = F.col, F.lit(0), F.lit(1)
    day = lambda d, o, x, y: F.struct(d.alias("day"), o.alias("opened"), x.alias("closed"), y.alias("left"))
    closed, created = (c("status_group") == "Closed").cast("int"), c("created_date").isNotNull().cast("int")
    days = F.array(day(c("created_date"), one, no, no), day(c("backlog_close_date"), no, closed, created))
    rows = requests.filter("present and not service").select(*TYPE, F.explode(F.filter(days, lambda x: x["day"].isNotNull())).alias("e")).select(*TYPE, "e.*")
    return rows.groupBy(*TYPE, "day").agg(*(F.sum(n).alias(n) for n in ("opened", "closed", "left")))


def non_service_by_period(requests: DataFrame, pairs: DataFrame, as_of: Column, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(window_days, period, type, opened_count, closed_count) of requests that aren't for service."""
    return non_service_by_period_of(type_counts(with_type(requests.filter("present and not service"), pairs)), as_of, windows)


def non_service_by_period_of(counts: DataFrame, as_of: Column, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """non_service_by_period() from type_counts()."""
    rows = in_periods(counts.filter("opened + closed > 0"), "day", as_of, windows).groupBy("window_days", "period", *TYPE)
    return rows.agg(F.sum("opened").cast("long").alias("opened_count"), F.sum("closed").cast("long").alias("closed_count"))


def non_service_open(requests: DataFrame, pairs: DataFrame, as_of: Column) -> DataFrame:
    return with_type(requests.filter("present and not service"), pairs).filter(open_at(as_of)).groupBy(*TYPE).agg(F.count(F.lit(1)).alias("open_count"))


def non_service_open_of(counts: DataFrame, as_of: Column) -> DataFrame:
    """non_service_open() from type_counts(): those created by as_of less those that left, which were created before."""
    rows = counts.filter(F.col("day") <= as_of).groupBy(*TYPE).agg(F.sum(F.col("opened") - F.col("left")).cast("long").alias("open_count"))
    return rows.filter("open_count > 0")


def problem_counts(requests: DataFrame) -> DataFrame:
    """(day, bit, n): closed service requests left out of timing by the day they left the backlog, once for each bit."""
    rows = requests.filter(F.col("present") & F.col("service") & (F.col("status_group") == "Closed") & (F.col("dq_flags").bitwiseAND(DATE_PROBLEMS) != 0))
    bits = [1 << k for k in range(13) if DATE_PROBLEMS & (1 << k)]
    each = F.filter(F.array(*(F.lit(b) for b in bits)), lambda b: F.col("dq_flags").bitwiseAND(b) != 0)
    return rows.select(F.col("backlog_close_date").alias("day"), F.explode(each).alias("bit")).groupBy("day", "bit").agg(F.count(F.lit(1)).alias("n"))


def date_problem_closures(requests: DataFrame, as_of: Column, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(window_days, period, label, reason, closed_count): closed service requests left out of timing, by each bit that they have."""
    return date_problem_closures_of(problem_counts(requests), as_of, windows)


def date_problem_closures_of(counts: DataFrame, as_of: Column, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """date_problem_closures() from problem_counts()."""
    rows = in_periods(counts, "day", as_of, windows).groupBy("window_days", "period", "bit").agg(F.sum("n").cast("long").alias("closed_count"))
    names = flag_map(counts.sparkSession)
    return rows.join(F.broadcast(names), "bit").select("window_days", "period", F.col("name").alias("label"), F.col("description").alias("reason"), "closed_count")


def closure_counts(requests: DataFrame, detect_age: int = DETECT_AGE) -> DataFrame:
    """(closed_date, category_group, closed_minute, members, old, total): closures, those of detect_age, and the sum of hundredths."""
    rows = requests.groupBy("closed_date", "category_group", F.date_trunc("minute", "closed_ts").alias("closed_minute"))
    old = F.sum((F.col("hundredths") > 100 * detect_age).cast("int"))
    return rows.agg(F.count(F.lit(1)).alias("members"), old.alias("old"), F.sum("hundredths").alias("total"))


def clear_outs(requests: DataFrame, start: Column, least: int = SWEEP_COUNT, detect_age: int = DETECT_AGE) -> DataFrame:
    """A note for each day and category with bulk closures since start.

    closed_count, mean hundredths of days rounded to whole hundredths, minutes_spanned, and sweep_categories: the other
    categories with members in the same sweep minutes, most members first, then by name.
    """
    members = requests.filter(F.col("bulk") & F.col("service") & F.col("present") & (F.col("status_group") == "Closed"))
    return clear_outs_of(closure_counts(members, detect_age), start, least)


def clear_outs_of(counts: DataFrame, start: Column, least: int = SWEEP_COUNT) -> DataFrame:
    """clear_outs() from closure_counts() of bulk closures."""
    counts = counts.filter(F.col("closed_date") >= start).withColumnRenamed("closed_date", "day")
    minutes = counts.groupBy("closed_minute").agg(F.sum("old").alias("old"), F.count_distinct("category_group").alias("groups")).filter((F.col("old") >= least) & (F.col("groups") > 1))
    per_minute = counts.join(minutes.select("closed_minute"), "closed_minute").select("closed_minute", "day", "category_group", "members")
    mine = per_minute.select("closed_minute", "day", "category_group")
    theirs = per_minute.groupBy("closed_minute", F.col("category_group").alias("other")).agg(F.sum("members").alias("members"))
    others = mine.join(theirs, "closed_minute").filter("other <> category_group").groupBy("day", "category_group", "other").agg(F.sum("members").alias("members"))
    listed = others.groupBy("day", "category_group").agg(F.sort_array(F.collect_list(F.struct((-F.col("members")).alias("n"), "other"))).alias("l"))
    listed = listed.select("day", "category_group", F.transform("l", lambda x: x["other"]).alias("sweep_categories"))
    notes = counts.groupBy("day", "category_group").agg(
        F.sum("members").cast("long").alias("closed_count"),
        F.sum("total").alias("total"),
        ((F.unix_timestamp(F.max("closed_minute")) - F.unix_timestamp(F.min("closed_minute"))) / 60 + 1).cast("int").alias("minutes_spanned"),
    )
    notes = notes.withColumn("avg_age_days", F.floor((2 * F.col("total") + F.col("closed_count")) / (2 * F.col("closed_count"))) / 100).drop("total")
    return notes.join(listed, ["day", "category_group"], "left").withColumn("is_sweep", F.col("sweep_categories").isNotNull())


def sentence(day: Column, category: Column, closed: Column, average: Column, minutes: Column, others: Column) -> Column:
    """A clear-out in words; others is an array of categories or null."""
    days = F.format_number(F.floor(average + 0.5), 0)
    many = F.concat(F.format_number(closed, 0), F.lit(" requests averaging "), days, F.lit(" days old"))
    what = F.when(closed == 1, F.concat(F.lit("1 request "), days, F.lit(" days old"))).otherwise(many)
    over = F.when(minutes <= 1, F.lit(" in one minute")).otherwise(F.concat(F.lit(" over "), F.format_number(minutes, 0), F.lit(" minutes")))
    head = F.concat(F.lit("On "), F.date_format(day, "yyyy-MM-dd"), F.lit(", "), category, F.lit(" closed "), what, F.when(closed == 1, F.lit("")).otherwise(over), F.lit("."))
    n = F.size(others)
    joined = F.when(n == 1, F.get(others, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(others, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.get(others, n - 1)))
    return F.when(F.coalesce(n, F.lit(0)) < 1, head).otherwise(F.concat(head, F.lit(" In the same minute, "), joined, F.lit(" also closed old requests.")))
