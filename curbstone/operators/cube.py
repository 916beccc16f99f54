"""The aggregate cube: counts and exact percentiles by neighborhood, district and category, open snapshots and daily series.

All take requests with neighborhood_slug, district_number, category_group (null: no value), status_group, created_date, closed_date,
backlog_close_date, hundredths (of days to close), timed, bulk and service (booleans). Rows that lack a dimension's value
are left out of the sets that group by it; in results '' and 0 stand for all.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbstone.functions.maps import BACKLOG_START, WINDOWS
from curbstone.functions.numbers import MEDIAN, P90, exact_percentiles

DIMS = ("neighborhood_slug", "district_number", "category_group")
COUNTS = ("opened_count", "excluded_count", "bulk_closed_count")


def period_of(day: Column, as_of: Column, days: int) -> Column:
    """'current' for the last `days` days up to as_of, 'prior' for those before, else null."""
    return F.when(day > as_of, None).when(day > F.date_sub(as_of, days), "current").when(day > F.date_sub(as_of, 2 * days), "prior")


def in_periods(rows: DataFrame, day: str, as_of: Column, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """rows for each window and period that their day lies in, as window_days and period."""
    each = [F.struct(F.lit(w).alias("window_days"), period_of(F.col(day), as_of, w).alias("period")) for w in windows]
    rows = rows.withColumn("__p", F.explode(F.filter(F.array(*each), lambda p: p["period"].isNotNull())))
    return rows.select("*", "__p.window_days", "__p.period").drop("__p")


def _all_value(dim: str) -> Column:
    return F.lit(0) if dim == "district_number" else F.lit("")


def all_sets(dims: tuple[str, ...] = DIMS) -> list[tuple[str, ...]]:
    return [s for k in range(len(dims) + 1) for s in combinations(dims, k)]


def roll_up(finest: DataFrame, keys: list[str], sums: list[str], dims: tuple[str, ...] = DIMS, sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Sums of rows by keys and each of sets, by default every subset of dims: a row once for each set that it has all values for.

    finest should be grouped by keys and dims already, so that what is multiplied is small.
    """
    sets = all_sets(dims) if sets is None else sets
    choices = []
    for s in sets:
        has = F.lit(True)
        for d in s:
            has = has & F.col(d).isNotNull()
        choices.append(F.when(has, F.struct(*((F.col(d) if d in s else _all_value(d)).alias(d) for d in dims))))
    rows = finest.select(*keys, *sums, F.explode(F.array_compact(F.array(*choices))).alias("__c"))
    return rows.select(*keys, "__c.*", *sums).groupBy(*keys, *dims).agg(*(F.sum(s).cast("long").alias(s) for s in sums))


def window_counts(requests: DataFrame, as_of: Column, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Opened by created day, excluded (closed but not timed) by the day of leaving the backlog, bulk-closed by close day."""
    c = F.col
    kinds = {
        "opened_count": c("created_date"),
        "excluded_count": F.when(~c("timed") & (c("status_group") == "Closed"), c("backlog_close_date")),
        "bulk_closed_count": F.when(c("timed") & c("bulk"), c("closed_date")),
    }
    days = F.array(*(F.struct(F.lit(k).alias("kind"), d.alias("day")) for k, d in kinds.items()))
    rows = requests.filter("service").select(*DIMS, F.explode(F.filter(days, lambda x: x["day"].isNotNull())).alias("e")).select(*DIMS, "e.kind", "e.day")
    # By day first: rows shrink to cells x days before each is put into the windows that it lies in.
    rows = rows.groupBy(*DIMS, "day").agg(*(F.sum((c("kind") == k).cast("long")).alias(k) for k in COUNTS))
    rows = in_periods(rows, "day", as_of, windows).groupBy("window_days", "period", *DIMS).agg(*(F.sum(k).alias(k) for k in COUNTS))
    return roll_up(rows, ["window_days", "period"], list(COUNTS)).filter("opened_count + excluded_count + bulk_closed_count > 0")


def window_percentiles(requests: DataFrame, as_of: Column, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """closed_count, median and p90 hundredths of days to close of timed requests by close day."""
    rows = requests.filter("service and timed").groupBy(*DIMS, F.col("closed_date").alias("day"), "hundredths").agg(F.count(F.lit(1)).alias("n"))
    rows = in_periods(rows, "day", as_of, windows).groupBy("window_days", "period", *DIMS, "hundredths").agg(F.sum("n").alias("n"))
    rolled = roll_up(rows, ["window_days", "period", "hundredths"], ["n"])
    by = ["window_days", "period", *DIMS]
    return exact_percentiles(rolled, by, "hundredths", "n", {"median": MEDIAN, "p90": P90}).withColumnRenamed("n", "closed_count")


def event_counts(requests: DataFrame) -> DataFrame:
    """(cell, day, hundredths, COUNTS, n): what happened to requests on a day, n being those timed with so many hundredths."""
    c = F.col
    event = lambda day, opened, excluded, bulk, hundredths: F.struct(
        day.alias("day"), opened.alias("opened_count"), excluded.alias("excluded_count"), bulk.cast("int").alias("bulk_closed_count"), hundredths.alias("hundredths")
    )
    no, one, none = F.lit(0), F.lit(1), F.lit(None).cast("long")
    events = F.array(
        event(c("created_date"), one, no, no, none),
        event(F.when(~c("timed") & (c("status_group") == "Closed"), c("backlog_close_date")), no, one, no, none),
        event(F.when(c("timed"), c("closed_date")), no, no, c("bulk"), c("hundredths").cast("long")),
    )
    rows = requests.filter("service").select(*DIMS, F.explode(F.filter(events, lambda x: x["day"].isNotNull())).alias("e")).select(*DIMS, "e.*")
    return rows.groupBy(*DIMS, "day", "hundredths").agg(*(F.sum(k).alias(k) for k in COUNTS), F.count("hundredths").alias("n"))


def window_cube(requests: DataFrame, as_of: Column, windows: tuple[int, ...] = WINDOWS, sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """A row for each window, period and cell that has any count or value; median_days and p90_days may be null.

    One pass: events are counted by cell, day and hundredths; counts and percentiles come from the same rows. sets are the cells
    asked for, by default all.
    """
    return window_cube_of(event_counts(requests), as_of, windows, sets)


def window_cube_of(events: DataFrame, as_of: Column, windows: tuple[int, ...] = WINDOWS, sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """window_cube() from event_counts()."""
    by = ["window_days", "period", *DIMS]
    rows = in_periods(events, "day", as_of, windows).groupBy("window_days", "period", *DIMS, "hundredths").agg(*(F.sum(k).alias(k) for k in (*COUNTS, "n")))
    rolled = roll_up(rows, ["window_days", "period", "hundredths"], [*COUNTS, "n"], sets=sets)
    got = exact_percentiles(rolled, by, "hundredths", "n", {"median": MEDIAN, "p90": P90}, COUNTS)
    return got.select(
        *by, "opened_count", F.col("n").cast("long").alias("closed_count"), "excluded_count", "bulk_closed_count", (F.col("median") / 100).alias("median_days"), (F.col("p90") / 100).alias("p90_days")
    )


def open_at(as_of: Column) -> Column:
    """Whether a request, or a count of some, was created by as_of and hasn't left the backlog by then."""
    return (F.col("created_date") <= as_of) & (F.col("backlog_close_date").isNull() | (F.col("backlog_close_date") > as_of))


def open_cube(requests: DataFrame, as_of: Column, age: Column, sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(cell, open_count, median_age_days): requests created by as_of that haven't left the backlog; age in hundredths."""
    return open_cube_of(requests.filter("service").withColumn("n", F.lit(1)), as_of, age, sets)


def open_cube_of(counts: DataFrame, as_of: Column, age: Column, sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """open_cube() from service requests counted (n) by cell, created_date, backlog_close_date and what age is made of."""
    rows = counts.filter(open_at(as_of)).select(*DIMS, age.alias("hundredths"), "n").groupBy(*DIMS, "hundredths").agg(F.sum("n").alias("n"))
    rolled = roll_up(rows, ["hundredths"], ["n"], sets=sets)
    got = exact_percentiles(rolled, list(DIMS), "hundredths", "n", {"median": MEDIAN})
    return got.select(*DIMS, F.col("n").cast("long").alias("open_count"), (F.col("median") / 100).alias("median_age_days"))


def daily_counts(requests: DataFrame) -> DataFrame:
    """(district_number, category_group, day, opened, closed): service requests that have a created day, by it and by the day they left."""
    dims = ("district_number", "category_group")
    day = lambda d, o, x: F.struct(F.col(d).alias("day"), F.lit(o).alias("opened"), F.lit(x).alias("closed"))
    days = F.filter(F.array(day("created_date", 1, 0), day("backlog_close_date", 0, 1)), lambda x: x["day"].isNotNull())
    events = requests.filter("service and created_date is not null").select(*dims, F.explode(days).alias("e")).select(*dims, "e.*")
    return events.groupBy(*dims, "day").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))


def daily_backlog(requests: DataFrame, as_of: Column, start: str = BACKLOG_START) -> DataFrame:
    """(day, cell, opened, closed, open_at_end) for each day from start to as_of and each cell of district x category.

    Events are counted by cell and day before they are rolled up; the running sum has one row for each cell and day. No request
    leaves before the day that it was created.
    """
    return daily_backlog_of(daily_counts(requests), as_of, start)


def daily_backlog_of(counts: DataFrame, as_of: Column, start: str = BACKLOG_START) -> DataFrame:
    """daily_backlog() from daily_counts()."""
    first, dims = F.lit(start).cast("date"), ("district_number", "category_group")
    events = counts.filter(F.col("day") <= as_of)
    events = events.groupBy(*dims, F.greatest("day", F.date_sub(first, 1)).alias("day")).agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
    rolled = roll_up(events, ["day"], ["opened", "closed"], dims)
    cells = rolled.select(*dims).distinct()
    grid = cells.select(*dims, F.explode(F.sequence(F.date_sub(first, 1), as_of)).alias("day"))
    filled = grid.join(rolled, [*dims, "day"], "left").fillna(0, ["opened", "closed"])
    over = Window.partitionBy(*dims).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.withColumn("open_at_end", F.sum(F.col("opened") - F.col("closed")).over(over))
    return filled.filter(F.col("day") >= first).select("day", *dims, *(F.col(n).cast("long").alias(n) for n in ("opened", "closed", "open_at_end")))
