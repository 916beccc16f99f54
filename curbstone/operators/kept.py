"""Counts of requests that are kept between refreshes and moved by the rows that changed since, and figures made of them.

Each kept table is a sum over requests, so a change is its new version's counts less its old one's; requests that didn't change
aren't read. What isn't a sum, the label of bulk closures, is made from kept counts of closures: it is the same for all old closures of
a day, category and minute. Where such a group's label changes, its other members have changed too, and are asked for.

Rows have the columns that the cube takes, with type_group, type_label and type_reason (null for service), present and created_utc.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstone.functions.maps import DETECT_AGE, MEMBER_AGE, MIN_COUNT, SWEEP_COUNT
from curbstone.operators import classify, cube, notes
from curbstone.session import materialized, small

CLOSURE = ("closed_date", "category_group", "closed_minute")


def _present(rows: DataFrame) -> DataFrame:
    return rows.filter("present")


def _open(rows: DataFrame) -> DataFrame:
    rows = rows.filter("present and service and created_utc is not null")
    return rows.groupBy(*cube.DIMS, "created_date", "backlog_close_date", "created_utc").agg(F.count(F.lit(1)).alias("n"))


def _closures(rows: DataFrame) -> DataFrame:
    return notes.closure_counts(rows.filter(classify.old_closure(rows, MEMBER_AGE)), DETECT_AGE)


def _totals(rows: DataFrame) -> DataFrame:
    return rows.filter("present").groupBy(F.lit("requests").alias("what")).agg(F.count(F.lit(1)).alias("n"))


#: What is kept: by which columns, which counts, and how they come from rows.
KEPT: dict[str, tuple[tuple[str, ...], tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {
    "closures": (CLOSURE, ("members", "old", "total"), _closures),
    "events": ((*cube.DIMS, "day", "hundredths"), (*cube.COUNTS, "n"), lambda rows: cube.event_counts(_present(rows))),
    "open": ((*cube.DIMS, "created_date", "backlog_close_date", "created_utc"), ("n",), _open),
    "daily": (("district_number", "category_group", "day"), ("opened", "closed"), lambda rows: cube.daily_counts(_present(rows))),
    "types": ((*notes.TYPE, "day"), ("opened", "closed", "left"), notes.type_counts),
    "problems": (("day", "bit"), ("n",), notes.problem_counts),
    "totals": (("what",), ("n",), _totals),
}


def counted(rows: DataFrame, name: str, since: Column | None = None) -> DataFrame:
    """One kept table of rows. Since a day: what left the backlog by then, and so can't be open later, isn't kept as open."""
    keys, counts, of = KEPT[name]
    if name == "open" and since is not None:
        rows = rows.filter(F.col("backlog_close_date").isNull() | (F.col("backlog_close_date") > since))
    return of(rows).select(*keys, *(F.col(c).cast("long").alias(c) for c in counts))


def moved(kept: DataFrame, old: DataFrame, new: DataFrame, name: str, since: Column | None = None) -> DataFrame:
    """kept, as it was counted since a day, less the counts of old and with those of new; what is zero in all is left out."""
    keys, counts, _ = KEPT[name]
    less = counted(old, name, since).select(*keys, *((-F.col(c)).alias(c) for c in counts))
    rows = kept.select(*keys, *counts).unionByName(less).unionByName(counted(new, name, since))
    rows = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))
    return rows.filter(" or ".join(f"{c} <> 0" for c in counts))


def clear_out_days(closures: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """classify.clear_out_days() from kept closures."""
    return closures.groupBy("closed_date", "category_group").agg(F.sum("old").alias("old_closures")).filter(F.col("old_closures") >= least)


def sweep_minutes(closures: DataFrame, least: int = SWEEP_COUNT) -> DataFrame:
    """classify.sweep_minutes() from kept closures."""
    return closures.groupBy("closed_minute").agg(F.sum("old").alias("old_closures")).filter(F.col("old_closures") >= least)


def bulk_closures(closures: DataFrame, days_least: int = MIN_COUNT, sweep_least: int = SWEEP_COUNT) -> DataFrame:
    """The kept closures that are bulk: on a clear-out day of their category or in a sweep minute."""
    days = clear_out_days(closures, days_least).select("closed_date", "category_group", F.lit(True).alias("__day"))
    minutes = sweep_minutes(closures, sweep_least).select("closed_minute", F.lit(True).alias("__minute"))
    rows = closures.join(days, ["closed_date", "category_group"], "left").join(minutes, "closed_minute", "left")
    return rows.filter("__day or __minute").select(*closures.columns)


def with_label(rows: DataFrame, closures: DataFrame, days_least: int = MIN_COUNT, sweep_least: int = SWEEP_COUNT) -> DataFrame:
    """rows with bulk, from kept closures that count them."""
    return classify.with_bulk(rows.drop("bulk"), clear_out_days(closures, days_least), sweep_minutes(closures, sweep_least))


def build(
    rows: DataFrame, since: Column | None = None, days_least: int = MIN_COUNT, sweep_least: int = SWEEP_COUNT, names: tuple[str, ...] = tuple(KEPT)
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(kept tables, rows with bulk) of all requests; names are the tables wanted, closures always among them.

    Rows with bulk are all rows once more: they are written only if more than one table is counted from them.
    """
    kept = {"closures": materialized(counted(rows, "closures"))}
    rows = with_label(rows, kept["closures"], days_least, sweep_least)
    rows = materialized(rows) if len({*names} - {"closures"}) > 1 else rows
    return kept | {n: materialized(counted(rows, n, since)) for n in names if n != "closures"}, rows


def move(
    kept: dict[str, DataFrame], old: DataFrame, new: DataFrame, others: Callable[[DataFrame], DataFrame], since: Column | None = None, days_least: int = MIN_COUNT,
    sweep_least: int = SWEEP_COUNT,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(kept tables, changed rows with bulk) after rows that were old, with the bulk they had, and are new now, which have none yet.

    since is the day that kept was counted since.
    others(groups) gives the rows that aren't among new in groups (CLOSURE) whose label changed, with the bulk they had.
    """
    out = {"closures": materialized(moved(kept["closures"], old, new, "closures"))}
    label = partial(bulk_closures, days_least=days_least, sweep_least=sweep_least)
    new = with_label(new, out["closures"], days_least, sweep_least)
    was, now = (label(c).select(*CLOSURE) for c in (kept["closures"], out["closures"]))
    both = kept["closures"].select(*CLOSURE).intersect(out["closures"].select(*CLOSURE))
    flipped, _ = small(was.exceptAll(now).unionByName(now.exceptAll(was)).intersect(both))
    if flipped.take(1):
        more = materialized(others(flipped))
        old, new = old.unionByName(more), new.unionByName(more.withColumn("bulk", ~F.col("bulk")))
    new = materialized(new)
    return out | {n: materialized(moved(k, old, new, n, since)) for n, k in kept.items() if n != "closures"}, new


def figures(kept: dict[str, DataFrame], as_of: Column, age: Column, start: str) -> dict[str, DataFrame]:
    """The published tables as of a day; age is that of a request in hundredths, from created_utc."""
    return {
        "stats_window": cube.window_cube_of(kept["events"], as_of),
        "open_backlog": cube.open_cube_of(kept["open"], as_of, age),
        "backlog_daily": cube.daily_backlog_of(kept["daily"], as_of, start),
        "exclusion": notes.non_service_by_period_of(kept["types"], as_of),
        "exclusion_open": notes.non_service_open_of(kept["types"], as_of),
        "exclusion_flag": notes.date_problem_closures_of(kept["problems"], as_of),
        "clear_out": notes.clear_outs_of(bulk_closures(kept["closures"]), F.lit(start).cast("date")),
    }
