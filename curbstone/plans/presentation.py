"""What the dashboard derives from answers: bins, legends, ranges, sort orders and texts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fewest closed requests for a shade, and number of bins.
LEAST_SHADED, BINS = 30, 5
DEFAULTS = {"window": "90", "category": "", "district": "", "range": "year"}


def shadeable(rows: DataFrame, closed: str = "current_closed_count", median: str = "current_median_days") -> DataFrame:
    return rows.filter((F.col(closed) >= LEAST_SHADED) & F.col(median).isNotNull())


def bin_cuts(rows: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """One row (cuts): the bins - 1 interpolated quantiles of value."""
    shares = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    return rows.agg(F.percentile(value, shares).alias("cuts"))


def with_bins(rows: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """rows with bin: how many cuts the value is above; a value equal to a cut stays below it."""
    cuts = bin_cuts(rows, value, bins)
    return rows.crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("cuts", lambda c: F.col(value) > c))).drop("cuts")


def legend(cuts: list[float]) -> list[str]:
    """A label for each bin."""
    if not cuts:
        return []
    t = [days_text(c) for c in cuts]
    return [f"up to {t[0]}", *(f"{a} to {b}" for a, b in zip(t, t[1:])), f"over {t[-1]}"]


def days_text(days: float | None) -> str:
    """Days with one digit under 100, else whole."""
    if days is None:
        return "no data"
    text = f"{days:,.1f}" if days < 100 else f"{days:,.0f}"
    return f"{text} day" + ("" if text == "1.0" else "s")


def trend_text(direction: str | None, pct: float | None) -> str:
    if direction is None:
        return "Too few requests for a trend"
    if direction == "steady":
        return "Steady"
    return direction.capitalize() + ("" if pct is None else f" by {abs(pct):,.1f}%")


def nulls_last(column: str, descending: bool) -> Column:
    return F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)


def sorted_by(rows: DataFrame, column: str, descending: bool, name: str = "category_group") -> DataFrame:
    """rows by any column, nulls last both ways, ties by name; slower from 0 sorts as the largest change."""
    key = F.col(column)
    if column == "pct":
        key = F.when(F.col("pct").isNull() & (F.col("direction") == "slower"), F.lit(float("inf"))).otherwise(key)
    return rows.withColumn("__key", key).orderBy(nulls_last("__key", descending), name).drop("__key")


def latest_notes(notes: DataFrame, n: int = 3) -> tuple[DataFrame, int]:
    """(the n newest notes, how many more there are)."""
    total = notes.count()
    return notes.orderBy(F.desc("day"), F.desc("closed_count"), "category_group").limit(n), max(0, total - n)


def notes_by(notes: DataFrame, grain: str) -> DataFrame:
    """(date, notes): notes under the day or the Monday week of a chart's point."""
    at = F.date_sub("day", F.weekday("day")) if grain == "week" else F.col("day")
    return notes.groupBy(at.alias("date")).agg(F.sort_array(F.collect_list(F.struct("day", "category_group", "closed_count"))).alias("notes"))


def chart_range(name: str, as_of: date, start: date) -> tuple[date, str]:
    """(first day, grain): all by week; the last year from a Monday by week; the last 90 days by day."""
    if name == "all":
        return start, "week"
    if name == "90d":
        return max(start, as_of - timedelta(89)), "day"
    year = as_of.replace(year=as_of.year - 1) if (as_of.month, as_of.day) != (2, 29) else as_of.replace(year=as_of.year - 1, day=28)
    return max(start, year - timedelta(year.weekday())), "week"


@dataclass(frozen=True)
class Filters:
    """What a shared address says; values that it leaves out are the defaults."""

    window: str = "90"
    category: str = ""
    district: str = ""
    range: str = "year"

    @classmethod
    def parse(cls, query: str) -> Filters:
        got = {k: v for k, v in parse_qsl(query.lstrip("?")) if k in DEFAULTS}
        if got.get("window") not in (None, "30", "90", "365"):
            del got["window"]
        if got.get("range") not in (None, "all", "year", "90d"):
            del got["range"]
        if "district" in got and got["district"] not in map(str, range(1, 9)):
            del got["district"]
        return cls(**got)

    def format(self) -> str:
        return urlencode({k: v for k, v in vars(self).items() if v != DEFAULTS[k]})
