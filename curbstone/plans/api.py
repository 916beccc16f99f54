"""The query surface: one function for each question of the dashboard, over published aggregates."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstone.functions.maps import CATEGORIES, UNMAPPED
from curbstone.functions.numbers import trend
from curbstone.operators.notes import sentence
from curbstone.plans.rules import BY, GRAINS, NotFound, Rules

STAT_COUNTS = ("opened_count", "closed_count", "excluded_count", "bulk_closed_count")


class Published:
    """One refresh's frames; a query reads them all from the same refresh.

    Frames: stats, open, backlog, exclusions, exclusions_open, date_problems, clear_outs. A frame may be given as a function, which is
    called when a query first needs it. categories and names (slug -> name) are what a query may ask for.

    cells(window, sets, where), if given, makes (stats, open) of one window for some grouping sets and values of dimensions alone:
    for figures that aren't stored.
    """

    def __init__(
        self, as_of: date, start: date, categories: list[str], names: dict[str, str], cells: Callable[..., tuple[DataFrame, DataFrame]] | None = None, **frames: DataFrame | Callable[[], DataFrame]
    ):
        self.cells = cells
        self.as_of, self.start, self.categories, self.names, self._frames = as_of, start, categories, names, frames

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name not in frames:
            raise AttributeError(name)
        frame = frames[name]
        if not isinstance(frame, DataFrame):
            frame = frames[name] = frame()
        return frame


def service_categories() -> list[str]:
    """Groups of the seeded map that are for service, and what isn't mapped."""
    return sorted({g for _, g, why in CATEGORIES if why is None} | {UNMAPPED})


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def cells(p: Published, window: int, slug: str | None, district: int, category: str | None) -> DataFrame:
    """Both periods and the open snapshot of each cell asked for.

    slug or category None: each value but, for neighborhoods, not all; '' all; else that one. A missing side is 0 or null.
    """
    keys = ["neighborhood_slug", "district_number", "category_group"]
    wanted = F.col("district_number") == district
    wanted = wanted & ((F.col("neighborhood_slug") != "") if slug is None else (F.col("neighborhood_slug") == slug))
    if category is not None:
        wanted = wanted & (F.col("category_group") == category)
    if p.cells:
        given = {k: v for k, v in zip(keys, (slug, district, category)) if v}
        open_ended = ("category_group",) if category is None else ()
        fixed = tuple(k for k in keys if k in given or (k == "neighborhood_slug" and slug is None))
        stats, open_ = p.cells(window, [fixed] + [tuple(k for k in keys if k in (*fixed, *open_ended))] * bool(open_ended), given)
    else:
        stats, open_ = p.stats.filter(F.col("window_days") == window), p.open
    rows = stats.filter(wanted).groupBy(*keys).pivot("period", ["current", "prior"])
    rows = rows.agg(*(F.max(c).alias(c) for c in (*STAT_COUNTS, "median_days", "p90_days")))
    rows = rows.join(open_.filter(wanted), keys, "full")
    counts = [F.coalesce(f"{s}_{c}", F.lit(0)).cast("long").alias(f"{s}_{c}") for s in ("current", "prior") for c in STAT_COUNTS]
    values = [f"{s}_{c}" for s in ("current", "prior") for c in ("median_days", "p90_days")]
    rows = rows.select(*keys, *counts, *values, F.coalesce("open_count", F.lit(0)).cast("long").alias("open_count"), "median_age_days")
    t = trend(F.col("current_closed_count"), cents(F.col("current_median_days")), F.col("prior_closed_count"), cents(F.col("prior_median_days")))
    return rows.withColumn("t", t).select("*", F.col("t.direction").alias("direction"), F.col("t.pct").alias("pct")).drop("t")


def with_names(p: Published, rows: DataFrame) -> DataFrame:
    """rows with the neighborhood's name, or its slug where no name is known."""
    names = rows.sparkSession.createDataFrame(list(p.names.items()), "neighborhood_slug string, __name string")
    return rows.join(F.broadcast(names), "neighborhood_slug", "left").withColumn("name", F.coalesce("__name", "neighborhood_slug")).drop("__name")


def neighborhoods(p: Published) -> DataFrame:
    """Neighborhoods that any request has."""
    return with_names(p, p.stats.filter("neighborhood_slug <> ''").select("neighborhood_slug").distinct()).orderBy("name")


def neighborhood_stats(p: Published, slug: str, window=None, category=None) -> DataFrame:
    r = Rules()
    w, c = r.window(window), r.known("category", category, p.categories)
    r.done()
    if slug not in p.names:
        raise NotFound(slug)
    return cells(p, w, slug, 0, c or "")


def category_summary(p: Published, window=None, district=None, neighborhood=None) -> DataFrame:
    """The total (category '') and each category, most opened first."""
    r = Rules()
    w, d, n = r.window(window), r.district(district), r.known("neighborhood", neighborhood, p.names)
    r.done()
    return cells(p, w, n or "", d, None).orderBy(F.desc("current_opened_count"), "category_group")


def map_cells(p: Published, window=None, category=None, district=None) -> DataFrame:
    r = Rules()
    w, c, d = r.window(window), r.known("category", category, p.categories), r.district(district)
    r.done()
    return with_names(p, cells(p, w, None, d, c or "")).orderBy("name")


def backlog(p: Published, first=None, last=None, category=None, district=None, grain=None) -> DataFrame:
    """(date, opened, closed, open_at_end) by day, or by Monday week with what was open at its last day's end."""
    r = Rules()
    a, b = r.day("from", first), r.day("to", last)
    c, d, g = r.known("category", category, p.categories), r.district(district), r.one_of("grain", grain, GRAINS)
    r.order(a, b)
    r.done()
    a, b = max(a or p.start, p.start), min(b or p.as_of, p.as_of)
    rows = p.backlog.filter((F.col("district_number") == d) & (F.col("category_group") == (c or "")) & F.col("day").between(F.lit(a), F.lit(b)))
    if g == "week":
        week = F.date_sub("day", F.weekday("day"))
        rows = rows.groupBy(week.alias("date")).agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"), F.max_by("open_at_end", "day").alias("open_at_end"))
        return rows.orderBy("date")
    return rows.select(F.col("day").alias("date"), "opened", "closed", "open_at_end").orderBy("date")


def getting_slower(p: Published, by=None, window=None, category=None, district=None, limit=None) -> DataFrame:
    """Neighborhoods or categories by the days that their median gained, most first."""
    r = Rules()
    kind, w, n = r.one_of("by", by, BY), r.window(window), r.limit(limit)
    c, d = r.known("category", category, p.categories), r.district(district)
    r.not_both(kind == "category" and bool(c), "category", "can't be used with by=category")
    r.done()
    rows = cells(p, w, None, d, c or "") if kind == "neighborhood" else cells(p, w, "", d, None).filter("category_group <> ''")
    name = F.col("neighborhood_slug" if kind == "neighborhood" else "category_group").alias("name")
    rows = rows.filter("direction = 'slower'").withColumn("added_days", (cents(F.col("current_median_days")) - cents(F.col("prior_median_days"))) / 100)
    rows = rows.select(name, "added_days", "pct", "current_median_days", "prior_median_days")
    return rows.orderBy(F.desc("added_days"), F.desc_nulls_first("pct"), "name").limit(n)


def trend_counts(p: Published, by=None, window=None) -> DataFrame:
    r = Rules()
    kind, w = r.one_of("by", by, BY), r.window(window)
    r.done()
    rows = cells(p, w, None, 0, "") if kind == "neighborhood" else cells(p, w, "", 0, None).filter("category_group <> ''")
    n = lambda k: F.count_if(F.col("direction") == k).alias(k)
    return rows.agg(n("slower"), n("steady"), n("faster"), F.count_if(F.col("direction").isNull()).alias("none"))


def exclusions(p: Published, window=None) -> DataFrame:
    """(kind, label, opened, closed, open) left out of headline figures in the current period, and open now."""
    r = Rules()
    w = r.window(window)
    r.done()
    now = F.col("window_days") == w
    types = p.exclusions.filter(now & (F.col("period") == "current")).select("type_group", "type_label", "opened_count", "closed_count")
    types = types.join(p.exclusions_open.select("type_group", "type_label", "open_count"), ["type_group", "type_label"], "full").fillna(0, ["opened_count", "closed_count", "open_count"])
    types = types.select(F.lit("non_service").alias("kind"), F.col("type_group").alias("category_group"), F.col("type_label").alias("label"), "opened_count", "closed_count", "open_count")
    zero = F.lit(0).cast("long")
    flags = p.date_problems.filter(now & (F.col("period") == "current"))
    flags = flags.select(F.lit("dq_flag").alias("kind"), F.lit("").alias("category_group"), "label", zero.alias("opened_count"), "closed_count", zero.alias("open_count"))
    return types.unionByName(flags).orderBy("kind", F.desc(F.col("opened_count") + F.col("closed_count")), F.desc("open_count"), "label")


def clear_out_notes(p: Published, first=None, last=None, category=None) -> DataFrame:
    r = Rules()
    a, b, c = r.day("from", first), r.day("to", last), r.known("category", category, p.categories)
    r.order(a, b)
    r.done()
    a, b = max(a or p.start, p.start), min(b or p.as_of, p.as_of)
    rows = p.clear_outs.filter(F.col("day").between(F.lit(a), F.lit(b)))
    rows = rows.filter(F.col("category_group") == c) if c else rows
    col = F.col
    words = sentence(col("day"), col("category_group"), col("closed_count"), col("avg_age_days"), col("minutes_spanned"), col("sweep_categories"))
    return rows.withColumn("sentence", words).orderBy(F.desc("day"), F.desc("closed_count"), "category_group")


def totals(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns))


def boundaries(spark, path: str) -> DataFrame:
    """(name, slug, geometry as JSON) of each feature of a GeoJSON file."""
    from curbstone.functions.text import slug

    schema = "features array<struct<properties: struct<NAME: string>, geometry: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    name = F.col("f.properties.NAME")
    return rows.select(name.alias("name"), slug(name).alias("slug"), F.col("f.geometry").alias("geometry"))
