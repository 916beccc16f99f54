"""Line deduplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstone.llm.common import keep

#: Share of a site's pages above which a line is boilerplate, and the fewest pages that must hold it.
RATIO, LEAST_PAGES = 0.02, 5
#: Boilerplate lines up to which they are sent to all executors (24 bytes each); beyond, they are joined by a shuffle.
BROADCAST_LINES = 100_000
#: Parts that a site's set of line hashes is cut into, so that a lookup scans a short list.
SLOTS = 64
#: Copies of the boilerplate table in the shuffle join, over which a frequent line's rows are spread.
SALTS = 32


def line_key(line: Column) -> Column:
    """What makes two lines the same: their text without white space at the ends; null for a blank line."""
    return F.nullif(F.btrim(line, F.lit("\x20\x09\x0a\x0b\x0c\x0d")), F.lit(""))


def _host(site: Column) -> Column:
    return F.when(site.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), site.cast("string")))


def _hashes(text: Column) -> Column:
    """A hash for each line of the text, null for blank ones."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(line_key(x).isNotNull(), F.xxhash64(line_key(x))))


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(host, line, pages, site_pages): line hashes on at least `least` pages of a site and on over `ratio` of its pages.

    A page counts once for each line; counts are summed within tasks before the shuffle, so a frequent line or a
    large site costs one row for each task.
    """
    rows = docs.select(_host(F.col(site)).alias("host"), F.col(text).alias("text"))
    pages = rows.groupBy("host").agg(F.count(F.lit(1)).alias("site_pages"))
    lines = rows.select("host", F.explode(F.array_distinct(F.array_compact(_hashes(F.col("text"))))).alias("line"))
    seen = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least)
    return seen.join(pages, "host").filter(F.col("pages") > ratio * F.col("site_pages"))


def dedup_lines(
    docs: DataFrame,
    site: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    least: int = LEAST_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """docs with boilerplate lines taken out of their texts, plus n_lines and n_dropped.

    Lines are split at newlines and compared without white space at their ends. A line goes, from every page of its
    site, if at least `least` pages of the site hold it and they are more than `ratio` of the site's pages. Blank lines
    stay, and so do the other lines, their order and their white space. A null text stays null (no lines); null sites
    form one site; equal rows are so many pages; an empty table gives no rows. Other columns are kept as they are,
    but those named n_lines or n_dropped are replaced.

    Up to broadcast_lines boilerplate lines, counted first, go to all executors as sets for each site; beyond that the
    lines are joined by (site, line, salt) and gathered for each document.
    """
    drop = keep(boilerplate(docs, site, text, ratio, least).select("host", "line"))
    if drop.count() <= broadcast_lines:
        return _by_broadcast(docs, drop, site, text)
    return _by_shuffle(docs, drop, site, text)


def _rest(docs: DataFrame, text: str, is_dropped) -> DataFrame:
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x: ~is_dropped(F.xxhash64(line_key(x))) | line_key(x).isNull())
    out = docs.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long"))
    return out.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col(text)))


def _by_broadcast(docs: DataFrame, drop: DataFrame, site: str, text: str) -> DataFrame:
    slot = F.pmod("line", F.lit(SLOTS)).cast("int")
    sets = drop.groupBy("host", slot.alias("slot")).agg(F.collect_list("line").alias("lines"))
    sets = sets.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "lines"))).alias("m"))
    empty = F.expr("cast(array() as array<bigint>)")
    sets = sets.select(
        F.col("host").alias("__host"),
        F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), empty)).alias("__drop"),
    )
    joined = docs.withColumn("__host", _host(F.col(site))).join(F.broadcast(sets), "__host", "left")
    has = lambda h: F.coalesce(F.array_contains(F.get("__drop", F.pmod(h, F.lit(SLOTS)).cast("int")), h), F.lit(False))
    return _rest(joined, text, has).drop("__host", "__drop")


def _by_shuffle(docs: DataFrame, drop: DataFrame, site: str, text: str) -> DataFrame:
    rows = docs.withColumn("__host", _host(F.col(site))).withColumn("__row", F.xxhash64(F.struct(*[c for c, t in docs.dtypes if not t.startswith("map")])))
    lines = rows.select("__host", "__row", F.explode(F.array_distinct(F.array_compact(_hashes(F.col(text))))).alias("line")).distinct()
    lines = lines.withColumn("salt", F.pmod("__row", F.lit(SALTS)).cast("int"))
    salted = drop.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("host", "__host")
    found = lines.join(salted, ["__host", "line", "salt"]).groupBy("__row").agg(F.collect_list("line").alias("__drop"))
    joined = rows.join(found, "__row", "left")
    has = lambda h: F.coalesce(F.array_contains("__drop", h), F.lit(False))
    return _rest(joined, text, has).drop("__host", "__row", "__drop")
