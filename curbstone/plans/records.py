"""Queries on cleaning, versions, maps, reconciliation and data quality."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbstone.functions.maps import NEIGHBORHOODS, category_map, flag_map, neighborhood_map, slug_of, source_map
from curbstone.functions.sql import register
from curbstone.functions.text import map_key, null_if_blank, slug
from curbstone.operators.constraints import Rules, violations
from curbstone.operators.notes import clear_outs, date_problem_closures, non_service_by_period, non_service_open, sentence
from curbstone.operators.profile import attribute_counts, match_rate, served_statistics
from curbstone.operators.reconcile import newest_keys, places, removed, restored, to_refetch
from curbstone.plans import domain as D
from curbstone.plans.figures import PERIODS
from curbstone.plans.registry import add
from curbstone.sources.feed import FeedSource, slice_where, with_functions
from curbstone.sources.served import argument, pages_of, statistics_of

add("win1_latest_version", lambda s, d: D.newest_versions(s, d).select("reference_number", "object_id", "public_status", "updated_ts"), f"{D.SQL} SELECT reference_number, object_id, public_status, updated_ts FROM latest")


def duplicates(spark, d):
    """AGG-27: staged rows less distinct requests."""
    rows = D.versions(spark, d)
    return rows.groupBy("public_status").agg((F.count(F.lit(1)) - F.count_distinct("reference_number")).alias("duplicates"))


add("agg27_duplicates", duplicates, f"{D.SQL} SELECT public_status, count(*) - count(DISTINCT reference_number) AS duplicates FROM versions GROUP BY ALL")
add(
    "join1_mapped",
    lambda s, d: D.cleaned(s, d).groupBy("category_level1", "source_level1", "category_group", "source_channel").agg(F.count(F.lit(1)).alias("n")),
    f"{D.SQL} SELECT category_level1, source_level1, category_group, source_channel, count(*) AS n FROM cleaned GROUP BY ALL",
)
add("scl10_scl11_resolution", lambda s, d: D.cleaned(s, d).select("reference_number", "status_group", "created_date", "backlog_close_date", "hundredths", "dq_flags"), f"{D.SQL} SELECT reference_number, status_group, created_date, backlog_close_date, hundredths, dq_flags FROM cleaned")

# The text cleaners on names of all tables; DuckDB's \s is ASCII, and so are these texts.
NAMES = "SELECT n_name AS t FROM nation UNION ALL SELECT p_name FROM part UNION ALL SELECT '  ' || replace(c_name, '#', ' / ') || '  ' FROM customer UNION ALL SELECT lang FROM documents"


def texts(spark, d):
    t = lambda n, c: D.load(spark, d, n).select(c.alias("t"))
    padded = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(" / ")), F.lit("  "))
    rows = t("nation", F.col("n_name")).union(t("part", F.col("p_name"))).union(t("customer", padded)).union(t("documents", F.col("lang")))
    return rows.select("t", null_if_blank(F.col("t")).alias("plain"), map_key(F.col("t")).alias("map_key"), slug(F.col("t")).alias("slug"))


add("scl1_scl2_scl8_texts", texts, f"""SELECT t, nullif(regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '') AS plain, {D.key_sql('t')} AS map_key,
  nullif(regexp_replace(regexp_replace(regexp_replace(lower(t), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug FROM ({NAMES})""")


def local_days(spark, d):
    """SCL-9 on the event stream: local days of UTC times."""
    from curbstone.functions.clean import local_date

    return D.load(spark, d, "events").groupBy(local_date(F.col("ts")).alias("local_day")).agg(F.count(F.lit(1)).alias("n"))


add("scl9_local_days", local_days, "SELECT ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')::DATE AS local_day, count(*) AS n FROM events GROUP BY ALL")

# Notes and exclusions.
_pairs = lambda s, rows: D.non_service_pairs(rows, D.category_map(s), D.line_map(s))


def excluded(spark, d):
    rows = D.requests(spark, d)
    return non_service_by_period(rows, _pairs(spark, rows), D.as_of(), D.WINDOWS).drop("type_reason")


def excluded_open(spark, d):
    rows = D.requests(spark, d)
    return non_service_open(rows, _pairs(spark, rows), D.as_of()).drop("type_reason")


TYPED = f"""typed AS (SELECT r.created_date, r.backlog_close_date, r.status_group, p.category_group AS type_group, p.label AS type_label
  FROM requests r JOIN pairs p ON r.category_level1 = p.category_level1 AND r.category_level2 IS NOT DISTINCT FROM p.category_level2 WHERE NOT r.service)"""
TYPED_PERIODS = f"""{TYPED}, {PERIODS}, typed_periods AS (SELECT window_days, period, type_group, type_label, count(*) FILTER (created_date > before_day AND created_date <= to_day) AS opened_count,
  count(*) FILTER (status_group = 'Closed' AND backlog_close_date > before_day AND backlog_close_date <= to_day) AS closed_count
  FROM typed JOIN periods ON (created_date > before_day AND created_date <= to_day) OR (status_group = 'Closed' AND backlog_close_date > before_day AND backlog_close_date <= to_day) GROUP BY ALL)"""
TYPED_OPEN = f"typed_open AS (SELECT type_group, type_label, count(*) AS open_count FROM typed WHERE created_date <= DATE '{D.AS_OF}' AND (backlog_close_date IS NULL OR backlog_close_date > DATE '{D.AS_OF}') GROUP BY ALL)"
add("agg16_non_service_periods", excluded, f"{D.SQL}, {TYPED_PERIODS} SELECT * FROM typed_periods")
add("agg17_non_service_open", excluded_open, f"{D.SQL}, {TYPED}, {TYPED_OPEN} SELECT * FROM typed_open")


def exclusion_types(spark, d):
    """JOIN-18: window types with open-now types, each side's missing counts 0; SORT-5 order."""
    w = excluded(spark, d).filter("window_days = 90 and period = 'current'").drop("window_days", "period")
    rows = w.join(excluded_open(spark, d), ["type_group", "type_label"], "full").fillna(0)
    return rows.orderBy(F.desc(F.col("opened_count") + F.col("closed_count")), "type_label")


add("join18_exclusion_types", exclusion_types, f"""{D.SQL}, {TYPED_PERIODS}, {TYPED_OPEN} SELECT type_group, type_label, coalesce(opened_count, 0) AS opened_count, coalesce(closed_count, 0) AS closed_count,
  coalesce(open_count, 0) AS open_count FROM (SELECT * FROM typed_periods WHERE window_days = 90 AND period = 'current') FULL JOIN typed_open USING (type_group, type_label)""")
add("agg18_join12_date_problems", lambda s, d: date_problem_closures(D.requests(s, d), D.as_of(), D.WINDOWS).drop("reason"), f"""{D.SQL}, {PERIODS} SELECT window_days, period, name AS label, count(*) AS closed_count
  FROM requests JOIN periods ON backlog_close_date > before_day AND backlog_close_date <= to_day JOIN flag_map ON bit & 15 <> 0 AND dq_flags & bit <> 0
  WHERE service AND status_group = 'Closed' AND dq_flags & 15 <> 0 GROUP BY ALL""")

NOTES_FROM = "2000-01-01"
NOTES = f"""members AS (SELECT closed_date AS day, category_group, date_trunc('minute', closed_ts) AS m, hundredths FROM requests WHERE bulk AND service AND status_group = 'Closed' AND closed_date >= DATE '{NOTES_FROM}'),
  sm AS (SELECT m FROM members GROUP BY m HAVING count(*) FILTER (hundredths > 18000) >= {D.SWEEP_LEAST} AND count(DISTINCT category_group) > 1),
  pm AS (SELECT m, day, category_group, count(*) AS n FROM members WHERE m IN (FROM sm) GROUP BY ALL),
  others AS (SELECT a.day, a.category_group, b.category_group AS other, sum(b.n) AS n FROM pm a JOIN pm b ON a.m = b.m AND a.category_group <> b.category_group GROUP BY ALL),
  listed AS (SELECT day, category_group, list(other ORDER BY n DESC, other) AS sweep FROM others GROUP BY ALL),
  notes AS (SELECT day, category_group, count(*) AS closed_count, ((2 * sum(hundredths) + count(*)) // (2 * count(*))) / 100.0::DOUBLE AS avg_age_days,
    (date_diff('minute', min(m), max(m)) + 1)::INT AS minutes_spanned FROM members GROUP BY ALL),
  clear_outs AS (SELECT *, sweep IS NOT NULL AS is_sweep, array_to_string(sweep, ', ') AS sweep_categories FROM notes LEFT JOIN listed USING (day, category_group))"""


def notes(spark, d):
    return clear_outs(D.requests(spark, d), F.lit(NOTES_FROM).cast("date"), D.SWEEP_LEAST)


add("agg13_agg14_agg15_clear_outs", lambda s, d: notes(s, d).withColumn("sweep_categories", F.array_join("sweep_categories", ", ")), f"{D.SQL}, {NOTES} SELECT day, category_group, closed_count, avg_age_days, minutes_spanned, is_sweep, sweep_categories FROM clear_outs")


def sentences(spark, d):
    c = F.col
    return notes(spark, d).select("day", "category_group", sentence(c("day"), c("category_group"), c("closed_count"), c("avg_age_days"), c("minutes_spanned"), c("sweep_categories")).alias("sentence"))


add("scl19_sentences", sentences, f"""{D.SQL}, {NOTES} SELECT day, category_group, 'On ' || day || ', ' || category_group || ' closed ' ||
  CASE WHEN closed_count = 1 THEN '1 request ' || format('{{:,}}', floor(avg_age_days + 0.5)::BIGINT) || ' days old'
    ELSE format('{{:,}}', closed_count) || ' requests averaging ' || format('{{:,}}', floor(avg_age_days + 0.5)::BIGINT) || ' days old' ||
      CASE WHEN minutes_spanned <= 1 THEN ' in one minute' ELSE ' over ' || format('{{:,}}', minutes_spanned) || ' minutes' END END || '.' ||
  CASE WHEN sweep IS NULL THEN '' ELSE ' In the same minute, ' || CASE WHEN len(sweep) = 1 THEN sweep[1] ELSE array_to_string(sweep[1:-2], ', ') || ' and ' || sweep[-1] END || ' also closed old requests.' END AS sentence
  FROM clear_outs""")

# Reconciliation: what is held are the newest versions; what the source serves leaves some keys out and has some newer.
HELD = "held AS (SELECT reference_number, updated_ts AS updated_utc, hash % 11 = 0 AS was_removed FROM (SELECT *, object_id + day(created_ts) AS hash FROM latest) WHERE hash % 13 <> 0)"
SERVED = "feed AS (SELECT reference_number, updated_ts + CASE WHEN object_id % 5 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS updated_utc FROM versions WHERE object_id % 7 <> 0)"


def held(spark, d):
    rows = D.newest_versions(spark, d).withColumn("hash", F.col("object_id") + F.dayofmonth("created_ts")).filter("hash % 13 <> 0")
    return rows.select("reference_number", F.col("updated_ts").alias("updated_utc"), (F.col("hash") % 11 == 0).alias("was_removed"))


def feed(spark, d):
    later = F.when(F.col("object_id") % 5 == 0, F.col("updated_ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("updated_ts"))
    return D.versions(spark, d).filter("object_id % 7 <> 0").select("reference_number", later.alias("updated_utc"))


_KEYS = f"{D.SQL}, {HELD}, {SERVED}, keys AS (SELECT reference_number, max(updated_utc) AS updated_utc FROM feed GROUP BY ALL)"
add("win5_newest_keys", lambda s, d: newest_keys(feed(s, d)), f"{_KEYS} SELECT * FROM keys")
add("join5_removed", lambda s, d: removed(held(s, d), newest_keys(feed(s, d))).select("reference_number"), f"{_KEYS} SELECT reference_number FROM held WHERE NOT was_removed AND reference_number NOT IN (SELECT reference_number FROM keys)")
add("join6_restored", lambda s, d: restored(held(s, d), newest_keys(feed(s, d))).select("reference_number"), f"{_KEYS} SELECT reference_number FROM held WHERE was_removed AND reference_number IN (SELECT reference_number FROM keys)")
add("join7_refetch", lambda s, d: to_refetch(held(s, d), newest_keys(feed(s, d))), f"{_KEYS} SELECT k.reference_number FROM keys k LEFT JOIN held h USING (reference_number) WHERE h.reference_number IS NULL OR k.updated_utc > h.updated_utc")


def chunks(spark, d):
    """SORT-8: the refetch list in key order, in chunks of 200."""
    rows = D.newest_versions(spark, d).select("public_status", "reference_number")
    return places(rows, "public_status", "reference_number").withColumn("chunk", F.floor(F.col("place") / 200)).groupBy("public_status", "chunk").agg(F.min("reference_number").alias("first"), F.max("reference_number").alias("last"), F.count(F.lit(1)).alias("n"))


add("sort8_flt3_chunks", chunks, f"""{D.SQL} SELECT public_status, chunk, min(reference_number) AS "first", max(reference_number) AS "last", count(*) AS n
  FROM (SELECT public_status, reference_number, (row_number() OVER (PARTITION BY public_status ORDER BY reference_number) - 1) // 200 AS chunk FROM latest) GROUP BY ALL""")


# Data quality.
def null_rates(spark, d):
    """AGG-19: nulls among requests created in the last 30 days and the 365 before, in one scan."""
    rows = D.cleaned(spark, d).withColumn("recent", F.col("created_date") > F.date_sub(D.as_of(), 30)).filter((F.col("created_date") > F.date_sub(D.as_of(), 395)) & (F.col("created_date") <= D.as_of()))
    return rows.groupBy("recent").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("category_level2").isNull()).alias("no_line"), F.count_if(F.col("district_number").isNull()).alias("no_district"),
        F.count_if(F.col("is_city") & F.col("neighborhood").isNull()).alias("no_neighborhood"), F.count_if("is_city").alias("in_city"),
    )


add("agg19_null_rates", null_rates, f"""{D.SQL} SELECT created_date > DATE '{D.AS_OF}' - 30 AS recent, count(*) AS n, count(*) FILTER (category_level2 IS NULL) AS no_line, count(*) FILTER (district_number IS NULL) AS no_district,
  count(*) FILTER (is_city AND neighborhood IS NULL) AS no_neighborhood, count(*) FILTER (is_city) AS in_city FROM cleaned WHERE created_date > DATE '{D.AS_OF}' - 395 AND created_date <= DATE '{D.AS_OF}' GROUP BY ALL""")


def busiest(spark, d):
    """SORT-2: busiest customers stand for addresses."""
    return D.load(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


add("sort2_busiest", busiest, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, o_custkey LIMIT 10")


def newest_checks(spark, d):
    """WIN-2, AGG-21: the newest event of each type, by time and then id."""
    order = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = D.load(spark, d, "events").withColumn("rn", F.row_number().over(order)).withColumn("most", F.max("value").over(Window.partitionBy("event_type")))
    return rows.filter("rn = 1").select("event_type", "event_id", "ts", "value", "most")


add("win2_agg21_newest_check", newest_checks, "SELECT event_type, event_id, ts, value, most FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS most FROM events) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")


def statuses(spark, d):
    """AGG-25: events by type as checks by status, with the ids of the first few."""
    rows = D.load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("over"))
    return rows.withColumn("status", F.when(F.col("over") > 0.05 * F.col("n"), "Warn").otherwise("Pass"))


add("agg25_scl27_status_counts", statuses, """SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS "over", CASE WHEN count(*) FILTER (value > 100) > 0.05 * count(*) THEN 'Warn' ELSE 'Pass' END AS status FROM events GROUP BY ALL""")

# The feed: events served as a feed, read and profiled through the library's sources.
def _events(d: str) -> str:
    return argument(f"{d}/events.parquet", OBJECTID="event_id", ReferenceNumber="event_type", DateUpdated="ts")


def served_events(spark, d, **options):
    spark.dataSource.register(with_functions(FeedSource, feed=pages_of))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("keyset_feed").options(argument=_events(d), pushdown="true", **options).load()


def pushed(spark, d):
    """SRC-1, FLT-1, FLT-2: filters of Spark's that the feed is asked for, those on the feature left to Spark."""
    rows = served_events(spark, d, last=1 << 40).filter("object_id > 100 and object_id <= 9000 and date_updated >= 1704153600000 and date_updated < 1706000000500")
    rows = rows.filter(F.col("reference_number").isin("click", "view", "error"))
    value = F.get_json_object("feature", "$.attributes.value").cast("double")
    return rows.withColumn("value", value).filter("value > 5").select("object_id", "reference_number", "date_updated", "value")


#: Rows of the feed in a range of ids, about; each range is a task.
RANGE = 125_000


def keyset_scan(spark, d):
    """SRC-1, SORT-10: the whole feed by keyset pages, in ranges of ids whose ends and number the feed's own figures give."""
    n, ends = served_statistics(spark, statistics_of, "count OBJECTID, max OBJECTID", argument=_events(d)).first()
    rows = served_events(spark, d, after=-1, last=ends or 0, ranges=max(4, math.ceil(n / RANGE)), pageSize=500)
    return rows.select("object_id", "reference_number", F.get_json_object("feature", "$.attributes.user_id").cast("long").alias("user_id"))


def served_profile(spark, d, asked, group=None, **more):
    return served_statistics(spark, statistics_of, asked, group, argument=_events(d), **more)


add("src1_flt1_flt2_pushed", pushed, """SELECT event_id AS object_id, event_type AS reference_number, epoch_us(ts) // 1000 AS date_updated, value FROM events WHERE event_id > 100 AND event_id <= 9000
  AND epoch_us(ts) // 1000 >= 1704153600000 AND epoch_us(ts) // 1000 < 1706000000500 AND event_type IN ('click', 'view', 'error') AND value > 5""")
add("src1_sort10_keyset_scan", keyset_scan, "SELECT event_id AS object_id, event_type AS reference_number, user_id FROM events")
add("src2_src3_served_profile", lambda s, d: served_profile(s, d, "count OBJECTID, min OBJECTID, max OBJECTID, min DateUpdated, max DateUpdated", first=0, last=1 << 17, ranges=4), """SELECT count(*) AS count_objectid, min(event_id) AS min_objectid,
  max(event_id) AS max_objectid, min(epoch_us(ts) // 1000) AS min_dateupdated, max(epoch_us(ts) // 1000) AS max_dateupdated FROM events WHERE event_id <= 131072""")
add("src2_served_count", lambda s, d: served_profile(s, d, "count OBJECTID", where=slice_where(datetime(2024, 1, 5), datetime(2024, 1, 20))), "SELECT count(*) AS count_objectid FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
add("src4_served_groups", lambda s, d: served_profile(s, d, "count OBJECTID, max DateUpdated", "ReferenceNumber", first=0, last=1 << 17, ranges=3).orderBy(F.desc("count_objectid"), "value"), """SELECT event_type AS value, count(*) AS count_objectid,
  max(epoch_us(ts) // 1000) AS max_dateupdated FROM events WHERE event_id <= 131072 GROUP BY ALL""")
add("src5_served_distinct", lambda s, d: served_profile(s, d, "distinct ReferenceNumber"), "SELECT count(DISTINCT event_type) AS distinct_referencenumber FROM events")

# Source profile of rows at hand.
add("src2_src3_src5_profile", lambda s, d: D.versions(s, d).agg(F.count(F.lit(1)).alias("n"), F.min("object_id").alias("first_id"), F.max("object_id").alias("last_id"), F.count_distinct("reference_number").alias("references")), f"""{D.SQL} SELECT count(*) AS n, min(object_id) AS first_id, max(object_id) AS last_id, count(DISTINCT reference_number) AS "references" FROM versions""")
add("src4_value_counts", lambda s, d: attribute_counts(D.versions(s, d), "category_level1"), f"{D.SQL} SELECT category_level1 AS value, count(*) AS n FROM versions GROUP BY ALL")
add("src1_sort10_keyset_page", lambda s, d: D.load(s, d, "events").filter("event_id > 4000").orderBy("event_id").limit(2000), "SELECT * FROM events WHERE event_id > 4000 ORDER BY event_id LIMIT 2000")
add("src8_offset_page", lambda s, d: D.load(s, d, "events").orderBy("event_id").offset(4000).limit(500), "SELECT * FROM events ORDER BY event_id LIMIT 500 OFFSET 4000")
add("src6_envelope", lambda s, d: D.load(s, d, "supplier").filter("s_suppkey between 10 and 60 and s_acctbal between -500.0 and 6000.0"), "SELECT * FROM supplier WHERE s_suppkey BETWEEN 10 AND 60 AND s_acctbal BETWEEN -500.0 AND 6000.0")


def text_profile(spark, d):
    """FLT-11: predicates over texts counted in one pass."""
    t = F.col("text")
    return D.load(spark, d, "documents").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t.isNull()).alias("no_text"), F.count_if(t == "").alias("blank"), F.count_if(F.char_length(t) < 30).alias("short"),
        F.count_if(t.contains("token")).alias("has_token"), F.count_if(F.col("n_chars") != F.char_length(t)).alias("wrong_length"),
    )


add("flt11_text_profile", text_profile, """SELECT count(*) AS n, count(*) FILTER (text IS NULL) AS no_text, count(*) FILTER (text = '') AS blank, count(*) FILTER (length(text) < 30) AS "short",
  count(*) FILTER (contains(text, 'token')) AS has_token, count(*) FILTER (n_chars <> length(text)) AS wrong_length FROM documents""")


def boundary_match(spark, d):
    """JOIN-19, AGG-28: neighborhoods of requests against names that a boundary file has, here those of even nations."""
    rows = D.cleaned(spark, d).filter("neighborhood is not null").groupBy("neighborhood").agg(F.count(F.lit(1)).alias("n"))
    names = D.load(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"))
    return match_rate(rows, names)


add("join19_agg28_match_rate", boundary_match, f"""{D.SQL} SELECT sum(n)::BIGINT AS n, sum(n) FILTER (m)::BIGINT AS matched, count(*) FILTER (NOT m) AS unmatched_names, (sum(n) FILTER (m))::DOUBLE / sum(n) AS rate
  FROM (SELECT neighborhood, count(*) AS n, {D.key_sql('neighborhood')} IN (SELECT {D.key_sql('n_name')} FROM nation WHERE n_nationkey % 2 = 0) AS m FROM cleaned WHERE neighborhood IS NOT NULL GROUP BY ALL)""")


def orphans(spark, d):
    """SET-6: names of the boundary file that no request has."""
    names = D.load(spark, d, "nation").select(F.col("n_name").alias("name"))
    used = D.cleaned(spark, d).select(map_key(F.col("neighborhood")).alias("k")).distinct()
    return names.join(used, map_key(F.col("name")) == F.col("k"), "left_anti")


add("set6_orphans", orphans, f"{D.SQL} SELECT n_name AS name FROM nation WHERE {D.key_sql('n_name')} NOT IN (SELECT {D.key_sql('neighborhood')} FROM cleaned WHERE neighborhood IS NOT NULL)")


def candidates(spark, d):
    """AGG-29: lines of which most closures are quick."""
    rows = D.cleaned(spark, d).filter("timed").groupBy("category_level1", "category_level2")
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hundredths") <= 40000).alias("quick"))
    return rows.filter((F.col("n") >= 40) & (F.col("quick") * 10 >= F.col("n") * 4))


add("agg29_candidates", candidates, f"{D.SQL}, t AS (SELECT c.* FROM served c WHERE timed) SELECT category_level1, category_level2, count(*) AS n, count(*) FILTER (hundredths <= 40000) AS quick FROM t GROUP BY ALL HAVING count(*) >= 40 AND count(*) FILTER (hundredths <= 40000) * 10 >= count(*) * 4")


def symmetry(spark, d):
    """AGG-30, SET-5: the largest day and the largest minute of quick closures."""
    rows = D.cleaned(spark, d).filter("timed and hundredths <= 40000")
    most = lambda what, *by: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.lit(what).alias("what"), F.max("n").alias("most"))
    return most("day", "closed_date", "category_group").unionByName(most("minute", F.date_trunc("minute", "closed_ts")))


add("agg30_set5_symmetry", symmetry, f"""{D.SQL}, t AS (SELECT * FROM served WHERE timed AND hundredths <= 40000)
  SELECT 'day' AS what, max(n) AS most FROM (SELECT count(*) AS n FROM t GROUP BY closed_date, category_group) UNION ALL SELECT 'minute', max(n) FROM (SELECT count(*) AS n FROM t GROUP BY date_trunc('minute', closed_ts))""")

# Reference data with the requests that use it.
def _used(rows, key, seed, by):
    n = rows.groupBy(key.alias(by)).agg(F.count(F.lit(1)).alias("requests"))
    return seed.join(n, by, "left").fillna(0, ["requests"])


def flags_used(s, d):
    bits = D.cleaned(s, d).select(F.explode(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda k: F.col("dq_flags").bitwiseAND(F.pow(F.lit(2), k).cast("int")) != 0)).alias("k"))
    n = bits.groupBy(F.pow(F.lit(2), F.col("k")).cast("int").alias("bit")).agg(F.count(F.lit(1)).alias("requests"))
    return flag_map(s).join(n, "bit", "left").fillna(0, ["requests"])


add("join20_seed_categories", lambda s, d: _used(D.cleaned(s, d), map_key(F.col("category_level1")), category_map(s).select("category_key", "source_value", "category_group", "is_service"), "category_key"), f"""{D.SQL} SELECT k AS category_key, v AS source_value, g AS category_group,
  reason IS NULL AS is_service, coalesce(n, 0) AS requests FROM category_map LEFT JOIN (SELECT {D.key_sql('category_level1')} AS k, count(*) AS n FROM cleaned GROUP BY ALL) USING (k)""")
add("seed_sources", lambda s, d: _used(D.cleaned(s, d), map_key(F.col("source_level1")), source_map(s).select("source_key", "source_channel"), "source_key"), f"""{D.SQL} SELECT k AS source_key, c AS source_channel, coalesce(n, 0) AS requests
  FROM source_map LEFT JOIN (SELECT {D.key_sql('source_level1')} AS k, count(*) AS n FROM cleaned GROUP BY ALL) USING (k)""")
add("seed_flags", flags_used, f"{D.SQL} SELECT f.*, (SELECT count(*) FROM cleaned c WHERE c.dq_flags & f.bit <> 0) AS requests FROM flag_map f")
NAMES_SQL = D._values("seed", "neighborhood_slug, neighborhood", [(slug_of(n), n) for n in NEIGHBORHOODS])
add("set2_seed_neighborhoods", lambda s, d: _used(D.cleaned(s, d), F.col("neighborhood_slug"), neighborhood_map(s).select("neighborhood_slug", "neighborhood").distinct(), "neighborhood_slug"), f"""{D.SQL}, {NAMES_SQL}
  SELECT DISTINCT neighborhood_slug, neighborhood, coalesce(n, 0) AS requests FROM seed LEFT JOIN (SELECT neighborhood_slug, count(*) AS n FROM cleaned GROUP BY ALL) USING (neighborhood_slug)""")


# The cleaners as SQL functions.
def sql_texts(spark, d):
    register(spark)
    names = D.load(spark, d, "nation").select(F.col("n_name").alias("t")).union(D.load(spark, d, "customer").select(F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit(" / ")), F.lit("  "))))
    return spark.sql("SELECT t, null_if_blank(t) AS plain, map_key(t) AS map_key, slug(t) AS slug, clean_zip(right(t, 5)) AS zip FROM {names}", names=names)


def sql_days(spark, d):
    register(spark)
    return spark.sql("SELECT local_date(ts) AS local_day, week_start(local_date(ts)) AS week, count(*) AS n FROM {events} GROUP BY ALL", events=D.load(spark, d, "events"))


add("scl1_scl2_scl8_scl13_sql", sql_texts, f"""SELECT t, nullif(regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '') AS plain, {D.key_sql('t')} AS map_key,
  nullif(regexp_replace(regexp_replace(regexp_replace(lower(t), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug,
  nullif(regexp_extract(trim(right(t, 5)), '^([0-9]{{5}})$', 1), '') AS zip FROM (SELECT n_name AS t FROM nation UNION ALL SELECT ' ' || replace(c_name, '#', ' / ') || '  ' FROM customer)""")
add("scl9_scl17_sql", sql_days, """SELECT local_day, date_trunc('week', local_day)::DATE AS week, count(*) AS n FROM (SELECT ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')::DATE AS local_day FROM events) GROUP BY ALL""")


# What is published, against its rules; here the orders stand for a table in which a third of the keys come twice.
def broken_rules(spark, d):
    rows = D.load(spark, d, "orders").select((F.col("o_orderkey") - F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("k"), "o_orderstatus", (F.col("o_orderkey") % 7 - 1).alias("n"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 5).alias("low"), (F.col("o_custkey") % 4).alias("high"))
    return violations({"orders": (rows, Rules(("k",), ("n",), (("low", "high"),), {"o_orderstatus": ["O", "F"]}))})


add("snk6_violations", broken_rules, """WITH r AS (SELECT o_orderkey - CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS k, o_orderstatus, o_orderkey % 7 - 1 AS n, nullif(o_custkey % 5, 0) AS low, o_custkey % 4 AS high FROM orders)
  SELECT 'orders' AS "table", 'doubled' AS rule, count(*) - count(DISTINCT k) AS n FROM r UNION ALL SELECT 'orders', 'negative n', count(*) FILTER (n < 0) FROM r
  UNION ALL SELECT 'orders', 'order of low, high', count(*) FILTER (low IS NULL OR low > high) FROM r UNION ALL SELECT 'orders', 'unknown o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM r""")
