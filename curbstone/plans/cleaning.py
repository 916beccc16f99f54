"""Queries that run the cleaners, the batch apply and the rules on raw rows made from the star tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from curbstone.functions import clean as C
from curbstone.functions import rules
from curbstone.functions.maps import FLAG, NEIGHBORHOODS, category_map, neighborhood_map, slug_of, source_map
from curbstone.operators import quality
from curbstone.operators.apply import merged, new_history, newest, with_maps
from curbstone.operators.seeds import upserted
from curbstone.plans import domain as D
from curbstone.plans import health
from curbstone.plans.registry import add
from curbstone.sources.export import capture, geojson
from curbstone.sources.feed import newer_where, slice_where

NOW = "2021-06-30 20:00:00"
#: Milliseconds from the tables' dates to these rows' dates, so that they are after the first valid one.
SHIFT = 7305 * 86_400_000
# What stands in for served values; each is taken by the order's key modulo their number.
CATEGORY = ("Solid Waste", " Animal  Control ", "Oddments", "", None, "Parking", "Homeless Camp - Primary")
LINE, CHANNEL, STREET, TICKET = ("General", "", None), ("Phone", "Fax", "", None, " Web "), ("", " A  St ", None), ("", "T1", None)
DISTRICT = ("District 3", "Non City", "district 07", "", None, "9", "  5 ", "NONCITY", "0", "District 88")
ADDRESS = ("12 Main  St ", "N/A", "TBD", "ok", "12", "12345", "", None, "  10  Oak   Ave", "Zoom", "None.", "--")
ZIP = ("95814", "95814-1234", "958141234", "95814 1234", "9581", "", None, "abcde", " 95820 ")
STATUS = ("NEW", "In Progress", "CLOSED", "Cancelled", "canceled", "?", None, "Closed", " closed ")


def _pick(values: tuple):
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col("k") % len(values) + 1).cast("int"))


def _pick_sql(values: tuple) -> str:
    return "[" + ", ".join(map(D._q, values)) + f"][k % {len(values)} + 1]"


def raw_rows(spark, d):
    """A raw row, as the feed's contract has it, for each order; some can't be identified or ordered."""
    k = F.col("k")
    t = lambda n: D.load(spark, d, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("o_orderkey").alias("k"), (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + SHIFT).alias("ms"), "n_name", "c_mktsegment")
    name = F.when(k % 5 == 0, F.col("n_name")).when(k % 5 == 1, F.lit("Upper\\Lower")).when(k % 5 == 2, F.lit("  ")).when(k % 5 == 3, F.concat("n_name", F.lit("'s  Park")))
    closed = F.when(k % 3 > 0, F.col("ms") + (k % 50 - 5) * 133_200_000 + (k % 7) * 60_000)
    number = lambda c, m: (F.lit(c) + (k % m) / F.lit(100.0))
    return rows.select(
        F.when(k % 97 == 0, 0).otherwise(k).alias("object_id"),
        F.when(k % 101 == 0, F.lit("  ")).when(k % 103 == 0, F.lit("x" * 51)).otherwise(F.concat(F.lit("  R-"), k.cast("string"), F.lit(" "))).alias("reference_number"),
        _pick(CATEGORY).alias("category_level1"), _pick(LINE).alias("category_level2"), F.col("c_mktsegment").alias("category_name"),
        _pick(DISTRICT).alias("council_district"), _pick(CHANNEL).alias("source_level1"), name.alias("neighborhood"),
        F.when(k % 107 == 0, F.lit(-2209161600000)).otherwise(F.col("ms")).alias("date_created"),
        F.when(k % 113 == 0, None).when(k % 127 == 0, F.lit(900000000000)).otherwise(F.col("ms") + (k % 40) * 86_400_000 + 3_600_000).alias("date_updated"),
        closed.alias("date_closed"), _pick(STREET).alias("cross_street"), _pick(ZIP).alias("zip"), _pick(TICKET).alias("sf_ticket_id"), _pick(ADDRESS).alias("address"),
        F.lit("star").alias("data_source"), _pick(STATUS).alias("public_status"),
        F.when(k % 11 > 0, number(-122.05, 120)).alias("x"), F.when(k % 13 > 0, number(38.15, 90)).alias("y"), "k",
    )


RAW = f"""WITH {D._values("category_map", "k, v, g, reason", [(D.key_of(v), v, g, why) for v, g, why in D.CATEGORIES])},
{D._values("source_map", "k, c", [(D.key_of(v), c) for v, c in D.SOURCES])},
{D._values("neighborhood_map", "k, name, slug", [(D.key_of(n), n, slug_of(n)) for n in NEIGHBORHOODS])},
base AS (SELECT o_orderkey AS k, epoch_ms(o_orderdate) + {SHIFT} AS ms, n_name, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
raw AS (SELECT CASE WHEN k % 97 = 0 THEN 0 ELSE k END AS object_id,
  CASE WHEN k % 101 = 0 THEN '  ' WHEN k % 103 = 0 THEN repeat('x', 51) ELSE '  R-' || k || ' ' END AS reference_number,
  {_pick_sql(CATEGORY)} AS category_level1, {_pick_sql(LINE)} AS category_level2, c_mktsegment AS category_name, {_pick_sql(DISTRICT)} AS council_district, {_pick_sql(CHANNEL)} AS source_level1,
  CASE k % 5 WHEN 0 THEN n_name WHEN 1 THEN 'Upper\\Lower' WHEN 2 THEN '  ' WHEN 3 THEN n_name || '''s  Park' END AS neighborhood,
  CASE WHEN k % 107 = 0 THEN -2209161600000 ELSE ms END AS date_created,
  CASE WHEN k % 113 = 0 THEN NULL WHEN k % 127 = 0 THEN 900000000000 ELSE ms + (k % 40) * 86400000 + 3600000 END AS date_updated,
  CASE WHEN k % 3 > 0 THEN ms + (k % 50 - 5) * 133200000 + (k % 7) * 60000 END AS date_closed, {_pick_sql(STREET)} AS cross_street, {_pick_sql(ZIP)} AS zip,
  {_pick_sql(TICKET)} AS sf_ticket_id, {_pick_sql(ADDRESS)} AS address, 'star' AS data_source, {_pick_sql(STATUS)} AS public_status,
  CASE WHEN k % 11 > 0 THEN -122.05::DOUBLE + (k % 120) / 100.0::DOUBLE END AS x, CASE WHEN k % 13 > 0 THEN 38.15::DOUBLE + (k % 90) / 100.0::DOUBLE END AS y, k FROM base)"""


def _plain(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '')"


def _slug(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"


def _bit(condition: str, name: str) -> str:
    return f"CASE WHEN {condition} THEN {FLAG[name]} ELSE 0 END"


def _day(c: str) -> str:
    return f"(({c} AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles')::DATE"


def _time(c: str) -> str:
    return f"CASE WHEN {c} >= 946684800000 THEN make_timestamp({c} * 1000) END"


REJECT = f"""CASE WHEN coalesce(object_id, 0) <= 0 THEN 'InvalidObjectId' WHEN {_plain('reference_number')} IS NULL THEN 'MissingReferenceNumber'
  WHEN length({_plain('reference_number')}) > 50 THEN 'ReferenceNumberTooLong' WHEN date_updated IS NULL THEN 'MissingDateUpdated' WHEN date_updated < 946684800000 THEN 'InvalidDateUpdated' END"""


def _hash(name: str, column: str) -> str:
    value = f"regexp_replace({column}::VARCHAR, '\\.0$', '')" if column in "xy" else f"{column}::VARCHAR"
    return f"'{name}' || chr(31) || coalesce(chr(1) || {value}, chr(0)) || chr(30)"


def clean_sql(raw: str, out: str) -> str:
    """CTEs of the cleaned rows of raw, as `out`."""
    junk = f"(address1 IS NOT NULL AND (length(address1) < 3 OR {D.key_sql('address1')} IS NULL OR {D.key_sql('address1')} IN {C.JUNK_ADDRESSES} OR regexp_matches({D.key_sql('address1')}, '^[0-9]+$')))"
    inside = f"(x BETWEEN {C.WEST} AND {C.EAST} AND y BETWEEN {C.SOUTH} AND {C.NORTH})"
    wrong = "coalesce(closed_utc < created_utc, false)"
    late = " + ".join(f"CASE WHEN {c} > TIMESTAMP '{NOW}' + INTERVAL 1 DAY THEN 1 ELSE 0 END" for c in ("created_utc", "updated_utc", "closed_utc"))
    early = " OR ".join(f"(date_{c} IS NOT NULL AND {c}_utc IS NULL)" for c in ("created", "updated", "closed"))
    return f"""{out}1 AS (SELECT *, {_plain('reference_number')} AS ref, {D.key_sql('public_status')} AS status_key, coalesce({D.key_sql('council_district')}, '') AS district_key,
    {_plain("replace(neighborhood, chr(92), '/')")} AS place, {_plain('address')} AS address1, {_plain('zip')} AS zip1, {_time('date_created')} AS created_utc, {_time('date_updated')} AS updated_utc, {_time('date_closed')} AS closed_utc,
    sha256({' || '.join(_hash(n, c) for n, c in C.HASHED)}) AS row_hash FROM {raw} WHERE {REJECT} IS NULL),
  {out}2 AS (SELECT *, nullif(regexp_extract(district_key, '^(?:district)?0*([1-8])$', 1), '')::INT AS district_number, nullif(regexp_extract(zip1, '^(\\d{{5}})(?:[- ]?\\d{{4}})?$', 1), '') AS zip5,
    CASE WHEN status_key IN ('new', 'inprogress') THEN 'Open' WHEN status_key = 'closed' THEN 'Closed' WHEN status_key IN ('cancelled', 'canceled') THEN 'Cancelled' ELSE 'Unknown' END AS status_group FROM {out}1),
  {out}3 AS (SELECT *, CASE WHEN district_key = 'noncity' THEN false WHEN district_number IS NOT NULL THEN true END AS is_city,
    CASE WHEN status_group IN ('Closed', 'Cancelled') THEN coalesce(closed_utc, updated_utc) WHEN status_group = 'Unknown' THEN closed_utc END AS left_utc FROM {out}2),
  {out} AS (SELECT ref AS reference_number, object_id, {_plain('category_level1')} AS category_level1, {_plain('category_level2')} AS category_level2, category_name, district_number, is_city, place AS neighborhood,
    {D.key_sql('place')} AS neighborhood_key, {_slug('place')} AS neighborhood_slug, CASE WHEN NOT coalesce({junk}, false) THEN address1 END AS address, {_plain('cross_street')} AS cross_street, zip5 AS zip,
    CASE WHEN {inside} THEN round(y, 6) END AS latitude, CASE WHEN {inside} THEN round(x, 6) END AS longitude, {_plain('public_status')} AS public_status, status_group, created_utc, updated_utc, closed_utc,
    {_day('created_utc')} AS created_date_local, {_day('closed_utc')} AS closed_date_local, greatest({_day('left_utc')}, CASE WHEN left_utc IS NOT NULL THEN {_day('created_utc')} END) AS backlog_close_date_local,
    CASE WHEN status_group = 'Closed' AND NOT {wrong} AND created_utc IS NOT NULL AND closed_utc IS NOT NULL THEN (2 * (date_closed - date_created) + 864000) // 1728000 END AS hundredths,
    {_bit("status_group = 'Unknown'", 'UnknownStatus')} + {_bit('is_city IS NULL', 'UnknownDistrict')} + {_bit('place IS NULL AND coalesce(is_city, false)', 'NeighborhoodMissingInCity')} + {_bit(f'coalesce({junk}, false)', 'AddressJunk')}
      + {_bit('zip1 IS NOT NULL AND zip5 IS NULL', 'InvalidZip')} + {_bit(f'x IS NOT NULL AND y IS NOT NULL AND NOT {inside}', 'GeoOutOfBounds')} + {_bit(early, 'SentinelDate')} + {_bit(f'{late} > 0', 'FutureDate')}
      + {_bit(wrong, 'InvalidCloseOrder')} + {_bit("status_group = 'Closed' AND closed_utc IS NULL", 'ClosedMissingDate')} AS dq_flags, row_hash,
    {D.key_sql('category_level1')} AS category_key, {D.key_sql('source_level1')} AS source_key FROM {out}3)"""


def now():
    return F.lit(NOW).cast("timestamp")


def cleaned_rows(spark, d):
    return C.clean(raw_rows(spark, d), now())


CLEAN = f"{RAW}, {clean_sql('raw', 'c')}"


def of_fields(*columns: str):
    """A cleaner's outputs by their distinct inputs' rows: columns of the cleaned rows, counted."""
    return lambda s, d: cleaned_rows(s, d).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


add("scl3_address", of_fields("address"), f"{CLEAN} SELECT address, count(*) AS n FROM c GROUP BY ALL")
add("scl4_district", of_fields("district_number", "is_city"), f"{CLEAN} SELECT district_number, is_city, count(*) AS n FROM c GROUP BY ALL")
plain_times = lambda *names: [F.col(c).cast("timestamp_ntz").alias(c) for c in names]
add("scl5_times", lambda s, d: cleaned_rows(s, d).select("reference_number", *plain_times("created_utc", "updated_utc", "closed_utc")), f"{CLEAN} SELECT reference_number, created_utc, updated_utc, closed_utc FROM c")
add(
    "scl6_points",
    lambda s, d: cleaned_rows(s, d).select("reference_number", *(F.col(c).cast("double").alias(c) for c in ("latitude", "longitude"))),
    f"{CLEAN} SELECT reference_number, latitude, longitude FROM c",
)
add("scl7_neighborhood", of_fields("neighborhood", "neighborhood_key", "neighborhood_slug"), f"{CLEAN} SELECT neighborhood, neighborhood_key, neighborhood_slug, count(*) AS n FROM c GROUP BY ALL")
add("scl12_status", of_fields("public_status", "status_group"), f"{CLEAN} SELECT public_status, status_group, count(*) AS n FROM c GROUP BY ALL")
add("scl13_zip", of_fields("zip"), f"{CLEAN} SELECT zip, count(*) AS n FROM c GROUP BY ALL")
add("scl14_row_hash", lambda s, d: cleaned_rows(s, d).select("reference_number", "row_hash"), f"{CLEAN} SELECT reference_number, row_hash FROM c")
ROW = "reference_number, object_id, category_level1, category_level2, district_number, is_city, neighborhood, address, cross_street, zip, status_group, created_date_local, closed_date_local, backlog_close_date_local, hundredths, dq_flags"
add("scl15_cleaned_rows", lambda s, d: cleaned_rows(s, d).withColumn("hundredths", (F.col("days_to_close") * 100).cast("long")).select(*ROW.split(", ")), f"{CLEAN} SELECT {ROW} FROM c")


def rejected(spark, d):
    """SNK-3: raw rows that can't be identified or ordered, with why."""
    reason = C.reject_reason(F.col("object_id"), F.col("reference_number"), F.col("date_updated"))
    return raw_rows(spark, d).withColumn("reason", reason).filter("reason is not null").select("object_id", F.col("k").alias("row"), "reason")


add("snk3_scl10_rejects", rejected, f"{RAW} SELECT object_id, k AS row, {REJECT} AS reason FROM raw WHERE {REJECT} IS NOT NULL")

# A batch of later and earlier versions against the rows held: of four orders one isn't in the batch, one is older with another
# name, one is the same and one is newer; every tenth isn't held.
DAY_MS = 86_400_000
VERSIONS = f"""held_raw AS (SELECT * FROM raw WHERE k % 10 > 0),
  batch_raw AS (SELECT * REPLACE (CASE k % 4 WHEN 1 THEN date_updated - {DAY_MS} WHEN 3 THEN date_updated + {DAY_MS} ELSE date_updated END AS date_updated,
    CASE k % 4 WHEN 1 THEN 'older' WHEN 3 THEN 'newer' ELSE category_name END AS category_name) FROM raw WHERE k % 4 > 0)"""
APPLY = f"""{RAW}, {VERSIONS}, {clean_sql('held_raw', 'held')}, {clean_sql('batch_raw', 'batch')},
  both_sides AS (SELECT reference_number, t.row_hash AS t_hash, b.row_hash AS b_hash, t.updated_utc AS t_updated, b.updated_utc AS b_updated, t.category_name AS t_name, b.category_name AS b_name
    FROM held t FULL JOIN batch b USING (reference_number)),
  kinds AS (SELECT *, CASE WHEN b_hash IS NULL THEN NULL WHEN t_hash IS NULL THEN 'inserted' WHEN t_hash = b_hash OR b_updated < t_updated THEN 'unchanged' ELSE 'updated' END AS change FROM both_sides)"""


def sides(spark, d):
    """(held, batch): cleaned and mapped versions, the newest of each request; held has the tracking columns."""
    raw, k = raw_rows(spark, d), F.col("k")
    later = F.when(k % 4 == 1, F.col("date_updated") - DAY_MS).when(k % 4 == 3, F.col("date_updated") + DAY_MS).otherwise(F.col("date_updated"))
    name = F.when(k % 4 == 1, F.lit("older")).when(k % 4 == 3, F.lit("newer")).otherwise(F.col("category_name"))
    maps = (category_map(spark), source_map(spark), neighborhood_map(spark))
    done = lambda rows: newest(with_maps(C.clean(rows, now()), *maps))
    stamp = F.lit("2021-01-01 00:00:00").cast("timestamp")
    tracked = {c: stamp for c in ("first_seen_utc", "last_seen_utc", "last_changed_utc")} | {"source_removed_utc": F.when(F.col("object_id") % 7 == 0, stamp)}
    return done(raw.filter(k % 10 > 0)).withColumns(tracked), done(raw.filter(k % 4 > 0).withColumns({"date_updated": later, "category_name": name}))


def applied(spark, d):
    """STR-1, STR-5: what the batch apply makes of each row."""
    held, batch = sides(spark, d)
    return merged(held, batch, now()).select(
        "reference_number", "change", "category_name", *plain_times("updated_utc", "first_seen_utc", "last_seen_utc", "last_changed_utc", "source_removed_utc")
    )


STAMP = "TIMESTAMP '2021-01-01 00:00:00'"
add("str1_str5_applied", applied, f"""{APPLY} SELECT reference_number, change, CASE WHEN change IN ('inserted', 'updated') THEN b_name ELSE t_name END AS category_name,
  CASE WHEN change IN ('inserted', 'updated') THEN b_updated ELSE t_updated END AS updated_utc, CASE WHEN change = 'inserted' THEN TIMESTAMP '{NOW}' ELSE {STAMP} END AS first_seen_utc,
  CASE WHEN change IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE {STAMP} END AS last_seen_utc, CASE WHEN change IN ('inserted', 'updated') THEN TIMESTAMP '{NOW}' ELSE {STAMP} END AS last_changed_utc,
  CASE WHEN change IS NULL AND substr(reference_number, 3)::BIGINT % 7 = 0 THEN {STAMP} END AS source_removed_utc FROM kinds""")


def recleaned(spark, d):
    """STR-2: the same versions cleaned by other rules; labels stay and other values are replaced."""
    held, batch = sides(spark, d)
    held = held.withColumn("zip", F.when(F.col("object_id") % 3 > 0, F.col("zip"))).withColumn("dq_flags", F.col("dq_flags").bitwiseOR(FLAG["BulkClosure"]))
    return merged(held, batch, now(), reclean=True).filter("change is not null").groupBy("change", F.col("dq_flags").bitwiseAND(FLAG["BulkClosure"]).alias("label")).agg(F.count(F.lit(1)).alias("n"))


add("str2_recleaned", recleaned, f"""{APPLY}, r AS (SELECT CASE WHEN k.change = 'unchanged' AND t_hash = b_hash AND h.zip IS NOT NULL AND h.object_id % 3 = 0 THEN 'recleaned' ELSE k.change END AS change
    FROM kinds k LEFT JOIN held h USING (reference_number) WHERE k.change IS NOT NULL)
  SELECT change, CASE WHEN change IN ('inserted', 'updated') THEN 0 ELSE 4096 END AS label, count(*) AS n FROM r GROUP BY ALL""")


def history(spark, d):
    """JOIN-2: versions, stale ones too, that history lacks."""
    held, batch = sides(spark, d)
    return new_history(batch, held, now(), 7).select("reference_number", "row_hash", "object_id", "status_group", "run_id")


add("join2_str5_history", history, f"{APPLY} SELECT reference_number, row_hash, object_id, status_group, 7::BIGINT AS run_id FROM batch b WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.reference_number = b.reference_number AND h.row_hash = b.row_hash)")


def counts(spark, d):
    """JOIN-3, JOIN-4: rows by what the apply did with them."""
    held, batch = sides(spark, d)
    return merged(held, batch, now()).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


add("join3_join4_applied_counts", counts, f"{APPLY} SELECT change, count(*) AS n FROM kinds GROUP BY ALL")

# Checks on the cleaned rows; the scans are those of a run.
TODAY_SQL = "DATE '2021-06-30'"


def today():
    return F.lit("2021-06-30").cast("date")


def present_rows(spark, d):
    return cleaned_rows(spark, d).withColumn("source_removed_utc", F.when(F.col("object_id") % 7 == 0, now()))


NULLS = ", ".join(f"count(*) FILTER ({c} IS NULL{' AND coalesce(is_city, false)' if c == 'neighborhood' else ''}) AS {c}" for c in quality.COLUMNS)
add("agg19_dq_null_counts", lambda s, d: quality.null_counts(present_rows(s, d), today(), 365, 730), f"""{CLEAN} SELECT created_date_local > {TODAY_SQL} - 365 AS recent, count(*) AS n,
  count(*) FILTER (coalesce(is_city, false)) AS n_city, {NULLS} FROM c WHERE object_id % 7 <> 0 AND created_date_local > {TODAY_SQL} - 1095 AND created_date_local <= {TODAY_SQL} GROUP BY ALL""")
add("sort2_busiest_addresses", lambda s, d: quality.busiest_addresses(present_rows(s, d), today(), 2000), f"""{CLEAN} SELECT address, count(*) AS n FROM c WHERE object_id % 7 <> 0 AND address IS NOT NULL AND created_date_local > {TODAY_SQL} - 2000
  GROUP BY ALL ORDER BY n DESC, address LIMIT 5""")
FLAGS_SQL = ", ".join(f"count(*) FILTER (dq_flags & {b} <> 0) AS {n}" for n, b in FLAG.items())
add("agg20_dq_flag_counts", lambda s, d: quality.flag_counts(present_rows(s, d)), f"{CLEAN} SELECT {FLAGS_SQL} FROM c WHERE object_id % 7 <> 0")


def null_rules(spark, d):
    """SCL-27: the rule on the null rates of one scan."""
    rates = {r["recent"]: r for r in quality.null_counts(present_rows(spark, d), today(), 365, 730).collect()}  # two rows at most
    found = []
    for c in quality.COLUMNS:
        size = "n_city" if c == "neighborhood" else "n"
        r = quality.null_rate(c, *(rates[k][x] if k in rates else 0 for k in (True, False) for x in (c, size)))
        found.append((r["check"], r["status"]))
    return spark.createDataFrame(found, "check string, status string")


RATE = "round(100 * {1} FILTER (recent) / sum({0}) FILTER (recent), 2)"
add("scl27_null_rate_rules", null_rules, f"""{CLEAN}, t AS (SELECT created_date_local > {TODAY_SQL} - 365 AS recent, count(*) AS n, count(*) FILTER (coalesce(is_city, false)) AS n_city, {NULLS} FROM c
    WHERE object_id % 7 <> 0 AND created_date_local > {TODAY_SQL} - 1095 AND created_date_local <= {TODAY_SQL} GROUP BY ALL),
  u AS ({' UNION ALL '.join(f"SELECT 'null_rate.{c}' AS name, coalesce(sum({c}) FILTER (recent), 0) AS a, coalesce(sum({'n_city' if c == 'neighborhood' else 'n'}) FILTER (recent), 0) AS b, coalesce(sum({c}) FILTER (NOT recent), 0) AS x, coalesce(sum({'n_city' if c == 'neighborhood' else 'n'}) FILTER (NOT recent), 0) AS y FROM t" for c in quality.COLUMNS)})
  SELECT name AS "check", CASE WHEN b < 30 OR y < 30 THEN 'Info' WHEN round_even(100.0 * a / b, 2) > round_even(100.0 * x / y, 2) + 5 THEN 'Warn' ELSE 'Pass' END AS status FROM u""")

# Rules of times, on the runs of a log that has one run for each user of the events.
RUNS = "runs AS (SELECT user_id, min(ts) AS before, max(ts) AS seen, count(*) AS n FROM events GROUP BY user_id)"


def _runs(spark, d):
    rows = D.load(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("before"), F.max("ts").alias("seen"), F.count(F.lit(1)).alias("n"))
    return rows


def _ruled(name: str, rule, sql: str) -> None:
    """A query that applies a rule to each run."""
    add(name, lambda s, d: _runs(s, d).select("user_id", rule(F.col("before"), F.col("seen"), F.col("n")).alias("result")), f"WITH {RUNS} SELECT user_id, {sql} AS result FROM runs")


at = lambda: F.lit(datetime(2024, 1, 29, 12)).cast("timestamp_ntz")
AT_SQL = "TIMESTAMP '2024-01-29 12:00:00'"
_ruled("scl22_next_watermark", lambda before, seen, n: rules.next_watermark(before, seen, at()), f"greatest(before, least(seen, {AT_SQL}))")
_ruled("scl23_seed_watermark", lambda before, seen, n: rules.seed_watermark(at(), seen, before + F.lit(timedelta(days=28))), f"least(least({AT_SQL}, seen) - INTERVAL 1 HOUR, before + INTERVAL 28 DAY)")
_ruled("scl24_guard", lambda before, seen, n: rules.guard_fails(n, F.lit(70)), "n < 70 * 0.95")
_ruled("scl26_page_count", lambda before, seen, n: rules.page_count(n, F.lit(66)), "CASE WHEN 20 * abs(n - 66) <= 66 THEN 'Within' WHEN n > 66 THEN 'Grew' ELSE 'Dropped' END")
_ruled("scl28_refresh_due", lambda before, seen, n: rules.refresh_due(n % 2, F.to_date(seen), F.to_date(at())), f"n % 2 > 0 OR seen::DATE < {AT_SQL}::DATE")
_ruled("scl27_source_count", lambda before, seen, n: rules.source_count(n, F.lit(68)), "CASE WHEN n < round_even(68 * 0.98, 0) THEN 'Fail' ELSE 'Pass' END")
add("scl21_api7_freshness", lambda s, d: _runs(s, d).select("user_id", health.fresh_column(F.col("seen").cast("timestamp"), F.lit("2024-01-30 00:00:00").cast("timestamp")).alias("fresh")), f"WITH {RUNS} SELECT user_id, TIMESTAMP '2024-01-30 00:00:00' - seen <= INTERVAL 45 MINUTE AS fresh FROM runs")

# The feed's predicates, as Spark reads them.
FROM, UNTIL = datetime(2024, 1, 5, 6, 7, 8), datetime(2024, 1, 20)
events = lambda s, d: D.load(s, d, "events").select("event_id", F.col("ts").alias("DateUpdated"))
add("flt1_slice_where", lambda s, d: events(s, d).filter(slice_where(FROM, UNTIL)).select("event_id"), f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{FROM}' AND ts < TIMESTAMP '{UNTIL}'")
add("flt2_newer_where", lambda s, d: events(s, d).filter(newer_where(FROM.replace(microsecond=900_000))).select("event_id"), f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{FROM}'")

# Stored maps, samples and features.


def seeds(spark, d):
    """JOIN-20: a stored map of nations brought up to a seed that lacks one, has a new one and changes some names."""
    rows = D.load(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")).alias("region"))
    k = F.col("n_nationkey")
    return upserted(rows.filter(k > 0), rows.filter(k < 24).withColumn("n_name", F.when(k % 5 == 0, F.lower("n_name")).otherwise(F.col("n_name"))), "n_nationkey")


add("join20_upserted", seeds, """SELECT n_nationkey, CASE WHEN n_nationkey < 24 AND n_nationkey % 5 = 0 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS region,
  CASE WHEN n_nationkey = 24 THEN 'deleted' WHEN n_nationkey = 0 THEN 'inserted' WHEN n_nationkey % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM nation""")
FIXTURES = {"address-junk": "address IS NULL AND dq_flags & 16 <> 0", "outside-bbox": "dq_flags & 64 <> 0", "closed": "status_group = 'Closed'"}


def captured(spark, d):
    """SNK-10: five cleaned rows for each predicate."""
    return capture(cleaned_rows(spark, d), {n: F.expr(p) for n, p in FIXTURES.items()}, 5).select("fixture", "object_id", "reference_number")


add("snk10_captured", captured, f"""{CLEAN}, taken AS ({' UNION ALL '.join(f"SELECT * FROM (SELECT {k} AS place, '{n}' AS fixture, object_id, reference_number FROM c WHERE {p} ORDER BY object_id LIMIT 5)" for k, (n, p) in enumerate(FIXTURES.items()))})
  SELECT fixture, object_id, reference_number FROM taken QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY place) = 1""")


def features(spark, d):
    """SNK-11: cleaned rows as compact GeoJSON."""
    return geojson(cleaned_rows(spark, d).select("reference_number", "zip", "longitude", "latitude"))


add("snk11_geojson", features, f"""{CLEAN} SELECT '{{"type":"Feature",' || CASE WHEN longitude IS NOT NULL AND latitude IS NOT NULL THEN '"geometry":{{"type":"Point","coordinates":[' || longitude || ',' || latitude || ']}},' ELSE '' END
  || '"properties":{{"reference_number":"' || reference_number || '"' || CASE WHEN zip IS NOT NULL THEN ',"zip":"' || zip || '"' ELSE '' END || '}}}}' AS feature FROM c""")
