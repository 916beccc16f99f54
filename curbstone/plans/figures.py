"""Queries on the cube, the open snapshot, the daily series and what they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbstone.functions.maps import DQ_FLAGS
from curbstone.functions.numbers import trend
from curbstone.operators.classify import clear_out_days, non_service_pairs, sweep_minutes
from curbstone.operators.cube import all_sets, daily_backlog, in_periods, open_cube, window_counts, window_cube, window_percentiles
from curbstone.plans import domain as D
from curbstone.plans.registry import add

CELL = "neighborhood_slug, district_number, category_group"
PERIODS = f"""periods AS (SELECT w AS window_days, p AS period, (DATE '{D.AS_OF}' - (w * b)::INT)::DATE AS to_day, (DATE '{D.AS_OF}' - (w * (b + 1))::INT)::DATE AS before_day
  FROM (VALUES {', '.join(f'({w})' for w in D.WINDOWS)}) a(w) CROSS JOIN (VALUES ('current', 0), ('prior', 1)) c(p, b))"""
#: Eight grouping sets with '' and 0 for all, without rows that lack a value; e needs the columns given.
SETS = "GROUPING SETS ((), (n), (d), (c), (n, d), (n, c), (d, c), (n, d, c))"
WHOLE = "(grouping(n) = 1 OR n IS NOT NULL) AND (grouping(d) = 1 OR d IS NOT NULL) AND (grouping(c) = 1 OR c IS NOT NULL)"
CELLS = "CASE WHEN grouping(n) = 1 THEN '' ELSE n END AS neighborhood_slug, CASE WHEN grouping(d) = 1 THEN 0 ELSE d END AS district_number, CASE WHEN grouping(c) = 1 THEN '' ELSE c END AS category_group"
R = "SELECT neighborhood_slug AS n, district_number AS d, category_group AS c, * FROM requests WHERE service"


def pct(values: str, a: int, b: int) -> str:
    """The exact percentile of a sorted list, by integers."""
    lo, hi = f"{values}[({a} * (len({values}) - 1)) // {b} + 1]", f"{values}[least(({a} * (len({values}) - 1)) // {b} + 2, len({values}))]"
    return f"((2 * ({b} * {lo} + (({a} * (len({values}) - 1)) % {b}) * ({hi} - {lo})) + {b}) // {2 * b})"


COUNTS_SQL = f"""r AS ({R}), e AS (
    SELECT n, d, c, 'o' AS k, created_date AS day FROM r
    UNION ALL SELECT n, d, c, 'x', backlog_close_date FROM r WHERE NOT timed AND status_group = 'Closed'
    UNION ALL SELECT n, d, c, 'b', closed_date FROM r WHERE timed AND bulk),
  counts AS (SELECT window_days, period, {CELLS}, count(*) FILTER (k = 'o') AS opened_count, count(*) FILTER (k = 'x') AS excluded_count, count(*) FILTER (k = 'b') AS bulk_closed_count
    FROM e JOIN periods ON day > before_day AND day <= to_day GROUP BY GROUPING SETS ({', '.join('(window_days, period' + (', ' + s if s else '') + ')' for s in ('', 'n', 'd', 'c', 'n, d', 'n, c', 'd, c', 'n, d, c'))}) HAVING {WHOLE})"""
VALUES_SQL = f"""lists AS (SELECT window_days, period, {CELLS}, list_sort(list(hundredths)) AS v
    FROM (SELECT * FROM r WHERE timed) JOIN periods ON closed_date > before_day AND closed_date <= to_day
    GROUP BY GROUPING SETS ({', '.join('(window_days, period' + (', ' + s if s else '') + ')' for s in ('', 'n', 'd', 'c', 'n, d', 'n, c', 'd, c', 'n, d, c'))}) HAVING {WHOLE}),
  percentiles AS (SELECT window_days, period, {CELL}, len(v) AS closed_count, {pct('v', 1, 2)} AS median, {pct('v', 9, 10)} AS p90 FROM lists)"""
CUBE_SQL = f"""{D.SQL}, {PERIODS}, {COUNTS_SQL}, {VALUES_SQL},
  cube AS (SELECT window_days, period, {CELL}, coalesce(opened_count, 0) AS opened_count, coalesce(closed_count, 0) AS closed_count,
    coalesce(excluded_count, 0) AS excluded_count, coalesce(bulk_closed_count, 0) AS bulk_closed_count, median / 100.0::DOUBLE AS median_days, p90 / 100.0::DOUBLE AS p90_days
    FROM counts FULL JOIN percentiles USING (window_days, period, {CELL}))"""
OPEN_CTE = f"""open_lists AS (SELECT {CELLS}, list_sort(list((DATE '{D.AS_OF}' - created_date) * 100)) AS v FROM ({R}) r
    WHERE created_date <= DATE '{D.AS_OF}' AND (backlog_close_date IS NULL OR backlog_close_date > DATE '{D.AS_OF}') GROUP BY {SETS} HAVING {WHOLE}),
  open_cube AS (SELECT {CELL}, len(v) AS open_count, {pct('v', 1, 2)} / 100.0::DOUBLE AS median_age_days FROM open_lists)"""


def cube(spark, d):
    return window_cube(D.requests(spark, d), D.as_of(), D.WINDOWS)


def opened_of(requests, sets=None):
    age = (F.datediff(D.as_of(), F.col("created_date")) * 100).cast("long")
    return open_cube(requests, D.as_of(), age, sets)


def opened(spark, d):
    return opened_of(D.requests(spark, d))


add("flagship", cube, f"{CUBE_SQL} SELECT * FROM cube")
add("agg1_agg2_agg3_agg4_counts", lambda s, d: window_counts(D.requests(s, d), D.as_of(), D.WINDOWS), f"{D.SQL}, {PERIODS}, {COUNTS_SQL} SELECT * FROM counts")
add("agg5_agg6_percentiles", lambda s, d: window_percentiles(D.requests(s, d), D.as_of(), D.WINDOWS), f"{D.SQL}, {PERIODS}, r AS ({R}), {VALUES_SQL} SELECT * FROM percentiles")
add("agg8_open_snapshot", opened, f"{D.SQL}, {OPEN_CTE} SELECT * FROM open_cube")

BACKLOG_CTE = f"""b AS (SELECT district_number AS d, category_group AS c, created_date, CASE WHEN backlog_close_date <= DATE '{D.AS_OF}' THEN backlog_close_date END AS left_date
    FROM requests WHERE service AND created_date <= DATE '{D.AS_OF}'),
  cells AS (SELECT CASE WHEN grouping(d) = 1 THEN 0 ELSE d END AS district_number, CASE WHEN grouping(c) = 1 THEN '' ELSE c END AS category_group
    FROM b GROUP BY GROUPING SETS ((), (d), (c), (d, c)) HAVING (grouping(d) = 1 OR d IS NOT NULL) AND (grouping(c) = 1 OR c IS NOT NULL)),
  ev AS (SELECT d, c, created_date AS day, 1 AS o, 0 AS x FROM b UNION ALL SELECT d, c, left_date, 0, 1 FROM b WHERE left_date IS NOT NULL),
  per_day AS (SELECT k.district_number, k.category_group, greatest(day, DATE '{D.BACKLOG_FROM}' - 1) AS day, sum(o) AS o, sum(x) AS x
    FROM ev JOIN cells k ON (k.district_number = 0 OR k.district_number = ev.d) AND (k.category_group = '' OR k.category_group = ev.c) GROUP BY ALL),
  spine AS (SELECT unnest(range(DATE '{D.BACKLOG_FROM}' - 1, DATE '{D.AS_OF}' + 1, INTERVAL 1 DAY))::DATE AS day),
  series AS (SELECT day, district_number, category_group, coalesce(o, 0)::BIGINT AS opened, coalesce(x, 0)::BIGINT AS closed,
    sum(coalesce(o, 0) - coalesce(x, 0)) OVER (PARTITION BY district_number, category_group ORDER BY day)::BIGINT AS open_at_end
    FROM spine CROSS JOIN cells LEFT JOIN per_day USING (day, district_number, category_group)),
  backlog AS (SELECT * FROM series WHERE day >= DATE '{D.BACKLOG_FROM}')"""


def backlog(spark, d):
    return daily_backlog(D.requests(spark, d), D.as_of(), D.BACKLOG_FROM)


def weeks(spark, d):
    """AGG-22: by Monday weeks, open at the last day's end."""
    week = F.date_sub("day", F.weekday("day"))
    rows = backlog(spark, d).groupBy(week.alias("week"), "district_number", "category_group")
    return rows.agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"), F.max_by("open_at_end", "day").alias("open_at_end"))


add("agg9_win4_daily_backlog", backlog, f"{D.SQL}, {BACKLOG_CTE} SELECT * FROM backlog")
add("agg22_scl17_weekly_backlog", weeks, f"""{D.SQL}, {BACKLOG_CTE} SELECT date_trunc('week', day)::DATE AS week, district_number, category_group,
  sum(opened)::BIGINT AS opened, sum(closed)::BIGINT AS closed, arg_max(open_at_end, day) AS open_at_end FROM backlog GROUP BY ALL""")


def periods(spark, d):
    """FLT-4: created days by window and period."""
    rows = in_periods(D.cleaned(spark, d).select("created_date"), "created_date", D.as_of(), D.WINDOWS)
    return rows.groupBy("window_days", "period").agg(F.count(F.lit(1)).alias("n"), F.min("created_date").alias("first_day"), F.max("created_date").alias("last_day"))


add("flt4_join11_join13_periods", periods, f"""{D.SQL}, {PERIODS} SELECT window_days, period, count(*) AS n, min(created_date) AS first_day, max(created_date) AS last_day
  FROM cleaned JOIN periods ON created_date > before_day AND created_date <= to_day GROUP BY ALL""")


def pivoted(spark, d, sets=None):
    """JOIN-16, SET-4: current and prior side by side with the open snapshot; a missing side is 0 or null.

    Requests are classified once for both sides, and only the window and the sets of cells asked for are counted.
    """
    requests = D.requests(spark, d)
    rows = window_cube(requests, D.as_of(), (90,), sets)
    both = rows.groupBy("window_days", "neighborhood_slug", "district_number", "category_group").pivot("period", ["current", "prior"])
    both = both.agg(F.max("closed_count").alias("closed"), F.max("median_days").alias("median"))
    cells = ["neighborhood_slug", "district_number", "category_group"]
    rows = both.drop("window_days").join(opened_of(requests, sets), cells, "full")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("current_closed", "prior_closed", "open_count")]
    return rows.select(*cells, *zero, "current_median", "prior_median", "median_age_days")


PIVOT_CTE = f"""sides AS (SELECT {CELL}, max(closed_count) FILTER (period = 'current') AS cc, max(closed_count) FILTER (period = 'prior') AS pc,
    max(median_days) FILTER (period = 'current') AS cm, max(median_days) FILTER (period = 'prior') AS pm FROM cube WHERE window_days = 90 GROUP BY ALL),
  pivoted AS (SELECT {CELL}, coalesce(cc, 0) AS current_closed, coalesce(pc, 0) AS prior_closed, coalesce(open_count, 0) AS open_count, cm AS current_median, pm AS prior_median, median_age_days
    FROM sides FULL JOIN open_cube USING ({CELL}))"""
PIVOT_SQL = f"{CUBE_SQL}, {OPEN_CTE}, {PIVOT_CTE}"
add("join16_set4_current_prior_open", pivoted, f"{PIVOT_SQL} SELECT * FROM pivoted")


def trends(spark, d, sets=None):
    """SCL-16 for each cell; fewer than 30 requests in a period give none."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    t = trend(F.col("current_closed"), cents("current_median"), F.col("prior_closed"), cents("prior_median"))
    return pivoted(spark, d, sets).withColumn("t", t).select("neighborhood_slug", "district_number", "category_group", "current_median", "prior_median", F.col("t.direction").alias("direction"), F.col("t.pct").alias("pct"))


TREND_CTE = f"""cents AS (SELECT *, round(current_median * 100)::BIGINT AS m1, round(prior_median * 100)::BIGINT AS m0, current_closed >= 30 AND prior_closed >= 30 AS enough FROM pivoted),
  trends AS (SELECT {CELL}, current_median, prior_median,
    CASE WHEN NOT enough THEN NULL WHEN m0 = 0 THEN CASE WHEN m1 = 0 THEN 'steady' ELSE 'slower' END WHEN abs(m1 - m0) * 20 < m0 THEN 'steady' WHEN m1 > m0 THEN 'slower' ELSE 'faster' END AS direction,
    CASE WHEN enough AND m0 <> 0 THEN (sign(m1 - m0) * ((2000 * abs(m1 - m0) + m0) // (2 * m0)))::DOUBLE / 10 END AS pct FROM cents)"""
TREND_SQL = f"{PIVOT_SQL}, {TREND_CTE}"
add("scl16_trends", trends, f"{TREND_SQL} SELECT * FROM trends")


def split(spark, d):
    """AGG-23."""
    rows = trends(spark, d, [s for s in all_sets() if "category_group" in s]).filter("category_group <> ''")
    n = lambda k: F.count_if(F.col("direction") == k).alias(k)
    return rows.groupBy("category_group").agg(n("slower"), n("steady"), n("faster"), F.count_if(F.col("direction").isNull()).alias("none"))


add("agg23_trend_split", split, f"""{TREND_SQL} SELECT category_group, count(*) FILTER (direction = 'slower') AS slower, count(*) FILTER (direction = 'steady') AS steady,
  count(*) FILTER (direction = 'faster') AS faster, count(*) FILTER (direction IS NULL) AS "none" FROM trends WHERE category_group <> '' GROUP BY ALL""")


def slower(spark, d):
    """SORT-3: the ten that got slower most; no percentage counts as the largest."""
    rows = trends(spark, d, [("neighborhood_slug",)]).filter("direction = 'slower' and neighborhood_slug <> '' and district_number = 0 and category_group = ''")
    rows = rows.withColumn("added", F.round((F.col("current_median") - F.col("prior_median")) * 100).cast("long"))
    return rows.orderBy(F.desc("added"), F.desc_nulls_first("pct"), "neighborhood_slug").limit(10).select("neighborhood_slug", "added", "pct")


add("sort3_getting_slower", slower, f"""{TREND_SQL} SELECT neighborhood_slug, round((current_median - prior_median) * 100)::BIGINT AS added, pct FROM trends
  WHERE direction = 'slower' AND neighborhood_slug <> '' AND district_number = 0 AND category_group = '' ORDER BY added DESC, pct DESC NULLS FIRST, neighborhood_slug LIMIT 10""")

add("join8_non_service_pairs", lambda s, d: non_service_pairs(D.cleaned(s, d), D.category_map(s), D.line_map(s)), f"{D.SQL} SELECT * FROM pairs")
add("agg11_clear_out_days", lambda s, d: clear_out_days(D.requests(s, d), D.DAY_LEAST), f"{D.SQL} SELECT * FROM clear_days")
add("agg12_scl20_sweep_minutes", lambda s, d: sweep_minutes(D.requests(s, d), D.SWEEP_LEAST), f"{D.SQL} SELECT * FROM sweeps")
add("join9_join10_classified", lambda s, d: D.requests(s, d).select("reference_number", "service", "bulk", "timed", "dq_flags", "hundredths"), f"{D.SQL} SELECT reference_number, service, bulk, timed, dq_flags, hundredths FROM requests")
add(
    "agg20_flt8_flag_counts",
    lambda s, d: D.requests(s, d).agg(*(F.count_if(F.col("dq_flags").bitwiseAND(b) != 0).alias(n) for b, n, _ in DQ_FLAGS)),
    f"{D.SQL} SELECT " + ", ".join(f"count(*) FILTER (dq_flags & {b} <> 0) AS {n}" for b, n, _ in DQ_FLAGS) + " FROM requests",
)
