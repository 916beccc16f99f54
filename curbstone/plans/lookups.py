"""The dashboard's questions as queries over figures of the test tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from curbstone.functions.maps import slug_of
from curbstone.operators.cube import daily_backlog, open_cube, window_cube
from curbstone.operators.notes import clear_outs, date_problem_closures, non_service_by_period, non_service_open
from curbstone.plans import api, presentation
from curbstone.plans import domain as D
from curbstone.plans import figures as G
from curbstone.plans import records as R
from curbstone.plans.registry import add


def published(spark, d) -> api.Published:
    rows = D.requests(spark, d)
    age = (F.datediff(D.as_of(), F.col("created_date")) * 100).cast("long")
    pairs = lambda: D.non_service_pairs(rows, D.category_map(spark), D.line_map(spark))

    def cells_of(window: int, sets: list[tuple[str, ...]], where: dict):
        some = rows
        for c, v in where.items():
            some = some.filter(F.col(c) == v)
        return window_cube(some, D.as_of(), (window,), sets), open_cube(some, D.as_of(), age, sets)

    names = {slug_of(r[0]): r[0] for r in D.load(spark, d, "nation").filter("n_nationkey <> 24").select("n_name").collect()}
    return api.Published(
        date.fromisoformat(D.AS_OF),
        date.fromisoformat(D.BACKLOG_FROM),
        api.service_categories(),
        names,
        cells=cells_of,
        stats=lambda: window_cube(rows, D.as_of(), D.WINDOWS),
        open=lambda: open_cube(rows, D.as_of(), age),
        backlog=lambda: daily_backlog(rows, D.as_of(), D.BACKLOG_FROM),
        exclusions=lambda: non_service_by_period(rows, pairs(), D.as_of(), D.WINDOWS),
        exclusions_open=lambda: non_service_open(rows, pairs(), D.as_of()),
        date_problems=lambda: date_problem_closures(rows, D.as_of(), D.WINDOWS),
        clear_outs=lambda: clear_outs(rows, F.lit(R.NOTES_FROM).cast("date"), D.SWEEP_LEAST),
    )


def cells_sql(window: int, where: str) -> str:
    """SQL of api.cells for cells that satisfy where."""
    side = lambda s: ", ".join(f"coalesce(max({c}) FILTER (period = '{s}'), 0) AS {s}_{c}" for c in api.STAT_COUNTS) + ", " + ", ".join(f"max({c}) FILTER (period = '{s}') AS {s}_{c}" for c in ("median_days", "p90_days"))
    counts = ", ".join(f"coalesce({s}_{c}, 0) AS {s}_{c}" for s in ("current", "prior") for c in api.STAT_COUNTS)
    return f"""{G.CUBE_SQL}, {G.OPEN_CTE}, sided AS (SELECT {G.CELL}, {side('current')}, {side('prior')} FROM cube WHERE window_days = {window} AND {where} GROUP BY ALL),
  joined AS (SELECT {G.CELL}, {counts}, current_median_days, current_p90_days, prior_median_days, prior_p90_days, coalesce(open_count, 0) AS open_count, median_age_days
    FROM sided FULL JOIN (SELECT * FROM open_cube WHERE {where}) USING ({G.CELL})),
  whole AS (SELECT *, round(current_median_days * 100)::BIGINT AS m1, round(prior_median_days * 100)::BIGINT AS m0,
    current_closed_count >= 30 AND prior_closed_count >= 30 AND current_median_days IS NOT NULL AND prior_median_days IS NOT NULL AS enough FROM joined),
  cells AS (SELECT * EXCLUDE (m1, m0, enough),
    CASE WHEN NOT enough THEN NULL WHEN m0 = 0 THEN CASE WHEN m1 = 0 THEN 'steady' ELSE 'slower' END WHEN abs(m1 - m0) * 20 < m0 THEN 'steady' WHEN m1 > m0 THEN 'slower' ELSE 'faster' END AS direction,
    CASE WHEN enough AND m0 <> 0 THEN (sign(m1 - m0) * ((2000 * abs(m1 - m0) + m0) // (2 * m0)))::DOUBLE / 10 END AS pct FROM whole)"""


add("api1_set2_neighborhoods", lambda s, d: api.neighborhoods(published(s, d)), f"{G.CUBE_SQL} SELECT DISTINCT neighborhood_slug, n_name AS name FROM cube JOIN nation ON lower(replace(n_name, '_', '-')) = neighborhood_slug WHERE neighborhood_slug <> ''")
add("api2_neighborhood_stats", lambda s, d: api.neighborhood_stats(published(s, d), "nation-6", 365, "parking"), cells_sql(365, "district_number = 0 AND neighborhood_slug = 'nation-6' AND category_group = 'Parking'") + " SELECT * FROM cells")
add("api3_sort4_category_summary", lambda s, d: api.category_summary(published(s, d), 90, 2), cells_sql(90, "district_number = 2 AND neighborhood_slug = ''") + " SELECT * FROM cells")
add("api4_join17_map", lambda s, d: api.map_cells(published(s, d), 365), cells_sql(365, "district_number = 0 AND neighborhood_slug <> '' AND category_group = ''") + " SELECT c.*, n_name AS name FROM cells c JOIN nation ON lower(replace(n_name, '_', '-')) = neighborhood_slug")
add("api5_flt10_backlog_days", lambda s, d: api.backlog(published(s, d), "1999-01-01", "2001-03-15", "Solid Waste", 3), f"{D.SQL}, {G.BACKLOG_CTE} SELECT day AS date, opened, closed, open_at_end FROM backlog WHERE district_number = 3 AND category_group = 'Solid Waste' AND day <= DATE '2001-03-15'")
add("api5_backlog_weeks", lambda s, d: api.backlog(published(s, d), None, None, None, None, "week"), f"""{D.SQL}, {G.BACKLOG_CTE} SELECT date_trunc('week', day)::DATE AS date, sum(opened)::BIGINT AS opened, sum(closed)::BIGINT AS closed, arg_max(open_at_end, day) AS open_at_end
  FROM backlog WHERE district_number = 0 AND category_group = '' GROUP BY ALL""")
SLOWER = "SELECT name, (m1 - m0) / 100.0::DOUBLE AS added_days, pct, current_median_days, prior_median_days FROM (SELECT *, round(current_median_days * 100)::BIGINT AS m1, round(prior_median_days * 100)::BIGINT AS m0, {0} AS name FROM cells WHERE direction = 'slower' AND {0} <> '') ORDER BY added_days DESC, pct DESC NULLS FIRST, name LIMIT {1}"
add("api6_slower_neighborhoods", lambda s, d: api.getting_slower(published(s, d), "neighborhood", 365, None, None, 5), cells_sql(365, "district_number = 0 AND neighborhood_slug <> '' AND category_group = ''") + " " + SLOWER.format("neighborhood_slug", 5))
add("api6_slower_categories", lambda s, d: api.getting_slower(published(s, d), "category", 90), cells_sql(90, "district_number = 0 AND neighborhood_slug = ''") + " " + SLOWER.format("category_group", 10))
add("api6_agg23_trend_counts", lambda s, d: api.trend_counts(published(s, d), "neighborhood", 365), cells_sql(365, "district_number = 0 AND neighborhood_slug <> '' AND category_group = ''") + """ SELECT count(*) FILTER (direction = 'slower') AS slower, count(*) FILTER (direction = 'steady') AS steady, count(*) FILTER (direction = 'faster') AS faster, count(*) FILTER (direction IS NULL) AS "none" FROM cells""")
PROBLEMS = "problems AS (SELECT window_days, period, name AS label, count(*) AS closed_count FROM requests JOIN periods ON backlog_close_date > before_day AND backlog_close_date <= to_day JOIN flag_map ON bit & 15 <> 0 AND dq_flags & bit <> 0 WHERE service AND status_group = 'Closed' AND dq_flags & 15 <> 0 GROUP BY ALL)"
add("api8_flt6_exclusions", lambda s, d: api.exclusions(published(s, d), 365), f"""{D.SQL}, {R.TYPED_PERIODS}, {R.TYPED_OPEN}, {PROBLEMS} SELECT 'non_service' AS kind, type_group AS category_group, type_label AS label, coalesce(opened_count, 0) AS opened_count, coalesce(closed_count, 0) AS closed_count, coalesce(open_count, 0) AS open_count
  FROM (SELECT * FROM typed_periods WHERE window_days = 365 AND period = 'current') FULL JOIN typed_open USING (type_group, type_label)
  UNION ALL SELECT 'dq_flag', '', label, 0, closed_count, 0 FROM problems WHERE window_days = 365 AND period = 'current'""")
add("agg24_exclusion_totals", lambda s, d: api.totals(api.exclusions(published(s, d), 365), "opened_count", "closed_count", "open_count"), f"""{D.SQL}, {R.TYPED_PERIODS}, {R.TYPED_OPEN}, {PROBLEMS},
  a AS (SELECT sum(opened_count) AS o, sum(closed_count) AS c FROM typed_periods WHERE window_days = 365 AND period = 'current'), b AS (SELECT sum(open_count) AS n FROM typed_open),
  f AS (SELECT sum(closed_count) AS c FROM problems WHERE window_days = 365 AND period = 'current')
  SELECT coalesce(a.o, 0)::BIGINT AS opened_count, (coalesce(a.c, 0) + coalesce(f.c, 0))::BIGINT AS closed_count, coalesce(b.n, 0)::BIGINT AS open_count FROM a, b, f""")
add("api9_flt7_clear_outs", lambda s, d: api.clear_out_notes(published(s, d), None, None, "parking").select("day", "category_group", "closed_count", "avg_age_days", "minutes_spanned", "is_sweep"), f"{D.SQL}, {R.NOTES} SELECT day, category_group, closed_count, avg_age_days, minutes_spanned, is_sweep FROM clear_outs WHERE category_group = 'Parking' AND day >= DATE '{D.BACKLOG_FROM}' AND day <= DATE '{D.AS_OF}'")


def bins(spark, d):
    """AGG-26, FLT-12: quantile bins of the map's medians."""
    return presentation.with_bins(presentation.shadeable(api.map_cells(published(spark, d), 365)), "current_median_days").select("neighborhood_slug", "bin")


add("agg26_flt12_map_bins", bins, cells_sql(365, "district_number = 0 AND neighborhood_slug <> '' AND category_group = ''") + """, s AS (SELECT * FROM cells WHERE current_closed_count >= 30 AND current_median_days IS NOT NULL),
  cuts AS (SELECT quantile_cont(current_median_days, [0.2, 0.4, 0.6, 0.8]) AS q FROM s) SELECT neighborhood_slug, len(list_filter(q, lambda x: current_median_days > x))::INT AS bin FROM s, cuts""")


def chart_notes(spark, d):
    """JOIN-21, API-12: weeks of the chart with how many clear-outs they had."""
    p = published(spark, d)
    weeks = api.backlog(p, grain="week")
    notes = presentation.notes_by(p.clear_outs, "week").select("date", F.size("notes").alias("n"))
    return weeks.join(notes, "date", "left").select("date", "open_at_end", F.coalesce("n", F.lit(0)).alias("n"))


add("join21_api12_chart_notes", chart_notes, f"""{D.SQL}, {G.BACKLOG_CTE}, {R.NOTES}, w AS (SELECT date_trunc('week', day)::DATE AS date, arg_max(open_at_end, day) AS open_at_end FROM backlog WHERE district_number = 0 AND category_group = '' GROUP BY ALL),
  c AS (SELECT date_trunc('week', day)::DATE AS date, count(*) AS n FROM clear_outs GROUP BY ALL) SELECT date, open_at_end, coalesce(n, 0)::INT AS n FROM w LEFT JOIN c USING (date)""")


def sorted_table(spark, d):
    """SORT-6: the category table by change, nulls last."""
    return presentation.sorted_by(api.category_summary(published(spark, d), 365), "pct", True).select("category_group", "pct", "direction")


add("sort6_category_table", sorted_table, cells_sql(365, "district_number = 0 AND neighborhood_slug = ''") + " SELECT category_group, pct, direction FROM cells")


def cross_check(spark, d):
    """AGG-31: the headline from the seeds alone, by anti joins and a window percentile; the cube must agree."""
    rows = D.cleaned(spark, d)
    pairs = D.non_service_pairs(rows, D.category_map(spark), D.line_map(spark)).select(F.col("category_level1").alias("a"), F.col("category_level2").alias("b"))
    rows = rows.join(F.broadcast(pairs), (F.col("category_level1") == F.col("a")) & F.col("category_level2").eqNullSafe(F.col("b")), "left_anti")
    rows = rows.filter("timed").filter((F.col("closed_date") > F.date_sub(D.as_of(), 365)) & (F.col("closed_date") <= D.as_of()))
    return rows.groupBy("category_group").agg(F.count(F.lit(1)).alias("closed_count"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY hundredths)").alias("median"))


add("agg31_win3_cross_check", cross_check, f"""{D.SQL} SELECT category_group, count(*) AS closed_count, quantile_cont(hundredths::DOUBLE, 0.5) AS median FROM served s
  WHERE service AND timed AND closed_date > DATE '{D.AS_OF}' - 365 AND closed_date <= DATE '{D.AS_OF}' GROUP BY ALL""")
