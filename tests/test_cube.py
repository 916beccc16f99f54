from datetime import date, datetime, timedelta
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curbstone.functions.numbers import MEDIAN, P90, exact_percentiles, percentile_of_array, trend
from curbstone.operators import classify, cube, notes

AS_OF = date(2026, 10, 2)
D = lambda n: AS_OF - timedelta(n)
SCHEMA = (
    "neighborhood_slug string, district_number int, category_group string, status_group string, created_date date, closed_date date, backlog_close_date date, "
    "hundredths bigint, timed boolean, bulk boolean, service boolean, present boolean, dq_flags int, closed_ts timestamp"
)


def row(n="downtown", d=4, c="Water", created=0, closed=None, days=None, status=None, timed=None, bulk=False, service=True, flags=0, left=None, minute=0):
    closed_day = None if closed is None else D(closed)
    left_day = closed_day if left is None else D(left)
    timed = (closed is not None and days is not None) if timed is None else timed
    ts = None if closed is None else datetime(closed_day.year, closed_day.month, closed_day.day, 20, minute)
    return (n, d, c, status or ("Open" if left_day is None else "Closed"), D(created), closed_day, left_day, None if days is None else int(days * 100), timed, bulk, service, True, flags, ts)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def cells(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def exact(values, a, b):
    v, n = sorted(values), len(values)
    k = Fraction(a * (n - 1), b)
    lo = int(k)
    x = v[lo] + (k - lo) * (v[min(lo + 1, n - 1)] - v[lo])
    return int(x + Fraction(1, 2))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5000), min_size=1, max_size=40), min_size=1, max_size=12))
def test_percentiles_are_exact(spark, groups):
    df = spark.createDataFrame([(g, v) for g, vs in enumerate(groups) for v in vs], "g int, v bigint").withColumn("n", F.lit(1))
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", "n", {"median": MEDIAN, "p90": P90}).collect()}
    for g, vs in enumerate(groups):
        assert (got[g]["n"], got[g]["median"], got[g]["p90"]) == (len(vs), exact(vs, 1, 2), exact(vs, 9, 10))
    df = spark.createDataFrame([(sorted(vs),) for vs in groups], "v array<bigint>")
    assert [r[0] for r in df.select(percentile_of_array(F.col("v"), 9, 10)).collect()] == [exact(vs, 9, 10) for vs in groups]


def test_worked_scenario(spark):
    rows = [row(created=d + 1, closed=1, days=d) for d in (1, 2, 3, 10)]
    rows += [row(created=5, left=1, status="Closed", timed=False), row(created=2), row(created=4), row(created=140, closed=40, days=100)]
    rows += [row(n="oak", created=20, closed=1, days=k) for k in range(1, 31)] + [row(n="oak", created=60, closed=45, days=2)] * 30
    got = cells(cube.window_cube(frame(spark, rows), F.lit(AS_OF)).filter("window_days = 30"), "neighborhood_slug", "district_number", "category_group", "period")
    a, b = got["downtown", 0, "", "current"], got["downtown", 0, "", "prior"]
    assert (a["opened_count"], a["closed_count"], a["excluded_count"], a["median_days"], a["p90_days"]) == (7, 4, 1, 2.5, 7.9)
    assert (b["closed_count"], b["median_days"], b["p90_days"]) == (1, 100.0, 100.0)
    oak = got["oak", 4, "Water", "current"]
    assert (oak["median_days"], oak["p90_days"]) == (15.5, 27.1)
    t = trend(F.lit(30), F.lit(1550), F.lit(30), F.lit(200))
    assert tuple(spark.range(1).select(t.alias("t")).first()["t"]) == ("slower", 675.0)


def test_period_edges(spark):
    days = spark.createDataFrame([(D(n),) for n in (-1, 0, 29, 30, 59, 60)], "d date")
    assert [r[0] for r in days.select(cube.period_of(F.col("d"), F.lit(AS_OF), 30)).collect()] == [None, "current", "current", "prior", "prior", None]


def test_rows_without_a_value_leave_its_sets(spark):
    got = cells(cube.window_counts(frame(spark, [row(n=None, d=None), row()]), F.lit(AS_OF), (30,)), "neighborhood_slug", "district_number", "category_group")
    assert {k: r["opened_count"] for k, r in got.items()} == {
        ("", 0, ""): 2, ("", 0, "Water"): 2, ("downtown", 0, ""): 1, ("", 4, ""): 1, ("downtown", 4, ""): 1, ("downtown", 0, "Water"): 1, ("", 4, "Water"): 1, ("downtown", 4, "Water"): 1,
    }


def test_empty_table_gives_no_cells(spark):
    empty = frame(spark, [])
    assert cube.window_cube(empty, F.lit(AS_OF)).count() == cube.daily_backlog(empty, F.lit(AS_OF), "2026-10-01").count() == 0


def test_open_and_backlog(spark):
    df = frame(spark, [row(created=4), row(created=2), row(created=900, left=1), row(created=3, left=0), row(created=-1)])
    got = cells(cube.open_cube(df, F.lit(AS_OF), (F.datediff(F.lit(AS_OF), "created_date") * 100).cast("long")), "neighborhood_slug", "district_number", "category_group")
    assert (got["", 0, ""]["open_count"], got["", 0, ""]["median_age_days"]) == (2, 3.0)
    days = [r for r in cube.daily_backlog(df, F.lit(AS_OF), "2026-09-28").filter("district_number = 0 and category_group = ''").orderBy("day").collect()]
    assert [(r["opened"], r["closed"], r["open_at_end"]) for r in days] == [(1, 0, 2), (1, 0, 3), (1, 0, 4), (0, 1, 3), (0, 1, 2)]


@pytest.mark.parametrize(("n", "member"), [(100, True), (99, False)])
def test_clear_out_day_needs_a_hundred(spark, n, member):
    rows = [row(c="Parking", created=200, closed=3, days=200, minute=k % 60) for k in range(n)] + [row(c="Parking", created=200, closed=3, days=d, minute=59) for d in (90, 91)]
    df = frame(spark, rows)
    got = classify.with_bulk(df, classify.clear_out_days(df), classify.sweep_minutes(df)).groupBy("hundredths").agg(F.count_if("bulk").alias("n"))
    assert {r[0]: r[1] for r in got.collect()} == ({20000: n, 9000: 0, 9100: 1} if member else {20000: 0, 9000: 0, 9100: 0})


@pytest.mark.parametrize(("n", "member"), [(50, True), (49, False)])
def test_sweep_minute_needs_fifty_of_any_category(spark, n, member):
    df = frame(spark, [row(c="ABC"[k % 3], created=200, closed=3, days=181) for k in range(n)] + [row(c="A", created=200, closed=3, days=300, flags=4)])
    got = classify.with_bulk(df, classify.clear_out_days(df), classify.sweep_minutes(df))
    assert got.filter("bulk").count() == (n if member else 0)
    notes_ = {r["category_group"]: r for r in notes.clear_outs(got, F.lit(D(100))).collect()}
    if member:
        assert notes_["C"]["sweep_categories"] == ["A", "B"] and notes_["A"]["minutes_spanned"] == 1 and notes_["A"]["avg_age_days"] == 181.0


@pytest.mark.parametrize(
    ("closed", "average", "minutes", "others", "want"),
    [
        (1, 200.5, 1, None, "On 2026-09-29, Parking closed 1 request 201 days old."),
        (1200, 199.4, 1, None, "On 2026-09-29, Parking closed 1,200 requests averaging 199 days old in one minute."),
        (120, 1200.0, 1500, ["A", "B", "C"], "On 2026-09-29, Parking closed 120 requests averaging 1,200 days old over 1,500 minutes. In the same minute, A, B and C also closed old requests."),
        (120, 1.0, 1, ["A"], "On 2026-09-29, Parking closed 120 requests averaging 1 days old in one minute. In the same minute, A also closed old requests."),
    ],
)
def test_sentence(spark, closed, average, minutes, others, want):
    df = spark.createDataFrame([(date(2026, 9, 29), "Parking", closed, average, minutes, others)], "d date, c string, n bigint, a double, m int, o array<string>")
    assert df.select(notes.sentence(*[F.col(c) for c in "dcnamo"])).first()[0] == want


@pytest.mark.parametrize(
    ("n1", "m1", "n0", "m0", "want"),
    [(29, 5, 30, 5, None), (30, None, 30, 5, None), (30, 0, 30, 0, ("steady", None)), (30, 5, 30, 0, ("slower", None)), (30, 104, 30, 100, ("steady", 4.0)), (30, 105, 30, 100, ("slower", 5.0)), (30, 95, 30, 100, ("faster", -5.0)), (30, 96, 30, 100, ("steady", -4.0))],
)
def test_trend(spark, n1, m1, n0, m0, want):
    df = spark.createDataFrame([(n1, m1, n0, m0)], "a int, b bigint, c int, d bigint")
    got = df.select(trend(*[F.col(c) for c in "abcd"]).alias("t")).first()["t"]
    assert (None if got is None else tuple(got)) == want
