"""Counts that are kept and moved by changes, against counting all requests again and against figures made straight from requests."""

import random
from datetime import datetime, timedelta, timezone

from fake_feed import FakeFeed, feature, ms
from pyspark.sql import functions as F

from curbstone.functions.maps import BACKLOG_START, line_map
from curbstone.operators import classify, cube, kept, notes
from curbstone.plans.jobs import PUBLISHED, Jobs
from curbstone.sources.store import Store

DAY = datetime(2026, 10, 2, 20, tzinfo=timezone.utc)
CLOSED = {"PublicStatus": "CLOSED", "DateCreated": ms("2026-03-13T20:00:00")}


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def made(spark, tmp_path):
    fake, clock = FakeFeed([]), [DAY]
    j = Jobs(spark, Store(spark, str(tmp_path / "store")), fake.feed(), lambda: clock[0])
    j.refresh_if_due = j.check = lambda _: None
    j._tidy = lambda: None  # so that changes are still told apart
    return fake, clock, j


def straight(j, now):
    """The published tables by the functions that take requests themselves."""
    table = j.store.read("service_request")
    day = F.lit(now.date())
    r = j.described(table).drop("bulk", *notes.TYPE)
    pairs = classify.non_service_pairs(r, j.maps[0], line_map(j.spark))
    r = classify.with_bulk(r, classify.clear_out_days(r), classify.sweep_minutes(r)).cache()
    present = r.filter("present")
    age = F.greatest(F.lit(0).cast("long"), F.floor((F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis("created_utc")) / 864000 + 0.5).cast("long"))
    return {
        "stats_window": cube.window_cube(present, day), "open_backlog": cube.open_cube(present.filter("created_utc is not null"), day, age), "backlog_daily": cube.daily_backlog(present, day),
        "exclusion": notes.non_service_by_period(r, pairs, day), "exclusion_open": notes.non_service_open(r, pairs, day), "exclusion_flag": notes.date_problem_closures(r, day),
        "clear_out": notes.clear_outs(r, F.lit(BACKLOG_START).cast("date")),
    }, r


def same(j, clock, whole, most=None, plain=False):
    """Refreshes from changes, and what is kept is what counting all again gives; with plain, what is published is what requests give."""
    with j.store.lock():
        info = j.refresh()
        assert info["whole"] == whole and (most is None or info["read"] <= most), info
        labels = F.when(F.col("dq_flags").bitwiseAND(4096) != 0, 1).otherwise(0)
        if plain:
            wanted, r = straight(j, clock[0])
            for n, df in wanted.items():
                assert rows(j.store.read(n)) == rows(df), n
            assert rows(j.store.read("service_request").select("reference_number", labels.alias("b"))) == rows(r.select("reference_number", F.col("bulk").cast("int").alias("b")))
        counts = {n: rows(j.store.read(f"kept_{n}")) for n in kept.KEPT}
        again = j.refresh(whole=True)
        assert {n: rows(j.store.read(f"kept_{n}")) for n in kept.KEPT} == counts and again["requests"] == info["requests"]
    j.spark.catalog.clearCache()
    return info


def refresh(j):
    with j.store.lock():
        return j.refresh()


def put(fake, j, features):
    fake.features = features
    j.backfill(restart=True)


def test_random_batches_move_counts_to_what_all_requests_give(spark, tmp_path):
    rng = random.Random(7)
    fake, clock, j = made(spark, tmp_path)
    kinds = ["Water", "Parking", "Other", "Oddments", "Solid Waste", "Animal Control"]

    def one(k, when):
        created = ms("2026-01-05T12:00:00") + rng.randrange(0, 280) * 86_400_000
        more = {"CategoryLevel1": rng.choice(kinds), "CategoryLevel2": rng.choice([None, "General", "Leak"]), "DateCreated": rng.choice([created, created, created, None, ms("2027-06-01T00:00:00")])}
        if rng.random() < 0.6:
            more |= {"PublicStatus": rng.choice(["CLOSED", "CLOSED", "CANCELLED"]), "DateClosed": rng.choice([created + rng.randrange(0, 240) * 86_400_000, created - 5_000_000, None])}
        return feature(rng.randrange(1, 10**6), f"R{k:03d}", when, Neighborhood=rng.choice(["Pocket", "Natomas", None]), CouncilDistrictNumber=f"District {rng.randrange(1, 9)}", **more)

    put(fake, j, [one(k, "2026-09-01T12:00:00") for k in range(120)])
    assert same(j, clock, True)["requests"] == 120
    clock[0] += timedelta(days=40)
    put(fake, j, [one(k, "2026-09-02T12:00:00") for k in rng.sample(range(140), 15)])
    with j.store.lock():
        gone = j.store.read("service_request").orderBy(F.xxhash64("object_id")).limit(3)
        j._put(gone.withColumn("source_removed_utc", F.lit(clock[0]).cast("timestamp")))
    same(j, clock, False, 18, plain=True)


def test_clear_outs_that_begin_and_end_move_the_labels_of_others(spark, tmp_path):
    fake, clock, j = made(spark, tmp_path)
    closing = lambda k, n, at: feature(k, f"P{k}", f"2026-09-29T20:0{n}:00", CategoryLevel1="Parking", DateClosed=ms(at), **CLOSED)
    put(fake, j, [closing(k, 0, f"2026-09-29T{8 + k % 10:02d}:{k % 60:02d}:00") for k in range(100, 199)] + [feature(1, "W1")])
    refresh(j)
    labelled = lambda: j.store.read("service_request").filter("dq_flags & 4096 <> 0").count()
    assert labelled() == 0
    put(fake, j, [closing(300, 0, "2026-09-29T20:30:00")])  # the hundredth: the others' labels change with it
    info = same(j, clock, False)
    assert labelled() == 100 and info["read"] == 100
    put(fake, j, [closing(301, 1, "2026-09-29T21:00:00")])  # one more: no other label changes, and no other is read
    info = refresh(j)
    assert (info["whole"], info["read"], labelled()) == (False, 1, 101)
    put(fake, j, [feature(k, f"P{k}", "2026-09-30T20:00:00", CategoryLevel1="Parking") for k in (300, 301)])  # open again
    refresh(j)
    assert labelled() == 0
    minute = "2026-09-29T12:34:00"
    put(fake, j, [feature(k, f"S{k}", "2026-09-29T20:00:00", CategoryLevel1=("Water", "Animal Control")[k % 2], DateClosed=ms(minute) + k, **CLOSED) for k in range(400, 450)])
    same(j, clock, False, plain=True)
    assert labelled() == 51  # a sweep minute of two categories, in which P154 was closed too


def test_what_can_not_be_told_is_counted_whole(spark, tmp_path):
    fake, clock, j = made(spark, tmp_path)
    put(fake, j, [feature(k, f"R{k}") for k in range(1, 9)])
    refresh(j)
    with j.store.lock():
        assert j.refresh()["read"] == 0
        old = j.store.value("refresh")["version"]
        j.store.commit(upsert={"service_request": (j.store.read("service_request"), "reference_number")})
        assert j.store.later("service_request", old) and j.refresh()["read"] == 8
        Jobs._tidy(j)  # rewrites the table, whose counts stay known
        assert j.store.value("refresh")["version"]["of"] != old["of"] and (j.refresh()["whole"], j.refresh()["read"]) == (False, 0)
        clock[0] -= timedelta(days=3)
        assert j.refresh()["whole"] is True  # an earlier day than the kept one
        j._rules = lambda: "others"
        assert j.refresh()["whole"] is True
        j.store.commit(replace={"service_request": j.store.read("service_request").filter("reference_number <> 'R1'")})
        again = j.refresh()
        assert again["whole"] is True and again["requests"] == 7
