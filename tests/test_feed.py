"""What the feed is asked for: filters of Spark's, figures by range; and how long it is asked."""

import json
import re
from datetime import datetime, timezone

import pytest
from fake_feed import FakeFeed, feature, ms
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, StringStartsWith

from curbstone.operators.profile import served_statistics
from curbstone.sources import feed as module
from curbstone.sources.feed import Breaker, FeedSource, Pushed, Refused, Retryable, measures, pages, with_functions, with_retries
from curbstone.sources.served import argument, pages_of, statistics_of

ID, TIME, KEY = ("object_id",), ("date_updated",), ("reference_number",)
T = ms("2026-09-20T12:00:00")


def test_filters_become_ranges_predicates_and_keys():
    p = Pushed(5, 900)
    other = StringStartsWith(("feature",), "x")
    filters = [GreaterThan(ID, 10), LessThanOrEqual(ID, 500), GreaterThanOrEqual(TIME, T), LessThan(TIME, T + 1500), EqualTo(KEY, "a'b"), other]
    assert list(p.take(filters)) == [filters[3], filters[4], other]  # a time within a second and keys are compared again
    where = "DateUpdated >= TIMESTAMP '2026-09-20 12:00:00' AND DateUpdated < TIMESTAMP '2026-09-20 12:00:02' AND ReferenceNumber IN ('a''b')"
    assert p.asks(1, "1=1") == [(10, 500, where)] and p.asks(2, "x > 1") == [(10, 255, f"x > 1 AND {where}"), (255, 500, f"x > 1 AND {where}")]
    p = Pushed()
    assert [*p.take([In(ID, (7, 3)), In(KEY, tuple(f"k{k}" for k in range(250)))])] and (p.after, p.last) == (2, 7) and len(p.asks(1, "1=1")) == 2
    p = Pushed(0, 100)
    assert not [*p.take([EqualTo(ID, 4), GreaterThan(ID, 50)])] and p.asks(3, "1=1") == []
    for f, rest, asked in (
        (EqualTo(TIME, T + 5), 1, ["DateUpdated >= TIMESTAMP '2026-09-20 12:00:00'", "DateUpdated < TIMESTAMP '2026-09-20 12:00:01'"]),
        (GreaterThan(TIME, T), 0, ["DateUpdated > TIMESTAMP '2026-09-20 12:00:00'"]),
        (GreaterThan(TIME, T + 5), 1, ["DateUpdated >= TIMESTAMP '2026-09-20 12:00:00'"]),
        (LessThan(TIME, T), 0, ["DateUpdated < TIMESTAMP '2026-09-20 12:00:00'"]),
        (LessThanOrEqual(TIME, T), 1, ["DateUpdated < TIMESTAMP '2026-09-20 12:00:01'"]),
        (LessThan(TIME, -5), 1, []),
    ):
        p = Pushed()
        assert len([*p.take([f])]) == rest and p.where == asked


def test_only_what_is_asked_for_leaves_the_feed(spark, tmp_path):
    """The feed notes what it is asked; Spark applies what is left, to the rows that a rough predicate lets through too."""
    rows = [feature(k, f"R{k % 50:03d}", f"2026-09-{1 + k % 28:02d}T00:00:00", ZIP=str(k % 7)) for k in range(1, 400)]
    log = str(tmp_path / "asked")

    def query(where, size):
        with open(log, "a", encoding="utf-8") as f:
            f.write(where + "\n")
        return FakeFeed(rows).query(where, size)

    spark.dataSource.register(with_functions(FeedSource, feed=query))
    df = spark.read.format("keyset_feed").option("pushdown", "true").option("last", 399).option("ranges", 2).option("pageSize", 20).load()
    keys = [f"R{k:03d}" for k in range(0, 50, 2)]
    asked = df.filter((F.col("object_id") > 100) & (F.col("date_updated") >= ms("2026-09-05T00:00:00")) & F.col("reference_number").isin(keys))
    asked = asked.filter(F.get_json_object("feature", "$.attributes.ZIP") == "3")
    got = {r["object_id"] for r in asked.collect()}
    want = [f["attributes"] for f in rows]
    assert got == {a["OBJECTID"] for a in want if a["OBJECTID"] > 100 and a["DateUpdated"] >= ms("2026-09-05T00:00:00") and a["ReferenceNumber"] in keys and a["ZIP"] == "3"} and got
    lines = open(log, encoding="utf-8").read().splitlines()
    assert lines and all("DateUpdated >= TIMESTAMP '2026-09-05 00:00:00'" in x and "ReferenceNumber IN ('R000'" in x for x in lines)
    assert {x.rsplit("<= ", 1)[1].split(")")[0] for x in lines} == {"249", "399"} and all(int(x.split("OBJECTID > ")[-1]) >= 100 for x in lines)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "get_json_object" in plan and not re.search(r"(date_updated|object_id)#\d+L >", plan)  # these aren't compared twice


def test_served_tables_answer_pages_and_figures(spark, tmp_path):
    t = [datetime(2026, 1, 1, 0, 0, k, 1500, tzinfo=timezone.utc) for k in range(10)]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(k, None if k == 3 else f"a AND (b'{k % 3}", t[k]) for k in range(10)], "n long, k string, t timestamp").coalesce(1).write.parquet(path)
    a = argument(path, OBJECTID="n", ReferenceNumber="k", DateUpdated="t")
    query = pages_of(a)
    ids = lambda where: [f["attributes"]["OBJECTID"] for _, p in pages(query, where, -1, 3) for f in p["features"]]
    assert ids("1=1") == list(range(10)) and ids("DateUpdated > TIMESTAMP '2026-01-01 00:00:07'") == [7, 8, 9]
    assert ids("ReferenceNumber IN ('a AND (b''1', 'x')") == [1, 4, 7] and query("OBJECTID = 2", 5)["features"][0]["attributes"]["DateUpdated"] == ms("2026-01-01T00:00:02") + 1
    with pytest.raises(ValueError, match="not a predicate"):
        query("n + 1 > 2", 5)
    got = statistics_of(a)("OBJECTID > 1", [("count", "OBJECTID"), ("max", "DateUpdated")], "ReferenceNumber")
    assert sorted((str(r["ReferenceNumber"]), r["count_objectid"]) for r in got) == [("None", 1), ("a AND (b'0", 2), ("a AND (b'1", 2), ("a AND (b'2", 3)]


def test_figures_by_range_are_merged(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def statistics(where, measures, group):
        """Counts and ends of the numbers 1 to 1000, by remainder."""
        with open(asked, "a", encoding="utf-8") as f:
            f.write(where + "\n")
        after, last = (int(x) for x in re.findall(r"OBJECTID (?:>|<=) (-?\d+)", where))
        found = {}
        for n in range(max(1, after + 1), min(1000, last) + 1):
            found.setdefault(n % 3 if group else None, []).append(n)
        value = {"count": len, "min": min, "max": max}
        return [{group: g} | {f"{s}_{f}".lower(): value[s](x) for s, f in measures} for g, x in found.items()] or ([] if group else [{f"{s}_{f}".lower(): 0 if s == "count" else None for s, f in measures}])

    (got,) = served_statistics(spark, statistics, "count OBJECTID, min OBJECTID, max OBJECTID", first=1, last=3000, ranges=5).collect()
    assert tuple(got) == (1000, 1, 1000) and len(open(asked, encoding="utf-8").read().splitlines()) == 5
    got = served_statistics(spark, statistics, "count OBJECTID, max OBJECTID", "ZIP", first=1, last=1000, ranges=4)
    assert got.columns == ["value", "count_objectid", "max_objectid"] and sorted(map(tuple, got.collect())) == [("0", 333, 999), ("1", 334, 1000), ("2", 333, 998)]
    with pytest.raises(ValueError, match="by range"):
        served_statistics(spark, statistics, "distinct OBJECTID", first=1, last=9, ranges=2)
    with pytest.raises(ValueError, match="measures are"):
        measures("median OBJECTID")


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_a_call_has_so_much_time_in_all():
    clock, tries = Clock(), []

    def slow():
        tries.append(1)
        clock.now += 40
        raise Retryable("later")

    with pytest.raises(Retryable, match="given up after 1[0-9][0-9] s: later"):
        with_retries(slow, retries=50, sleep=clock.sleep, total=150, clock=clock)
    assert clock.now < 150 + 40 and len(tries) == 4


def test_an_attempt_that_hangs_is_one_that_failed():
    import threading

    stuck, tries = threading.Event(), []

    def hangs():
        tries.append(1)
        if len(tries) == 1:
            stuck.wait(20)
        return {"ok": 1}

    assert with_retries(hangs, sleep=lambda s: None, attempt=0.05) == {"ok": 1} and len(tries) == 2
    stuck.set()
    with pytest.raises(KeyError):
        with_retries(lambda: {}["x"])


def test_a_dead_feed_is_asked_seldom(monkeypatch):
    clock, tries = Clock(), []
    breaker = Breaker(clock)

    def dead():
        tries.append(1)
        raise Retryable("HTTP 503")

    for _ in range(30):
        with pytest.raises(Retryable):
            with_retries(dead, retries=5, sleep=lambda s: None, clock=clock, breaker=breaker)
    assert len(tries) == module.FEWEST
    clock.now += module.OPEN_S
    with pytest.raises(Retryable):
        with_retries(dead, retries=0, clock=clock, breaker=breaker)
    assert len(tries) == module.FEWEST + 1 and breaker.opened is not None
    clock.now += module.OPEN_S
    assert with_retries(lambda: {"ok": 1}, retries=0, clock=clock, breaker=breaker) == {"ok": 1} and breaker.opened is None
    for k in range(100):  # a refusal is an answer, and a failure now and then doesn't open it
        with pytest.raises((Refused, Retryable)):
            with_retries(lambda: (_ for _ in ()).throw(Refused("400") if k % 3 else Retryable("503")), retries=0, clock=clock, breaker=breaker)
    assert breaker.opened is None


def test_features_keep_their_json(spark):
    rows = [feature(3, None, ZIP="é"), feature(4, 12)]
    rows[1]["attributes"]["DateUpdated"] = None
    spark.dataSource.register(with_functions(FeedSource, feed=FakeFeed(rows).query))
    got = spark.read.format("keyset_feed").load().collect()
    assert [(r["object_id"], r["reference_number"], r["date_updated"]) for r in got] == [(3, None, T), (4, "12", None)]
    assert json.loads(got[0]["feature"])["attributes"]["ZIP"] == "é"


def test_pages_of_a_table_are_cut_from_blocks(tmp_path, monkeypatch):
    """Rows in no order are all served, by far fewer reads of the table than there are pages, within a few blocks' rows."""
    import pyarrow as pa
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    from curbstone.sources import feed, served

    ids = [(k * 7919) % 10_007 for k in range(10_007)]
    pq.write_table(pa.table({"id": ids, "name": [f"n{k}" for k in ids]}), tmp_path / "t.parquet", row_group_size=1000)
    reads = []

    class Counted:
        def __init__(self, data):
            self.data, self.schema = data, data.schema

        def to_table(self, **how):
            reads.append(how)
            return self.data.to_table(**how)

        def to_batches(self, **how):
            reads.append(how)
            return self.data.to_batches(**how)

    opened = ds.dataset
    monkeypatch.setattr(served.ds, "dataset", lambda path: Counted(opened(path)))
    query = served.pages_of(served.argument(str(tmp_path / "t.parquet"), OBJECTID="id"))
    rows = [f["attributes"] for _, page in feed.pages(query, "1=1 AND OBJECTID <= 9000", -1, 50) for f in page["features"]]
    assert [(r["OBJECTID"], r["name"]) for r in rows] == [(k, f"n{k}") for k in range(9001)]
    assert len(reads) <= 2
    small = served.pages_of(served.argument(str(tmp_path / "t.parquet"), OBJECTID="id"), block=400)
    assert [f["attributes"]["OBJECTID"] for _, page in feed.pages(small, "1=1", 3000, 300) for f in page["features"]] == list(range(3001, 10_007))


def test_figures_of_a_table_are_merged(tmp_path):
    """Figures worked out a few rows at a time are those of all rows, for groups, nulls and no rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from curbstone.sources import served

    pq.write_table(pa.table({"id": list(range(1, 10)), "g": ["a", "b", None] * 3}), tmp_path / "t.parquet", row_group_size=2)
    ask = served.statistics_of(served.argument(str(tmp_path / "t.parquet"), OBJECTID="id", ReferenceNumber="g"))
    asked = [("count", "OBJECTID"), ("min", "OBJECTID"), ("max", "OBJECTID")]
    want = {"a": (3, 1, 7), "b": (3, 2, 8), None: (3, 3, 9)}
    assert {r["ReferenceNumber"]: (r["count_objectid"], r["min_objectid"], r["max_objectid"]) for r in ask("1=1", asked, "ReferenceNumber")} == want
    assert ask("OBJECTID > 99", asked, None) == [{"count_objectid": 0, "min_objectid": None, "max_objectid": None}]
