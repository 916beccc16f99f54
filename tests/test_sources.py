import json

import pytest
from pyspark.sql import functions as F

from curbstone.operators.profile import attribute_counts, match_rate
from curbstone.operators.quality import flag_count, null_rate, page_count_check, rejects, repeat_address, source_count
from curbstone.plans import api
from curbstone.sources.feed import FeedSource, page_baseline
from curbstone.sources.store import Store


def test_boundaries(spark, tmp_path):
    features = [{"properties": {"NAME": n}, "geometry": {"type": "Point", "coordinates": [k, 1]}} for k, n in enumerate(["Valley Hi / North Laguna", "Z'berg Park"])]
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = api.boundaries(spark, str(tmp_path / "b.json")).collect()
    assert [(r["name"], r["slug"]) for r in got] == [("Valley Hi / North Laguna", "valley-hi-north-laguna"), ("Z'berg Park", "zberg-park")]
    assert json.loads(got[1]["geometry"])["coordinates"] == [1, 1]


@pytest.mark.parametrize(("text", "want"), [("# x\n| Row count | 1,573,259 |\n", 1573259), ("| Row count | **12** |", 12), ("| Row count | 0 |", None), ("nothing", None), (None, None)])
def test_page_baseline(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(page_baseline(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("served", "want"), [(105, "Within"), (95, "Within"), (106, "Grew"), (94, "Dropped")])
def test_page_count(served, want):
    assert page_count_check(served, 100) == want


def test_quality_rules():
    s = lambda r: r["status"]
    assert [s(source_count(n, h)) for n, h in ((97, None), (97, 0), (97, 100), (98, 100))] == ["Info", "Info", "Fail", "Pass"]
    assert s(source_count(24, 25)) == "Pass"  # 24.5 rounds to 24, half to even
    assert [s(null_rate("zip", *x)) for x in ((9, 29, 0, 100), (9, 100, 4, 100), (10, 100, 4, 100), (0, 0, 0, 0))] == ["Info", "Pass", "Warn", "Info"]
    assert [s(flag_count("x", n, p)) for n, p in ((5, None), (150, 100), (151, 100), (10_100, 10_000), (10_101, 10_000))] == ["Info", "Pass", "Warn", "Pass", "Warn"]
    assert [s(repeat_address(x)) for x in ([], [("a", 99)], [("a", 100), ("b", 1)])] == ["Pass", "Pass", "Warn"] and [s(rejects(n)) for n in (0, 1)] == ["Pass", "Warn"]


def test_profile(spark):
    rows = spark.createDataFrame([("A/B", 3), ("a b", 1), ("C", 2)], "neighborhood string, n int")
    names = spark.createDataFrame([("A B",), ("D",)], "name string")
    assert tuple(match_rate(rows, names).first()) == (6, 4, 1, 4 / 6)
    assert [tuple(r) for r in attribute_counts(rows.union(rows.limit(1)), "neighborhood").limit(1).collect()] == [("A/B", 2)]


def test_batch_source_reads_every_page_in_ranges(spark):
    spark.dataSource.register(FeedSource)
    reader = spark.read.format("keyset_feed").option("feed", "fake_feed:shared_query").option("pageSize", 4)
    assert reader.load().count() == 23
    rows = reader.option("ranges", 5).option("last", 69).option("after", 6).load()
    assert rows.rdd.getNumPartitions() == 5 and sorted(r[0] for r in rows.select("object_id").collect()) == list(range(9, 70, 3))


def test_store_shows_whole_commits(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    df = lambda n: spark.range(n).toDF("x")
    first = s.commit(replace={"a": df(2)}, append={"log": df(1)}, values={"k": 1, "gone": 2})
    s.commit(append={"log": df(3)}, values={"gone": None})
    (tmp_path / "s" / "a" / "v3").mkdir()  # a crash left a part of a commit
    assert s.read("a").count() == 2 and s.read("log").count() == 4 and s.value("k") == 1 and s.value("gone") is None
    assert s.read("log", at=first).count() == 1 and s.read("none") is None and s.read("none", "x int").count() == 0
    s.commit(replace={"a": df(5)})
    assert s.read("a").count() == 5 and s.read("a", at=first).count() == 2
    s.compact("log", lambda d: d.filter("x > 0"))
    assert s.read("log").count() == 2


def test_rules_stop_a_publication(spark):
    from curbstone.operators.constraints import Rules, Violated, require, violations

    rows = lambda *r: spark.createDataFrame(list(r), "k int, s string, n int, low double, high double")
    rules = Rules(("k", "s"), ("n",), (("low", "high"),), {"s": ["a", "b"]})
    good = rows((1, "a", 0, None, None), (1, "b", 5, 1.0, 1.0))
    require({"t": (good, rules), "none": (good.limit(0), rules)})
    bad = rows((1, "a", 1, 1.0, 2.0), (1, "a", -1, 3.0, 2.0), (None, "c", None, 1.0, None), (None, "c", 1, None, None))
    got = {r["rule"]: r["n"] for r in violations({"t": (bad, rules)}).collect()}
    assert got == {"doubled": 2, "negative n": 2, "order of low, high": 2, "unknown s": 2}
    with pytest.raises(Violated, match="t: 2 rows, doubled"):
        require({"t": (bad, rules)})


def test_sql_functions_say_what_the_columns_say_and_need_no_python(spark):
    from curbstone.functions import clean, sql, text

    sql.register(spark)
    t = spark.createDataFrame([(x,) for x in (None, "", "   ", "  Valley  Hi / Z’berg ", "95814-1234", " 95814 ", "9581", "É a_b")], "s string")
    both = spark.sql("SELECT s, null_if_blank(s) AS a, map_key(s) AS b, slug(s) AS c, clean_zip(s) AS d FROM {t}", t=t)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "null_if_blank" not in plan
    s = F.col("s")
    want = t.select("s", text.null_if_blank(s), text.map_key(s), text.slug(s), clean.clean_zip(s)[0])
    assert sorted(map(repr, map(tuple, both.collect()))) == sorted(map(repr, map(tuple, want.collect())))
