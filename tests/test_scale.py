"""Steps whose cost must not lie in one task or be paid twice."""

import os
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_places_number_groups_that_no_task_sorts_whole(spark):
    from curbstone.operators.reconcile import places

    rows = spark.range(5000).select(F.when(F.col("id") % 10 > 0, "a").when(F.col("id") % 20 > 0, "b").alias("g"), F.format_string("%05d", (F.col("id") * 1237) % 5000).alias("k"))
    got = places(rows, "g", "k", part=300)
    found, want = {}, {}
    for r in got.collect():
        found.setdefault(r["g"], []).append((r["place"], r["k"]))
    for r in rows.collect():
        want.setdefault(r["g"], []).append(r["k"])
    assert {g: sorted(v) for g, v in found.items()} == {g: list(enumerate(sorted(v))) for g, v in want.items()}
    assert "windowspecdefinition(__part" in got._jdf.queryExecution().analyzed().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_chunks_sort_no_status_whole(spark):
    from curbstone.plans import records

    plan = records.chunks(spark, SF)._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"windowspecdefinition\(public_status#\d+, reference_number", plan)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_requests_are_classified_once_for_a_pivot(spark, monkeypatch):
    from curbstone.plans import domain, figures

    calls, of = [], domain.requests
    monkeypatch.setattr(domain, "requests", lambda *a: calls.append(a) or of(*a))
    figures.pivoted(spark, SF)
    assert len(calls) == 1


def test_materialized_tables_are_read_by_column(spark, tmp_path, monkeypatch):
    from curbstone.session import materialized

    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: str(tmp_path))
    df = materialized(spark.range(9).select("id", F.lit("x").alias("text"), F.array(F.col("id")).alias("a")))
    assert df.count() == 9 and "ReadSchema: struct<id:bigint>" in df.select("id")._jdf.queryExecution().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_only_the_counts_asked_for_are_moved(spark, monkeypatch):
    from curbstone.operators import kept
    from curbstone.plans import changes

    names, of = set(), kept.counted
    monkeypatch.setattr(kept, "counted", lambda rows, name, *more: names.add(name) or of(rows, name, *more))
    changes.moved_counts(spark, SF, "daily")
    assert names == {"closures", "daily"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_what_is_held_and_what_is_newest_come_from_one_pass(spark, monkeypatch):
    from curbstone.plans import changes, domain

    read, of = [], domain.load
    monkeypatch.setattr(domain, "load", lambda s, d, name: read.append(name) or of(s, d, name))
    changes.moved_counts(spark, SF, "events")
    assert (read.count("lineitem"), read.count("orders")) == (1, 1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_moved_counts_are_those_of_sql_where_newest_versions_lack_their_part(spark, tmp_path):
    import duckdb
    from test_queries import plain

    from curbstone.plans import registry

    name, c = "str11_cube_from_changes", duckdb.connect()
    for t in ("nation", "customer", "part", "orders", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").filter("p_partkey % 3 <> 1" if t == "part" else "true").write.parquet(f"{tmp_path}/{t}.parquet")
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    want = c.sql(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(map(plain, x))) for x in got.collect()) == sorted(repr(tuple(map(plain, x))) for x in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_and_newest_are_the_versions_that_each_has_alone(spark):
    from curbstone.plans import domain as D

    names = ["reference_number", "object_id", "updated_ts", "public_status", "closed_ts", "category_level1", "district_number", "neighborhood_slug"]
    rows, all_ = D.held_and_newest(spark, SF, F.col("l_partkey") % 10 != 0).cache(), D.versions(spark, SF)
    for got, want in ((rows.filter("now"), D.latest(all_)), (rows.filter("held"), D.latest(all_.filter("object_id % 10 <> 0")))):
        got, want = got.select(*names), want.select(*names)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert rows.filter("not now and not held").count() == 0 and rows.filter("held and not now").count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rows_are_not_written_with_labels_for_one_table(spark, monkeypatch):
    from curbstone.operators import kept
    from curbstone.plans import domain as D

    written, of = [], kept.materialized
    monkeypatch.setattr(kept, "materialized", lambda df: written.append(df.columns) or of(df))
    rows = D.requests(spark, SF).drop("bulk")
    counts, labelled = kept.build(rows, None, D.DAY_LEAST, D.SWEEP_LEAST, ("daily",))
    assert len(written) == 2 and not any("bulk" in columns for columns in written)
    assert labelled.filter("bulk").count() == D.requests(spark, SF).filter("bulk").count() > 0 and set(counts) == {"closures", "daily"}
