"""How many tasks near deduplication takes where a session shuffles to many partitions: each leaves files and events."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

PARTITIONS = 40


@pytest.fixture
def many_partitions(spark):
    """Every shuffle has PARTITIONS partitions, however little is in them."""
    ours = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _tasks(spark, name: str, run) -> tuple[int, object]:
    """(tasks that ended in run(), what it gave)."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        got = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    infos = [tracker.getStageInfo(s) for s in stages]
    return sum(i.numCompletedTasks for i in infos if i), got


def _roots(edges: list[tuple[int, int]]) -> dict[int, int]:
    up = {x: x for e in edges for x in e}

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("alone", [0, 1 << 17])
def test_components_by_shuffles_and_by_one_task(spark, monkeypatch, alone):
    from curbstone.llm import components as c

    monkeypatch.setattr(c, "TASK_EDGES", alone)
    draw = random.Random(5)
    edges = [(draw.randrange(900), draw.randrange(900)) for _ in range(500)]
    edges += [(1000, 1000 + k) for k in range(1, 400)] + [(2000 + k, 2001 + k) for k in range(60)]
    real = [(a, b) for a, b in edges if a != b]
    got = c.components(spark.createDataFrame([*edges, (7, None)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(_roots(real).items())


def test_components_of_few_edges_take_few_tasks(spark, many_partitions):
    from curbstone.llm.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(64)], "a long, b long")
    n, got = _tasks(spark, "components", lambda: components(edges).collect())
    assert {r[1] for r in got} == {0} and len(got) == 65
    assert n <= 6 * PARTITIONS


def test_components_are_dealt_out_evenly(spark, many_partitions):
    from curbstone.llm.common import keep
    from curbstone.llm.components import components

    edges = spark.createDataFrame([(k, k % 50) for k in range(50, 4000)], "a long, b long")
    sizes = [r["count"] for r in keep(components(edges)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 3 * 4000 / PARTITIONS


def test_near_duplicates_take_few_tasks(spark, many_partitions):
    from curbstone.llm.near import near_duplicates

    draw = random.Random(7)
    base = [[f"w{draw.randrange(5000)}" for _ in range(60)] for _ in range(20)]
    rows = []
    for k, words in enumerate(base):
        for copy in range(4):
            text = list(words)
            if copy:
                text[copy] = f"x{k}"
            rows.append((10 * k + copy, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    n, got = _tasks(spark, "near", lambda: near_duplicates(docs).collect())
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 10 for i, _ in rows}
    assert n <= 45 * PARTITIONS
