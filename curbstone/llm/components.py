"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbstone.llm.common import keep

MOST_ROUNDS = 60
#: Nodes whose edges are dealt out, at most, and over how many parts.
HUBS, SALTS = 10_000, 64
#: Edges (16 bytes each) that a task takes alone; more are shuffled.
TASK_EDGES = 1 << 17


def _state(edges: DataFrame) -> tuple:
    """Changes whenever the edges do, but for chance."""
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40))), F.lit(0))).first())


def _edge(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour, or itself.

    Nodes with more than 1 / HUBS of all ends of edges are at most HUBS; they are sent to all executors, and their edges are dealt
    out over SALTS, so that a node which a third of all edges have is no single task.
    """
    both = edges.select(F.inline(F.array(_edge("a", "b"), _edge("b", "a"))))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    up = both.filter("b > a")
    hubs = keep(both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(SALTS, 2 * total // HUBS)).select("a", F.lit(True).alias("hub")))
    if hubs.take(1):
        hubs = F.broadcast(hubs)
        up = up.join(hubs, "a", "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("hub")
        spread = F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        up = up.join(least.join(hubs, "a", "left").select("a", "m", spread.alias("salt")), ["a", "salt"])
    else:
        up = up.join(least, "a")
    return up.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.inline(F.array(_edge("a", "m"), _edge("b", "m")))).filter("a <> b").distinct()


def _both_stars_alone(edges: DataFrame) -> DataFrame:
    """_small_star() of _large_star() for edges that one task takes; in one partition neither windows nor distinct() shuffle."""
    least = F.min("b").over(Window.partitionBy("a"))
    both = edges.coalesce(1).select(F.inline(F.array(_edge("a", "b"), _edge("b", "a"))))
    large = both.withColumn("m", least).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
    return large.withColumn("m", least).select(F.inline(F.array(_edge("a", "m"), _edge("b", "m")))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of each node of edges (a, b): component is the least id that the node reaches.

    Nodes are longs. Each round replaces the edges by fewer or shorter ones, as two aggregations and two joins with
    the least neighbour of a node; a node with many edges is dealt out over several tasks. Edges are checkpointed each round,
    and rounds end when nothing changes. A round makes no more edges than it gets, so once they are TASK_EDGES or fewer the
    rounds are of one task, without the files and tasks of a shuffle for each of its partitions. Loops and repeated edges don't matter, edges with a null end are left out,
    and without edges there are no rows.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = keep(edges.distinct())
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        edges = keep(_both_stars_alone(edges) if state[0] <= TASK_EDGES else _small_star(_large_star(edges, state[0])))
        new = _state(edges)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    # Dealt out evenly, whether one task or many made the edges.
    ends = F.array(*(F.struct(F.col(c).alias("id"), F.col("b").alias("component")) for c in ("a", "b")))
    return edges.select(F.inline(ends)).distinct()
