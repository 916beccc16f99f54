"""Exact top-k inner products: vectors in buckets by length, each pruned by length or by a coordinate, what is left multiplied out."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbstone.llm.common import keep, keep_table

NEIGHBOURS = 5
#: Components are whole numbers: SCALE x the component, rounded down.
SCALE = 256
#: Length classes of a doubling of length. Rows of a part of a class, and queries, that meet in one group. Queries multiplied out at a time.
CLASSES, ROWS, QUERIES, CHUNK = 8, 1 << 13, 1 << 12, 512
#: Rows of the first wave, and by how much each further one is larger: waves take the longest vectors first and pass on what a score must reach.
FIRST, GROWTH = 1 << 14, 4
#: Cosine that a bucket must have at least for a coordinate to prune better than lengths.
COORDINATE = 0.8
#: Share by which bounds are widened, far above the error of doubles.
SLACK = 1e-9
LEAST = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as a double; beyond 64 bits the nearest number of 64 bits."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds only finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b: exact, beyond 64 bits the nearest number of 64 bits."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if bound < 2.0**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if bound < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64)


def _first(key: np.ndarray, k: int, *order: np.ndarray) -> np.ndarray:
    """Places of the first k rows of each key by order, the last named the foremost."""
    place = np.lexsort((*order, key))
    sorted_key = key[place]
    start = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])) if len(key) else np.zeros(0, np.int64)
    rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return place[rank < k]


class _Scan:
    """The best of a bucket's rows for some queries, as the rows come in batches by descending length."""

    def __init__(self, f: pd.DataFrame, k: int):
        self.keys, self.x, self.length, self.k = f[["k1", "k2"]].to_numpy(), np.stack(f["w"].to_numpy()), f["length"].to_numpy(), k
        self.floor = f["floor"].to_numpy().copy()
        self.focus = np.abs(self.x).argmax(1) if self.x.shape[1] else None
        self.held = np.zeros((0, 5), np.int64)  # query, score, least id, key of the row

    def add(self, f: pd.DataFrame) -> None:
        length = f["length"].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(self.floor > 0, self.floor / (self.length * length[0] * (1 + SLACK)), -1.0)  # the cosine that this bucket must have
        live = need <= 1
        by_coordinate = live & (need >= COORDINATE) & (self.length > 0)
        rows, found = np.stack(f["w"].to_numpy()), []
        others = np.flatnonzero(live & ~by_coordinate)
        for at in range(0, len(others), CHUNK):
            found += self._by_length(others[at : at + CHUNK], rows, length)
        if by_coordinate.any():
            found += self._by_coordinate(np.flatnonzero(by_coordinate), need, rows, length)
        if found:
            q, r, score = (np.concatenate(x) for x in zip(*found))
            more = np.column_stack([q, score, f["least"].to_numpy()[r], f[["k1", "k2"]].to_numpy()[r]])
            held = np.concatenate([self.held, more])
            self.held = held[_first(held[:, 0], self.k, held[:, 2], -held[:, 1])]
            full = np.flatnonzero(np.bincount(self.held[:, 0], minlength=len(self.floor)) == self.k)
            last = np.searchsorted(self.held[:, 0], full, "right") - 1
            self.floor[full] = np.maximum(self.floor[full], self.held[last, 1])

    def _by_length(self, q: np.ndarray, rows: np.ndarray, length: np.ndarray) -> list:
        """Only rows that are long enough for one of the queries q, a beginning of the bucket, are multiplied."""
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where(self.floor[q] > 0, self.floor[q] / (self.length[q] * (1 + SLACK)), 0.0)
        n = int(np.searchsorted(-length, -shortest.min(), "right"))
        score = products(self.x[q], rows[:n])
        floor = self.floor[q]
        if n > self.k:
            floor = np.maximum(floor, np.partition(score, n - self.k, axis=1)[:, n - self.k].astype(np.int64))
        i, r = np.nonzero(score >= floor[:, None])
        return [(q[i], r, score[i, r].astype(np.int64))]

    def _by_coordinate(self, q: np.ndarray, need: np.ndarray, rows: np.ndarray, length: np.ndarray) -> list:
        """A row within the angle t of a query has a coordinate whose angle is within t of the query's: a stretch of the sorted coordinates."""
        found = []
        for c in np.unique(self.focus[q]):
            value = rows[:, c] / np.maximum(length, 1e-300)
            order = np.argsort(value)
            mine = q[self.focus[q] == c]
            at, t = np.arccos(np.clip(self.x[mine, c] / self.length[mine], -1, 1)), np.arccos(np.clip(need[mine], -1, 1))
            low = np.searchsorted(value[order], np.cos(np.minimum(np.pi, at + t)) - SLACK, "left")
            high = np.searchsorted(value[order], np.cos(np.maximum(0, at - t)) + SLACK, "right")
            for i, a, b in zip(mine, low, high):
                near = order[a:b]
                near = near[length[near] * self.length[i] * (1 + SLACK) >= self.floor[i]]
                score = products(self.x[i : i + 1], rows[near])[0].astype(np.int64)
                good = score >= self.floor[i]
                found.append((np.full(int(good.sum()), i), near[good], score[good]))
        return found

    def result(self) -> list[np.ndarray]:
        return [*self.keys[self.held[:, 0]].T, *self.held[:, 3:].T, self.held[:, 1], self.held[:, 2]]


_FOUND = "q1 long, q2 long, k1 long, k2 long, score long, least long"


def _scan(rows: DataFrame, k: int) -> DataFrame:
    """_FOUND: the k best rows of each group (group, kind: 0 query, 1 row, k1, k2, least, w, length, floor) for each of its queries."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _FOUND.split(", ")])
    give = lambda s: pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in s.result()], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, scan = None, [], None
        for batch in batches:
            f = batch.to_pandas()
            key, is_query = f["group"].to_numpy(), f["kind"].to_numpy() == 0
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(f)) if len(f) else []
            start = 0
            for end in ends:
                if key[start] != group:
                    if scan is not None:
                        yield give(scan)
                    group, asked, scan = key[start], [], None
                n = int(is_query[start:end].sum())
                if n:
                    asked.append(f.iloc[start : start + n])
                if start + n < end and asked:
                    scan = scan or _Scan(pd.concat(asked), k)
                    scan.add(f.iloc[start + n : end])
                start = end
        if scan is not None:
            yield give(scan)

    return rows.repartition("group").sortWithinPartitions("group", "kind", F.desc("length")).mapInArrow(run, _FOUND)


def _classes(nodes: DataFrame) -> list[tuple]:
    """(dim, class, parts, base, top) of each length class, longest first: base rows are longer, top is the greatest length in it.

    There are CLASSES for each doubling between the shortest and the longest vector of a dimension, however many rows.
    """
    sizes = nodes.groupBy("dim", "class").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("top")).collect()
    out, base = [], {}
    for r in sorted(sizes, key=lambda r: -r["class"]):
        out.append((r["dim"], r["class"], ceil(r["n"] / ROWS), base.get(r["dim"], 0), r["top"]))
        base[r["dim"]] = base.get(r["dim"], 0) + r["n"]
    return out


def _wave(start: int) -> int:
    """The wave of rows of which start are longer."""
    wave, end = 0, FIRST
    while start >= end:
        wave, end = wave + 1, end * GROWTH
    return wave


def best_products(nodes: DataFrame, k: int) -> DataFrame:
    """_FOUND: for each node that is asked the k nodes (k1, k2, least, asked, w) with the highest products; ties to the least id.

    Nodes are put into classes by length, large classes into parts. Waves take the longest first. In a wave each query goes to the buckets
    whose longest row may still reach what its k best so far have; there, by the cosine that a row must have, either a
    coordinate or the lengths leave rows out, and the rest are multiplied. A group holds QUERIES queries and one batch of rows.
    """
    spark = nodes.sparkSession
    length = F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    nodes = nodes.withColumns({"dim": F.size("w"), "length": length})
    nodes = nodes.withColumn("class", F.when(F.col("length") > 0, F.floor(CLASSES * F.log2("length"))).otherwise(-1).cast("int"))
    classes = _classes(nodes)
    asked = keep(nodes.filter("asked").select("dim", "k1", "k2", "least", "w", "length"))
    turns = [(r["dim"], ceil(r["count"] / QUERIES)) for r in asked.groupBy("dim").count().collect()]
    turns = F.broadcast(spark.createDataFrame(turns, "dim int, turns int"))
    part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "k1", "k2"), F.col(n)).cast("int")
    queries = asked.join(turns, "dim").withColumn("turn", part("turns", "turn"))
    best = spark.createDataFrame([], _FOUND)
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "least", "k1", "k2")
    waves = sorted({_wave(base + p * ROWS) for _, _, parts, base, _ in classes for p in range(parts)})
    for wave in waves:
        of_wave = [(d, c, parts, [p for p in range(parts) if _wave(base + p * ROWS) == wave], top) for d, c, parts, base, top in classes]
        here = [(d, c, parts, p[0], p[-1], top) for d, c, parts, p, top in of_wave if p]
        here = F.broadcast(spark.createDataFrame(here, "dim int, class int, parts int, first int, last int, top double"))
        rows = nodes.join(here, ["dim", "class"]).withColumn("part", part("parts", "part")).filter("part between first and last")
        rows = rows.join(turns, "dim").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumns({"kind": F.lit(1), "floor": F.lit(LEAST)})
        reached = best.groupBy("q1", "q2").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        reached = reached.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), "floor")
        near = queries.join(reached, ["k1", "k2"], "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST))).join(here, "dim")
        near = near.filter((F.col("floor") <= 0) | (F.col("length") * F.col("top") * (1 + SLACK) >= F.col("floor")))
        near = near.withColumn("part", F.explode(F.sequence("first", "last"))).withColumn("kind", F.lit(0))
        columns = [F.xxhash64("dim", "class", "part", "turn").alias("group"), "kind", "k1", "k2", "least", "w", "length", "floor"]
        found = best.unionByName(_scan(near.select(*columns).unionByName(rows.select(*columns)), k))
        best = keep(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place"))
    return best


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k other rows with the highest inner products, exactly.

    Products are of whole numbers, floor(scale x component). Equal vectors are one node with its least ids, so a
    vector that many rows share is no crowd. See best_products(); queries are a stated set, a small part of all rows.

    Null vectors and those with null or non-finite components take no part, nor do rows without a key; all-zero vectors do. Vectors are
    multiplied with those of the same length, empty ones among themselves to 0. Ties go to the smaller id. Rows with the query's key
    are the query itself; other rows that share a key are each a candidate; query rows that share a key are one query, and
    the best of their products count. With fewer candidates than k all are given; without rows or queries there are none. Scores
    beyond 64 bits are the nearest number of 64 bits.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(finite(F.col("v")) & F.col("id").isNotNull()).select("id", "q", integers(F.col("v"), scale).alias("w"))
    rows = rows.withColumns({"k1": F.xxhash64(F.lit(1), "w"), "k2": F.xxhash64(F.lit(2), "w")})
    nodes = keep_table(rows.groupBy("k1", "k2").agg(F.first("w").alias("w"), F.min("id").alias("least"), F.bool_or("q").alias("asked")))
    asked = keep(rows.filter("q").select("id", "k1", "k2").distinct())
    own = rows.join(asked.select("id").distinct(), "id", "left_semi").select("id", "k1", "k2").distinct().groupBy("id").count().agg(F.max("count")).first()[0]
    best = best_products(nodes, k + (own or 0))  # a query's own nodes, mostly one, may have no other id
    smallest = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    ids = rows.groupBy("k1", "k2", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies")).withColumn("place", smallest).filter(F.col("place") <= k + 1)
    pairs = best.drop("least").join(asked.select(F.col("id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")), ["q1", "q2"]).join(ids, ["k1", "k2"])
    pairs = pairs.filter("id <> query_id").groupBy("query_id", "id", "k1", "k2", "copies").agg(F.max("score").alias("score"))
    pairs = pairs.select("query_id", F.col("id").alias("vec_id"), "score", F.explode(F.sequence(F.lit(1), "copies")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
