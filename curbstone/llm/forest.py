"""Approximate nearest neighbours by a hash-prefix forest: rows sorted by long hash strings, descended and then ascended together."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbstone.llm.common import keep, keep_table

#: Trees, letters of their hash strings, random directions that a letter chooses among, and the bits of a letter.
TREES, LETTERS, DIRECTIONS, BITS, SEED = 32, 12, 4, 3, 11
DEPTH = LETTERS * BITS
#: A query ascends until its matches in all trees, counted with repeats, are BUDGET x the square root of all different vectors.
BUDGET = 100
#: Rows and queries of a prefix that meet in one group; more are dealt into parts. Rows hashed together.
ROWS, QUERIES, CHUNK = 1 << 14, 1 << 12, 1024
#: Prefixes whose sizes are sent to all executors (about 60 bytes each); more are joined by a shuffle.
BROADCAST_PREFIXES = 20_000
NEIGHBOURS = 10
#: Share of squared lengths by which squared distances are widened, far above the error of doubles.
SLACK = 1e-12


def usable(vector: Column) -> Column:
    """Whether a vector is there, holds only finite numbers, and isn't all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def hash_strings(x: np.ndarray) -> np.ndarray:
    """A hash string for each row and tree: LETTERS letters, the first in the highest bits.

    A letter names the one of DIRECTIONS random directions along which the row lies farthest, either way.
    """
    planes = np.random.Generator(np.random.PCG64([SEED, x.shape[1]])).standard_normal((x.shape[1], TREES * LETTERS * DIRECTIONS)).astype(np.float32)
    out = np.empty((len(x), TREES), np.int64)
    worth = np.int64(1) << (BITS * np.arange(LETTERS - 1, -1, -1))
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK]
        y = ((part / np.where(largest := np.abs(part).max(1), largest, 1)[:, None]).astype(np.float32) @ planes).reshape(-1, TREES, LETTERS, DIRECTIONS)
        far = np.abs(y).argmax(3)
        letter = 2 * far + (np.take_along_axis(y, far[..., None], 3)[..., 0] > 0)
        out[at : at + CHUNK] = letter @ worth
    return out


def _centres(nodes: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each dimension. Distances don't depend on where the origin is; hashes and roundings do."""
    rows = nodes.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.avg(F.col("x").cast("double")).alias("x")).collect()
    out = {d: np.zeros(d) for d in {r["dim"] for r in rows}}
    for r in rows:
        out[r["dim"]][r["at"]] = r["x"] if np.isfinite(r["x"]) else 0.0
    return out


def _hashed(nodes: DataFrame) -> DataFrame:
    """(k1, k2, dim, codes, scale, error, small) of rows (k1, k2, dim, v): hash strings, the vector less the mean rounded to a byte a
    component, and how far that is from it."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("dim", pa.int32()), ("codes", pa.list_(pa.int64())), ("scale", pa.float64()), ("error", pa.float64()), ("small", pa.binary())])
    centres = _centres(nodes)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            f = batch.to_pandas()
            for dim, g in f.groupby("dim"):
                x = matrix(g["v"]) - centres[dim]
                codes, scale = hash_strings(x), np.abs(x).max(1) / 127
                small = np.rint(x / np.where(scale, scale, 1)[:, None]).astype(np.int8)
                error = np.sqrt(((x - small * scale[:, None]) ** 2).sum(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1, dtype=np.int32) * TREES), pa.array(codes.reshape(-1)))
                small = pa.array([r.tobytes() for r in small], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(g["k1"]), pa.array(g["k2"]), pa.array(g["dim"], pa.int32()), lists, pa.array(scale), pa.array(error), small], schema=schema)

    return nodes.mapInArrow(run, "k1 long, k2 long, dim int, codes array<long>, scale double, error double, small binary")


def _trees(hashed: DataFrame, depth: int, *columns: str) -> DataFrame:
    """hashed, once for each tree: (dim, tree, prefix, code, *columns), prefix being the first depth bits. At depth 0 one tree is all."""
    rows = hashed.select("dim", *columns, F.posexplode(F.slice("codes", 1, TREES if depth else 1)).alias("tree", "code"))
    return rows.select("dim", "tree", F.shiftright("code", DEPTH - depth).alias("prefix"), "code", *columns)


def _wide(f: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(f["small"]), np.int8).reshape(len(f), -1) * f["scale"].to_numpy()[:, None]


class _Visit:
    """Some queries in one tree: matches by level, and the rows at each level that may be among the k nearest, as sorted rows come in batches.

    Rounded vectors say within which bounds a distance lies; a row stays if its least distance is within the k-th of the greatest.
    """

    def __init__(self, queries: pd.DataFrame, depth: int, k: int):
        self.queries, self.depth, self.k = queries, depth, k
        self.codes, self.x = queries["code"].to_numpy(), _wide(queries)
        self.squares, self.error = (self.x**2).sum(1), queries["error"].to_numpy()
        self.levels = np.arange(depth, DEPTH + 1)
        self.counts = np.zeros((len(queries), len(self.levels)), np.int64)
        self.held: list[list[np.ndarray]] = [[] for _ in self.codes]  # (k1, k2, level, least, greatest distance) of each query's rows

    def add(self, f: pd.DataFrame) -> None:
        """A run of rows in the order of their hash strings: a level's matches are a stretch of it, within that of the level above."""
        codes, y, keys = f["code"].to_numpy(), _wide(f), f[["k1", "k2"]].to_numpy()
        squares = self.squares[:, None] + (y**2).sum(1)
        far, error = squares - 2 * self.x @ y.T, self.error[:, None] + f["error"].to_numpy()
        least = np.sqrt(np.maximum(far - SLACK * squares, 0)) - error
        most = np.sqrt(np.maximum(far, 0) + SLACK * squares) + error
        shift = DEPTH - self.levels
        low = self.codes[:, None] >> shift << shift
        start = np.searchsorted(codes, low)
        stop = np.searchsorted(codes, low + (np.int64(1) << shift))
        self.counts += stop - start
        for i in range(len(self.codes)):
            at = {}
            for j in range(len(self.levels)):  # deeper levels overwrite those above
                a, b = int(start[i, j]), int(stop[i, j])
                if a == b:
                    break
                if j and (a, b) == (start[i, j - 1], stop[i, j - 1]):
                    for r in at:
                        at[r] = self.levels[j] if a <= r < b else at[r]
                    continue
                near = range(a, b)
                if b - a > self.k:
                    bound = np.partition(most[i, a:b], self.k - 1)[self.k - 1]
                    near = (a + np.flatnonzero(least[i, a:b] <= bound)).tolist()
                at.update((r, self.levels[j]) for r in (*near, *(r for r in at if a <= r < b)))
            if at:
                r = np.fromiter(at, np.int64)
                self.held[i].append(np.column_stack([keys[r], np.fromiter(at.values(), np.int64), least[i, r].view(np.int64), most[i, r].view(np.int64)]))

    def found(self) -> tuple[list, list, list]:
        """(queries' keys, their counts, their rows as lists of structs' fields)."""
        rows = [np.concatenate(h) if h else np.zeros((0, 5), np.int64) for h in self.held]
        return self.queries[["k1", "k2"]].to_numpy(), self.counts, rows


_FOUND = "q1 long, q2 long, counts array<long>, k1 array<long>, k2 array<long>, level array<long>, least array<double>, most array<double>"


def _meet(rows: DataFrame, depth: int, k: int) -> DataFrame:
    """_FOUND: a row for each query and group of rows (group, kind: 0 query, 1 row, code, k1, k2, scale, error, small)."""
    schema = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("counts", "k1", "k2", "level")), *((c, pa.list_(pa.float64())) for c in ("least", "most"))])

    def give(visits: list[_Visit]) -> pa.RecordBatch:
        keys, counts, rows = (sum(map(list, x), []) for x in zip(*(v.found() for v in visits)))
        columns = [[int(q[0]) for q in keys], [int(q[1]) for q in keys], counts, *([r[:, c] for r in rows] for c in range(3)), *([np.ascontiguousarray(r[:, c]).view(np.float64) for r in rows] for c in (3, 4))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, visit = None, [], None
        for batch in batches:
            f = batch.to_pandas()
            key, is_query = f["group"].to_numpy(), f["kind"].to_numpy() == 0
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(f)) if len(f) else []
            start, done = 0, []
            for end in ends:
                if key[start] != group:
                    if visit is not None:
                        done.append(visit)
                    group, asked, visit = key[start], [], None
                n = int(is_query[start:end].sum())
                if n:
                    asked.append(f.iloc[start : start + n])
                if start + n < end and asked:
                    visit = visit or _Visit(pd.concat(asked), depth, k)
                    visit.add(f.iloc[start + n : end])
                start = end
            if done:
                yield give(done)
        if visit is not None:
            yield give([visit])

    dealt = rows.repartition("group").sortWithinPartitions("group", "kind", "code")
    return dealt.mapInArrow(run, _FOUND)


def candidates(hashed: DataFrame, asked: DataFrame, n: int, k: int) -> DataFrame:
    """(q1, q2, k1, k2, least, most): for each query, one of asked (k1, k2), those of its candidates in each tree that may be among the k
    nearest, with the least and the greatest distance that rounded vectors allow.

    A tree is its rows sorted by hash string; it is dealt out by the strings' first letters, so many that a query may be expected to
    have enough matches under them. There a query descends to its longest match, counts the matches at each level above,
    and the nearest rows at each level are noted. The counts of all trees are added up, and the query ascends in all trees
    together, a bit of a letter at a time, so that at most about twice as many are taken as are needed, until they are BUDGET x sqrt(n):
    rows that match at that level in any tree are its candidates. Queries that have too few under these bits go on with a letter less,
    at last with all rows.

    A crowded beginning is dealt into parts by rows and by queries, so a task holds QUERIES queries and one batch of rows.
    """
    need, by = BUDGET * math.sqrt(n), ["dim", "tree", "prefix"]
    depth = max([0, *(d for d in range(1, DEPTH + 1) if TREES * n / (1 << d) >= need)])
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    of = lambda c: F.pmod(F.xxhash64(F.lit(c), "k1", "k2"), F.col(c)).cast("int")
    parts = lambda c, m: F.ceil(F.col(c) / m).cast("int")
    left = keep(hashed.join(asked, ["k1", "k2"], "left_semi"))
    out = None
    while True:
        queries = _trees(left, depth, "k1", "k2", "scale", "error", "small")
        sizes = queries.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"))
        sizes = _trees(hashed, depth).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(sizes, by)
        sizes = keep(sizes.select(*by, parts("n", ROWS).alias("parts"), parts("queries", QUERIES).alias("turns")))
        sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_PREFIXES else sizes
        rows = _trees(hashed, depth, "k1", "k2", "scale", "error", "small").join(sizes, by)
        rows = rows.withColumn("part", of("parts")).withColumn("turn", each("turns")).withColumn("kind", F.lit(1))
        queries = queries.join(sizes, by).withColumn("turn", of("turns")).withColumn("part", each("parts")).withColumn("kind", F.lit(0))
        group = F.xxhash64(*by, "part", "turn").alias("group")
        columns = [group, "kind", "code", "k1", "k2", "scale", "error", "small"]
        found = keep(_meet(queries.select(*columns).unionByName(rows.select(*columns)), depth, k))
        totals = found.select("q1", "q2", F.posexplode("counts").alias("level", "matches")).groupBy("q1", "q2", "level").agg(F.sum("matches").alias("matches"))
        reached = totals.filter((F.col("matches") >= need) | F.lit(depth == 0)).groupBy("q1", "q2").agg(F.max(F.when((F.col("matches") >= need) | (F.col("level") == 0), F.col("level"))).alias("reached"))
        reached = keep(reached.select("q1", "q2", (F.col("reached") + depth).alias("reached")))
        near = found.join(reached, ["q1", "q2"]).select("q1", "q2", "reached", F.explode(F.arrays_zip("k1", "k2", "level", "least", "most")).alias("r"))
        near = near.select("q1", "q2", "r.*", "reached").filter("level >= reached").drop("level", "reached")
        out = near if out is None else out.unionByName(near)
        if not depth:
            return out
        left = keep(left.join(reached.select(F.col("q1").alias("k1"), F.col("q2").alias("k2")), ["k1", "k2"], "left_anti"))
        if not left.take(1):
            return out
        depth = max(0, depth - BITS)


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k nearest other rows found, nearest first.

    score is the Euclidean distance of the original vectors in double precision; equal distances go to the smaller id.
    Equal vectors are one node of one forest over all rows, with their k + 1 smallest ids, so that a vector which many rows share is
    no crowd. candidates() gives nodes by rounded vectors; all whose least distance is within the k-th greatest are measured exactly,
    so no candidate is lost to rounding. Many rows nearer to each other than a 250th of their distance from the mean of all vectors
    are all measured.
    The number of candidates grows with the square root of the rows; queries are a stated set, a small part of all rows.

    Null vectors, all-zero ones and those with null or non-finite components take no part, as query or candidate; nor do rows
    without a key. Vectors are compared with those of the same length. Rows with the query's key are the query itself; other
    rows that share a key are each a candidate. Equal vectors tie. Without queries or rows there are no rows; if there are
    fewer candidates than k, all are given. Query rows that share a key are one query if their vectors are equal, else each
    is one and their neighbours are ranked together.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    rows = rows.withColumns({"dim": F.size("v"), "k1": F.xxhash64(F.lit(1), "v"), "k2": F.xxhash64(F.lit(2), "v")})
    nodes = keep_table(rows.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.first("dim").alias("dim")))
    asked = keep(rows.filter("q").select("id", "k1", "k2").distinct())
    # A query's own nodes, mostly one, are nearest to it but no candidates; other ids of theirs are.
    own = rows.join(asked.select("id").distinct(), "id", "left_semi").select("id", "k1", "k2").distinct().groupBy("id").count().agg(F.max("count")).first()[0]
    wanted = k + (own or 0)
    found = candidates(keep_table(_hashed(nodes)), asked.select("k1", "k2").distinct(), nodes.count(), wanted)
    found = found.groupBy("q1", "q2", "k1", "k2").agg(F.max("least").alias("least"), F.min("most").alias("most"))
    of_query = Window.partitionBy("q1", "q2")
    found = found.withColumn("place", F.row_number().over(of_query.orderBy("most", "k1", "k2")))
    found = found.withColumn("bound", F.max(F.when(F.col("place") <= wanted, F.col("most"))).over(of_query)).filter("least <= bound").select("q1", "q2", "k1", "k2")
    smallest = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    ids = rows.groupBy("k1", "k2", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies")).withColumn("place", smallest).filter(F.col("place") <= k + 1)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                far = [float(np.sqrt(((np.asarray(x, np.float64) - np.asarray(y, np.float64)) ** 2).sum())) for x, y in zip(f["v"], f["w"])]
                yield f[["q1", "q2", "k1", "k2"]].assign(score=far)

    pairs = found.join(nodes.select("k1", "k2", "v"), ["k1", "k2"]).join(nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("v").alias("w")), ["q1", "q2"])
    pairs = pairs.mapInPandas(measure, "q1 long, q2 long, k1 long, k2 long, score double")
    pairs = pairs.join(asked.select(F.col("id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")), ["q1", "q2"]).join(ids, ["k1", "k2"])
    pairs = pairs.filter("id <> query_id").select("query_id", F.col("id").alias("vec_id"), "score", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
