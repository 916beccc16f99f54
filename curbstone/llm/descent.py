"""Embedding near-deduplication by NN-descent: a neighbour graph refined by neighbours of neighbours, kept above a threshold."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbstone.llm.common import keep, keep_table
from curbstone.llm.components import components
from curbstone.llm.forest import matrix, usable

THRESHOLD = 0.98
#: Length of neighbour lists, nodes that have a node in theirs and join its list, and what a local join offers each member.
NEIGHBOURS, BACK, OFFERS = 10, 6, 4
#: The first graph: random planes cut each label into cells of about CELL rows, so many times; at most BLOCK rows meet at once.
STARTS, CELL, BLOCK, SEED = 4, 96, 384, 5
#: Rounds of refinement: at least, at most; and the recall, on AUDIT vectors of which TELLING have links, at which they end.
LEAST_ROUNDS, MOST_ROUNDS, AUDIT, TELLING, RECALL = 2, 6, 4096, 64, 0.98
#: Rows of a side of a block in the exact pass; rows that the audit and the exact pass compare at a time; labels whose sizes are broadcast.
SIDE, CHUNK, LABELS = 4096, 512, 100_000
#: Crowded cells whose numbers of parts are broadcast (about 60 bytes each), and the copies of these numbers in the join used beyond.
BROADCAST_CELLS, SALTS = 20_000, 32
#: Rounds work on halves (16-bit floats), whose products of unit vectors are off by less than this; what is so near the threshold is measured.
ROUNDING = 2e-3

_PAIRS = "a long, b long, cosine float"


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _units(raw: pd.Series, kind: type) -> np.ndarray:
    """The rows of a binary column of vectors."""
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _grouped(rows: DataFrame, by: list[str], function: Callable[[pd.DataFrame, np.ndarray], dict], schema: str, deal: list[str] | None = None) -> DataFrame:
    """function of (whole groups, where they begin and end) of rows dealt by `by`, or by some of it: many small groups at a time.

    A task holds one batch of rows and the group that goes on in the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            f = batch.to_pandas()
            if not len(f):
                continue
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            ends = _ends(f, by)
            if len(ends) > 2:
                yield pa.RecordBatch.from_pydict(function(f.iloc[: ends[-2]], ends[:-1]))
            held = f.iloc[ends[-2] :]
        if held is not None:
            yield pa.RecordBatch.from_pydict(function(held, np.array([0, len(held)])))

    return rows.repartition(*(deal or by)).sortWithinPartitions(*by).mapInArrow(run, schema)


def _ends(f: pd.DataFrame, by: list[str]) -> np.ndarray:
    new = np.zeros(len(f) - 1, bool)
    for c in by:
        x = f[c].to_numpy()
        new |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(f)]])


def _best(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k most similar other rows of x, a stack of matrices of unit rows: (their places, cosines)."""
    g = x @ x.swapaxes(-1, -2)
    n = g.shape[-1]
    g[..., np.arange(n), np.arange(n)] = -2.0
    k = min(k, n - 1)
    top = np.argpartition(-g, k - 1, axis=-1)[..., :k]
    return top, np.take_along_axis(g, top, -1)


def _pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict:
    cols = [np.concatenate([np.ravel(p[c]) for p in parts]) if parts else np.zeros(0) for c in range(3)]
    a, b = cols[0].astype(np.int64), cols[1].astype(np.int64)
    other = a != b
    return {"a": a[other], "b": b[other], "cosine": cols[2].astype(np.float32)[other]}


def _shortest(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each a, once each."""
    pairs = pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def with_units(nodes: DataFrame) -> DataFrame:
    """nodes (with dim, label, v) with the size of their label and length, and v as unit vectors: whole (binary doubles) and half."""
    sizes = nodes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("size"))
    columns = [c for c in nodes.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole: list = [None] * batch.num_rows
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            v = batch.column("v").to_pandas()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for k, x in zip(at.tolist(), unit(matrix(v.iloc[at]))):
                    whole[k] = x
            out = {"whole": [x.tobytes() for x in whole], "half": [x.astype(np.float16).tobytes() for x in whole]}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(x, pa.binary()) for x in out.values())], names=[*columns, *out])

    types = dict(nodes.dtypes)
    units = nodes.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in columns), "whole binary", "half binary"]))
    sizes = keep(sizes)
    return units.join(F.broadcast(sizes) if sizes.count() <= LABELS else sizes, ["dim", "label"])


def start(nodes: DataFrame, k: int, turn: int = 0) -> DataFrame:
    """A first graph (a, b, cosine): neighbours within cells of random planes, other ones each turn; a crowded cell is dealt into blocks by hash.

    nodes have the size of their label, and each label is cut into cells of about CELL rows. Cells are counted within tasks first, and a
    crowded cell's rows are dealt out before they meet.
    """
    most = nodes.agg(F.max("size")).first()[0] or 1
    bits = max(0, math.ceil(math.log2(most / CELL)))

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, g in f.groupby("dim"):
                x = _units(g["half"], np.float16).astype(np.float32)
                own = np.ceil(np.log2(np.maximum(g["size"].to_numpy() / CELL, 1))).astype(np.int64)
                for t in range(turn * STARTS, (turn + 1) * STARTS):
                    planes = np.random.Generator(np.random.PCG64([SEED, t])).standard_normal((x.shape[1], max(bits, 1)))
                    codes = ((x @ planes > 0) * (1 << np.arange(max(bits, 1)))).sum(1) if bits else np.zeros(len(x), np.int64)
                    yield g.drop(columns="size").assign(start=np.int32(t), cell=codes.astype(np.int64) & ((1 << own) - 1))

    by = ["dim", "label", "start", "cell"]
    rows = nodes.select("node", "dim", "label", "half", "size").mapInPandas(cells, "node long, dim int, label string, half binary, start int, cell long")
    parts = keep(rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).filter("parts > 1"))
    if parts.count() <= BROADCAST_CELLS:
        rows = rows.join(F.broadcast(parts), by, "left")
    else:
        parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "node"), F.lit(SALTS)).cast("int")).join(parts, [*by, "salt"], "left")
    rows = rows.select(*by, F.pmod(F.xxhash64("node", "start"), F.coalesce("parts", F.lit(1))).alias("part"), "node", "half")

    def meet(f: pd.DataFrame, ends: np.ndarray) -> dict:
        node, out = f["node"].to_numpy(), []
        for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if e - s > 1:
                top, cosine = _best(_units(f["half"].iloc[s:e], np.float16).astype(np.float32), k)
                out.append((np.repeat(node[s:e], top.shape[1]), node[s:e][top], cosine))
        return _pairs(out)

    return _shortest(_grouped(rows, [*by, "part"], meet, _PAIRS), k)


def refine(graph: DataFrame, nodes: DataFrame, k: int, turn: int) -> DataFrame:
    """One local join: a node's neighbours, and up to BACK nodes that have it as a neighbour, are compared with one another.

    A member is offered only what is nearer than the last of its own full list.
    """
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"))
    some = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b", F.lit(turn)), "b"))
    back = back.withColumn("rank", some).filter(F.col("rank") <= BACK).drop("rank")
    lists = graph.select("a", "b").union(back).union(graph.select("a", F.col("a").alias("b"))).distinct()
    bars = graph.groupBy(F.col("a").alias("node")).agg(F.min("cosine").alias("bar"), F.count(F.lit(1)).alias("n"))
    known = nodes.select("node", "half").join(bars, "node").select(F.col("node").alias("b"), "half", F.when(F.col("n") >= k, F.col("bar")).otherwise(-2.0).cast("float").alias("bar"))
    rows = lists.join(known, "b").select("a", "b", "half", "bar")

    def join(f: pd.DataFrame, ends: np.ndarray) -> dict:
        b, bar, half, out = f["b"].to_numpy(), f["bar"].to_numpy(), f["half"].to_numpy(), []
        size, wide = np.diff(ends), np.array([len(half[s]) for s in ends[:-1]])
        for n, w in sorted(set(zip(size[size > 1].tolist(), wide[size > 1].tolist()))):
            at = ends[:-1][(size == n) & (wide == w)][:, None] + np.arange(n)
            x = _units(half[at.reshape(-1)], np.float16).astype(np.float32)
            top, cosine = _best(x.reshape(len(at), n, -1), OFFERS)
            own, other = np.broadcast_to(b[at][..., None], top.shape), np.take_along_axis(b[at][:, None, :], top, 2)
            near = cosine > bar[at][..., None]
            out.append((own[near], other[near], cosine[near]))
        return _pairs(out)

    return _shortest(graph.union(_grouped(rows, ["a"], join, _PAIRS)), k)


def edges(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of the graph that are linked: those that halves can't tell from the threshold are measured in double precision."""
    pairs = graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").filter(F.col("cosine") >= threshold - ROUNDING)
    pairs = pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    sure = F.col("cosine") >= threshold + ROUNDING
    whole = lambda c: nodes.select(F.col("node").alias(c), F.col("whole").alias(f"whole_{c}"))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cosine = [float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(f["whole_a"], f["whole_b"])]
            yield f[["a", "b"]][np.array(cosine, float) >= threshold]

    near = pairs.filter(~sure).join(whole("a"), "a").join(whole("b"), "b").mapInPandas(measure, "a long, b long")
    return pairs.filter(sure).select("a", "b").union(near)


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def audit(nodes: DataFrame, labels: DataFrame, threshold: float) -> float | None:
    """The recall of about AUDIT vectors, compared with all others: the lower of two shares of those that have links.

    A vector is found if all its links are within one component. One share counts vectors; the other lets a vector with g
    links weigh 1 / (g + 1), so that a group counts as one however large it is and can't hide small groups that are missed.
    None if a sample with fewer than TELLING such vectors can't tell.
    """
    known = _labelled(nodes, labels)
    total = max(1, nodes.count())
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1 << 30)) < int(min(1.0, AUDIT / total) * (1 << 30)))
    sample = chosen.select("node", "component", "dim", "label", "whole").limit(4 * AUDIT).toPandas()
    held = nodes.sparkSession.sparkContext.broadcast({k: (g["node"].to_numpy(), g["component"].to_numpy(), _units(g["whole"], float)) for k, g in sample.groupby(["dim", "label"])})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, g in f.groupby(["dim", "label"]):
                if k not in held.value:
                    continue
                node, component, x = held.value[k]
                links, found = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
                ids, comp, y = g["node"].to_numpy(), g["component"].to_numpy(), _units(g["whole"], float)
                for s in range(0, len(ids), CHUNK):
                    hit = (x @ y[s : s + CHUNK].T >= threshold) & (node[:, None] != ids[None, s : s + CHUNK])
                    links += hit.sum(1)
                    found += (hit & (component[:, None] == comp[None, s : s + CHUNK])).sum(1)
                yield pd.DataFrame({"node": node, "links": links, "found": found})[links > 0]

    got = known.select("node", "component", "dim", "label", "whole").mapInPandas(count, "node long, links long, found long")
    got = got.groupBy("node").agg(F.sum("links").alias("links"), F.sum("found").alias("found"))
    whole, weight = F.col("found") == F.col("links"), 1 / (F.col("links") + 1)
    n, vectors, weights, groups = got.agg(F.count(F.lit(1)), F.count_if(whole), F.sum(weight), F.sum(F.when(whole, weight).otherwise(0.0))).first()
    if n < TELLING and total > AUDIT:
        return None
    return min(vectors / n, groups / weights) if n else 1.0


def across(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different components: all vectors of a label are compared, in blocks of SIDE x SIDE rows.

    a and b are components. A block gives, for each vector, ties of what it links to the least component among these, once each:
    they connect what its links connect.
    """
    blocks = F.ceil(F.col("size") / SIDE).cast("int")
    rows = _labelled(nodes, labels).withColumn("block", F.pmod(F.xxhash64(F.lit("across"), "node"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("dim", "label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "component", "whole")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        comp, x = f["component"].to_numpy(), _units(f["whole"], float)
        left, right = (f["block"] == f["lo"]).to_numpy(), (f["block"] == f["hi"]).to_numpy()
        (ca, xa), (cb, xb) = (comp[left], x[left]), (comp[right], x[right])
        out = [np.zeros((0, 2), np.int64)]
        for s in range(0, len(ca), CHUNK):
            c = ca[s : s + CHUNK]
            hit = (xa[s : s + CHUNK] @ xb.T >= threshold) & (c[:, None] != cb[None])
            i, j = np.nonzero(hit)
            least = c.copy()
            np.minimum.at(least, i, cb[j])
            ties = np.concatenate([np.stack([cb[j], least[i]], 1), np.stack([c, least], 1)])
            out.append(np.unique(ties[ties[:, 0] != ties[:, 1]], axis=0))
        ties = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": ties[:, 0], "b": ties[:, 1]})

    return rows.groupBy("dim", "label", "lo", "hi").applyInPandas(compare, "a long, b long")


def close(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(node, links): every node's list enlarged to its whole component and cut at the threshold, counting equal vectors.

    A component is compared in blocks of BLOCK x BLOCK rows, small ones several to a group; only counts come out.
    """
    rows = nodes.join(labels.select(F.col("id").alias("node"), "component"), "node")
    sizes = labels.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    sizes = keep(sizes)
    rows = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    groups = max(1, math.ceil(labels.count() / (2 * BLOCK)))
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.xxhash64("component", lo, hi))
    rows = rows.select(group.alias("group"), "component", lo.alias("lo"), hi.alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "whole", "copies")

    def compare(f: pd.DataFrame, ends: np.ndarray) -> dict:
        node, all_copies, all_sides, links = f["node"].to_numpy(), f["copies"].to_numpy(), f["side"].to_numpy(), []
        for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
            x, copies, side = _units(f["whole"].iloc[s:e], float), all_copies[s:e], all_sides[s:e]
            hit = x @ x.T >= threshold
            np.fill_diagonal(hit, False)
            if side.any():
                hit &= side[:, None] != side[None]
            links.append((hit @ copies).astype(np.int64))
        return {"node": node, "links": np.concatenate(links)}

    return _grouped(rows, ["group", "component", "lo", "hi"], compare, "node long, links long", ["group"]).groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Vectors with equal labels are linked if their cosine, in double precision, is threshold or more. n_links counts the other
    rows linked directly; component_id is the smallest vec_id reached over links, itself included; kept marks that row.

    Equal vectors of a label are one node with a number of copies. NN-descent gives each node a list of NEIGHBOURS; lists
    whose entries all pass the threshold are saturated, and as the lists of one component overlap, all lists of a component
    are enlarged to the whole component at the end, compared in blocks: no partner is cut off. Rounds go on, with longer
    lists and further cells, until the audited recall of vectors and of groups is RECALL. If it is less after MOST_ROUNDS, or too
    few vectors have links for the audit to tell, all vectors of each label are compared in blocks, so no link is missed
    then; the cost of that grows with the square of a label.

    Labels may have any type that has a text form. Null labels, null, all-zero and non-finite vectors link with nothing: 0 links,
    their own id. Vectors of different lengths aren't compared. Rows without vec_id link with nothing and have a null component; kept
    is true for them. Equal rows are linked with each other. An empty table gives no rows. Other columns aren't read.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    same = [F.xxhash64(F.lit(s), "label", "v").alias(f"k{s}") for s in (1, 2)]
    rows = rows.select("id", "label", "v", "ok", *same)
    classes = rows.filter("ok").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min_by("label", "id").alias("label"), F.min_by("v", "id").alias("v"))
    nodes = keep_table(with_units(keep_table(classes.select("k1", "k2", "node", "copies", "label", "v", F.size("v").alias("dim")))))
    k, recall = NEIGHBOURS, None
    graph = keep(start(nodes, k))
    for turn in range(MOST_ROUNDS):
        graph = keep(refine(graph, nodes, k, turn))
        if turn + 1 >= LEAST_ROUNDS:
            labels = keep(components(edges(graph, nodes, threshold)))
            recall = audit(nodes, labels, threshold)
            if recall is not None and recall >= RECALL:
                break
            k += NEIGHBOURS
            if turn + 1 < MOST_ROUNDS:
                graph = keep(_shortest(graph.union(start(nodes, k, turn + 1)), k))
    else:
        labels = keep(components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(across(nodes, labels, threshold))))
    # The one row of a vector that occurs once has the node's id; the rows of others are dealt over salts.
    salt, every = F.pmod(F.xxhash64("node"), F.lit(SALTS)), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    found = nodes.select("k1", "k2", "node", "copies").join(close(nodes, labels, threshold), "node", "left").join(labels.withColumnRenamed("id", "node"), "node", "left")
    found = found.select(
        "k1", "k2", F.explode(F.when(F.col("copies") == 1, F.array(salt)).otherwise(every)).alias("salt"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"),
    )
    rows = rows.select("id", F.when(F.col("ok"), F.col("k1")).alias("k1"), "k2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    return rows.join(found, ["k1", "k2", "salt"], "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
