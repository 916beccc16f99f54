"""Ranked lexical search by block-max pruning: blocks of documents with each term's greatest score, the best bound first."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbstone.llm.common import keep_table, new_folder

TOP = 50
#: Bytes of text after which a block of documents ends. Bytes of a text that are split at a time.
BLOCK, SLICE = 1 << 19, 1 << 20
#: Terms of items, with repeats across items, that are searched for at once; more items are dealt into groups, one after the other.
TERMS = 1 << 17


def _table(kept: str) -> bytes:
    """A translation of bytes: A-Z to a-z, ASCII other than what is kept to blanks, all else as it is."""
    return bytes(ord(chr(b).lower()) if chr(b).lower() in kept else 32 for b in range(128)) + bytes(range(128, 256))


LETTERS = _table("abcdefghijklmnopqrstuvwxyz")
LETTERS_DIGITS = _table("abcdefghijklmnopqrstuvwxyz0123456789")


def term_counts(text: bytes | None, table: bytes = LETTERS_DIGITS) -> Counter:
    """How often each term is in a whole text of UTF-8 (null: none); terms are runs of what table doesn't turn into blanks."""
    text, counts, at = (text or b"").translate(table), Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        counts.update(text[at:end].split())
        at = end
    return counts


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): the different terms of each item; rows that share a key are one item. Items without terms have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, t in zip(b.column(0), b.column(1)):
                terms = list(term_counts(t.as_py()))
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(terms), pa.int64()), pa.array(terms, pa.binary())], names=["item", "term"])

    return items.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(run, "item long, term binary").distinct()


_INDEX = pa.schema([
    ("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())),
    ("df", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64())),
])
_INDEX_DDL = "block long, docs array<long>, sizes array<long>, terms array<int>, df array<int>, at array<int>, tf array<long>"


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents as they lie, by _INDEX: ids, numbers of all terms, and by term of the vocabulary its documents (their places at) and tf.

    terms are in order, and the entries of a term follow those of the one before, df of them. A null id is the least long.
    """

    def block(number: int, ids: list, sizes: list, entries: list) -> pa.RecordBatch:
        e = np.array(entries, np.int64).reshape(-1, 3)  # term, place, tf
        e = e[np.argsort(e[:, 0], kind="stable")]
        terms, df = np.unique(e[:, 0], return_counts=True)
        one = [[number], [ids], [sizes], [terms.astype(np.int32)], [df.astype(np.int32)], [e[:, 1].astype(np.int32)], [e[:, 2]]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, _INDEX)], schema=_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, sizes, entries, held = [], [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                body = t.as_py()
                counts = term_counts(body)
                entries += [(vocabulary[w], len(ids), n) for w, n in counts.items() if w in vocabulary]
                ids.append(i)
                sizes.append(counts.total())
                held += len(body or b"") + 16
                if held >= BLOCK:
                    yield block(number, ids, sizes, entries)
                    number, ids, sizes, entries, held = number + 1, [], [], [], 0
        if ids:
            yield block(number, ids, sizes, entries)

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(np.iinfo(np.int64).min)), F.col(text).cast("binary"))
    return rows.mapInArrow(run, _INDEX_DDL)


class _Items:
    """Items as sets of terms of the vocabulary, their weights, and what each item's score must reach."""

    def __init__(self, sets: list[np.ndarray], weight: np.ndarray, n: int, total: int):
        self.sets, self.weight, self.n, self.total = sets, weight, n, total
        self.flat, self.starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]

    def impacts(self, r: dict) -> tuple[np.ndarray, np.ndarray]:
        """(each entry's part of a score, the greatest of each term) of a block."""
        m = 50 + (50 * r["sizes"] * self.n) // max(self.total, 1)
        part = np.repeat(self.weight[r["terms"]], r["df"]) * ((1_000_000_000 * r["tf"]) // (1000 * r["tf"] + 20 * m[r["at"]]))
        starts = np.cumsum(r["df"]) - r["df"]
        return part, np.maximum.reduceat(part, starts) if len(part) else part

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Of each item what a document of a block can score at most."""
        dense = np.zeros(len(self.weight), np.int64)
        dense[terms] = most
        return np.add.reduceat(dense[self.flat], self.starts)

    def scores(self, item: int, r: dict, part: np.ndarray) -> np.ndarray:
        """Scores of all documents of a block."""
        place = np.flatnonzero(np.isin(r["terms"], self.sets[item], assume_unique=True))
        n, start = r["df"][place], (np.cumsum(r["df"]) - r["df"])[place]
        entries = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = np.zeros(len(r["docs"]), np.int64)
        np.add.at(out, r["at"][entries], part[entries])
        return out


def _blocks(batch: pa.RecordBatch) -> Iterator[dict]:
    columns = [batch.column(k) for k in range(batch.num_columns)]
    for i in range(batch.num_rows):
        yield {f.name: c[i].as_py() if f.name == "block" else c[i].values.to_numpy(zero_copy_only=False) for f, c in zip(_INDEX, columns)}


def _best_blocks(batches: Iterator[pa.RecordBatch], items: _Items) -> Iterator[pa.RecordBatch]:
    """(item, bound, block): for each item the block of this task with the highest bound."""
    best, where = np.zeros(len(items.sets), np.int64), np.zeros(len(items.sets), np.int64)
    for batch in batches:
        for r in _blocks(batch):
            bound = items.bounds(r["terms"], items.impacts(r)[1])
            better = bound > best
            best[better], where[better] = bound[better], r["block"]
    found = np.flatnonzero(best)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(best[found]), pa.array(where[found])], names=["item", "bound", "block"])


def _search(batches: Iterator[pa.RecordBatch], items: _Items, floor: np.ndarray, k: int, only: dict[int, list[int]] | None = None) -> Iterator[pa.RecordBatch]:
    """(item, doc, score): a task's k best documents for each item, of those that reach floor; with only, of the items listed for a block.

    Of the blocks of a batch an item takes the one with the highest bound first, until the next bound is below what its k best reach.
    """
    floor, held = floor.copy(), {}
    for batch in batches:
        blocks = [r for r in _blocks(batch) if only is None or r["block"] in only]
        if not blocks:
            continue
        parts = [items.impacts(r) for r in blocks]
        bounds = np.stack([items.bounds(r["terms"], most) for r, (_, most) in zip(blocks, parts)])
        for item in range(len(items.sets)):
            for b in np.argsort(-bounds[:, item], kind="stable"):
                if bounds[b, item] < floor[item]:
                    break
                if only is not None and item not in only[blocks[b]["block"]]:
                    continue
                score = items.scores(item, blocks[b], parts[b][0])
                good = score >= floor[item]
                docs, score = blocks[b]["docs"][good], score[good]
                if item in held:
                    docs, score = np.concatenate([held[item][0], docs]), np.concatenate([held[item][1], score])
                first = np.lexsort((docs, -score))[:k]
                held[item] = docs[first], score[first]
                if len(first) == k:
                    floor[item] = max(floor[item], score[first[-1]])
    for item, (docs, score) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item, np.int32)), pa.array(docs), pa.array(score)], names=["item", "doc", "score"])


def _ranked(docs: DataFrame, pairs: list, k: int) -> DataFrame | None:
    """(item_id, doc_id, score) of the items whose pairs (item, term) are given."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in pairs}))}
    names = sorted({r["item"] for r in pairs}, key=lambda i: (i is not None, i))
    place, sets = {i: n for n, i in enumerate(names)}, [[] for _ in names]
    for r in pairs:
        sets[place[r["item"]]].append(vocabulary[bytes(r["term"])])
    if not sets:
        return None
    index = keep_table(build_index(docs, vocabulary), new_folder(spark, "index-"))
    with_terms = F.size(F.filter("sizes", lambda n: n > 0))
    n, total = index.agg(F.sum(with_terms), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode(F.arrays_zip("terms", "df")).alias("e")).groupBy("e.terms").agg(F.sum("e.df").alias("df")).collect():
        df[r["terms"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * (n or 0) + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    items = _Items([np.sort(np.array(s, np.int64)) for s in sets], weight, n or 0, total or 0)
    # What the k best of its most promising block score is what any other block must reach.
    best = index.mapInArrow(partial(_best_blocks, items=items), "item int, bound long, block long")
    best = best.groupBy("item").agg(F.max_by("block", F.struct("bound", "block")).alias("block")).collect()
    only: dict[int, list[int]] = {}
    for r in best:
        only.setdefault(r["block"], []).append(r["item"])
    lowest = np.ones(len(sets), np.int64)
    found = "item int, doc long, score long"
    first = index.filter(F.col("block").isin(list(only))).mapInArrow(partial(_search, items=items, floor=lowest, k=k, only=only), found)
    floor = lowest.copy()
    for r in first.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).collect():
        floor[r["item"]] = r["least"]
    out = index.mapInArrow(partial(_search, items=items, floor=floor, k=k), found)
    ids = F.broadcast(spark.createDataFrame([(n, i) for i, n in place.items()], "item int, item_id long"))
    doc = F.when(F.col("doc") != np.iinfo(np.int64).min, F.col("doc")).alias("doc_id")
    return out.join(ids, "item").select("item_id", doc, "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents with the highest scores above 0, equal ones by ascending doc_id.

    Terms are runs of ASCII letters, digits and all that isn't ASCII, A-Z lower-cased, of whole texts. A term weighs
    floor(1000 ln((2N + 2) / (2df + 1))); a document scores the sum of weight x (10^9 tf div (1000 tf + 20 m)) with m = 50 + (50 n N div L),
    over N documents with terms that have L terms in all. All but the logarithm is in 64-bit integers.

    One pass over the texts makes an index of blocks for the terms of the items (up to TERMS; more items are searched for in groups); passes
    over the index count documents, find each item's most promising block and so what its results must reach, and search.
    A task holds one batch of blocks; what reaches the driver grows with the terms of the items, not with the documents.

    Null and empty texts have no terms; items without terms, and all items where no document has any, have no rows. Items with one
    key are one item, null too; documents that share an id are each ranked, and a null doc_id (or the least long) comes first among equals.
    """
    spark = docs.sparkSession
    pairs = keep_table(item_terms(items))
    groups = max(1, math.ceil(pairs.count() / TERMS))
    of = F.pmod(F.xxhash64("item"), F.lit(groups))
    found = [_ranked(docs, pairs.filter(of == g).collect(), k) for g in range(groups)]
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for f in found:
        out = out if f is None else out.unionByName(f)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
