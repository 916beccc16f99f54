"""How sources of a language differ in their words: terms with equal counts in all sources are one row, compared once and multiplied."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbstone.llm.common import keep, keep_table
from curbstone.llm.lexical import LETTERS, term_counts

LEAST_DOCS, TERM_RANKS = 3, 200
#: Counts that a task holds before it gives them on. Pairs of sources that are worked out at a time.
HELD, PAIRS = 1 << 18, 1 << 20
#: Groups, or vectors of the report, up to which their table is sent to all executors (under 100 bytes each, or their vector).
BROADCAST_GROUPS = 50_000
#: Shares are of a thousand million, in two steps so that products of counts stay within 64 bits.
STEP_A, STEP_B = 100_000, 10_000


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)) as a long; exact for counts to 9 x 10^13."""
    a, d = (count + 1) * STEP_A, total + terms
    return F.lit(1) + _div(a, d) * STEP_B + _div((a % d) * STEP_B, d)


def surprise(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) as a long."""
    return _div((p - q) * (p - q), q)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often, and in how many documents, a term is; summed within tasks, a key can come in several rows."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def give(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            if n:
                columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string())]
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(list(n.values())), pa.array([docs[t] for t in n])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = term_counts(text.as_py(), LETTERS)
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(found)
                docs.update(found.keys())
                size += len(n)
                if size >= HELD:
                    yield from give(held)
                    held, size = {}, 0
        yield from give(held)

    text = F.col("text").cast("binary")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")), text)
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


_SUMS = "lang string, g int, h int, value long"


def _both(vectors: DataFrame) -> DataFrame:
    """_SUMS: over vectors (lang, many, cells: source number, p, p without occurrences), what sources that both have a term add to their
    pair beyond what each adds as if the other hadn't it; partial sums, several rows for a pair."""
    schema = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("h", pa.int32()), ("value", pa.int64())])

    def pairs(lang: str, cells: np.ndarray, many: np.ndarray, left: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """The cells left with the n cells from first on, each cell's vector standing for many terms. A pair of a source with itself is left to be dropped."""
        i, j = np.repeat(left, n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        (g, p, p0), (h, q, q0) = cells[i].T, cells[j].T
        f = lambda p, q: (p - q) * (p - q) // q
        value = (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)) * many[i]
        order = np.lexsort((h, g))
        g, h = g[order], h[order]
        start = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])))
        columns = [pa.array([lang] * len(start), pa.string()), pa.array(g[start], pa.int32()), pa.array(h[start], pa.int32()), pa.array(np.add.reduceat(value[order], start))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, many, flat = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), b.column(2).flatten()
            size = np.diff(b.column(2).offsets.to_numpy()).astype(np.int64)
            cells = np.column_stack([flat.field(k).to_numpy() for k in range(3)]).astype(np.int64)
            n, first, many, of = (np.repeat(x, size) for x in (size, np.cumsum(size) - size, many, langs))
            for lang in sorted(set(langs)):
                mine = np.flatnonzero(of == lang)
                for left in np.split(mine, np.flatnonzero(np.diff(np.cumsum(n[mine]) // PAIRS)) + 1):
                    yield pairs(lang, cells, many, left, first[left], n[left])

    return vectors.select("lang", "many", "cells").mapInArrow(run, _SUMS)


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text): for each source of a language how far each other source
    of it is (part pair: all), and by which terms it stands out from the language (part term: the first term_ranks).

    Terms are runs of ASCII letters and of what isn't ASCII, A-Z lower-cased, of whole texts; a language keeps those in least_docs of its documents
    or more. A source's share of a term is p = 1 + floor(10^9 (count + 1) / (N + V)), N its kept occurrences and V the language's kept terms, and
    f(p, q) = floor((p - q)^2 / q). A pair's value is the sum of f over all V terms, q the other source's; a term's value is f with the
    language's q, for terms that the source has with p above q. Ranks go by value, highest first, then by the item's bytes.

    Terms are counted within tasks, then by language and term into a vector of the sources that have it. Equal vectors are one row with the
    number of their terms. A pair's sum is put together from three: the sources' terms as if the other hadn't them, by counts that
    occur; what vectors that have both add to that; and the terms that neither has. So no work is done for sources without a term.
    The report finds each source's best vectors first, and only their terms.

    Null text, lang and source are ''. A group without terms has its pairs, all others' shares being compared with its own; a language without
    kept terms has value 0 for each pair and no terms; one with a single source has no pairs. Empty table: no rows. Memory: what a task counts
    is bounded; a vector has a cell for each source that has the term, and the result itself a row for each pair of a language's sources.
    Sums are within 64 bits, as shares of a source sum to about 10^9.
    """
    found = counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(plain("lang").alias("lang"), plain("source").alias("source")).distinct()
    groups = keep(groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source"))))
    kept = found.join(_sized(groups), ["lang", "source"]).groupBy("lang", "term")
    kept = kept.agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("g", "n"))).alias("vector"))
    kept = keep_table(kept.filter(F.col("docs") >= least_docs).drop("docs"))
    # Equal vectors are one from here on.
    vectors = keep_table(kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("many"), F.first("total").alias("total"), F.min("term").alias("least")))
    langs = vectors.groupBy("lang").agg(F.sum("many").alias("terms"), F.sum(F.col("many") * F.col("total")).alias("lang_n"))
    cells = vectors.select("lang", "many", F.explode("vector").alias("c")).select("lang", "c.*", "many")
    seen = keep(cells.groupBy("lang", "g", "n").agg(F.sum("many").alias("many")))  # of each source, how many terms have a count
    totals = seen.groupBy("lang", "g").agg(F.sum(F.col("n") * F.col("many")).alias("group_n"), F.sum("many").alias("has"))
    stats = groups.join(totals, ["lang", "g"], "left").join(langs, "lang", "left").fillna(0, ["group_n", "has", "terms", "lang_n"])
    c = F.col
    some = lambda p: F.when(c("terms") > 0, p).otherwise(1)  # noqa: E731  (without terms nothing is summed)
    stats = stats.withColumn("p0", some(share(F.lit(0).cast("long"), c("group_n"), F.greatest("terms", F.lit(1)))))
    stats = _sized(keep(stats.select("lang", "source", "g", "group_n", "has", "terms", "lang_n", "p0")))

    # Pairs.
    other = stats.select("lang", c("g").alias("h"), c("source").alias("item"), c("p0").alias("q0"), c("has").alias("h_has"))
    shares = seen.join(stats, ["lang", "g"]).select("lang", "g", "many", share(c("n"), c("group_n"), c("terms")).alias("p"), "p0")
    against = shares.join(other.select("lang", "h", "q0"), "lang").filter("g <> h")
    alone = against.groupBy("lang", "g", "h").agg(F.sum(c("many") * surprise(c("p"), c("q0"))).alias("ours"), F.sum(c("many") * surprise(c("q0"), c("p"))).alias("theirs"))
    one = alone.select("lang", "g", "h", c("ours").alias("value")).unionByName(alone.select("lang", c("h").alias("g"), c("g").alias("h"), c("theirs").alias("value")))
    of_cells = vectors.select("lang", "many", "vector", F.monotonically_increasing_id().alias("v")).filter(F.size("vector") > 1)
    of_cells = of_cells.select("lang", "many", "v", F.explode("vector").alias("c")).select("lang", "many", "v", "c.*").join(stats, ["lang", "g"])
    of_cells = of_cells.select("lang", "many", "v", F.struct("g", share(c("n"), c("group_n"), c("terms")).alias("p"), "p0").alias("cell"))
    both = _both(of_cells.groupBy("lang", "v").agg(F.first("many").alias("many"), F.collect_list("cell").alias("cells")))
    sums = one.unionByName(both.filter("g <> h")).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    pairs = stats.join(other, "lang").filter("g <> h").join(sums, ["lang", "g", "h"], "left")
    neither = F.when(c("terms") > 0, (c("terms") - c("has") - c("h_has")) * surprise(c("p0"), c("q0"))).otherwise(0)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + neither).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    # Terms.
    rated = vectors.select("lang", "vector", "total", "least", F.explode("vector").alias("c")).select("lang", "vector", "total", "least", "c.*").join(stats, ["lang", "g"])
    p, q = share(c("n"), c("group_n"), c("terms")), share(c("total"), c("lang_n"), c("terms"))
    rated = rated.withColumns({"p": p, "q": q}).filter("p > q").select("lang", "source", "vector", "least", surprise(c("p"), c("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "least"))
    first = keep(rated.withColumn("place", place).filter(c("place") <= term_ranks).drop("place", "least"))
    terms = kept.select("lang", "vector", c("term").alias("item")).join(_sized(first), ["lang", "vector"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value)).filter(c("rank") <= term_ranks)
    return pairs.unionByName(terms)
