"""A document classifier whose evidence is combined with site and path posteriors by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbstone.llm.common import keep, keep_table
from curbstone.llm.wordhash import EDGE, SPACE, text_groups, word_hashes

#: About so many labelled rows, chosen by hash, fit the classifier; more are not read.
SAMPLE = 6000
#: Words are hashed to so many features; each counts once in a document.
BUCKETS = 1 << 18
#: Beginnings of words, in bytes, that are features too, so that inflected forms share evidence.
PREFIXES = (4, 5, 6, 7, 8)
#: Full-batch steps and their size; a word's weight stays 0 unless about EVIDENCE documents pull it, and LEAST hold it.
STEPS, RATE, EVIDENCE, LEAST = 300, 0.05, 1.5, 2
#: A document is rejected if its posterior of being good is below GOOD or that of being toxic is above TOXIC.
GOOD, TOXIC = 0.5, 0.4
#: Posteriors of sites and paths up to which they are sent to all executors; beyond, they are joined by a shuffle.
BROADCAST_PATHS, SALTS = 100_000, 32
#: Between sites no less than so many documents' weight lies on the prior, and no more.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1e6

STATS = 12
#: Of bytes: upper-case, lower-case, digit, punctuation, mark; as columns of 0 and 1.
_CLASSES = np.zeros((256, 5))
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), np.flatnonzero(EDGE & ~SPACE), b"*#$%&|!~^_=<>")):
    _CLASSES[list(_bytes), _k] = 1
#: Texts whose words are hashed together.
GROUP_BYTES = 1 << 20


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: (hashed words and beginnings of words, with repeats; STATS numbers, all 0 without words)."""
    data = [t.encode("utf-8", "replace") for t in texts]
    words = word_hashes(data, EDGE, PREFIXES)
    columns = [words.hashes, *words.prefixes]
    for k, raw in enumerate(data):
        a, b = words.bounds[k], words.bounds[k + 1]
        n = int(b - a)
        if not n:
            yield np.zeros(0, np.int64), np.zeros(STATS)
            continue
        own = words.hashes[a:b]
        ids = np.concatenate([c[a:b] for c in columns])
        ids = (ids[ids != 0] % np.uint64(BUCKETS)).astype(np.int64)
        seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES
        size, letters = len(raw), max(1.0, seen[0] + seen[1])
        lines = raw.split(b"\n")
        distinct = len(np.unique(own))
        yield ids, np.array([
            np.log1p(n), distinct / n, distinct / n**0.8, float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0, size / n / 10, seen[0] / letters,
            seen[2] / size, seen[3] / size, seen[4] / size, len(set(lines)) / len(lines), n / len(lines) / 50, float(n < 8),
        ])


class Model(NamedTuple):
    """Two logistic heads, bad and toxic, over the same features; words only ever add to either."""

    words: np.ndarray  # 2 x BUCKETS, not negative
    stats: np.ndarray  # 2 x STATS
    bias: np.ndarray  # 2
    mean: np.ndarray
    scale: np.ndarray


def log_odds(model: tuple, ids: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Of being bad and of being toxic, by the classifier alone; model: a Model or its fields."""
    words, weights, bias, mean, scale = model
    ids = np.unique(ids[words[:, ids].any(0)])
    return words[:, ids].sum(1) + weights @ ((stats - mean) / scale) + bias


def fit(ids: list[np.ndarray], stats: np.ndarray, labels: np.ndarray) -> Model:
    """Logistic regression by full-batch Adam, words' weights not negative and with an L1 penalty.

    ids: distinct hashed words of each row. labels: rows x 2, 1 for bad or toxic, nan where unknown.
    """
    mean, scale = stats.mean(0), stats.std(0) + 1e-3
    x = (stats - mean) / scale
    flat = np.concatenate([*ids, np.zeros(0, np.int32)])
    row = np.repeat(np.arange(len(ids), dtype=np.int32), [len(i) for i in ids])
    held = (np.bincount(flat, minlength=BUCKETS) >= LEAST)[flat]
    flat, row = flat[held], row[held]
    words = np.zeros((2, BUCKETS), np.float32)
    weights, bias = [], []
    for h in range(2):
        known = np.isfinite(labels[:, h])
        y = np.where(known, labels[:, h], 0)
        total = max(1, int(known.sum()))
        rate = min(max(y.sum() / total, 1e-3), 1 - 1e-3)
        # Words that too few labelled rows pull up before any weight is set would stay at 0.
        surplus = np.bincount(flat, y[row], BUCKETS) - rate * np.bincount(flat, known[row], BUCKETS)
        may = (surplus > EVIDENCE / 2)[flat]
        own_row = row[may]
        used, own = np.unique(flat[may], return_inverse=True)
        n = len(used)
        theta = np.zeros(n + x.shape[1] + 1)
        theta[-1] = np.log(rate / (1 - rate))
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, STEPS + 1):
            z = np.bincount(own_row, theta[own], len(ids)) + x @ theta[n:-1] + theta[-1]
            err = np.where(known, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0) / total
            grad = np.concatenate([np.bincount(own, err[own_row], n), x.T @ err + 1e-3 * theta[n:-1], [err.sum()]])
            pull = EVIDENCE / total
            grad[:n] = np.where(theta[:n] > 0, grad[:n] + pull, np.minimum(grad[:n] + pull, 0))
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            theta -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
            theta[:n] = np.maximum(theta[:n], 0)
        words[h, used] = theta[:n]
        weights.append(theta[n:-1])
        bias.append(theta[-1])
    return Model(words, np.array(weights), np.array(bias), mean, scale)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    """A model fitted on about `sample` rows of labels (doc_id, quality, toxic) whose documents are there.

    The rows are chosen by a hash of doc_id. Executors turn their texts into features; the driver gets those alone: at most
    BUCKETS hashed words (4 bytes each) for each row of the sample, however long texts and however large the input. A null
    label isn't used; without labels every document is good.
    """
    chosen = labels.select(F.col("doc_id").alias("__id"), (1 - F.col("quality")).cast("double").alias("__bad"), F.col("toxic").cast("double").alias("__toxic"))
    share = min(1.0, sample / max(1, chosen.count()))
    chosen = chosen.filter(F.pmod(F.xxhash64(F.lit("quality"), "__id"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["__id"])
    rows = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(chosen, "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for _, group in text_groups(batch.column(0), GROUP_BYTES) for f in features(group)]
            ids = pa.array([np.unique(f[0]).astype(np.int32) for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([f[1] for f in found], pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["ids", "stats", "bad", "toxic"])

    got = rows.select("__text", "__bad", "__toxic").mapInArrow(run, "ids array<int>, stats array<double>, bad double, toxic double").toArrow()
    if not got.num_rows:
        return Model(np.zeros((2, BUCKETS), np.float32), np.zeros((2, STATS)), np.array([-4.0, -4.0]), np.zeros(STATS), np.ones(STATS))
    ids = [np.asarray(x.values if hasattr(x, "values") else x, np.int32) for x in got["ids"].combine_chunks()]
    stats = np.array(got["stats"].to_pylist())
    given = np.array([[np.nan if v is None else v for v in got[c].to_pylist()] for c in ("bad", "toxic")]).T
    return fit(ids, stats, given)


def score(docs: DataFrame, model: Model, text: str = "text", with_text: bool = True) -> DataFrame:
    """docs, without their texts if asked for, with the classifier's probabilities __good and __toxic."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(tuple(model))  # its size is fixed by BUCKETS
    given = [f for f in docs.schema.fields if with_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in given]
        for batch in batches:
            z = np.array([log_odds(held.value, *f) for _, group in text_groups(batch.column(text), GROUP_BYTES) for f in features(group)]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(z * [-1, 1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(p[:, 0]), pa.array(p[:, 1])], names=[*names, "__good", "__toxic"])

    schema = T.StructType([*given, T.StructField("__good", T.DoubleType()), T.StructField("__toxic", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(q / (1 - q))


def posteriors(scored: DataFrame, site: Column, path: Column) -> DataFrame:
    """(site, path, path_n, path_<p>, site_<p>, all_<p>, ...) for p good and toxic: sums that classify() shrinks.

    One grouped aggregation gives sums by path, whose sums give sites and the whole. The strength of each level's
    prior is estimated from the spread of sites around the whole and of paths around their sites: what exceeds
    the spread that documents alone would cause (method of moments). Where there is no excess the prior wins.
    """
    names = ("good", "toxic")
    paths = scored.groupBy(site.alias("__site"), path.alias("__path")).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(f"__{p}").alias(p) for p in names), *(F.sum(F.col(f"__{p}") * F.col(f"__{p}")).alias(f"{p}2") for p in names)
    )
    paths = keep(paths)
    sites = paths.groupBy("__site").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic", "good2", "toxic2")))
    whole = sites.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "good", "toxic", "good2", "toxic2"))).first()
    n = max(1, whole["n"])
    mean = {p: (whole[p] + 0.5) / (n + 1) for p in names}
    spread = {p: max(whole[f"{p}2"] / n - (whole[p] / n) ** 2, 1e-9) for p in names}

    def strength(rows: DataFrame, around: dict[str, Column]) -> dict[str, float]:
        got = rows.agg(
            F.count(F.lit(1)).alias("groups"),
            *(F.sum(F.col("n") * (F.col(p) / F.col("n") - around[p]) ** 2).alias(p) for p in names),
            F.sum("n").alias("n"),
        ).first()
        out = {}
        for p in names:
            excess = ((got[p] or 0.0) - (got["groups"] or 0) * spread[p]) / max(1, got["n"] or 0)
            out[p] = min(max(spread[p] / excess if excess > 0 else MOST_PRIOR, LEAST_PRIOR), MOST_PRIOR)
        return out

    of_site = strength(sites, {p: F.lit(mean[p]) for p in names})
    up = sites.select(F.col("__site").alias("__s"), F.col("n").alias("sn"), *(F.col(p).alias(f"s_{p}") for p in names))
    paths = paths.join(up, F.col("__site").eqNullSafe(F.col("__s"))).drop("__s")
    of_path = strength(paths, {p: F.col(f"s_{p}") / F.col("sn") for p in names})
    return paths.select(
        "__site", "__path", F.col("n").alias("path_n"), F.col("sn").alias("site_n"),
        *(F.col(p).alias(f"path_{p}") for p in names), *(F.col(f"s_{p}").alias(f"site_{p}") for p in names),
        *(F.lit(float(mean[p])).alias(f"all_{p}") for p in names),
        *(F.lit(float(of_site[p])).alias(f"kappa_site_{p}") for p in names), *(F.lit(float(of_path[p])).alias(f"kappa_path_{p}") for p in names),
    )


def classify(docs: DataFrame, model: Model, site: str = "source", path: str = "lang", text: str = "text", with_text: bool = True) -> DataFrame:
    """docs with p_good, p_toxic (posteriors) and keep: p_good >= GOOD and p_toxic <= TOXIC.

    The classifier's log-odds are shifted by those of the document's path against the whole corpus. A path's rate is
    the sum of its other documents' probabilities, shrunk toward its site's rate, itself shrunk toward the global
    one; sparse paths and sites thus get their parents' rates. All documents count in the sums, and a document never
    counts for itself. Texts are scored once: rows and probabilities are kept as a table in the shared folder, without the texts
    where with_text is false (the result has no text column then). No text is shuffled: up to BROADCAST_PATHS rows of sums
    (counted first) are sent to all executors, more are joined over SALTS copies.

    A null text is empty. Null sites and paths are groups of their own. Equal rows count and get equal results. An empty
    table gives no rows. Columns named p_good, p_toxic or keep are replaced, other columns stay.
    """
    docs = docs.drop("p_good", "p_toxic", "keep")
    names = ("good", "toxic")
    key = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    scored = keep_table(score(docs, model, text, with_text)).withColumn("__s", key(site)).withColumn("__p", key(path))
    sums = keep(posteriors(scored, F.col("__s"), F.col("__p")))
    on = (F.col("__s") == F.col("__site")) & (F.col("__p") == F.col("__path"))
    if sums.count() <= BROADCAST_PATHS:
        rows = scored.join(F.broadcast(sums), on)
    else:
        salted = sums.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = scored.withColumn("__salt", F.pmod(F.xxhash64("__good", "__toxic"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, on & (F.col("__salt") == F.col("__salt2")))

    def posterior(p: str) -> Column:
        own = F.col(f"__{p}")
        of_site = (F.col(f"site_{p}") - own + F.col(f"kappa_site_{p}") * F.col(f"all_{p}")) / (F.col("site_n") - 1 + F.col(f"kappa_site_{p}"))
        of_path = (F.col(f"path_{p}") - own + F.col(f"kappa_path_{p}") * of_site) / (F.col("path_n") - 1 + F.col(f"kappa_path_{p}"))
        return 1 / (1 + F.exp(-(_logit(own) + _logit(of_path) - _logit(F.col(f"all_{p}")))))

    out = rows.select(*(F.col(c) for c in docs.columns if with_text or c != text), *(posterior(p).alias(f"p_{p}") for p in names))
    return out.withColumn("keep", (F.col("p_good") >= GOOD) & (F.col("p_toxic") <= TOXIC))
