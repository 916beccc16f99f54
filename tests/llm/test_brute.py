"""Operators that SQL can't express, against plain Python over whole test tables."""

import collections
import hashlib
import math
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbstone.llm import forest, quality, secrets, sharding
from curbstone.llm.queries import queries

SF = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Secrets: a scanner that walks over the characters, without regular expressions.
ALNUM = set(string.ascii_letters + string.digits)
VALUE, ACCESS, HEX = ALNUM | set("+/_.=-"), set(string.ascii_uppercase + string.digits), set("0123456789abcdef")


def run_of(text, at, allowed):
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def key_word(text, at):
    """Where a key word that begins at `at` ends, else None; only ASCII letters count in either case."""
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        piece = text[at : at + len(word)]
        if piece.isascii() and piece.lower() == word:
            return at + len(word)
    return None


def assign_at(text, at):
    end = key_word(text, at)
    if end is None:
        return None
    end += text[end : end + 1] in ('"', "'") and end < len(text)
    while text[end : end + 1] == " ":
        end += 1
    if text[end : end + 1] not in (":", "=") or end >= len(text):
        return None
    end += 1
    while text[end : end + 1] == " ":
        end += 1
    quote = text[end : end + 1] in ('"', "'") and end < len(text)
    stop = run_of(text, end + quote, VALUE)
    return (end + quote, stop) if stop > end + quote else None


def plain_spans(text):
    found, at = [], 0
    while at < len(text):
        hit = assign_at(text, at) if text[at] in "pPsStTaA" else None
        if hit:
            if hit[1] - hit[0] >= 6:
                found.append((at, 0, hit[1]))
            at = hit[1]
        else:
            at += 1
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        stop = run_of(text, at + 4, ACCESS)
        if stop == at + 4:
            at += 1
            continue
        if stop - at >= 20:
            found.append((at, 1, stop))
        at = stop
    at = 0
    while at < len(text):
        stop = run_of(text, at, HEX)
        if stop - at >= 24:
            found.append((at, 2, stop))
        at = max(stop, at + 1)
    return sorted(found)


def test_secret_base_spans_on_all_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    got = queries()["op3_secret_scan"](spark, SF).collect()
    assert len(got) == len(texts) and sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got) > 10
    for r in got:
        want = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in want) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("markov")] == [x for x in joined.split(",") if x]


def identifiers(rng, words):
    """Ordinary identifiers of LEAST characters or more, in spellings that code has."""
    out = []
    while len(out) < 600:
        w = [rng.choice(words).lower() for _ in range(rng.randint(2, 4))]
        x = ("_".join(w), w[0] + "".join(p.capitalize() for p in w[1:]), "-".join(w), "_".join(w).upper(), "/".join(w), "".join(w), f"{w[0]}_{rng.randint(0, 9999)}_{w[1]}")[len(out) % 7]
        if len(x) >= secrets.LEAST:
            out.append(x)
    return out


def test_secret_models_amid_real_documents(spark):
    """Held-out random strings and identifiers are put into real documents; models are trained on other documents."""
    rng = random.Random(99)
    docs = documents(spark)
    ratio = secrets.train(secrets.pair_counts(docs.filter("doc_id % 2 = 0")))
    held = docs.filter("doc_id % 2 = 1 and lang = 'en' and length(text) > 500").limit(400).collect()
    words = [w for r in held for w in r["text"].split() if w.isascii() and w.isalpha() and 3 < len(w) < 12]
    planted, rows = {}, []
    names = identifiers(rng, words)
    keys = [x for x in secrets.random_samples(600, 999) if not secrets.base_spans(x)]
    for k, (r, name, key) in enumerate(zip(held, names, keys)):
        at = r["text"].index(" ", 200)
        head = f"{r['text'][:at]} {name} "
        planted[k] = (len(head), len(head) + len(key))
        rows.append((k, head + key + r["text"][at:]))
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), ratio).collect()
    spans = {r["doc_id"]: {tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("markov")} for r in got}
    hits = sum(planted[k] in spans[k] for k in planted)
    false = sum(len(spans[k] - {planted[k]}) for k in planted)
    print(f"secret models: {hits} of {len(planted)} random strings found, {false} other spans")
    assert hits >= 0.95 * len(planted) and false <= 0.05 * len(planted)


# The ring: rows walk one after the other.
def walk(rows, shards, replicas=128):
    """{row: shard} of rows [(place, tie, id)]: each goes to its node's shard, or clockwise to the first with room."""
    nodes = sharding.ring(shards, replicas)
    n = len(rows)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    arcs = collections.defaultdict(list)
    for r in sorted(rows):
        arcs[next((k for k, (at, _) in enumerate(nodes) if at >= r[0]), 0)].append(r)
    out, left = {}, []
    for arc in sorted(arcs):
        for r in arcs[arc]:
            s = nodes[arc][1]
            if room[s]:
                room[s] -= 1
                out[r] = s
            else:
                left.append((arc, r))
    for arc, r in left:
        while not room[nodes[arc][1]]:
            arc = (arc + 1) % len(nodes)
        room[nodes[arc][1]] -= 1
        out[r] = nodes[arc][1]
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_no_plain_number_is_called_a_secret(spark, sf):
    """Of the spans that the models add on whole tables, none is a run of digits."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    added = []
    for r in secrets.find_secrets(docs).filter("n_markov > 0").collect():
        for span in r["spans"].split(","):
            kind, a, b = span.split(":")
            if kind == "markov":
                added.append(texts[r["doc_id"]][int(a) : int(b)])
    assert not [t for t in added if t.isdigit()] and len(added) < 0.001 * len(texts) + 5


def test_ring_against_a_walk_and_rows_moved(spark):
    docs = documents(spark)
    places = docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 32).alias("p"), F.xxhash64("text", "doc_id").alias("t")).collect()
    rows = [(r["p"], r["t"], r["doc_id"]) for r in places]
    want = {i: s for (_, _, i), s in walk(rows, 40).items()}
    at = {n: {r["doc_id"]: r["shard"] for r in sharding.shard_by_ring(docs, n).collect()} for n in (40, 41)}
    assert at[40] == want and at[41] == {i: s for (_, _, i), s in walk(rows, 41).items()}
    moved = np.mean([at[40][i] != at[41][i] for i in want])
    loose = {n: {r["doc_id"]: r["shard"] for r in sharding.shard_by_ring(docs, n, slack=0.25).collect()} for n in (40, 41)}
    free = np.mean([loose[40][i] != loose[41][i] for i in want])
    print(f"ring: {moved:.3f} of all rows move from 40 to 41 shards, {free:.3f} with a quarter of slack")
    assert free < 0.12 and moved < 0.45


# Quality: posteriors by numpy from the classifier's probabilities.
def test_posteriors_by_numpy(spark):
    docs = documents(spark).select("doc_id", "source", "lang", "text")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = quality.score(docs, model, with_text=False).toPandas()
    got = {r["doc_id"]: r for r in quality.classify(docs, model, with_text=False).collect()}
    logit = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    want = {}
    for name in ("good", "toxic"):
        p, n = scored[f"__{name}"].to_numpy(), len(scored)
        mean, spread = (p.sum() + 0.5) / (n + 1), max((p**2).mean() - p.mean() ** 2, 1e-9)
        sites, paths = scored.groupby("source").groups, scored.groupby(["source", "lang"]).groups

        def strength(groups, around):
            excess = (sum(len(g) * (p[g].mean() - around(k)) ** 2 for k, g in groups.items()) - len(groups) * spread) / n
            return min(max(spread / excess if excess > 0 else 1e6, 2.0), 1e6)

        by_site = strength(sites, lambda k: mean)
        by_path = strength(paths, lambda k: p[sites[k[0]]].mean())
        for i, d in enumerate(scored["doc_id"]):
            s, g = sites[scored["source"][i]], paths[scored["source"][i], scored["lang"][i]]
            site = (p[s].sum() - p[i] + by_site * mean) / (len(s) - 1 + by_site)
            path = (p[g].sum() - p[i] + by_path * site) / (len(g) - 1 + by_path)
            want[d, name] = 1 / (1 + math.exp(-(logit(p[i]) + logit(path) - logit(mean))))
    for (d, name), x in want.items():
        assert got[d][f"p_{name}"] == pytest.approx(x, abs=1e-9)
    assert all(r["keep"] == (want[d, "good"] >= quality.GOOD and want[d, "toxic"] <= quality.TOXIC) for d, r in got.items())


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_forest_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    held = rows.toPandas()
    ids, x = held["vec_id"].to_numpy(), np.array(held["embedding"].tolist(), float)
    found = collections.defaultdict(set)
    for r in forest.search(rows, F.col("vec_id") % 100 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = []
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        hits.append(len(found[q] & set([int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10])))
    assert np.mean(hits) >= 9.5


@pytest.mark.parametrize("shape", ["even", "dominant", "clusters"])
def test_forest_recall_by_shape(spark, shape):
    """Neighbours aren't lost to rounding where one component is far larger than the others, nor within tight clusters."""
    rng = np.random.default_rng(31)
    x = rng.standard_normal((2000, 32))
    if shape == "dominant":
        x[:, 0] += 1000
    if shape == "clusters":
        x = np.repeat(rng.standard_normal((20, 32)), 100, axis=0) + 0.001 * x
    x = rng.permutation(x).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = collections.defaultdict(set)
    for r in forest.search(rows, F.col("vec_id") % 100 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    x = x.astype(float)
    hits = []
    for q in range(0, 2000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len(found[q] & set(np.argsort(d, kind="stable")[:10].tolist())))
    assert np.mean(hits) >= 9.0
