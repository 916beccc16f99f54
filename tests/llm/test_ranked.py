"""Products, lexical search and the divergence audit against plain Python, on odd rows and with small blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbstone.llm import divergence, lexical, products

VECTORS = "vec_id bigint, embedding array<double>, k1 int, w string, least int, turn int"
DOCS = "doc_id bigint, text string, lang string, source string, g int, term string, n int, value int"


def vectors(spark, rows):
    """Rows (vec_id, embedding) with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, v, 1, "w", 2, 3) for i, v in rows], VECTORS)


def brute_products(rows, every, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i in {i for i, _ in ok if i % every == 0}:
        found = sorted({(-max(sum(a * b for a, b in zip(v, w)) for q, v in ok if q == i and len(v) == len(w)), j, c) for c, (j, w) in enumerate(ok) if j != i and any(q == i and len(v) == len(w) for q, v in ok)})
        out |= {(i, r, j, -s) for r, (s, j, _) in enumerate(found[:k], 1)}
    return out


def found(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()}


def shapes(rng):
    x = rng.standard_normal((400, 12))
    yield "even", x
    yield "lengths", x * np.exp(rng.normal(0, 1.5, (400, 1)))
    yield "clusters", np.concatenate([rng.standard_normal((8, 12)) * 4] * 50) + 0.05 * x
    yield "ties", rng.integers(-1, 2, (400, 12)).astype(float)


@pytest.mark.parametrize("shape", range(4))
def test_products_in_waves_and_parts(spark, shape, monkeypatch):
    for name, value in (("ROWS", 32), ("FIRST", 64), ("QUERIES", 4), ("CHUNK", 3)):
        monkeypatch.setattr(products, name, value)
    _, x = list(shapes(np.random.default_rng(3)))[shape]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(products.search(vectors(spark, rows), F.col("vec_id") % 25 == 0)) == brute_products(rows, 25)


def test_a_bucket_is_pruned_by_coordinates_and_lengths(monkeypatch):
    """Rows multiplied out are few where the threshold is high, and none is lost."""
    import pandas as pd

    rng = np.random.default_rng(5)
    x = np.rint(np.concatenate([rng.standard_normal((5, 16)) * 300] * 200) + rng.standard_normal((1000, 16)) * 3).astype(np.int64)
    size = np.sqrt((x.astype(float) ** 2).sum(1))
    order = np.argsort(-size)
    x, size = x[order], size[order]
    frame = lambda at, floor: pd.DataFrame({"k1": at, "k2": at, "w": list(x[at]), "length": size[at], "floor": floor, "least": at})
    queries, rows = np.arange(0, 1000, 50), np.arange(1000)
    score = x[queries] @ x.T
    floor = np.sort(score, axis=1)[:, -6]
    work, real = [], products.products
    monkeypatch.setattr(products, "products", lambda a, b: work.append(len(a) * len(b)) or real(a, b))
    scan = products._Scan(frame(queries, floor), 6)
    scan.add(frame(rows, 0))
    want = {(q, r) for i, q in enumerate(queries) for r in np.lexsort((rows, -score[i]))[:6]}
    assert {(int(queries[q]), int(r)) for q, r in scan.held[:, [0, 3]]} == want and sum(work) < 0.5 * len(queries) * 1000
    scan = products._Scan(frame(queries, np.full(20, 10**9)), 6)
    work.clear()
    scan.add(frame(rows, 0))
    assert not work and not len(scan.held)


def test_products_of_odd_rows(spark):
    odd = [
        (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]),
        (7, [-0.001, 3.0]), (50, [1.0, 2.0, 3.0]), (100, []), (101, []), (150, [2.0, 0.5]), (150, [0.25, 0.5]), (8, [1e12, -1e12]), (200, [1e13, 1e12]), (9, [1.0, 2.0]), (10, [0.5, 0.5]), (11, [3.0, 1.0]),
    ]
    got = found(products.search(vectors(spark, odd), F.col("vec_id") % 50 == 0))
    top = 2**63 - 1
    assert got == {(q, r, v, min(top, s)) for q, r, v, s in brute_products(odd, 50)}
    assert {(q, v) for q, _, v, _ in got if q in (50, 100)} == {(100, 101)}
    assert found(products.search(vectors(spark, []), F.col("vec_id") % 50 == 0)) == set() == found(products.search(vectors(spark, [(1, [1.0])]), F.col("vec_id") % 50 == 0))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 1, "x", 2, 3) for i, t, l, s in rows], DOCS)


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute_ranks(rows, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    tf = [(i, Counter(words(t))) for i, t in rows]
    n, total = sum(bool(c) for _, c in tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    sets = {}
    for item, t in items:
        sets.setdefault(item, set()).update(words(t))
    out = []
    for item, terms in sets.items():
        scores = []
        for i, c in tf:
            m = 50 + (50 * c.total() * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is not None, i, -s))
        out += [(item, r, i, -s) for r, (s, _, i, _) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, terms", [(1, 1 << 17), (300, 20), (1 << 19, 1 << 17)])
def test_ranks_by_blocks(spark, block, terms, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "TERMS", terms)
    monkeypatch.setattr(lexical, "SLICE", 40)
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["École", "ÉCOLE", "漢字", "a_b", "x-y"]
    rows = [(k % 90, " ".join(rng.choices(vocabulary, weights=[1 / (1 + j) for j in range(65)], k=rng.randint(0, 40)))) for k in range(120)]
    rows += [(None, "w1 W2 w3"), (200, None), (201, ""), (202, " \n\x00 "), (203, "w5 " * 5000), (204, "w9"), (205, "w9")]
    items = [(1, "W1 w2, w3 w3"), (2, None), (3, ""), (4, "nothing here"), (None, "w9 w40"), (5, "école ÉCOLE 漢字! a_b"), (5, "w50"), (6, " ".join(vocabulary))]
    df = docs(spark, [(i, t, "en", "a") for i, t in rows])
    got = lexical.search(df, spark.createDataFrame(items, "item_id bigint, text string"), 7)
    assert sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got.collect()), key=repr) == brute_ranks(rows, items, 7)


def test_ranks_without_rows(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert lexical.search(docs(spark, []), items).count() == 0 == lexical.search(docs(spark, [(1, "a", "en", "x")]), items.limit(0)).count()
    assert lexical.search(docs(spark, [(1, None, "en", "x")]), items).count() == 0


def test_a_poor_block_is_left_out(monkeypatch):
    """Blocks whose bound is below what the k best reach aren't scored."""
    rng = np.random.default_rng(1)
    items = lexical._Items([np.array([0, 2])], np.array([500, 10, 2000]), 100, 1000)
    block = lambda k, tf: {"block": k, "docs": np.arange(k * 10, k * 10 + 10), "sizes": np.full(10, 10), "terms": np.array([0, 1]), "df": np.array([10, 10]), "at": np.tile(np.arange(10), 2), "tf": tf}
    blocks = [block(k, np.full(20, 1 + (9 if k == 7 else 0)) + rng.integers(0, 1)) for k in range(20)]
    scored, real = [], lexical._Items.scores
    monkeypatch.setattr(lexical, "_blocks", lambda b: iter(blocks))
    monkeypatch.setattr(lexical._Items, "scores", lambda self, i, r, p: scored.append(r["block"]) or real(self, i, r, p))
    (got,) = lexical._search([None], items, np.ones(1, np.int64), 5)
    assert scored == [7] and got.column("doc").to_pylist() == [70, 71, 72, 73, 74]


def brute_audit(rows, ranks):
    rows = [(lower(t), l or "", s or "") for _, t, l, s in rows]
    found = [(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)), l, s) for t, l, s in rows]
    out = []
    for lang in {l for _, l, _ in found}:
        df = Counter(t for c, l, _ in found if l == lang for t in c)
        kept = {t for t, n in df.items() if n >= 3}
        count = {s: Counter() for _, l, s in found if l == lang}
        for c, l, s in found:
            if l == lang:
                count[s].update({t: n for t, n in c.items() if t in kept})
        p = lambda c: {t: 1 + (10**9 * (c[t] + 1)) // (c.total() + len(kept)) for t in kept}
        shares, whole = {s: p(c) for s, c in count.items()}, p(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = sorted(((-sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in count if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(shares[s][t], whole[t]), t) for t in kept if count[s][t] and shares[s][t] > whole[t]), key=lambda x: (x[0], x[1].encode()))[:ranks]
            out += [(lang, s, part, i, -v, r) for part, x in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(x, 1)]
    return sorted(out)


def ours(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("held, pairs", [(1 << 18, 1 << 20), (5, 3)])
def test_audit(spark, held, pairs, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    rng = random.Random(6)
    words = ["the", "The", "cat", "Éa", "éa", "字", "x1y", "z_z", *(f"w{c}" for c in "abcdefghijklmnop")]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "ä", None])) for k in range(150)]
    rows += [(200, None, "en", "empty"), (201, "", "xx", "a"), (202, "one two", "xx", "b"), (203, "123", "yy", "only"), (204, "the " * 3000, "en", "a"), (204, "the " * 3000, "en", "a")]
    assert ours(divergence.audit(docs(spark, rows), term_ranks=6)) == brute_audit(rows, 6)


def test_audit_without_rows(spark):
    assert ours(divergence.audit(docs(spark, []))) == [] == ours(divergence.audit(docs(spark, [(1, None, None, None)])))


def test_shares_are_exact_for_large_counts(spark):
    rng = random.Random(7)
    rows = [(c, c + rng.randrange(10**13), rng.randrange(1, 10**9)) for c in (rng.randrange(9 * 10**13) for _ in range(200))]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    got = df.select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r["p"] == 1 + (10**9 * (r["c"] + 1)) // (r["n"] + r["v"]) for r in got)
