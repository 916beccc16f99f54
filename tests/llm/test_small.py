"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbstone.llm import descent, forest, lines, mixing, near, packing, quality, secrets, sharding, warc
from curbstone.llm.queries import VOCABULARY

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words int, h int, size string, start int, `group` string"
VECTORS = "vec_id bigint, embedding array<float>, label int, node int, v string, k1 int"


def docs(spark, rows):
    """Rows (doc_id, text, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, 2, "x", 3, "g") for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, "   \n ", None), (4, "one two", "a"), (4, "one two", "a"), (None, "no id here at all now", "b"), (5, "long " * 50_000, "b"), (6, "É ß 漢字 \x00   x", None)]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_mix(spark):
    got = mixing.mix(docs(spark, ODD)).groupBy("h", "digest", "copy", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    got = got.collect()
    assert len(got) == len(ODD) and sum(r["taken"] for r in got) == pytest.approx(sum(r["size"] for r in got), abs=3)
    assert all(r["taken"] <= 3 * r["size"] for r in got) and {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    again = mixing.mixed_documents(docs(spark, ODD))
    assert again.columns == docs(spark, []).columns and again.filter("doc_id = 4").count() >= 2
    assert mixing.mix(docs(spark, [])).count() == mixing.mixed_documents(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, None)])).count() == 1


def brute_targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= limit * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_targets_and_order(spark):
    sizes = {"a": 10, "b": 5000, "c": 700, "d": 9000, None: 30}
    df = docs(spark, [(k * 100 + j, " ".join(["w"] * (n // 10)), s) for k, (s, n) in enumerate(sizes.items()) for j in range(10)])
    want = brute_targets(sizes)
    got = mixing.mix(df, block=16)
    by = {r["skey"]: r for r in got.groupBy("skey").agg(F.first("target").alias("t"), F.sum("words").alias("n")).collect()}
    for s, t in want.items():
        r = by["n" if s is None else "s" + s]
        assert r["t"] == pytest.approx(t) and abs(r["n"] - t) <= 1
    # Every block has one slot, which no other source has; any run of slots has the sources near their shares.
    slots = got.filter("slot is not null").select("slot", "skey").distinct().orderBy("slot").collect()
    assert got.filter("lap is not null and slot is null").count() == 0
    assert len({r["slot"] for r in slots}) == len(slots)
    half = [r["skey"] for r in slots[: len(slots) // 2]]
    for s, t in want.items():
        k = "n" if s is None else "s" + s
        assert abs(half.count(k) - t / sum(want.values()) * len(half)) <= 4
    assert rows(got, "doc_id", "slot", "first", "words") == rows(mixing.mix(df.repartition(7), block=16), "doc_id", "slot", "first", "words")


def test_mix_takes_what_has_a_slot(spark, monkeypatch):
    df = docs(spark, [(k, "w " * 40, "ab"[k % 2]) for k in range(60)])
    whole, real = mixing.mix(df, block=16), mixing.schedule

    def half(*a):
        slots, n = real(*a)
        return slots.filter("slot % 2 = 0"), n

    monkeypatch.setattr(mixing, "schedule", lambda *a: (real(*a)[0].limit(0), real(*a)[1]))
    assert mixing.mix(df, block=16).agg(F.sum("words")).first()[0] == 0 and mixing.mixed_documents(df, block=16).count() == 0
    monkeypatch.setattr(mixing, "schedule", half)
    assert 0.4 < mixing.mix(df, block=16).agg(F.sum("words")).first()[0] / whole.agg(F.sum("words")).first()[0] < 0.6


def test_points_of_the_schedule(spark):
    ids = [1, 2, 3, 1 << 20, (1 << 31) + 5, (1 << 40) + 77, (1 << 47) + 1]
    got = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", mixing._point(F.col("i")).alias("u")).collect()
    assert all(r["u"] == r["i"] * mixing.GOLDEN % (1 << 48) for r in got)


def test_mixed_documents_keep_rows_apart(spark, monkeypatch):
    """Rows that share key, source and text but not another column, and rows that share all; the order is that of the slots."""
    monkeypatch.setattr(mixing, "SALTS", 4)
    monkeypatch.setattr(mixing, "COPIES", 8)
    data = [(1, "one two three", lang, "a", None) for lang in ("en", "de", "fr")] + [(2, "x y z", "en", "a", {"k": "v"})] * 30
    data += [(k, "word " * 50, "en", "b", {"k": str(k)}) for k in range(100, 140)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, tags map<string, string>")
    got = mixing.mixed_documents(df, block=16).collect()
    times = {}
    for r in got:
        times.setdefault((r["doc_id"], r["lang"]), []).append(r)
    assert {k for k in times if k[0] == 1} == {(1, "en"), (1, "de"), (1, "fr")} and 60 <= len(times[2, "en"]) <= 90
    assert all(r["text"] == "x y z" and r["tags"] == {"k": "v"} for r in times[2, "en"])
    assert {len(times[1, lang]) for lang in ("en", "de", "fr")} <= {2, 3}
    # Any beginning of the mix has the sources near their shares.
    words = [(r["source"], len(r["text"].split())) for r in got]
    total = sum(n for _, n in words)
    for part in (0.25, 0.5, 0.75):
        held, by = 0, {"a": 0, "b": 0}
        for source, n in words:
            if held < part * total:
                held, by[source] = held + n, by[source] + n
        assert abs(by["a"] - held * sum(n for s, n in words if s == "a") / total) <= 80


def test_lines(spark):
    df = docs(spark, ODD + [(k, f"Menu \nbody {k}\r\n\nmenu2", "a") for k in range(10, 30)])
    want = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(df).collect()}
    assert want[10] == ("body 10\r\n", 4, 2) and want[1] == (None, 0, 0) and want[2] == ("", 1, 0) and want[3][2] == 0
    assert want[4] == ("one two", 1, 0)  # on two rows of a site: under the least number of pages
    assert rows(lines.dedup_lines(df), "doc_id", "text", "n_dropped") == rows(lines.dedup_lines(df, broadcast_lines=0), "doc_id", "text", "n_dropped")
    assert lines.dedup_lines(docs(spark, [])).count() == 0 and set(lines.dedup_lines(df).columns) == {*df.columns, "n_lines", "n_dropped"}


def test_shards(spark):
    df = docs(spark, ODD + [(k, f"t{k}", "s") for k in range(100, 600)] + [(7, "same", "s")] * 300)
    got = sharding.shard_by_ring(df).collect()
    n = [0] * 40
    for r in got:
        n[r["shard"]] += 1
    assert len(got) == df.count() and max(n) - min(n) <= 1
    for s in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n[s]))
    by = {r["doc_id"]: r for r in got}
    assert by[1]["size"] == 16 and by[1]["text_crc32"] == 0 and by[6]["text_crc32"] == zlib.crc32(ODD[7][1].encode())
    assert sharding.shard_by_ring(docs(spark, [])).count() == 0


def test_ring_moves_little_when_a_shard_is_added():
    a, b = (dict(sharding.ring(n, 128)) for n in (40, 41))
    assert all(b[p] == s for p, s in a.items()) and {b[p] for p in set(b) - set(a)} == {40}
    parts = sharding.bounded_loads([5, 0, 9], [0, 1, 2], [5, 5, 4])
    assert parts == [(0, 0, 5, 0, 0), (2, 0, 4, 2, 0), (2, 4, 9, 1, 0)]


def test_secrets_spans():
    s = lambda t: [(secrets.KINDS[k], t[a:b]) for a, k, b in secrets.base_spans(t)]
    assert s("PassWord = 'abc123' x") == [("assign", "PassWord = 'abc123")]
    assert s("secret=token:abcdefg") == []  # the short match takes up "token"
    assert s("pas\u017fword: abcdefgh") == [] and s("to\u212aen: abcdefgh") == []  # other letters that fold to ASCII don't count
    assert s("AKIA" + "A" * 15) == [] and s("xAKIA" + "A" * 16) == [("access", "AKIA" + "A" * 16)]
    assert s("0123456789abcdef01234567Z") == [("hex", "0123456789abcdef01234567")] and s("a" * 23) == []
    assert s("api_key: " + "0" * 24) == [("assign", "api_key: " + "0" * 24), ("hex", "0" * 24)]


def test_secrets(spark):
    words = "ordinary identifiers such as configuration_manager internationalization DocumentBuilderFactory and getElementByIdentifier " * 5
    df = docs(spark, ODD + [(50, words, "a"), (51, words + " zQ8x-Vt0_LmP4rT7yW2kD9sJ6hN3bC5g " + words, "a"), (52, "é" * 10 + "token='abcdef1'", "a")])
    ratio = secrets.train(secrets.pair_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    got = {r["doc_id"]: r for r in secrets.scan(df, ratio).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert (got[1]["spans"], got[1]["base_sha256"], got[50]["n_markov"]) == ("", none, 0)
    at = len(words) + 1
    assert got[51]["spans"] == f"markov:{at}:{at + 32}" and got[51]["base_sha256"] == none
    assert got[52]["spans"] == "assign:10:24" and got[52]["base_sha256"] == hashlib.sha256(b"assign:10:24").hexdigest()
    assert secrets.find_secrets(docs(spark, [])).count() == 0 and secrets.find_secrets(df).count() == df.count()


@pytest.mark.parametrize("most", [50_000, 0])
def test_warc(spark, tmp_path, most, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    schema = "page_id bigint, url string, html string, digest int, salt int, payload int"
    data = [(3, "http://a/", "same"), (1, "http://b/\r\nX: y", "same"), (2, None, None), (5, "u", ""), (None, "u", "same"), (7, "u", "é" * 100_000), (7, "u", "é" * 100_000)]
    pages = spark.createDataFrame([(*r, 1, 2, 3) for r in data], schema)
    made = warc.write_packages(pages, str(tmp_path / "w"))
    got = {(r["page_id"], r["payload_bytes"]): r for r in warc.read_packages(made, str(tmp_path / "w")).collect()}
    assert sum(r["records"] for r in made.collect()) == 7
    a, b, n = got[1, 4], got[3, 4], got[None, 4]
    assert (a["record_type"], a["refers_to"], b["record_type"], b["refers_to"], n["refers_to"]) == ("response", None, "revisit", 1, 1)
    assert a["payload_digest"] == b["payload_digest"] == warc.base32_sha1(b"same") and bytes(a["payload"]) == b"same" and a["url"] == "http://b/%0D%0AX: y"
    assert (got[5, 0]["record_type"], got[5, 0]["refers_to"]) == ("revisit", 2) and bytes(got[7, 200_000]["payload"]) == ("é" * 100_000).encode()
    none = warc.write_packages(pages.limit(0), str(tmp_path / "n"))
    assert none.count() == 0 and warc.read_packages(none, str(tmp_path / "n")).count() == 0


def test_zip_directories(tmp_path):
    import io
    import zipfile

    from curbstone.llm.zips import data_offset, directory

    for force in (False, True):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
            z.comment = b"PK\x05\x06 in the comment"
            for k in range(3):
                with z.open(zipfile.ZipInfo(f"m{k}é.txt"), "w", force_zip64=force) as f:
                    f.write(b"x" * k + b"data")
        data = raw.getvalue()
        read_at = lambda at, n: data[at : at + n]
        found = directory(read_at, len(data))
        assert [(m.name, m.size) for m in found] == [("m0é.txt", 4), ("m1é.txt", 5), ("m2é.txt", 6)]
        assert data[(at := data_offset(read_at, found[2])) : at + 6] == b"xxdata"
    # A ZIP64 end record, with the short one's fields full.
    import struct

    end = data.rfind(b"PK\x05\x06", 0, len(data) - 25)
    n, size, offset = struct.unpack_from("<HII", data, end + 10)
    body = data[:end]
    record = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, offset)
    data = body + record + b"PK\x06\x07" + struct.pack("<IQI", 0, len(body), 1) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert [m.name for m in directory(lambda at, n: data[at : at + n], len(data))] == ["m0é.txt", "m1é.txt", "m2é.txt"]
    with pytest.raises(ValueError, match="no end"):
        directory(lambda at, n: b"x" * n, 100)


def brute_near(items):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in items:
        w = word.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def variants(seed, n):
    """A hub and copies of it that resemble it more than one another, chains, and strangers that share a passage."""
    rng = np.random.default_rng(seed)
    word = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 10**6, k))
    hub, out = word(120).split(), []
    for _ in range(n):
        w = list(hub)
        for k in rng.choice(120, rng.integers(1, 5), replace=False):
            w[k] = word(1)
        out.append(" ".join(w))
    chain = word(200).split()
    for _ in range(n):
        at = int(rng.integers(0, 195))
        chain = chain[:at] + word(5).split() + chain[at + 5 :]
        out.append(" ".join(chain))
    passage = word(80)
    out += [word(int(rng.integers(5, 40))) + " " + passage + " " + word(int(rng.integers(5, 40))) for _ in range(n)]
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "STAR", block)
    texts = variants(3, 60) + ["Same words here", "same  WORDS\there", "a b c d e", "a b c d E f", ""]
    items = [(1000 - 3 * k, t) for k, t in enumerate(texts)]
    df = docs(spark, [(i, t, "s") for i, t in items])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df).collect()}
    assert got == brute_near(items)


def test_block_compares_on_full_sets():
    """Pairs at exactly the threshold whose minima agree in less than 59 % of all cases are linked as any other."""
    rng, seen = np.random.default_rng(11), []
    while len(seen) < 6:
        x = rng.integers(0, 1 << 62, (4000, 80), dtype=np.uint64)
        for row in x:
            a, b = np.sort(row[:70]), np.sort(np.concatenate([row[:60], row[70:]]))
            if (near.signature(a) == near.signature(b)).mean() < 0.64:
                seen.append((a, b))
    for a, b in seen:
        assert near.linked(a, b) and near.block_edges([1, 2], [0, 0], [1, 2], [a, b]) == [(1, 2)]
        assert near.block_edges([1, 2], [0, 1], [1, 2], [a, b]) == [(1, 2)] and near.block_edges([1, 2], [0, 0], [1, 1], [a, b]) == []


def test_shared_counts_all_intersections(monkeypatch):
    monkeypatch.setattr(near, "WIDE", 7)
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64)) for _ in range(30)]
    got = near.shared(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)


def test_near_odd(spark):
    got = near.near_duplicates(docs(spark, ODD)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 2, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 5, True), (6, 2, 6, True),
    ]
    assert near.near_duplicates(docs(spark, [])).count() == 0 and near.near_duplicates(docs(spark, [(1, None, "a")])).count() == 1


def test_components(spark):
    from curbstone.llm.components import components

    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    up = {x: x for p in pairs for x in p}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    want = {(i, top(i)) for i in up if any(i in p and p[0] != p[1] for p in pairs)}
    df = spark.createDataFrame([*pairs, (7, None), (None, None), *pairs[:9]], "a bigint, b bigint")
    assert {tuple(r) for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    data = ODD + [(k, "A sentence here. Another one follows it! " * (k % 90), "s") for k in range(100, 300)] + [(9, "<|endoftext|> is text", "s")]
    got = packing.pack(docs(spark, data), VOCABULARY, with_ids=True).collect()
    want = sorted((i if i is not None else -1, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x, _ in data)
    pieces, found = {}, []
    for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["start"], r["sequence_id"])):
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces.setdefault(r["sequence_id"], []).append(r)
    by: dict = {}
    for s in sorted(pieces):
        for r in sorted(pieces[s], key=lambda r: r["offset"]):
            own = by.setdefault(r["doc_id"], [])
            if r["start"] == 0:
                own.append([])
            assert sum(map(len, own[-1])) == r["start"]
            own[-1].append(tuple(r["ids"]))
    found = sorted((i if i is not None else -1, sum(p, ())) for i, ps in by.items() for p in ps)
    assert found == want
    lengths = [sum(r["length"] for r in ps) for ps in pieces.values()]
    for ps in pieces.values():
        at = 0
        for r in sorted(ps, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths)
    assert max(lengths) <= 1024 and padding < 0.03 * sum(lengths)
    assert packing.pack(docs(spark, []), VOCABULARY).count() == 0


def test_plan_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        nodes = np.concatenate([[0], np.cumsum(rng.integers(1, 8, 40))])
        costs = rng.integers(0, 9, 41)
        best = [0] + [math.inf] * 40
        cost = lambda i, j: packing.SEQUENCE + costs[j] + (0 if (n := int(nodes[j] - nodes[i])) & (n - 1) == 0 else 32 - n)
        for j in range(1, 41):
            best[j] = min(best[i] + cost(i, j) for i in range(j) if nodes[j] - nodes[i] <= 32)
        cuts = packing.plan(nodes, costs, 32)
        assert cuts[0] == 0 and cuts[-1] == 40 and sum(cost(i, j) for i, j in zip(cuts, cuts[1:])) == best[40]


def test_encoder_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY)
    t.encode_special_tokens = True
    rng = np.random.default_rng(5)
    pool = list("aeiouxyz  \n\t.,!?'’\"0123é漢ß  🙂\x00-_") + ["'s", "'ll", " the", "  ", "\r\n", "ing"]
    for _ in range(300):
        s = "".join(rng.choice(pool, rng.integers(0, 60)))
        assert e.ids(s).tolist() == t.encode(s, add_special_tokens=False).ids, s


def test_encoder_on_endless_runs():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY)
    t.encode_special_tokens = True
    n = 1_100_000
    many = [" " * 2 * n, "a" + " " * n, "a" + " " * n + "b", "x" + "\t" * n + "y", "\n" * n + "z.", "q" * n, ("a \n\t\u3000" * 5 + "  " * 3000 + "\n" * 1500 + " b") * 9]
    many += [" " * 999 + "x" + " " * 1000 + "'s" + " " * 1001 + "1" + "\t" * 1000 + "\x1c" * 1000, "\x1c" * 5000 + " " * 2000 + "\u2028" * 1500 + "é"]
    for s in many:
        assert e.ids(s).tolist() == t.encode(s, add_special_tokens=False).ids, s[:20]


def test_packing_survives_a_run_of_blanks(spark):
    data = [(1, "a" + " " * 2_000_000, "s"), (2, "b", "s"), (3, " " * 1_500_000 + "c", "s")]
    got = packing.pack(docs(spark, data), VOCABULARY).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"]: (r["n"], r["t"]) for r in got} == {1: (2_000_002, 2_000_002), 2: (2, 2), 3: (1_500_001, 1_500_001)}


def test_packing_as_it_lies(spark):
    """Sequences follow the order of the rows, whatever their keys."""
    data = [(k * 7919 % 500, f"Document {k} is short.", "s") for k in range(500)]
    got = packing.pack(docs(spark, data).coalesce(1), VOCABULARY, as_it_lies=True).orderBy("sequence_id", "offset").collect()
    assert [r["doc_id"] for r in got if r["start"] == 0] == [i for i, *_ in data]


def test_quality(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    good = lambda: " ".join(word() for _ in range(60)) + "."
    bad = lambda: " ".join(word() + "***" for _ in range(60))
    toxic = lambda: good() + " worthless " + good()
    kinds = [(good, 1, 0), (bad, 0, 0), (toxic, 1, 1)]
    data = [(k, kinds[k % 3][0](), f"s{k % 4}") for k in range(600)]
    df = docs(spark, data + [(None, None, None), (9999, "", "x"), (9998, "long text " * 40_000, "x")])
    labels = spark.createDataFrame([(k, kinds[k % 3][1], kinds[k % 3][2]) for k in range(300)] + [(3, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.train(df, labels)
    rated = quality.classify(df.withColumn("keep", F.lit(1)), model)
    assert rated.count() == 603 and set(rated.columns) == {*df.columns, "p_good", "p_toxic", "keep"}
    held = {r["doc_id"]: r["keep"] for r in rated.filter("doc_id >= 300 and doc_id < 600").collect()}
    assert np.mean([held[k] == (k % 3 == 0) for k in held]) > 0.97
    empty = quality.classify(docs(spark, []), quality.train(docs(spark, []), labels.limit(0)))
    assert empty.count() == 0
    a, b = quality.classify(df, model), None
    quality.BROADCAST_PATHS, was = 0, quality.BROADCAST_PATHS
    try:
        b = quality.classify(df, model)
        assert rows(a, "doc_id", "keep") == rows(b, "doc_id", "keep")
    finally:
        quality.BROADCAST_PATHS = was


def test_sparse_sites_shrink(spark):
    """A site with many bad documents pulls its doubtful ones down; a site with one document has the global rate."""
    data = [("big", "p", 0.1)] * 200 + [("good", "p", 0.9)] * 400 + [("one", "p", 0.1)]
    scored = spark.createDataFrame([(s, p, x, 0.1) for s, p, x in data], "site string, path string, __good double, __toxic double")
    r = {x["__site"]: x for x in quality.posteriors(scored, F.col("site"), F.col("path")).collect()}
    assert r["big"]["path_n"] == 200 and r["big"]["kappa_site_good"] < 50 and r["one"]["site_n"] == 1 and r["one"]["all_good"] == pytest.approx(0.63, abs=0.01)


BAD = [[float("nan"), 1.0], [0.0, 0.0], None, [1.0, None], [float("inf"), 1.0], []]


def vectors(spark, data):
    return spark.createDataFrame([(i, v, l, 1, "x", 2) for i, v, l in data], VECTORS)


def brute_neighbours(data, q, k=10):
    ids = np.array([i for i, _ in data])
    y = np.array([v for _, v in data], float)
    d = np.sqrt(((y - y[ids == q][0]) ** 2).sum(1))
    return [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != q][:k]


def test_forest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 8)).astype(np.float32)
    data = [(k, x[k].tolist(), 0) for k in range(700)] + [(k, x[5].tolist(), 0) for k in range(800, 830)] + [(900 + k, v, 0) for k, v in enumerate(BAD)] + [(None, [1.0] * 8, 0)]
    got = forest.search(vectors(spark, data), F.col("vec_id") % 100 == 0)
    plain = [(i, np.array(v, np.float32)) for i, v, _ in data if i is not None and i < 900]
    hit = total = 0
    for q in (0, 100, 500, 800):
        mine = got.filter(F.col("query_id") == q).orderBy("rank").collect()
        y, own = dict(plain), dict(plain)[q].astype(float)
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(r["score"] == np.sqrt(((y[r["vec_id"]] - own) ** 2).sum()) for r in mine)
        hit, total = hit + len({r["vec_id"] for r in mine} & {i for i, _ in brute_neighbours(plain, q)}), total + 10
    assert hit >= 0.9 * total
    assert [r["vec_id"] for r in got.filter("query_id = 800").orderBy("rank").collect()] == [5, *range(801, 810)]
    assert got.filter("query_id = 900").count() == 0 and forest.search(vectors(spark, []), F.col("vec_id") == 0).count() == 0
    few = forest.search(vectors(spark, [(100, [1.0, 2.0], 0), (1, [1.0, 3.0], 0), (2, [1.0, 2.0, 3.0], 0), (1, [1.0, 3.0], 0)]), F.col("vec_id") == 100).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(100, 1, 1, 1.0), (100, 2, 1, 1.0)]


def test_forest_on_clusters(spark, monkeypatch):
    """Clustered vectors, one of which a third of all rows share: few candidates, crowded beginnings in parts, recall against brute force."""
    monkeypatch.setattr(forest, "ROWS", 300)
    monkeypatch.setattr(forest, "QUERIES", 4)
    monkeypatch.setattr(forest, "BUDGET", 40)
    rng = np.random.default_rng(14)
    centres = rng.standard_normal((40, 24))
    data = [(k, (centres[k % 40] + 0.4 * rng.standard_normal(24)).astype(np.float32).tolist(), 0) for k in range(4000)]
    data += [(5000 + k, data[17][1], 0) for k in range(2000)]
    got = {}
    for r in forest.search(vectors(spark, data), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    plain = [(i, v) for i, v, _ in data]
    want = {q: brute_neighbours(plain, q) for q in range(0, 7000, 100) if q in dict(plain)}
    assert set(got) == set(want)
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(found) >= 9.0 and got[5000] == want[5000]


def test_descent(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    data, key = [], 1
    for k, b in enumerate(base):
        for _ in range(1 + (k % 7) * 2 if k else 450):
            data.append((key * 7 % 4001, (b + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist(), k % 3))
            key += 1
    data += [(5000 + k, data[0][1], data[0][2]) for k in range(20)] + [(6000, data[0][1], 99), (6001, data[0][1], None)] + [(7000 + k, v, 0) for k, v in enumerate(BAD)]
    df = vectors(spark, data + [(None, data[0][1], 0)])
    got = {r["vec_id"]: r for r in descent.near_vectors(df).collect()}
    ok = [(i, np.array(v, float), l) for i, v, l in data if l is not None and i < 7000]
    x = np.array([v for _, v, _ in ok])
    x /= np.sqrt((x * x).sum(1))[:, None]
    hit = (x @ x.T >= 0.98) & (np.array([l for *_, l in ok])[:, None] == np.array([l for *_, l in ok])[None])
    np.fill_diagonal(hit, False)
    comp = np.array([i for i, *_ in ok])
    while True:
        new = np.minimum(comp, np.where(hit, comp[None], 10**9).min(1))
        if (new == comp).all():
            break
        comp = new
    assert [(got[i]["n_links"], got[i]["component_id"]) for i, *_ in ok] == list(zip(hit.sum(1).tolist(), comp.tolist()))
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in (6001, 7000, 7003))
    assert descent.near_vectors(vectors(spark, [])).count() == 0 and descent.near_vectors(vectors(spark, [(1, None, 1)])).count() == 1


def group_and_pairs(group, pairs, dim=32):
    """(vec_id, vector, label) of one group of near copies and of pairs at cosines from 0.981 to 0.99; pairs have ids (2k, 2k + 1) + group."""
    rng = np.random.default_rng(8)
    centre, data = rng.standard_normal(dim), []
    data += [(k, (centre + 0.01 * rng.standard_normal(dim)).tolist(), 0) for k in range(group)]
    for k in range(pairs):
        x, y = (v / np.sqrt(v @ v) for v in rng.standard_normal((2, dim)))
        y = y - (x @ y) * x
        c = rng.uniform(0.981, 0.99)
        data += [(group + 2 * k, x.tolist(), 0), (group + 2 * k + 1, (c * x + np.sqrt(1 - c * c) * y / np.sqrt(y @ y)).tolist(), 0)]
    return data


def descent_nodes(spark, data, dim):
    nodes = spark.createDataFrame([(i, dim, str(l), v) for i, v, l in data], "node long, dim int, label string, v array<double>")
    return descent.with_units(nodes)


def test_descent_audit_counts_groups(spark):
    nodes = descent_nodes(spark, group_and_pairs(300, 40), 32)
    found = spark.createDataFrame([(k, 0) for k in range(300)] + [(300 + 2 * (k // 2), 300 + 2 * (k // 2)) for k in range(20)], "id long, component long")
    assert descent.audit(nodes, found, 0.98) < 0.1  # the group's 89,700 links hide the 40 pairs, all of which are missed
    pairs = spark.createDataFrame([(k, 300 + 2 * ((k - 300) // 2) if k >= 300 else 0) for k in range(380)], "id long, component long")
    assert descent.audit(nodes, pairs, 0.98) == 1.0


def test_descent_finds_pairs_beside_a_group(spark, monkeypatch):
    for name, value in (("STARTS", 1), ("CELL", 2), ("LEAST_ROUNDS", 1), ("MOST_ROUNDS", 1), ("SIDE", 128), ("CHUNK", 50)):
        monkeypatch.setattr(descent, name, value, raising=False)
    data = group_and_pairs(300, 100)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in descent.near_vectors(vectors(spark, data)).collect()}
    assert all(got[300 + 2 * k + s] == (1, 300 + 2 * k) for k in range(100) for s in (0, 1))
    assert {got[k] for k in range(300)} == {(299, 0)}


def test_descent_near_the_threshold(spark):
    """Halves can't tell these pairs from the threshold; labels are texts here, and vectors have two lengths."""
    data = []
    for k, c in enumerate(np.linspace(0.9795, 0.9805, 41)):
        for dim in (8, 12):
            x = np.zeros(dim)
            x[k % 8] = 1.0
            y = c * x
            y[(k + 1) % 8] = np.sqrt(1 - c * c)
            data += [(len(data), (3 * x).tolist(), f"l{k}"), (len(data) + 1, (y / 7).tolist(), f"l{k}")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: r["n_links"] for r in descent.near_vectors(df).collect()}
    for i in range(0, len(data), 2):
        x, y = (np.array(data[k][1]) for k in (i, i + 1))
        cosine = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)
        assert abs(cosine - 0.98) < 1e-12 or got[i] == got[i + 1] == int(cosine > 0.98)


def test_descent_crowded_cells(spark, monkeypatch):
    """Parts of crowded cells by a shuffle, and a vector that a third of all rows share."""
    monkeypatch.setattr(descent, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(descent, "BLOCK", 64)
    data = group_and_pairs(300, 30)
    data += [(10_000 + k, data[310][1], 0) for k in range(200)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in descent.near_vectors(vectors(spark, data)).collect()}
    assert {got[k] for k in range(300)} == {(299, 0)} and {got[10_000 + k] for k in range(200)} == {(201, 310)} and got[312] == (1, 312)


def test_descent_cells_by_label(spark, monkeypatch):
    monkeypatch.setattr(descent, "STARTS", 1)
    rng = np.random.default_rng(9)
    data = [(k, rng.standard_normal(16).tolist(), 0 if k < 4000 else 1) for k in range(4040)]
    lists = descent.start(descent_nodes(spark, data, 16), 100).filter("a >= 4000").groupBy("a").count().collect()
    assert {r["count"] for r in lists} == {39} and len(lists) == 40  # a label that fits in one cell isn't cut, whatever the others hold
