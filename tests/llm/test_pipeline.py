"""The pipeline's stages over a small corpus, held against plain Python."""

import collections
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    from curbstone.llm.common import keep_table

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        new = keep_table(f(spark, docs, SF))
        out.append((docs, new))
        docs = new
    return out


def table(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.filter(F.char_length("text") != F.col("n_chars")).count() == 0


def test_quality_keeps_clean_documents(spark, stages):
    before, after = stages[0]
    kept = {r[0] for r in after.select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    clean = [r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0 or r["toxic"] == 1]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean) and sum(d in kept for d in bad) <= 0.3 * len(bad)
    assert after.exceptAll(before).count() == 0


def test_lines(stages):
    before, after = stages[1]
    rows = before.collect()
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d")
    pages = collections.Counter(r["source"] for r in rows)
    seen = collections.Counter((r["source"], k) for r in rows for k in {key(x) for x in r["text"].split("\n")} if k)
    drop = {k for k, n in seen.items() if n >= 5 and n > 0.02 * pages[k[0]]}
    got = table(after)
    for r in rows:
        assert got[r["doc_id"]]["text"] == "\n".join(x for x in r["text"].split("\n") if (r["source"], key(x)) not in drop)


def test_near(stages):
    from test_small import brute_near

    before, after = stages[2]
    want = {i for i, (_, c) in brute_near([(r["doc_id"], r["text"]) for r in before.collect()]).items() if i == c}
    assert {r[0] for r in after.select("doc_id").collect()} == want


def test_mix(stages):
    from test_small import brute_targets

    before, after = stages[3]
    texts, words = table(before), lambda t: len(WORD.findall(t))
    sizes = collections.Counter()
    for r in texts.values():
        sizes[r["source"]] += words(r["text"])
    taken, times = collections.Counter(), collections.Counter()
    for r in after.collect():
        taken[r["source"]] += words(r["text"])
        times[r["doc_id"]] += 1
        assert r["text"] in texts[r["doc_id"]]["text"]
    for s, t in brute_targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 1
    assert max(times.values()) <= 3


def test_pack(stages):
    before, after = stages[4]
    got = after.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert got.filter("n > 1024").count() == 0
    assert after.filter("start = 0").count() == before.count() and after.filter(F.size("ids") != F.col("length")).count() == 0
    total = lambda: before.select(F.count(F.lit(1))).first()[0]
    assert after.filter("length + start = doc_tokens").count() == total()


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).drop("ids").exceptAll(stages[-1][1].drop("ids")).count() == 0


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep string, p_good string, p_toxic int, n_lines int, n_dropped int, h string, slot int, `row` string"


def odd(spark, rows):
    """Documents (doc_id, text, lang, source) with columns named as the operators' own."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "mine", "p", 7, 8, 9, "h", 3, "r") for r in rows], ODD)


def own(r):
    return (r["keep"], r["p_good"], r["p_toxic"], r["n_lines"], r["n_dropped"], r["h"], r["slot"], r["row"])


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and clashing columns go through every stage."""
    english = "The committee met on Monday and talked about the new library. Nothing was decided, but the plans are good. "
    rows = [(1, None, "en", "web"), (2, "", None, "web"), (3, " \n\t ", "en", None), (None, english + "One row has no number.", "en", "web"), (5, english * 900, "en", None)]
    rows += [(6, english + "This row is there three times.", "en", "web")] * 3 + [(7, "a" + " " * 300_000 + "b", None, None), (8, english + "It says something else in the end, at some length.", "de", "web")]
    docs = odd(spark, rows)
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, SF)
        got = out.collect()
        if k == 4:
            assert {r["doc_id"] for r in got} == {i for i, *_ in rows} and sum(r["length"] for r in got if r["doc_id"] == 1) == 1
            continue
        assert out.columns == docs.columns and all(own(r) == ("mine", "p", 7, 8, 9, "h", 3, "r") for r in got), name
        ids = collections.Counter(r["doc_id"] for r in got)
        texts = {(r["doc_id"], r["text"]) for r in got}
        if name == "line dedup":
            assert sum(ids.values()) == len(rows) and (1, None) in texts and ids[6] == 3
        if name == "near dedup":
            assert ids[None] == 1 and ids[6] == 3 and ids[1] == ids[2] == ids[3] == 1
        if name == "mix":
            assert not {1, 2, 3} & set(ids) and ids[6] >= 3
        if name == "quality":
            assert texts <= {(i, t) for i, t, *_ in rows} and ids[6] in (0, 3)


def test_stages_on_an_empty_table(spark, tmp_path):
    import shutil

    folder = tmp_path / "sf"
    folder.mkdir()
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, odd(spark, []), SF)
        assert out.count() == 0 and (k == 4 or out.columns == odd(spark, []).columns)
    shutil.copyfile(f"{SF}/labels.parquet", folder / "labels.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(folder / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(folder)).count() == 0


def test_many_parts_are_packed_in_the_order_of_the_mix(spark, monkeypatch):
    """However Spark deals the files of the mix to tasks, sequences follow its slots."""
    from curbstone.llm import mixing
    from curbstone.llm.common import keep_table

    monkeypatch.setattr(mixing, "PART_WORDS", 1 << 13)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = keep_table(corpus_pipeline.mix(spark, docs, SF))
    files = sorted(mixed.inputFiles())
    assert len(files) > 10
    want = [r["doc_id"] for f in files for r in spark.read.parquet(f).coalesce(1).select("doc_id").collect()]
    packed = corpus_pipeline.windows(spark, mixed, SF).filter("start = 0").orderBy("sequence_id", "offset")
    got = [r["doc_id"] for r in packed.select("doc_id").collect()]
    assert got == want and got != sorted(got)


def test_packed_sequences_keep_the_shares_of_the_mix(spark, stages):
    """Any beginning of the packed sequences has the sources near their shares, and copies of a document lie apart."""
    mixed, packed = stages[3][1], stages[4][1]
    source = {r["doc_id"]: r["source"] for r in mixed.select("doc_id", "source").distinct().collect()}
    pieces = packed.orderBy("sequence_id", "offset").select("doc_id", "start", "length").collect()
    total, whole = sum(r["length"] for r in pieces), collections.Counter()
    for r in pieces:
        whole[source[r["doc_id"]]] += r["length"]
    held, by = 0, collections.Counter()
    for r in pieces:
        if held <= 0.5 * total:
            held, by[source[r["doc_id"]]] = held + r["length"], by[source[r["doc_id"]]] + r["length"]
    for s, n in whole.items():
        assert abs(by[s] / held - n / total) < 0.1
    order = [r["doc_id"] for r in pieces if r["start"] == 0]
    assert all(a != b for a, b in zip(order, order[1:]))
