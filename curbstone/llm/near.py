"""MinHash near-deduplication: universal hash minima, banding, verification on full sets, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstone.llm.common import delete, keep, keep_table, new_folder
from curbstone.llm.components import components
from curbstone.llm.wordhash import SPACE, mix, text_groups, word_hashes

#: Words in a shingle, and the least similarity of linked documents as a fraction.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Minima in a signature: BANDS x ROWS. At similarity 0.75 a pair shares no band with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
#: Documents of a star, or of one side of a block of a bucket, that one group holds.
STAR, BLOCK = 128, 256
#: Shingles that a block's sets are compared on at a time.
WIDE = 8192
#: Bits of the filter that finds the documents whose sets are needed: 2 MB, sent to all executors.
FILTER_BITS = 1 << 24
#: Centres of large stars up to which their numbers of parts are sent to all executors (about 30 bytes each), not shuffled.
BROADCAST_ROWS = 20_000
#: Over so many parts the rows of a text with many copies are spread.
SALTS = 16
#: Texts hashed together.
GROUP_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
    """For each text: (a 128-bit hash of its words, its distinct shingles as sorted 64-bit hashes).

    Words are runs of other than ASCII white space, A-Z taken as a-z. A text of fewer than SHINGLE words is one shingle.
    """
    words = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts], SPACE)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        h = words.hashes[a:b]
        n = max(1, b - a - SHINGLE + 1) if b > a else 0
        x = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, b - a)):
            x = mix(x + h[k : k + n] + np.uint64(k + 1))
        yield hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.unique(x)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of FACTORS * x + TERMS modulo 2**64 over the shingles, their high 32 bits."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        least = np.minimum(least, (shingles[k : k + 512, None] * FACTORS + TERMS).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band of each signature, different from band to band."""
    s = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), s.shape[:2])
    for r in range(ROWS):
        x = mix(x + s[:, :, r])
    return x.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if DENOMINATOR * small < NUMERATOR * large:
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return DENOMINATOR * same >= NUMERATOR * (small + large - same)


def signed(docs: DataFrame) -> DataFrame:
    """(id, words, n, bands) of each row (id, text)."""
    schema = pa.schema([("id", pa.int64()), ("words", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in text_groups(batch.column(1), GROUP_BYTES):
                found = [(w, len(s), signature(s)) for w, s in shingle_sets(group)]
                keys = bands(np.array([f[2] for f in found]))
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS)
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(group)), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), lists], schema=schema)

    return docs.mapInArrow(run, "id long, words binary, n long, bands array<long>")


def _perhaps(ids: DataFrame) -> DataFrame:
    """(bucket, bits): a filter of FILTER_BITS bits, one set for each id, in rows of 4 KB; its size doesn't depend on the ids."""
    bit = _filter_bit()
    return ids.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def _filter_bit() -> Column:
    return F.pmod(F.xxhash64(F.lit("sets"), "id"), F.lit(FILTER_BITS))


def _with_sets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(group, side, node, component, shingles) for each row of targets (id, group, side, component): the sets of docs (id, text).

    Texts that aren't wanted are left out by a filter of fixed size, sent to all executors, before their sets are made; what the
    filter lets through by chance goes in the join of sets and targets. So texts aren't shuffled, and no broadcast
    grows with the data. A task gives the set of an id and its words once.
    """
    place = F.bitmap_bit_position(_filter_bit())
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = docs.withColumn("bucket", F.bitmap_bucket_number(_filter_bit())).join(F.broadcast(_perhaps(targets.select("id"))), "bucket")
    rows = rows.filter(byte.bitwiseAND(F.pow(F.lit(2), F.pmod(place, F.lit(8))).cast("int")) != 0).select("id", "text")
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, bytes]] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, part in text_groups(batch.column(1), GROUP_BYTES):
                out: list[tuple[int, bytes]] = []
                for k, (words, s) in enumerate(shingle_sets(part), first):
                    if (ids[k], words) not in given:
                        given.add((ids[k], words))
                        out.append((ids[k], s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)

    sets = rows.mapInArrow(run, "id long, shingles binary")
    return sets.join(targets.distinct(), "id").select("group", "side", F.col("id").alias("node"), "component", "shingles")


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _star_edges(rows: DataFrame) -> DataFrame:
    """Edges between each group's centre (side 0) and those of its members (side 1) that are linked with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centres = None, []
        for batch in batches:
            a, b = [], []
            for g, side, node, raw in zip(*(batch.column(c).to_pylist() for c in ("group", "side", "node", "shingles"))):
                s = np.frombuffer(raw, np.uint64)
                if g != group:
                    group, centres = g, []
                if side == 0:
                    centres.append((node, s))
                    continue
                for centre, c in centres:
                    if linked(c, s):
                        a.append(centre)
                        b.append(node)
                        break
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, _EDGES)

    dealt = rows.repartition("group").sortWithinPartitions("group", "side")
    return dealt.mapInArrow(run, "a long, b long")


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets, by products of matrices of WIDE shingles at a time."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = (times > 1)[column]  # the others are in no intersection
    column, row = (np.cumsum(times > 1) - 1)[column[often]], row[often]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):
        part = slice(*np.searchsorted(column, [at, at + WIDE]))
        held = np.zeros((len(sets), WIDE), np.float32)
        held[row[part], column[part] - at] = 1
        out += np.rint(held @ held.T).astype(np.int64)
    return out


def block_edges(nodes: list[int], sides: list[int], labels: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join the components of all linked pairs of one block, given the components known before.

    Pairs are of sides 0 and 1, or all pairs if there is one side. Full sets are compared, of every pair that isn't in
    one component already and whose sizes allow a link.
    """
    sizes, side, label = np.array([len(s) for s in sets]), np.array(sides), np.array(labels)
    small, large = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
    may = (DENOMINATOR * small >= NUMERATOR * large) & (label[:, None] != label)
    if len(set(sides)) > 1:
        may &= side[:, None] != side
    some = np.flatnonzero(may.any(1))
    if not len(some):
        return []
    same = shared([sets[k] for k in some])
    hit = may[np.ix_(some, some)] & (DENOMINATOR * same >= NUMERATOR * (sizes[some][:, None] + sizes[some] - same))
    up = {c: c for c in labels}

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    found = []
    for i, j in zip(*(some[x].tolist() for x in np.nonzero(np.triu(hit)))):
        a, b = top(labels[i]), top(labels[j])
        if a != b:
            up[max(a, b)] = min(a, b)
            found.append((nodes[i], nodes[j]))
    return found


def _block_pairs(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def give() -> pa.RecordBatch:
            got = block_edges(*map(list, zip(*held))) if len(held) > 1 else []
            return pa.RecordBatch.from_pydict({"a": [e[0] for e in got], "b": [e[1] for e in got]}, _EDGES)

        for batch in batches:
            for g, side, node, label, raw in zip(*(batch.column(c).to_pylist() for c in ("group", "side", "node", "component", "shingles"))):
                if g != group:
                    if held:
                        yield give()
                    group, held = g, []
                held.append((node, side, label, np.frombuffer(raw, np.uint64)))
        if held:
            yield give()

    dealt = rows.repartition("group").sortWithinPartitions("group", "side", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Documents are linked if their sets of SHINGLE-word shingles have similarity 0.75 or more. component_id is the
    smallest doc_id that a document reaches over links, itself included; kept marks the document with that id.

    1. Each text gets a hash of its words, and a signature of minima, kept as one hash for each band. Texts with equal
       words are one node, the smallest doc_id.
    2. Nodes that share a band are a bucket. Its centre is the member whose buckets are largest in all, as a text that
       many copies come from is. Members are compared with their centres on full sets: at most BANDS pairs a node.
    3. What then still is apart in a bucket is compared on full sets in blocks of BLOCK x BLOCK, giving only edges that join
       components. So no pair that shares a band is left out, while groups of copies, already joined in step 2, cost
       nothing here. Buckets with the same members are compared once. A bucket of n texts that resemble nothing costs
       n / BLOCK copies of each set, the price of looking at all its pairs.
    4. Components come from alternating large-star and small-star.

    Large stars and buckets are split over groups of bounded size. A null or blank text has no shingles and is linked with
    nothing. Rows that share a doc_id are one document. Rows without doc_id are linked with nothing and have no component;
    kept is true for them. An empty table gives no rows. Only key and text are read.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark, folders = docs.sparkSession, []

    def held(df: DataFrame) -> DataFrame:
        """df as a table that goes before this function returns; its small files are read several to a task."""
        folders.append(new_folder(spark))
        return keep_table(df, folders[-1])

    sign = keep_table(signed(docs))
    some = sign.filter("n > 0 and id is not null")
    nodes = some.groupBy("words").agg(F.min("id").alias("node"), F.min_by("bands", "id").alias("bands"), F.count(F.lit(1)).alias("copies"))
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = held(banded.join(shared, "bucket"))

    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    centres = members.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))
    stars = held(members.join(centres, "bucket").filter("node <> centre").select("bucket", "centre", "node"))
    pairs = held(stars.select("centre", "node").distinct())
    # Only centres with more than STAR members are cut into parts; they are at most one for STAR pairs.
    large = held(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts")).filter("parts > 1"))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    parts, none = F.coalesce("parts", F.lit(1)), F.lit(0).cast("long").alias("component")
    part = lambda k: F.concat_ws("/", F.col("centre"), k).alias("group")
    centres_of = pairs.select("centre").distinct().join(large, "centre", "left").withColumn("k", F.explode(F.sequence(F.lit(0), parts - 1)))
    goals = centres_of.select(F.col("centre").alias("id"), part(F.col("k")), F.lit(0).alias("side"), none).unionByName(
        pairs.join(large, "centre", "left").select(F.col("node").alias("id"), part(F.pmod(F.xxhash64("node"), parts).cast("int")), F.lit(1).alias("side"), none)
    )
    labels = keep(components(held(_star_edges(_with_sets(docs, held(goals))))))

    left = _labelled(stars, labels)
    apart = left.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum("node").alias("s")
    ).filter("lo < hi")
    apart = apart.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = left.join(apart, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.concat_ws("/", F.col("bucket"), F.least("block", "other"), F.greatest("block", "other"))
    goals = held(rest.select(F.col("node").alias("id"), group.alias("group"), (F.col("block") > F.col("other")).cast("int").alias("side"), "component"))
    more = held(_block_pairs(_with_sets(docs, goals)))
    if more.take(1):
        labels = keep(components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)))
    for folder in folders:
        delete(spark, folder)

    # Only texts that occur twice need their node looked up; salts spread a text with very many copies.
    twice = nodes.filter("copies > 1").join(labels.withColumnRenamed("id", "node"), "node", "left").select("words", "node", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    single = labels.select("id", F.col("component").alias("own"))
    return (
        sign.select("id", "words", "n", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(twice, ["words", "salt"], "left")
        .join(single, "id", "left")
        .withColumn("component_id", F.when(F.col("n") > 0, F.coalesce("component", "node", "own", "id")).otherwise(F.col("id")))
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )
