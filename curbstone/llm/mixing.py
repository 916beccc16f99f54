"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbstone.llm.common import keep, word_count

WEIGHTS, LIMIT = (5, 2, 1), 3
#: Words in a block, and slots in a run whose ranks are counted together.
BLOCK, RUN = 4096, 1024
#: 2**48 / golden ratio, odd: multiples of it modulo 2**48 are spread evenly, however many are taken.
GOLDEN, HALF = 173961102589771, 24
CELL_BITS = 12
#: Words of the mix in one partition of mixed_documents(), copies of a row that one array holds, and parts of a repeated row.
PART_WORDS, COPIES, SALTS = 1 << 22, 1024, 16


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(skey, source, source_size, target, quota) for each source of sized (skey, source, size).

    Sources by code point, null last, take the weights in turn and share the words of all of them. A target stops at
    limit x its source's size and what is over is shared among the others by weight. With the sources sorted by
    limit x size / weight that is one running sum: a source is capped if its own cap is below the level that
    the rest would get. There is one row for each source here, never one for each document.
    """
    every = Window.partitionBy(F.lit(1))
    total = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    total = total.withColumn("place", place).withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * limit)
    by_level = every.orderBy(F.col("cap") / F.col("weight"), "place")
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    total = total.withColumn("level", (F.sum("source_size").over(every) - before) / rest)
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    level = F.min(F.when(~capped, F.struct("cap_level", "place", "level"))).over(every)["level"]
    total = total.withColumn("cap_level", F.col("cap") / F.col("weight"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return total.withColumn("target", target).select(
        "skey", "source", "source_size", "target", F.least(F.round("target").cast("long"), "cap").alias("quota")
    )


def _point(i: Column) -> Column:
    """i * GOLDEN modulo 2**48, in products that a long holds."""
    mask = (1 << HALF) - 1
    low, high = i.bitwiseAND(F.lit(mask)), F.shiftright(i, HALF).bitwiseAND(F.lit(mask))
    upper = (low * (GOLDEN >> HALF) + high * (GOLDEN & mask)).bitwiseAND(F.lit(mask))
    return (low * (GOLDEN & mask) + F.shiftleft(upper, HALF)).bitwiseAND(F.lit((1 << 2 * HALF) - 1))


def schedule(shares: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """((skey, block, slot), number of blocks): which slot takes each source's block, for sources (skey, quota).

    Slot i has the point i x GOLDEN mod 2**48, which falls into the interval of one source: intervals lie side by
    side and are as long as the sources' numbers of blocks. A source's blocks are its slots by rank; a source whose blocks are
    all dealt leaves its further slots empty. Gaps between n golden-ratio points are under 1.9 / n, so with twice as many
    slots as blocks every block has one. Ranks are counted within runs of slots and added to the sums of earlier
    runs, so no task gets all slots of a source; one row for each source meets in one task.
    """
    spark = shares.sparkSession
    every = Window.partitionBy(F.lit(1)).orderBy("skey")
    need = shares.withColumn("need", F.ceil(F.col("quota") / block).cast("long")).filter("need > 0")
    n = need.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    span = F.lit(float(1 << 2 * HALF) / max(n, 1))
    end = F.sum("need").over(every.rowsBetween(Window.unboundedPreceding, 0))
    spans = need.withColumn("end", end).select(
        "skey", "need", F.floor((F.col("end") - F.col("need")) * span).alias("lo"), F.floor(F.col("end") * span).alias("hi")
    )
    width = 1 << (2 * HALF - CELL_BITS)
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    slots = spark.range(2 * n + 8 if n else 0).select(F.col("id").alias("slot"), _point(F.col("id") + 1).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").filter("lo <= u and u < hi")
    slots = slots.withColumn("run", F.floor(F.col("slot") / RUN)).select("skey", "need", "slot", "run")
    runs = slots.groupBy("skey", "run").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("skey").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("skey", "run").orderBy("slot")) - 1
    ranked = slots.withColumn("rank", rank).join(runs, ["skey", "run"]).withColumn("block", F.col("before") + F.col("rank"))
    return ranked.filter("block < need").select("skey", "block", "slot"), n


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _identity(docs: DataFrame, key: str, source: str, text: str) -> tuple[Column, Column]:
    """Two hashes of a row, equal for rows that are equal in all columns; the first shuffles documents."""
    plain = lambda c: F.to_json(F.struct(c)) if "map<" in dict(docs.dtypes)[c] else F.col(c)
    columns = [plain(c) for c in (key, source, text, *(c for c in docs.columns if c not in (key, source, text)))]
    return F.xxhash64(F.lit("mix"), *columns), F.xxhash64(F.lit("row"), *columns[::-1])


def _sized(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(doc_id, source, skey, h, digest, size, copies): docs without their texts, equal rows counted."""
    h, digest = _identity(docs, key, source, text)
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), source_key(F.col(source)).alias("skey"),
        h.alias("h"), digest.alias("digest"), word_count(F.col(text)).alias("size"),
    )
    return keep(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")))


def _pieces(sized: DataFrame, weights: tuple[int, ...], limit: int, block: int) -> tuple[DataFrame, int]:
    """(mix()'s rows, number of blocks) for sized documents."""
    sized = sized.withColumn("all", F.col("size") * F.col("copies"))
    shares = keep(targets(sized.select("skey", "source", F.col("all").alias("size")), weights, limit))
    slots, n = schedule(shares, block)
    bits = max(1, math.ceil(math.log2(max(sized.count(), 1)) / 2))
    rows = sized.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("skey", "bucket").agg(F.sum("all").alias("n"))
    sums = sums.select("skey", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    sums = sums.join(shares.drop("source"), "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("h", "digest").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum("all").over(within) - F.col("all")).join(sums, ["skey", "bucket"])
    # Equal rows lie one after the other.
    rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).withColumn(
        "copy", F.explode(F.sequence(F.col("run") * COPIES, F.least((F.col("run") + 1) * COPIES, "copies") - 1))
    )
    rows = rows.withColumn("start", F.col("n_before") + F.col("start") + F.col("copy") * F.col("size"))
    taken = (F.col("size") > 0) & (F.col("quota") > F.col("start"))
    laps = F.when(taken, F.sequence(F.lit(0), F.floor((F.col("quota") - 1 - F.col("start")) / F.greatest("source_size", F.lit(1))).cast("int")))
    rows = rows.withColumn("lap", F.explode_outer(laps))
    begin = F.col("lap") * F.col("source_size") + F.col("start")
    rows = rows.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), "quota"))
    blocks = F.when(F.col("lap").isNotNull(), F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)))
    # Rows that aren't taken have no block; numbers under 0, which no slot has, deal them out in the join.
    rows = rows.withColumn("block", F.explode_outer(blocks)).withColumn("block", F.coalesce("block", -1 - F.pmod("h", F.lit(1 << 16))))
    first = F.greatest(F.col("block") * block, F.col("begin"))
    words = F.least((F.col("block") + 1) * block, F.col("end")) - first
    rows = rows.withColumn("first", first - F.col("begin")).withColumn("words", words)
    words = F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(F.lit(0)).cast("long")
    rows = rows.join(slots, ["skey", "block"], "left").withColumn("words", words)
    return rows.select("doc_id", "h", "digest", "copy", "skey", "size", "source_size", "target", "slot", "lap", "begin", "first", "words"), n


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    limit: int = LIMIT,
    block: int = BLOCK,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """What the mix takes: (doc_id, h, digest, copy, skey, size, source_size, target, slot, lap, begin, first, words).

    Each source's documents are shuffled by a hash and laid end to end, again and again (lap 0, 1, ...) up to the
    source's target; this stream is cut into blocks of `block` words, and block k goes to the source's k-th slot in the
    schedule. A row is the part of a document, words first to first + words, that lies in one block: what has no slot isn't taken.
    A document that isn't taken has one row with words 0 and no slot. h, digest and copy tell rows apart; slot and, within a slot,
    begin are the order of the mix.

    Places in the stream are sums over hash buckets of about the square root of all rows plus sums within
    a bucket, so a large source is many tasks. Null texts have no words; null sources form a source, the last. Rows that are equal
    in all columns are counted before they are dealt out and taken separately; an empty table gives no rows. Other columns
    only tell rows apart. Runs agree: all order is by hash.
    """
    return _pieces(_sized(docs, key, source, text), weights, limit, block)[0]


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: docs' columns, one row for each document and lap, its text cut to the words taken.

    Rows come in the order of the mix, by the slot of their first word: partitions are consecutive parts of it, of about
    PART_WORDS words, and are sorted; written as files they keep that order. So sources lie interleaved by their weights,
    and a document's copies lie a lap apart. A document that the mix takes twice stands there twice; one that it doesn't take is left
    out. Only a source's last document is ever cut. n_chars, where it is a column, follows the text. Rows that differ in any column
    are different documents, whatever their keys. Nulls, equal rows and empty tables: as mix(); documents without words
    aren't taken.
    """
    key, source, text = how.get("key", "doc_id"), how.get("source", "source"), how.get("text", "text")
    weights, limit, block = how.get("weights", WEIGHTS), how.get("limit", LIMIT), how.get("block", BLOCK)
    sized = _sized(docs, key, source, text)
    pieces, n = _pieces(sized, weights, limit, block)
    laps = pieces.filter("words > 0").groupBy("h", "digest", "size", "copy", "lap").agg(
        *(F.min(c).alias(c) for c in ("slot", "begin", "first")), F.sum("words").alias("words")
    )
    h, digest = _identity(docs, key, source, text)
    rows = docs.select(h.alias("h"), digest.alias("digest"), F.struct(*docs.columns).alias("row"))
    repeated = sized.filter("copies > 1").select("h", "digest")
    salt = F.lit(0).cast("long")
    if repeated.take(1):  # one row stands for all that equal it, in as many places as its copies are dealt to
        once = rows.join(repeated, ["h", "digest"], "left_anti").withColumn("salt", salt)
        more = rows.join(repeated, ["h", "digest"], "left_semi").groupBy("h", "digest").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("copies"))
        rows = once.unionByName(more.withColumn("salt", F.explode(F.sequence(salt, F.least(F.lit(SALTS), "copies") - 1))).drop("copies"))
    else:
        rows = rows.withColumn("salt", salt)
    rows = rows.join(laps.withColumn("salt", F.pmod("copy", F.lit(SALTS))), ["h", "digest", "salt"])
    parts = max(1, math.ceil(n * block / PART_WORDS))
    part = F.least(F.floor(F.col("slot") * parts / max(n, 1)), F.lit(parts - 1)).cast("int")
    rows = rows.repartitionById(parts, part).sortWithinPartitions("slot", "begin", "h", "digest", "copy", "lap")
    words = F.regexp_extract_all(F.col("row")[text], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("words").cast("int")), "")
    whole = F.when(F.col("words") == F.col("size"), F.col("row")[text]).otherwise(cut)
    put = {text: whole} | ({"n_chars": F.char_length(whole).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return rows.select(*(put.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
