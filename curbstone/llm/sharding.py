"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The ring is cut into so many equal cells; a key looks for its virtual node in its own cell only.
CELL_BITS = 12


def ring(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(position, shard) of each virtual node, clockwise; positions are unsigned 32-bit and depend on shard and replica alone."""
    nodes = {}
    for s in range(shards):
        for r in range(replicas):
            nodes.setdefault(int.from_bytes(blake2b(f"{s}/{r}".encode(), digest_size=4).digest(), "big"), s)
    return sorted(nodes.items())


def bounded_loads(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each arc go: (arc, first rank, end rank, shard, first slot), all integers.

    An arc's own shard takes its keys first; keys beyond a full shard continue clockwise to the next virtual
    node whose shard has room. The list has at most one row for each arc and shard that took part of it.
    """
    room, filled, parts, over = list(capacity), [0] * len(capacity), [], []
    for arc, n in enumerate(counts):
        s = owners[arc]
        if taken := min(n, room[s]):
            parts.append((arc, 0, taken, s, filled[s]))
            room[s] -= taken
            filled[s] += taken
        if n > taken:
            over.append((arc, taken, n))
    for arc, first, end in over:
        at = arc
        while first < end:
            at = (at + 1) % len(owners)
            s = owners[at]
            if taken := min(end - first, room[s]):
                parts.append((arc, first, first + taken, s, filled[s]))
                room[s] -= taken
                filled[s] += taken
                first += taken
    return parts


def shard_by_ring(
    docs: DataFrame, shards: int = 40, replicas: int = 128, slack: float = 0.0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows of docs with size, text_crc32, shard and slot (gapless from 0 in each shard); law: equal row counts.

    A row's place on the ring is the hash of its key and text. A shard takes at most its capacity: the shards'
    equal shares of all rows, which differ by one at most, times 1 + slack. With slack 0 every shard is exactly full,
    so counts are at most one apart. Rows beyond it walk clockwise, so only overflowing rows move.

    Only two small tables meet the driver: one count for each virtual node (shards x replicas rows at most) and
    the parts that bounded_loads() returns. Both are broadcast; their size depends on the parameters alone.

    A null text counts as empty (size 16, CRC 0), a null key hashes as null, an empty table gives no rows. Equal rows
    get different slots. Only key and text are read; other columns, whatever their names, play no part.
    """
    spark = docs.sparkSession
    nodes = ring(shards, replicas)
    places, owners = [p for p, _ in nodes], [s for _, s in nodes]
    step = 1 << (32 - CELL_BITS)
    cells = []
    for c in range(1 << CELL_BITS):
        first, end = bisect_left(places, c * step), bisect_left(places, (c + 1) * step)
        cells.append((c, [(places[i], i) for i in range(first, end)] + [(1 << 32, end % len(nodes))]))
    cells = spark.createDataFrame(cells, "cell int, nodes array<struct<at: bigint, arc: int>>")
    payload = F.coalesce(F.col(text), F.lit("")).cast("binary")
    place = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 32)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(payload) + 16).cast("long").alias("size"),
        F.crc32(payload).alias("text_crc32"),
        place.alias("place"),
        F.xxhash64(F.col(text), F.col(key)).alias("tie"),
    )
    rows = (
        rows.withColumn("cell", F.shiftrightunsigned("place", 32 - CELL_BITS).cast("int"))
        .join(F.broadcast(cells), "cell")
        .withColumn("arc", F.filter("nodes", lambda n: n["at"] >= F.col("place"))[0]["arc"])
        .drop("cell", "nodes")
    )
    counts = [0] * len(nodes)
    for r in rows.groupBy("arc").count().collect():
        counts[r["arc"]] = r["count"]
    n = sum(counts)
    fair = [n // shards + (s < n % shards) for s in range(shards)]
    capacity = [x + int(x * slack) for x in fair]
    parts = spark.createDataFrame(
        [(a, [(f, e, s, k)]) for a, f, e, s, k in bounded_loads(counts, owners, capacity)],
        "arc int, parts array<struct<first: bigint, end: bigint, shard: int, slot: bigint>>",
    )
    parts = parts.groupBy("arc").agg(F.flatten(F.collect_list("parts")).alias("parts"))
    ranked = rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("arc").orderBy("place", "tie", F.col("doc_id").asc_nulls_last())) - 1
    )
    part = F.filter("parts", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["end"]))[0]
    return (
        ranked.join(F.broadcast(parts), "arc")
        .withColumn("part", part)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("part.shard").alias("shard"),
            (F.col("part.slot") + F.col("rank") - F.col("part.first")).alias("slot"),
        )
    )
