"""Packing token sequences by an order-preserving dynamic program over document and sentence boundaries."""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

WINDOW = 1024
#: In tokens: what a cut within a document costs at a sentence's end and elsewhere, and what a sequence costs by itself.
SENTENCE_CUT, HARD_CUT, SEQUENCE = 8, 48, 4
#: Where no boundary comes for so many tokens, cuts are allowed at every GRID-th token.
GAP, GRID = 128, 32
#: Tokens planned at once; of these the last TAIL stay open and are planned again with what follows.
PLAN, TAIL = 1 << 18, 4 * WINDOW
END_ID = 0
#: Runs of so much white space are cut out of a text before its pattern is run, as the pattern goes back over them step by step.
LONG_BLANK = 1000
#: White space as the pattern's \s has it: a fixed value of Unicode.
BLANKS = "\x09-\x0d \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """The ids that the library tokenizers gives for a byte-level BPE file, by tiktoken's faster code.

    Ranks are the file's own ids, which for this vocabulary are in the order of its merges; tests hold the ids against
    tokenizers. Special tokens' strings in a text are ordinary text. Words split by the usual byte-level pattern, by
    which a run of white space is one piece, less its last character where something follows that isn't white space.
    Long runs are taken apart by that rule and not by the pattern, whose stack they would overflow.
    """

    #: The pattern of the byte-level pre-tokenizer: a fixed value of the file format.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"] if t["special"]}
        to_byte = self._bytes()
        ranks = {bytes(to_byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self._encoding = tiktoken.Encoding("byte-level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._long_blank = re.compile(f"[{BLANKS}]{{{LONG_BLANK},}}")
        #: For each id, whether a sentence may end with it.
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        for word, i in ranks.items():
            self.ends[i] = word.rstrip()[-1:] in (b".", b"!", b"?") or b"\n" in word

    @staticmethod
    def _bytes() -> dict[str, int]:
        """Byte-level BPE files write byte b as the character b if that is visible, else as the next one from 256 on."""
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(seen)]
        return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(other)}

    def ids(self, text: str) -> np.ndarray:
        encode = lambda t: self._encoding.encode_to_numpy(t, disallowed_special=())
        parts, at = [], 0
        for m in self._long_blank.finditer(text):
            stop = m.end() - (m.end() < len(text))
            parts += [encode(text[at : m.start()]), np.array(self._encoding._encode_single_piece(text[m.start() : stop]), np.uint32)]
            at = stop
        return np.concatenate([*parts, encode(text[at:])]) if parts else encode(text)


def plan(nodes: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indices into nodes (cut positions, ascending, with gaps of at most window), first and last included, of least total cost.

    A sequence from node i to node j costs SEQUENCE + costs[j] + its padding: window - length, or 0 at a power of two.
    As padding is linear in the start, the best start for j is the least best[i] + nodes[i] in the window, the front of
    a monotone queue; starts at exactly a power of two before j are tried besides.
    """
    n = len(nodes)
    exact: list[list[int]] = [[] for _ in range(n)]
    k = 1
    while k < window:
        at = np.searchsorted(nodes, nodes - k)
        for j in np.flatnonzero((nodes[at] == nodes - k) & (nodes >= k)).tolist():
            exact[j].append(int(at[j]))
        k *= 2
    pos, cost = nodes.tolist(), costs.tolist()
    best, via = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(float(pos[0]), 0)])
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0][1]] < p - window:
            queue.popleft()
        low, i = queue[0]
        low += window - p
        for e in exact[j]:
            if best[e] < low:
                low, i = best[e], e
        low += cost[j] + SEQUENCE
        best[j], via[j] = low, i
        key = low + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(via[cuts[-1]])
    return np.array(cuts[::-1])


def cut_nodes(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where ids may be cut, and what each cut costs: document ends, sentence ends, and a grid over long gaps.

    With last, every token near the end may be a cut, so that the rest can be split at powers of two.
    """
    total = len(ids)
    cost = np.full(total + 1, np.inf)
    cost[np.flatnonzero(ends[ids]) + 1] = SENTENCE_CUT
    cost[doc_ends] = 0
    cost[0] = cost[total] = 0
    have = np.flatnonzero(np.isfinite(cost))
    for k in np.flatnonzero(np.diff(have) > GAP).tolist():
        grid = np.arange(have[k] + GRID, have[k + 1], GRID)
        cost[grid] = HARD_CUT
    if last:
        tail = cost[max(0, total - WINDOW) :]
        tail[np.isinf(tail)] = HARD_CUT
    nodes = np.flatnonzero(np.isfinite(cost))
    return nodes, cost[nodes]


class _Stream:
    """Documents in order, planned and given out as pieces; holds about PLAN tokens at a time."""

    def __init__(self, encoder: Encoder, first_id: int, with_ids: bool):
        self.encoder, self.next_id, self.with_ids = encoder, first_id, with_ids
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # (doc_id, tokens of the document, tokens of it given out before)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        ids = np.append(ids, np.uint32(END_ID))
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids), 0))
        self.held += len(ids)

    def pieces(self, last: bool) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in PIECES}
        if not self.held:
            return out
        ids = np.concatenate(self.ids)
        lengths = np.array([n - done for _, n, done in self.docs])
        doc_ends = np.cumsum(lengths)
        nodes, costs = cut_nodes(ids, doc_ends, self.encoder.ends, last)
        cuts = nodes[plan(nodes, costs)]
        if not last:
            cuts = cuts[cuts <= len(ids) - TAIL]
        done = int(cuts[-1])
        starts = np.unique(np.concatenate([cuts[:-1], (doc_ends - lengths)[(doc_ends - lengths) < done]]))
        stops = np.append(starts[1:], done)
        of = np.searchsorted(doc_ends, starts, side="right")
        seq = np.searchsorted(cuts, starts, side="right") - 1
        raw = ids.astype("<u4")
        for a, b, d, s in zip(starts.tolist(), stops.tolist(), of.tolist(), seq.tolist()):
            doc_id, total, before = self.docs[d]
            row = (doc_id, a - int(doc_ends[d] - lengths[d]) + before, b - a, zlib.crc32(raw[a:b]), total, self.next_id + s, a - int(cuts[s]))
            for name, value in zip(PIECES, row):
                out[name].append(value)
            if self.with_ids:
                out.setdefault("ids", []).append(raw[a:b].astype(np.int32))
        self.next_id += len(cuts) - 1
        open_docs = [(i, t, b) for i, t, b in self.docs]
        first = int(np.searchsorted(doc_ends, done, side="right"))
        self.docs = open_docs[first:]
        if self.docs:
            doc_id, total, _ = self.docs[0]
            self.docs[0] = (doc_id, total, total - (int(doc_ends[first]) - done))
        self.ids = [ids[done:]]
        self.held = len(ids) - done
        return out


def _by_place(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows, made of docs' rows one by one, in the order in which docs' files hold them; as they are if docs isn't read from files."""
    if not docs.inputFiles():
        return rows
    name = F.col("_metadata.file_name")
    number = F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.lit(-1).cast("long"))
    place = {"part": number, "file": name, "row": F.col("_metadata.row_index")}
    try:
        placed = rows.select("*", *(c.alias(n) for n, c in place.items()))
    except AnalysisException:  # rows of files that were joined or grouped have no place of their own
        return rows
    return placed.repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "text")


PIECES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, with_ids: bool = False, as_it_lies: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most WINDOW tokens: PIECES, and ids (array<int>) if asked for.

    A document is its ids and then END_ID. Documents are ordered by key across partitions (range partitioning; null
    keys last, equal keys by the text's hash) and stay in that order within sequences. With as_it_lies they are taken in the order in
    which docs' files hold them, by the number in a file's name and the row's place in it, whichever way Spark deals files to tasks: for a
    table whose files hold an order, as a mix does. docs that isn't read from files is taken in the order of its partitions. Each task reads
    its documents as a stream and holds about PLAN tokens (more for a single document that has more) and one batch of texts; a
    retried task makes the same pieces, as its rows come sorted. sequence_id is the partition's number x 2**40 plus a count, so it
    grows in the order of the documents. Sequences don't cross partitions: what is left at a partition's end is split at powers of two
    where that saves padding.

    A null text is empty: one piece with END_ID alone. Any text has ids, a run of millions of blanks or of one letter too. Equal rows are packed separately. An empty table gives no rows.
    Only key and text are read, so other columns and their names don't matter. vocabulary is a byte-level BPE file
    that every executor can open.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if as_it_lies:
        rows = _by_place(docs, rows)
    else:
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
    schema = pa.schema(list(zip([*PIECES, *["ids"] * with_ids], types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        stream = _Stream(encoder, TaskContext.get().partitionId() << 40, with_ids)
        give = lambda x: pa.RecordBatch.from_arrays([pa.array(x.get(f.name, []), f.type) for f in schema], schema=schema)
        for batch in batches:
            for doc_id, words in zip(batch.column(0), batch.column(1)):
                stream.add(doc_id.as_py(), encoder.ids(words.as_py()))
                if stream.held >= PLAN:
                    yield give(stream.pieces(False))
        yield give(stream.pieces(True))

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in PIECES) + ", ids array<int>" * with_ids)
