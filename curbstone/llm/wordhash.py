"""64-bit hashes of the words of many texts at once, by numpy over their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
#: Odd multipliers of the polynomial and of the finishing steps: any would do, but stored hashes depend on them.
BASE, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
EDGE = SPACE.copy()
EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_groups(column: pa.Array, size: int) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of runs of a column's texts of about size bytes, null as ''; a run is made when it is needed."""
    first, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        held += n
        if held >= size or k == len(column) - 1:
            yield first, [t or "" for t in column.slice(first, k + 1 - first).to_pylist()]
            first, held = k + 1, 0


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Of all words in order: hash, length in bytes, hashes of their beginnings; bounds: of each text's words, one more than texts."""

    hashes: np.ndarray
    lengths: np.ndarray
    prefixes: list[np.ndarray]
    bounds: np.ndarray


def _powers(n: int) -> np.ndarray:
    p = np.full(n, BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def word_hashes(texts: list[bytes], separator: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> Words:
    """Words, as runs of bytes that aren't separators, with A-Z taken as a-z.

    Equal words have equal hashes; others differ but for chance. A prefix hash is of a word's first n bytes, and 0
    for shorter words. Texts are read in slices of about SLICE bytes, cut between words, so memory is small beside the texts.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    starts, hashes, lengths = [], [], []
    begun: list[list[np.ndarray]] = [[] for _ in prefixes]
    power = _powers(64)
    at = 0
    while at < len(data):
        size = SLICE
        while True:
            part = data[at : at + size]
            sep = separator[part]
            if at + size >= len(data) or sep.any():
                break
            size *= 2
        if at + size < len(data):
            stop = int(np.flatnonzero(sep)[-1]) + 1
            part, sep = part[:stop], sep[:stop]
        word = ~sep
        first = np.flatnonzero(word & np.concatenate([[True], sep[:-1]]))
        if len(first):
            last = np.flatnonzero(word & np.concatenate([sep[1:], [True]])) + 1
            n = last - first
            if n.max() > len(power):
                power = _powers(int(n.max()) * 2)
            where = np.flatnonzero(word)
            value = LOWER[part[where]].astype(np.uint64) + np.uint64(1)
            ends = np.cumsum(n)
            value *= power[np.arange(len(where)) - np.repeat(ends - n, n)]
            hashes.append(mix(np.add.reduceat(value, ends - n)))
            for k, out in zip(prefixes, begun):
                got = np.zeros(len(first), np.uint64)
                long = n >= k
                got[long] = mix(sum(value[(ends - n)[long] + i] for i in range(k)) + np.uint64(k << 32))
                out.append(got)
            starts.append(first + at)
            lengths.append(n)
        at += len(part)
    none = np.zeros(0, np.int64)
    joined = lambda x, t: np.concatenate(x) if x else none.astype(t)
    bounds = np.searchsorted(joined(starts, np.int64), offsets)
    return Words(joined(hashes, np.uint64), joined(lengths, np.int64), [joined(b, np.uint64) for b in begun], bounds)
