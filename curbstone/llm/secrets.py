"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds, in their order; "assign" ignores case in its key word only.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", r"api_?key")
ASSIGN_REST = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGN = 6
KINDS = ("assign", "access", "hex", "markov")

#: A candidate of the models: a run of these characters, of at least LEAST of them.
CANDIDATE, LEAST = r"[A-Za-z0-9+/_=-]{%d,}", 16
#: A candidate is a secret if its log-likelihood ratio, in nats, is at least TOTAL and at least MEAN a character.
TOTAL, MEAN = 12.0, 0.5
#: Random strings drawn for training.
SAMPLE_RANDOM, SEED = 4000, 7
#: Added to every count of a pair of characters, as a share of that model's counts, and at least LEAST_PRIOR.
PRIOR, LEAST_PRIOR = 1e-5, 0.5
#: One in so many pairs of neighbouring words is also counted as an identifier made of them.
JOINED = 16
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Samples labelled as ordinary by hand, for what a small corpus may lack; a large one outweighs them.
ORDINARY = """
get_element_by_id DocumentBuilderFactory configuration_manager internationalization AbstractRequestHandler user_account_settings
utf-8 x86_64 2024-01-31 2023-12-25T10-30-00 HTTP/1 README_FIRST index/page/1 path/to/some/file static/images/logo-small application/json
MAX_CONNECTION_COUNT DEFAULT_TIMEOUT_SECONDS isEnabledForUser onClickListener updateCustomerAddress find-first-match left-hand-side
1000000 12345678 00000000 20240131 1234567890123456 4111111111111111 5555555555555555 version-2 release-10 chapter3 section12 item_0042
---------------- ================ ________________ //////////////// ++++++++++++++++ XXXXXXXXXXXXXXXX aaaaaaaaaaaaaaaa 0123456789
telecommunications responsibilities characteristically Donaudampfschifffahrt anticonstitutionnellement electroencefalografista
""".split()
#: Alphabets that random samples are drawn from.
ALPHABETS = (CHARS[:62], CHARS[:64], CHARS[:62] + "_-", CHARS[26:62], CHARS[:26] + CHARS[52:62], "0123456789abcdef")

_DIGITS = np.array([CHARS.index(c) for c in "0123456789"])


def _both_cases(pattern: str) -> str:
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


_ASSIGN = re.compile("(" + "|".join(map(_both_cases, ASSIGN_WORDS)) + ")" + ASSIGN_REST)
_ACCESS, _HEX, _CANDIDATE = re.compile(ACCESS), re.compile(HEX), re.compile(CANDIDATE % LEAST)
_RUN = re.compile(CANDIDATE % 4)
_HINTS = ("passw", "secret", "token", "api")
#: For each byte its place in CHARS, or len(CHARS).
_PLACE = np.array([CHARS.find(chr(b)) % (len(CHARS) + 1) for b in range(256)], np.int64)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the fixed patterns' matches, each kind's from left to right without overlap.

    ACCESS and HEX have their least length in the pattern: as runs are as long as they can be, that finds what matching any run
    and dropping short ones finds. For "assign" a dropped match still takes up its characters.
    """
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


def random_samples(n: int = SAMPLE_RANDOM, seed: int = SEED) -> list[str]:
    """Random strings of 16 to 64 characters from each alphabet in turn; the same for the same seed."""
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABETS[k % len(ALPHABETS)], k=rng.randint(16, 64))) for k in range(n)]


def identifiers(first: str, second: str, k: int) -> str:
    """An ordinary identifier made of two words, in the k-th of the usual spellings."""
    first, second = first.lower(), second.lower()
    return (
        f"{first}_{second}", first + second.capitalize(), f"{first}-{second}", f"{first}_{second}".upper(), first.capitalize() + second.capitalize(), f"{first}/{second}", f"{first}={second}",
    )[k % 7]


def labelled(text: str) -> tuple[list[str], list[str]]:
    """(ordinary strings, random strings) of a text, labelled by rule.

    What the fixed patterns find is random. Ordinary are runs of 4 to LEAST - 1 characters and plain numbers of any length that overlap
    nothing found, as what may be a secret by its length isn't among them; and identifiers made of neighbouring ones of letters. Each
    counts once in a text, so that one that repeats itself has no more say than others.
    """
    base = base_spans(text)
    secret = [m for s, _, e in base for m in _RUN.findall(text[s:e]) if len(m) >= LEAST]
    ordinary, at = [], 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][2] <= a:
            at += 1
        if (b - a < LEAST or m[0].isdigit()) and not (at < len(base) and base[at][0] < b):
            ordinary.append(m[0])
    made = [identifiers(x, y, k) for k, (x, y) in enumerate(zip(ordinary[::JOINED], ordinary[1::JOINED])) if x.isalpha() and y.isalpha()]
    return list({*ordinary, *made}), list(set(secret))


def _pairs(strings: list[str]) -> np.ndarray:
    """Counts of pairs of characters next to one another in strings of CHARS, as a matrix."""
    n = len(CHARS)
    if not strings:
        return np.zeros((n, n), np.int64)
    # A character outside CHARS between two strings has the place n, which is cut off.
    codes = _PLACE[np.frombuffer("\n".join(strings).encode("ascii"), np.uint8)]
    return np.bincount(codes[:-1] * (n + 1) + codes[1:], minlength=(n + 1) ** 2).reshape(n + 1, n + 1)[:n, :n]


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(is_random, first, second, n): pairs of characters, by their places in CHARS, in the labelled strings of all documents.

    Texts are counted in their tasks, whole; at most 2 x len(CHARS)**2 rows come out. A null text has none.
    """
    schema = pa.schema([("is_random", pa.bool_()), ("first", pa.int32()), ("second", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(CHARS), len(CHARS)), np.int64)
        for batch in batches:
            for t in batch.column(0):
                for k, strings in enumerate(labelled(t.as_py())):
                    total[k] += _pairs(strings)
        kind, first, second = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind == 1), pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(total[kind, first, second])], schema=schema)

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "is_random boolean, first int, second int, n long")
    return rows.groupBy("is_random", "first", "second").agg(F.sum("n").alias("n"))


def train(counts: DataFrame) -> np.ndarray:
    """log P(b | a, random) - log P(b | a, ordinary) for characters a, b of CHARS, from pair_counts() and random_samples().

    ORDINARY, characters repeated many times and plain numbers, any digit after any other, are ordinary too, whether a corpus has few or many.
    """
    held = np.zeros((2, len(CHARS), len(CHARS)))
    for r in counts.collect():
        held[int(r["is_random"]), r["first"], r["second"]] += r["n"]
    held[1] += _pairs(random_samples())
    weight = max(1.0, 1e-4 * held[0].sum())
    held[0] += _pairs(ORDINARY) + _pairs([c * LEAST for c in CHARS]) * weight
    held[0][np.ix_(_DIGITS, _DIGITS)] += (LEAST - 1) * weight
    held += np.maximum(LEAST_PRIOR, PRIOR * held.sum((1, 2)))[:, None, None]
    # Rows of rare characters lean on what follows in all, so that an unseen character isn't evidence by itself.
    held += 20 * held.sum(1, keepdims=True) / held.sum((1, 2), keepdims=True)
    p = np.log(held / held.sum(2, keepdims=True))
    return p[1] - p[0]


def markov_spans(text: str, ratio: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that the models call random and that overlap no base span."""
    places = [m.span() for m in _CANDIDATE.finditer(text)]
    if not places:
        return []
    codes = _PLACE[np.frombuffer("".join(text[a:b] for a, b in places).encode("ascii"), np.uint8)]
    ends = np.cumsum([b - a for a, b in places])
    steps = np.append(ratio[codes[:-1], codes[1:]], 0.0)
    steps[ends - 1] = 0.0  # from one candidate to the next
    score = np.add.reduceat(steps, np.concatenate([[0], ends[:-1]]))
    found = []
    for (a, b), x in zip(places, score.tolist()):
        if x >= TOTAL and x >= MEAN * (b - a) and not any(s < b and a < e for s, _, e in base):
            found.append((a, 3, b))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, comma-joined; base_sha256 is of
    the base kinds' alone. Whole texts are read; a task holds one batch of them. A null text is empty: no spans, and the
    hash of the empty string. Equal rows give equal rows; an empty table gives none; other columns aren't read.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]
    schema = pa.schema(list(zip(names, [pa.int64()] * 5 + [pa.string()] * 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                base = base_spans(t)
                more = markov_spans(t, ratio, base)
                count = [sum(k == n for _, k, _ in base) for n in range(3)]
                rows.append((doc_id, *count, len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} {'long' if k < 5 else 'string'}" for k, n in enumerate(names)))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """scan() with models trained on the labelled strings of all the same documents."""
    return scan(docs, train(pair_counts(docs, text)), key, text)
