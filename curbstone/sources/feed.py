"""Reading the paged feed: predicates, keyset pages, JSON features, transport errors, and a Python data source."""

from __future__ import annotations

import json
import random
import re
import sys
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from types import ModuleType
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader,
)

from curbstone.sources.contract import DATE, FIELDS, OID

# Rows of a page, keys of a list, attempts after the first, seconds of an attempt and of all attempts of a call.
PAGE, KEYS, RETRIES, ATTEMPT_S, TOTAL_S = 2000, 200, 5, 30.0, 300.0
#: The breaker opens when of FEWEST calls or more within WINDOW_S this share failed, for OPEN_S.
WINDOW_S, FEWEST, FAILING, OPEN_S = 60.0, 20, 0.5, 15.0


class Retryable(RuntimeError):
    """The service may answer the same request later."""


class Refused(RuntimeError):
    """The service won't answer this request."""


def sql_time(t: datetime) -> str:
    return f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}'"


def slice_where(since: datetime | None, until: datetime | None) -> str:
    """Rows updated from since up to, but not at, until; all without either."""
    parts = [f"DateUpdated {op} {sql_time(t)}" for op, t in ((">=", since), ("<", until)) if t]
    return " AND ".join(parts) or "1=1"


def newer_where(after: datetime) -> str:
    """Rows updated after a time, taken as the start of its second so that none is missed."""
    return f"DateUpdated > {sql_time(after.replace(microsecond=0))}"


def keys_where(keys: list[str], size: int = KEYS) -> list[str]:
    """IN-lists of at most size quoted keys."""
    quoted = ["'" + k.replace("'", "''") + "'" for k in keys]
    return [f"ReferenceNumber IN ({', '.join(quoted[k : k + size])})" for k in range(0, len(quoted), size)]


def checked(status: int, body: bytes) -> dict:
    """The body as JSON. An error in it, or a status of 429 or 5xx, is Retryable unless its code says that it can't help."""
    if status == 429 or status >= 500:
        raise Retryable(f"HTTP {status}")
    if status >= 400:
        raise Refused(f"HTTP {status}")
    head = re.match(rb'\s*\{\s*"error"\s*:', body)
    got = json.loads(body)
    if head:
        error = got["error"] if isinstance(got["error"], dict) else {}
        code, text = error.get("code"), error.get("message", "error")
        if code is None or code == 429 or code >= 500:
            raise Retryable(f"{code}: {text}")
        raise Refused(f"{code}: {text}")
    return got


class Breaker:
    """Stops calls to a service that mostly fails, so that a dead feed isn't asked by every task in full.

    Outcomes of the last WINDOW_S seconds count. While it is open, calls fail at once with Retryable; after OPEN_S one call is let
    through, and its outcome closes the breaker or opens it again. breaker_of() has one for each feed, which all calls in a Python
    process share: those of tasks that run in one worker one after the other, and of threads.
    """

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.seen, self.opened, self.trying, self.lock = clock, deque(), None, False, threading.Lock()

    def before(self) -> None:
        with self.lock:
            if self.opened is None:
                return
            if self.trying or self.clock() - self.opened < OPEN_S:
                raise Retryable("the feed failed too often and isn't asked for now")
            self.trying = True

    def after(self, ok: bool) -> None:
        with self.lock:
            now = self.clock()
            if self.trying:
                self.trying, self.opened = False, None if ok else now
                self.seen.clear()
                return
            self.seen.append((now, ok))
            while self.seen[0][0] < now - WINDOW_S:
                self.seen.popleft()
            if len(self.seen) >= FEWEST and sum(not ok for _, ok in self.seen) >= FAILING * len(self.seen):
                self.opened = now


def breaker_of(feed: object) -> Breaker:
    """This process's breaker of a feed. It is kept in a module of its own, as this one's code may come anew with each task."""
    held = sys.modules.setdefault("_curbstone_breakers", ModuleType("_curbstone_breakers")).__dict__
    return held.setdefault("of", {}).setdefault(feed, Breaker())


def limited(call: Callable[[], dict], seconds: float) -> dict:
    """call() in a thread of its own; Retryable if it takes longer, whose thread is left to end by itself."""
    got: list = []

    def run() -> None:
        try:
            got.append((call(), None))
        except BaseException as e:  # noqa: BLE001  (raised below, in the caller's thread)
            got.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        raise Retryable(f"no answer within {seconds:g} s")
    answer, error = got[0]
    if error is not None:
        raise error
    return answer


def with_retries(
    call: Callable[[], dict],
    retries: int = RETRIES,
    wait: float = 1.0,
    sleep: Callable[[float], None] = time.sleep,
    attempt: float = ATTEMPT_S,
    total: float = TOTAL_S,
    clock: Callable[[], float] = time.monotonic,
    breaker: Breaker | None = None,
) -> dict:
    """call(), again after Retryable with growing, jittered waits; the last error is raised.

    An attempt has attempt seconds, all of them with their waits total seconds: a wait that would end later isn't begun.
    """
    began = clock()
    for k in range(retries + 1):
        left = total - (clock() - began)
        try:
            if breaker:
                breaker.before()
            try:
                got = limited(call, min(attempt, left))
            except Exception as e:
                if breaker:
                    breaker.after(not isinstance(e, Retryable))
                raise
            if breaker:
                breaker.after(True)
            return got
        except Retryable as e:
            pause = wait * 2**k * (0.5 + random.random())
            if k == retries:
                raise
            if clock() - began + pause >= total:
                raise Retryable(f"given up after {clock() - began:.0f} s: {e}") from e
            sleep(pause)
    raise AssertionError


def patient(query: Callable[[str, int], dict | bytes], **how) -> Callable[[str, int], dict]:
    """query, repeated where the service may answer later; an answer in bytes is checked and read, and kept with its page."""

    def ask(where: str, size: int) -> dict:
        def once() -> dict:
            got = query(where, size)
            return checked(200, got) | {"_body": got} if isinstance(got, bytes) else got

        return with_retries(once, **({"breaker": breaker_of(name)} | how))

    name = getattr(query, "__module__", ""), getattr(query, "__qualname__", repr(query)), repr(getattr(query, "__self__", ""))
    return ask


def body_of(page: dict) -> bytes:
    """The exact bytes of a page's answer, or its JSON where it wasn't given in bytes."""
    return page["_body"] if "_body" in page else json.dumps(page).encode()


def pages(query: Callable[[str, int], dict], where: str, after: int = 0, size: int = PAGE, most: int | None = None) -> Iterator[tuple[int, dict]]:
    """(cursor, page) by keyset: rows of where with OBJECTID above the cursor, in order; query(where, size) gives a page.

    Ends with an empty page, or with a short one that doesn't say that more was cut off. most: pages at most.
    """
    n = 0
    while most is None or n < most:
        page = query(f"({where}) AND OBJECTID > {after}", size)
        rows = page.get("features") or []
        if not rows:
            return
        n += 1
        after = max(int(f["attributes"]["OBJECTID"]) for f in rows)
        yield after, page
        if len(rows) < size and not page.get("exceededTransferLimit"):
            return


def from_features(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Raw rows of features as JSON texts: strings as they are (other scalars as their text), numbers whole, finite points.

    Read with one schema of strings; a value of the wrong kind is null, a fractional number is cut, an OBJECTID that isn't there is 0.
    """
    names = "struct<" + ", ".join(f"`{n}`: string" for n, _, _ in FIELDS) + ">"
    schema = f"attributes {names}, geometry struct<x: string, y: string>"
    rows = df.withColumn("__f", F.from_json(F.col(feature), schema))
    raw = lambda name: F.get_json_object(F.col(feature), f"$.attributes.{name}")
    quoted = lambda name: F.col(feature).rlike(rf'"{name}"\s*:\s*"')

    def column(name: str, kind: str) -> Column:
        if kind in (OID, DATE):
            n = F.when(~quoted(name), raw(name).try_cast("decimal(30,6)"))
            whole = F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("long")
            return F.coalesce(whole, F.lit(0).cast("long")) if kind == OID else whole
        return F.col(f"__f.attributes.{name}")

    def point(axis: str) -> Column:
        v = F.col(f"__f.geometry.{axis}").try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    return rows.select(*(column(n, k).alias(c) for n, k, c in FIELDS), point("x").alias("x"), point("y").alias("y"))


COLUMNS = "object_id bigint, reference_number string, date_updated bigint, feature string"


class FeedSource(DataSource):
    """Features of a feed with what they can be asked for by: spark.read or readStream.format("keyset_feed").

    (object_id, reference_number, date_updated in milliseconds, feature as JSON). Options: feed, a "module:function" whose
    function(where, size) gives a page (with argument: whose function(argument) gives that function); where; after; last; pageSize;
    ranges, the number of parts that a batch read cuts (after, last] into, with last; pushdown, true where a batch
    read shall ask the feed for what filters on the first three columns leave, for which spark.sql.python.filterPushdown.enabled must be on. with_functions() gives functions instead of names.
    """

    functions: ClassVar[dict[str, Callable]] = {}

    @classmethod
    def name(cls) -> str:
        return "keyset_feed"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (_Pushing if pushes else _Batch)(dict(self.options), self.functions)

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options), self.functions)


def with_functions(source: type[DataSource], **functions: Callable) -> type[DataSource]:
    """The source with its functions themselves, sent to tasks with it, in place of the options that name them."""
    return type(source.__name__, (source,), {"functions": functions})


def _named(options: dict, functions: dict[str, Callable], option: str = "feed") -> Callable:
    """The function of an option, made with the argument option if there is one."""
    from importlib import import_module

    if option in functions:
        found = functions[option]
    else:
        module, _, function = options[option].partition(":")
        found = getattr(import_module(module), function)
    return found(options["argument"]) if "argument" in options else found


def _rows(page: dict) -> Iterator[tuple]:
    for f in page.get("features") or []:
        a = f["attributes"]
        key, updated = a.get("ReferenceNumber"), a.get("DateUpdated")
        yield int(a["OBJECTID"]), None if key is None else str(key), updated if isinstance(updated, int) else None, json.dumps(f)


class Pushed:
    """What a feed is asked for of a conjunction of Spark filters: a range of ids, predicates, and keys.

    take() gives back the filters that Spark still has to apply: those that the feed isn't asked for, and those that it can only be
    asked for roughly. Ids are exact. The feed knows times by the second, so a time within a second is widened to it.
    Keys are asked for, and compared again, as services differ in how they compare texts.
    """

    def __init__(self, after: int = 0, last: int | None = None):
        self.after, self.last, self.where, self.keys = after, last, [], None

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        by_column = {("object_id",): self._id, ("date_updated",): self._time, ("reference_number",): self._key}
        for f in filters:
            taken = by_column.get(getattr(f, "attribute", None))
            if not taken or not taken(f):
                yield f

    def _to(self, last: int) -> None:
        self.last = last if self.last is None else min(self.last, last)

    def _id(self, f: Filter) -> bool:
        v = getattr(f, "value", None)
        if isinstance(f, In) and f.value:
            self.after, _ = max(self.after, min(f.value) - 1), self._to(max(f.value))
            return False
        if not isinstance(v, int):
            return False
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.after = max(self.after, v if isinstance(f, GreaterThan) else v - 1)
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self._to(v - 1 if isinstance(f, LessThan) else v)
        return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))

    def _time(self, f: Filter) -> bool:
        v = getattr(f, "value", None)
        if not isinstance(v, int) or not 0 <= v < 253_402_300_000_000:
            return False
        second, whole = v // 1000, v % 1000 == 0
        at = lambda s: sql_time(datetime.fromtimestamp(s, timezone.utc))
        if isinstance(f, EqualTo):
            self.where += [f"DateUpdated >= {at(second)}", f"DateUpdated < {at(second + 1)}"]
            return False
        if isinstance(f, GreaterThan):
            self.where.append(f"DateUpdated {'>' if whole else '>='} {at(second)}")
        elif isinstance(f, GreaterThanOrEqual):
            self.where.append(f"DateUpdated >= {at(second)}")
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.where.append(f"DateUpdated < {at(second if whole and isinstance(f, LessThan) else second + 1)}")
        else:
            return False
        return whole and not isinstance(f, LessThanOrEqual)

    def _key(self, f: Filter) -> bool:
        keys = [f.value] if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
        if keys is not None:
            keys = sorted({k for k in keys if k is not None})
            self.keys = keys if self.keys is None else sorted(set(self.keys) & set(keys))
        return False

    def asks(self, ranges: int, where: str) -> list[tuple[int, int | None, str]]:
        """(after, last, predicate) of each part: the ids in ranges if their end is known, the keys in lists."""
        after, last = self.after, self.last
        cuts = [after, last] if last is None or ranges <= 1 else [after + (last - after) * k // ranges for k in range(ranges + 1)]
        parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if b is None or a < b]
        lists = [None] if self.keys is None else keys_where(self.keys)
        plain = [where] if where != "1=1" or not self.where and self.keys is None else []
        return [(a, b, " AND ".join([*plain, *self.where, *([k] if k else [])])) for a, b in parts for k in lists]


class _Batch(DataSourceReader):
    def __init__(self, options: dict, functions: dict):
        self.options, self.functions = options, functions
        self.pushed = Pushed(int(options.get("after", 0)), int(options["last"]) if "last" in options else None)

    def partitions(self) -> list[InputPartition]:
        asks = self.pushed.asks(max(1, int(self.options.get("ranges", 1))), self.options.get("where", "1=1"))
        return [InputPartition(a) for a in asks] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:  # the filters leave nothing
            return
        after, last, where = partition.value
        where += f" AND OBJECTID <= {last}" if last is not None else ""
        for _, page in pages(patient(_named(self.options, self.functions)), where, after, int(self.options.get("pageSize", PAGE))):
            yield from _rows(page)


class _Pushing(_Batch):
    """Spark refuses a reader with pushFilters where its setting is off, so there is one without it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from self.pushed.take(filters)


class _Stream(SimpleDataSourceStreamReader):
    """Each trigger takes one page after the last OBJECTID; the offset is that number."""

    def __init__(self, options: dict, functions: dict):
        self.options, self.functions = options, functions

    def initialOffset(self) -> dict:
        return {"objectid": int(self.options.get("after", 0))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = list(pages(patient(_named(self.options, self.functions)), self.options.get("where", "1=1"), start["objectid"], int(self.options.get("pageSize", PAGE)), 1))
        return iter([r for _, p in found for r in _rows(p)]), {"objectid": found[-1][0] if found else start["objectid"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        where = f"({self.options.get('where', '1=1')}) AND OBJECTID <= {end['objectid']}"
        return iter([r for _, p in pages(patient(_named(self.options, self.functions)), where, start["objectid"], int(self.options.get("pageSize", PAGE))) for r in _rows(p)])


#: What a feed may work out over the rows of a predicate.
STATISTICS = ("count", "min", "max", "distinct")


class StatisticsSource(DataSource):
    """Figures that the feed works out itself: spark.read.format("feed_statistics"), a small row for each range of ids (and group).

    Options: statistics, a "module:function" whose function(where, asked, group) gives rows for asked, a list of (statistic, field), as dicts
    named by measure() and by the group's field; measures, as "count OBJECTID, max DateUpdated"; group, a field; where; after; last; ranges;
    argument. functions as with FeedSource. Columns: value, the group's as text, if there is a group, and each measure as a bigint. served_statistics() merges ranges.
    """

    functions: ClassVar[dict[str, Callable]] = {}

    @classmethod
    def name(cls) -> str:
        return "feed_statistics"

    def schema(self) -> str:
        columns = [f"{measure(*m)} bigint" for m in measures(self.options["measures"])]
        return ", ".join((["value string"] if "group" in self.options else []) + columns)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Statistics(dict(self.options), self.functions)


def measures(text: str) -> list[tuple[str, str]]:
    found = [tuple(m.split()) for m in text.split(",")]
    if any(len(m) != 2 or m[0] not in STATISTICS for m in found):
        raise ValueError(f"measures are one of {', '.join(STATISTICS)} and a field: {text}")
    return found


def measure(statistic: str, field: str) -> str:
    return f"{statistic}_{field}".lower()


class _Statistics(DataSourceReader):
    def __init__(self, options: dict, functions: dict):
        self.options, self.functions = options, functions

    def partitions(self) -> list[InputPartition]:
        o = self.options
        pushed = Pushed(int(o["after"]) if "after" in o else 0, int(o["last"]) if "last" in o else None)
        return [InputPartition(a) for a in pushed.asks(max(1, int(o.get("ranges", 1))), o.get("where", "1=1"))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        after, last, where = partition.value
        if "after" in self.options or last is not None:
            where += f" AND OBJECTID > {after}" + (f" AND OBJECTID <= {last}" if last is not None else "")
        asked, group, ask = measures(self.options["measures"]), self.options.get("group"), _named(self.options, self.functions, "statistics")
        for row in with_retries(lambda: {"rows": ask(where, asked, group)})["rows"]:
            head = [None if row[group] is None else str(row[group])] if group else []
            yield (*head, *(row[measure(*m)] for m in asked))


def page_baseline(markdown: Column) -> Column:
    """The number in a Markdown table's "Row count" line, thousands separated by commas; null unless above 0."""
    n = F.replace(F.regexp_extract(markdown, r"(?m)^\|\s*Row count\s*\|\s*\**([0-9][0-9,]*)", 1), F.lit(",")).try_cast("long")
    return F.when(n > 0, n)
