"""Tables as Parquet versions under one commit file: a commit shows all of its tables or none of them."""

from __future__ import annotations

import json
import math
import re
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds between a lock's signs of life, and after which a lock without one is taken over.
BEAT, STALE = 20.0, 600.0
#: For how long commits and their tables stay after newer ones; parts of an appended table that are merged when there are more.
RETAIN, MOST_PARTS = timedelta(days=1), 64
#: An upserted table is rewritten when its changed rows are more than this share of the others.
CHANGED = 0.5
#: Rows of a bucket of a keyed table, about; touched buckets up to which only they are read.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 10_000


class Busy(RuntimeError):
    """Another run holds the lock."""


class Lost(RuntimeError):
    """The lock was taken over, or another writer made this commit first: nothing of it is shown."""


class _Files:
    """Small files by the file system that Spark itself uses for a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = self.path(path)
        self.fs = root.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(root).toUri(), conf)
        self.no_options = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> dict[str, float]:
        """What is in a folder, with the time of its last change in seconds; empty if it isn't there."""
        if not self.fs.exists(self.path(folder)):
            return {}
        found = {f.getPath().getName(): f.getModificationTime() / 1000 for f in self.fs.listStatus(self.path(folder))}
        return {n: t for n, t in found.items() if not n.startswith(".")}

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file wasn't there; then it is, all of it at once, by a rename that replaces nothing."""
        folder, _, last = name.rpartition("/")
        part = f"{folder}/.{last}.{uuid.uuid4().hex}"
        self.put(part, text)
        try:
            self.context.rename(self.path(part), self.path(name), self.no_options)
        except Py4JJavaError as e:
            self.delete(part)
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    """A folder of versioned tables, a commit log, numbered locks and a run log, on any file system that Spark writes to.

    Each commit writes new parts of some tables, then creates one file with the parts of all tables and small values such
    as checkpoints. Readers take the newest commit once, so they never see parts of two. A crash leaves folders that no
    commit names. A commit's file is created only if its number is free, and carries the number of the writer's lock: who takes a lock
    over first makes a commit, so a writer that lost its lock finds either that lock in the newest commit or its own number taken, and
    gets Lost.

    A table is replaced whole, appended to, or upserted: changed rows are written beside it and hide rows with their key,
    until they are so many that the table is rewritten. So a small change of a large table is a small write. Parts of keyed tables lie
    in buckets by a hash of the key, of about BUCKET_ROWS rows however large the table is, so that a small batch reads little too: read(near=).
    """

    def __init__(self, spark: SparkSession, path: str, keyed: dict[str, str] | None = None):
        self.spark, self.path, self.keyed = spark, path.rstrip("/"), keyed or {}
        self.files, self.held = _Files(spark, self.path), None

    def _commits(self) -> dict[int, float]:
        return {int(n[:-5]): t for n, t in sorted(self.files.names(f"{self.path}/_commits").items()) if n.endswith(".json")}

    def _commit(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/_commits/{number:012d}.json"))

    def head(self) -> dict:
        """The newest commit: number, tables, values."""
        numbers = self._commits()
        return self._commit(max(numbers)) if numbers else {"number": 0, "tables": {}, "values": {}}

    # Parts: vN-ID, or vN-ID-bB with B buckets.
    def _write(self, name: str, df: DataFrame, number: int, buckets: int | None = None) -> str:
        part, key = f"v{number}-{uuid.uuid4().hex[:8]}", self.keyed.get(name)
        if key is None:
            df.write.parquet(f"{self.path}/{name}/{part}")
            return part
        n = buckets or max(1, math.ceil(df.count() / BUCKET_ROWS))
        part += f"-b{n}"
        df.withColumn("__bucket", _bucket(F.col(key), n)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}/{part}")
        return part

    def _parts(self, name: str, parts: list[str], near: DataFrame | None = None) -> DataFrame:
        """The rows of some parts; with near, of keyed parts those in the buckets of its keys."""
        plain = [p for p in parts if not _buckets(p)]
        frames = [self.spark.read.parquet(*[f"{self.path}/{name}/{p}" for p in plain])] if plain else []
        touched: dict[int, list[int]] = {}
        for p in (p for p in parts if _buckets(p)):  # each is a table of its own, whose folders are buckets
            df, n = self.spark.read.parquet(f"{self.path}/{name}/{p}"), _buckets(p)
            if n > 1 and near is not None:
                if n not in touched:
                    touched[n] = [r[0] for r in near.select(_bucket(F.col(self.keyed[name]), n)).distinct().limit(MOST_BUCKETS + 1).collect()]
                df = df.filter(F.col("__bucket").isin(touched[n])) if len(touched[n]) <= MOST_BUCKETS else df
            frames.append(df.drop("__bucket"))
        return reduce(DataFrame.unionByName, frames)

    def read(self, table: str, schema=None, at: dict | None = None, near: DataFrame | None = None) -> DataFrame | None:
        """A table as of a commit, the newest one by default; if it isn't there, empty with the schema, or None.

        With near, which has the table's key, only the buckets of its keys: all rows with such a key, and some others.
        """
        head = at or self.head()
        version = head["tables"].get(table)
        if version is None:
            return None if schema is None else self.spark.createDataFrame([], schema)
        base, changed = self._parts(table, version, near), head.get("changed", {}).get(table)
        if not changed:
            return base
        key = changed["key"]
        newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__commit")))
        rows = self._parts(table, changed["parts"], near).withColumn("__rn", newest).filter("__rn = 1").drop("__rn", "__commit")
        return base.join(rows.select(key), key, "left_anti").unionByName(rows)

    def version(self, table: str, number: int, at: dict | None = None) -> dict:
        """What changes() needs to tell what came after commit number; rows that this commit upserts may follow."""
        return {"number": number, "of": (at or self.head())["tables"].get(table)}

    def later(self, table: str, version: dict, at: dict | None = None) -> list[str] | None:
        """The parts with rows upserted since a version; None where the table was rewritten since."""
        head = at or self.head()
        if version["of"] is None or head["tables"].get(table) != version["of"]:
            return None
        return [p for p in head.get("changed", {}).get(table, {"parts": []})["parts"] if _number(p) > version["number"]]

    def changes(self, table: str, version: dict, at: dict | None = None) -> tuple[DataFrame, DataFrame] | None:
        """(rows as they were at a version, rows as they are) of the keys that were upserted since; None where it was rewritten since.

        Reads the parts written since, and the buckets of their keys.
        """
        head = at or self.head()
        changed, later = head.get("changed", {}).get(table), self.later(table, version, head)
        if later is None:
            return None
        base = self._parts(table, version["of"])
        if not later:
            return base.limit(0), base.limit(0)
        newest = F.row_number().over(Window.partitionBy(changed["key"]).orderBy(F.desc("__commit")))
        rows = self._parts(table, later).withColumn("__rn", newest).filter("__rn = 1").drop("__rn", "__commit")
        keys = rows.select(changed["key"])
        earlier = [p for p in changed["parts"] if _number(p) <= version["number"]]
        before = {"tables": {table: version["of"]}, "changed": {table: changed | {"parts": earlier}} if earlier else {}}
        return self.read(table, at=before, near=keys).join(keys, changed["key"], "left_semi"), rows

    def value(self, name: str, default=None):
        return self.head()["values"].get(name, default)

    def commit(
        self,
        replace: dict[str, DataFrame] | None = None,
        append: dict[str, DataFrame] | None = None,
        values: dict | Callable[[int], dict] | None = None,
        upsert: dict[str, tuple[DataFrame, str]] | None = None,
    ) -> dict:
        """Writes tables, whole, as further parts or as changed rows (with their key), and shows them together with values (None removes one).

        values may be a function of the commit's number.
        """
        head = self.head()
        number = head["number"] + 1
        values = values(number) if callable(values) else values
        tables, changed = dict(head["tables"]), {k: dict(v) for k, v in head.get("changed", {}).items()}
        for name, (df, key) in (upsert or {}).items():
            held = changed.setdefault(name, {"key": key, "parts": [], "rows": 0, "of": self._parts(name, tables[name]).count()})
            # As many buckets as the table has, so that changed rows of other buckets needn't be read either.
            part = self._write(name, df.withColumn("__commit", F.lit(number)), number, max(map(_buckets, tables[name])) or None)
            changed[name] = held | {"parts": [*held["parts"], part], "rows": held["rows"] + self.spark.read.parquet(f"{self.path}/{name}/{part}").count()}
        for name, df in (replace or {}).items():
            tables[name] = [self._write(name, df, number)]
            changed.pop(name, None)
        for name, df in (append or {}).items():
            tables[name] = [*tables.get(name, []), self._write(name, df, number)]
        return self._show(head, tables=tables, changed=changed, values={k: v for k, v in (head["values"] | (values or {})).items() if v is not None})

    def _show(self, head: dict, **new) -> dict:
        """The commit after head, if head is the newest and this writer's lock hasn't been taken over."""
        lock = head.get("lock", 0)
        if self.held is not None and lock > self.held:
            raise Lost(f"lock {self.held} was taken over by lock {lock}")
        commit = {"number": head["number"] + 1, "lock": lock if self.held is None else self.held, "tables": head["tables"], "changed": head.get("changed", {}), "values": head["values"]} | new
        if not self.files.create(f"{self.path}/_commits/{commit['number']:012d}.json", json.dumps(commit)):
            raise Lost(f"commit {commit['number']} was made by another writer")
        return commit

    def compact(self, table: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict | None:
        """Rewrites an appended table as one part, without rows that keep() leaves out."""
        df = self.read(table)
        return None if df is None else self.commit(replace={table: keep(df)})

    def tidy(self, retain: timedelta = RETAIN) -> None:
        """Merges many small parts, rewrites tables with many changed rows, and deletes commits older than retain with what only they show.

        Merged and rewritten parts are written first and shown by one commit. Only the holder of the lock may call it. A reader has
        retain to finish with the commit that it took.
        """
        head = self.head()
        tables, changed, number = dict(head["tables"]), dict(head.get("changed", {})), head["number"] + 1
        for name, c in head.get("changed", {}).items():
            if c["rows"] > CHANGED * c["of"]:
                tables[name] = [self._write(name, self.read(name, at=head), number)]
                del changed[name]
        for name, parts in head["tables"].items():
            if len(parts) > MOST_PARTS and name not in head.get("changed", {}):
                late = parts[-(MOST_PARTS // 2) :]
                tables[name] = [*parts[: -len(late)], self._write(name, self._parts(name, late), number)]
        if tables != head["tables"]:
            self._show(head, tables=tables, changed=changed)
        commits, now = self._commits(), time.time()
        numbers = sorted(commits)
        old = [n for n in numbers[:-1] if now - commits[n] >= retain.total_seconds()]
        if not old:
            return
        shown: dict[str, set[str]] = {}
        for n in numbers:
            if n not in old:
                commit = self._commit(n)
                for name, parts in commit["tables"].items():
                    shown.setdefault(name, set()).update(parts, commit.get("changed", {}).get(name, {}).get("parts", []))
        for n in old:
            self.files.delete(f"{self.path}/_commits/{n:012d}.json")
        for name in self.files.names(self.path):
            for part in self.files.names(f"{self.path}/{name}") if not name.startswith("_") else ():
                if part not in shown.get(name, set()) and _number(part) <= numbers[-1]:
                    self.files.delete(f"{self.path}/{name}/{part}")

    @contextmanager
    def lock(self, owner: str = ""):
        """One writer at a time, without waiting: Busy if another holds it.

        Locks are numbered; the newest counts until it is given back. The holder gives a sign of life every BEAT seconds; a lock without one
        for STALE seconds is that of a writer that was killed or is stuck, and is taken over: the new holder makes a commit with its number,
        after which the old one, should it go on, can't commit (Lost).
        """
        folder = f"{self.path}/_locks"
        file = lambda n, what: f"{folder}/{n:012d}.{what}"
        there = self.files.names(folder)
        newest = max((int(n[:12]) for n in there if n.endswith(".lock")), default=0)
        if newest and f"{newest:012d}.done" not in there:
            alive = max(t for n, t in there.items() if n.startswith(f"{newest:012d}."))
            if time.time() - alive <= STALE:
                raise Busy(file(newest, "lock"))
        number = newest + 1
        if not self.files.create(file(number, "lock"), f"{owner} {uuid.uuid4().hex}"):
            raise Busy(file(number, "lock"))
        for n in there:
            if int(n[:12]) < newest:
                self.files.delete(f"{folder}/{n}")
        ended = threading.Event()

        def beat() -> None:
            while not ended.wait(BEAT):
                self.files.put(file(number, "beat"), owner)

        threading.Thread(target=beat, daemon=True).start()
        self.held = number
        try:
            while newest:  # the fence
                try:
                    self._show(self.head())
                    break
                except Lost:
                    if self.head().get("lock", 0) > number:
                        raise
            yield
        finally:
            ended.set()
            self.held = None
            self.files.put(file(number, "done"), owner)

    # Runs.
    def runs(self) -> list[dict]:
        return self.value("runs", [])

    def _put_run(self, run: dict) -> dict:
        self.commit(values={"runs": [r for r in self.runs() if r["id"] != run["id"]] + [run]})
        return run

    def begin(self, job: str, now: datetime) -> dict:
        """A new running run; runs that never ended are closed as failed, as their writer is gone."""
        runs = [r | {"status": "Failed", "message": "abandoned"} if r["status"] == "Running" else r for r in self.runs()]
        run = {"id": 1 + max([0, *(r["id"] for r in runs)]), "job": job, "status": "Running", "started": now.isoformat()}
        self.commit(values={"runs": [*runs, run]})
        return run

    def end(self, run: dict, status: str, now: datetime, **counts) -> dict:
        return self._put_run(run | {"status": status, "finished": now.isoformat()} | counts)


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _number(part: str) -> int:
    """The commit that a part was written for."""
    return int(re.match(r"v(\d+)", part)[1])


def _buckets(part: str) -> int:
    """The number of buckets of a part, 0 if it has none."""
    found = re.search(r"-b(\d+)$", part)
    return int(found[1]) if found else 0
