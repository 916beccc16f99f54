"""Jobs that keep the tables: backfill, incremental, reconcile, reclean, refresh and checks; and the times they run at."""

from __future__ import annotations

import argparse
import gzip
import hashlib
import json
import math
import sys
from collections.abc import Callable, Iterator
from datetime import date, datetime, time, timedelta, timezone
from functools import partial
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstone.functions.clean import FIRST_VALID, ZONE, clean, epoch_time, local_date, reject_reason
from curbstone.functions.maps import BACKLOG_START, CATEGORIES, DATE_PROBLEMS, DETECT_AGE, LABELS, MEMBER_AGE, MIN_COUNT, NEIGHBORHOODS, SWEEP_COUNT, UNMAPPED, category_map, line_map, neighborhood_map, slug_of, source_map
from curbstone.functions.text import null_if_blank
from curbstone.operators import classify, cube, kept, notes, quality
from curbstone.operators.apply import change_counts, merged, new_history, newest, with_maps
from curbstone.operators.constraints import Rules, require
from curbstone.operators.reconcile import guard_fails
from curbstone.plans import api
from curbstone.session import materialized
from curbstone.sources.contract import compare
from curbstone.sources.feed import KEYS, PAGE, body_of, from_features, keys_where, newer_where, page_baseline, pages, patient, slice_where, with_retries
from curbstone.sources.store import RETAIN, Busy, Store, utc_now

OVERLAP, EVERY, RECONCILE_AT, KEEP_PAGES = timedelta(minutes=60), timedelta(minutes=15), time(3, 30), timedelta(days=30)
#: What a scan of keys reads of each row.
KEY_FIELDS = ("OBJECTID", "ReferenceNumber", "DateUpdated")
#: Pages that one batch of a backfill applies together: only the current table is rewritten for each batch.
BATCH_PAGES = 50
#: What each published table must satisfy.
_GROUPS = {"category_group": ["", UNMAPPED, *sorted({g for _, g, _ in CATEGORIES})]}
PUBLISHED = {
    "stats_window": Rules(("window_days", "period", *cube.DIMS), (*cube.COUNTS, "closed_count"), (("median_days", "p90_days"),), _GROUPS),
    "open_backlog": Rules(cube.DIMS, ("open_count",), (), _GROUPS),
    "backlog_daily": Rules(("day", "district_number", "category_group"), ("opened", "closed", "open_at_end"), (), _GROUPS),
    "exclusion": Rules(("window_days", "period", *notes.TYPE), ("opened_count", "closed_count")),
    "exclusion_open": Rules(notes.TYPE, ("open_count",)),
    "exclusion_flag": Rules(("window_days", "period", "label"), ("closed_count",)),
    "clear_out": Rules(("day", "category_group"), ("closed_count",)),
}
EXIT = {"Succeeded": 0, "Failed": 1, "Skipped": 3, "SchemaDrift": 4}


class Feed:
    """What a job needs of a source: query(where, size) -> page, count(where) -> int, describe() -> layer.

    keys(where, size), query by default, gives pages that need only have the fields KEY_FIELDS. query and keys are sent to tasks.
    last(where) gives the greatest OBJECTID, for a backfill in ranges.
    A page may be given as the body of the answer, in bytes, so that exactly these are kept. Calls that raise Retryable are repeated.
    """

    def __init__(self, query: Callable[[str, int], dict], count: Callable[[str], int], describe: Callable[[], dict], keys: Callable[[str, int], dict] | None = None, last: Callable[[str], int] | None = None):
        self.query, self.count, self.describe, self.keys, self.last = query, count, describe, keys or query, last


# What tasks fetch.
def key_scan(spark: SparkSession, query: Callable[[str, int], dict], last: int, ranges: int, size: int = PAGE) -> DataFrame:
    """Features (feature) with KEY_FIELDS alone of the whole feed: tasks fetch (0, last] in ranges of OBJECTID, and what is above it."""

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = patient(query)
        for k in (int(k) for f in frames for k in f["id"]):
            where = f"1=1 AND OBJECTID <= {last * (k + 1) // ranges}" if k < ranges else "1=1"
            for _, page in pages(ask, where, last * k // ranges, size):
                yield pd.DataFrame({"feature": [json.dumps({"attributes": {n: f["attributes"].get(n) for n in KEY_FIELDS}}) for f in page["features"]]})

    return spark.range(0, ranges + 1, 1, ranges + 1).mapInPandas(fetch, "feature string")


def fetched(keys: DataFrame, query: Callable[[str, int], dict], size: int = PAGE) -> DataFrame:
    """(payload, sha256, features) of the pages with the rows of keys (reference_number), fetched by tasks in lists of KEYS.

    payload is the answer, compressed; sha256 is of the answer as it came.
    """

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = patient(query)
        for f in frames:
            for where in keys_where(f["reference_number"].tolist()):
                for _, page in pages(ask, where, 0, size):
                    body = body_of(page)
                    yield pd.DataFrame({"payload": [gzip.compress(body, mtime=0)], "sha256": [hashlib.sha256(body).hexdigest()], "features": [[json.dumps(x) for x in page["features"]]]})

    return keys.select("reference_number").mapInPandas(fetch, "payload binary, sha256 string, features array<string>")


def range_pages(spark: SparkSession, query: Callable[[str, int], dict], where: str, ranges: list[dict], most: int, size: int = PAGE) -> DataFrame:
    """(range, cursor, payload, sha256, features) of the next pages, most at most, of each of the ranges, each a task.

    A range has its number, the cursor after which it goes on, and its last OBJECTID, or None for all that follow.
    """

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = patient(query)
        for k in (int(k) for f in frames for k in f["id"]):
            r = ranges[k]
            within = where if r["last"] is None else f"{where} AND OBJECTID <= {r['last']}"
            for cursor, page in pages(ask, within, r["cursor"], size, most):
                body = body_of(page)
                row = {"range": [r["range"]], "cursor": [cursor], "payload": [gzip.compress(body, mtime=0)], "sha256": [hashlib.sha256(body).hexdigest()]}
                yield pd.DataFrame(row | {"features": [[json.dumps(x) for x in page["features"]]]})

    return spark.range(0, len(ranges), 1, len(ranges)).mapInPandas(fetch, "range int, cursor long, payload binary, sha256 string, features array<string>")


# Watermarks.
def next_watermark(before: datetime, seen: datetime | None, began: datetime) -> datetime:
    """The newest time seen, but not after the run began, and never back."""
    return max(before, min(seen or before, began))


def seed_watermark(began: datetime, until: datetime | None, existing: datetime | None, overlap: timedelta = OVERLAP) -> datetime:
    """Where incremental runs start after a backfill: the overlap before its end, and no later than it is already."""
    seed = min(began, until or began) - overlap
    return min(seed, existing) if existing else seed


def next_run(now: datetime, at: time = RECONCILE_AT, zone: str = ZONE) -> datetime:
    """The next time that clocks in the zone show `at`; a time that a change of clocks leaves out comes an hour later."""
    tz = ZoneInfo(zone)
    day = now.astimezone(tz).date()
    while True:
        local = datetime.combine(day, at, tz)
        if local.astimezone(timezone.utc).astimezone(tz).time() != at:
            local = datetime.combine(day, (datetime.combine(day, at) + timedelta(hours=1)).time(), tz)
        if local > now:
            return local.astimezone(timezone.utc)
        day += timedelta(days=1)


def refresh_due(changed: int, last_day: date | None, today: date) -> bool:
    return changed > 0 or last_day is None or last_day < today


class Jobs:
    """All jobs over one store and one feed. now() is taken once for each run and passed on as a literal."""

    def __init__(self, spark: SparkSession, store: Store, feed: Feed, now: Callable[[], datetime] = utc_now, page_size: int = PAGE, batch_pages: int = BATCH_PAGES):
        store.keyed |= {t: "reference_number" for t in ("service_request", "service_request_history")}
        self.spark, self.store, self.feed, self.now, self.page_size, self.batch_pages = spark, store, feed, now, page_size, batch_pages
        self.ask, self.retain = patient(feed.query), RETAIN
        self.maps = (category_map(spark), source_map(spark), neighborhood_map(spark))

    # One run: lock, run row, contract, work, refresh, checks.
    def _run(self, job: str, work: Callable[[dict, datetime], dict]) -> dict:
        began = self.now()
        try:
            with self.store.lock(job):
                run = self.store.begin(job, began)
                difference = compare(with_retries(self.feed.describe))
                if difference.drift:
                    return self.store.end(run, "SchemaDrift", self.now(), message=str(difference))
                try:
                    counts = work(run, began)
                except Exception as e:
                    self.store.end(run, "Failed", self.now(), message=str(e)[:500])
                    raise
                run = self.store.end(run, "Succeeded", self.now(), **counts)
                try:
                    self.refresh_if_due(counts.get("inserted", 0) + counts.get("updated", 0) + counts.get("recleaned", 0) + counts.get("removed", 0) + counts.get("restored", 0))
                    self.check(run)
                except Exception as e:  # figures are behind then, but what was read is kept
                    run = self.store.end(run, "Succeeded", self.now(), refresh_error=str(e)[:500])
                self._tidy()
                return run
        except Busy:
            return {"job": job, "status": "Skipped"}

    def _tidy(self) -> None:
        """Tidies the store; counts that belong to the table as it is still belong to it when it has been rewritten."""
        last = self.store.value("refresh")
        known = last and "version" in last and self.store.later("service_request", last["version"]) == []
        self.store.tidy(self.retain)
        head = self.store.head()
        if known and head["tables"]["service_request"] != last["version"]["of"]:
            self.store.commit(values={"refresh": last | {"version": self.store.version("service_request", head["number"], head)}})

    def _raw(self, found: list[dict]) -> DataFrame:
        rows = [(json.dumps(f),) for p in found for f in p["features"]]
        return self.spark.createDataFrame(rows, "feature string")

    def apply(self, features: DataFrame, run: dict, now: datetime, reclean: bool = False, values: dict | None = None) -> dict:
        """Cleans and applies features (feature): one commit with the tables, the rejects and values such as a checkpoint."""
        stamp = F.lit(now).cast("timestamp")
        rows = from_features(materialized(features.select("feature")))
        reason = reject_reason(F.col("object_id"), F.col("reference_number"), F.col("date_updated"))
        bad = rows.withColumn("reason", reason).filter("reason is not null").select("object_id", "reference_number", "reason", F.to_json(F.struct(*rows.columns)).alias("raw"), F.lit(run["id"]).cast("long").alias("run_id"))
        staged = materialized(clean(rows, stamp))
        versions = materialized(with_maps(staged, *self.maps))
        batch = materialized(newest(versions))
        # Only the buckets of the batch's keys are read of both tables.
        head, keys = self.store.head(), batch.select("reference_number")
        current = self.store.read("service_request", at=head, near=keys)
        if current is None:
            current = self._empty_current(batch)
        history = self.store.read("service_request_history", at=head, near=keys)
        # Every version goes to history, so that it doesn't depend on how pages fall into batches.
        fresh = new_history(versions.dropDuplicates(["reference_number", "row_hash"]), history if history is not None else batch.select("reference_number", "row_hash").limit(0), stamp, run["id"])
        touched = current.join(batch.select("reference_number"), "reference_number", "left_semi")
        table = materialized(merged(touched, batch, stamp, reclean))
        counts = change_counts(table)
        fresh, bad = materialized(fresh), materialized(bad)
        counts |= {"history": fresh.count(), "rejected": bad.count(), "duplicates": staged.count() - batch.count()}
        append = {"service_request_history": fresh} if counts["history"] else {}
        append |= {"ingest_reject": bad} if counts["rejected"] else {}
        seen = staged.agg(F.max("updated_utc")).first()[0]
        self._put(table.drop("change"), append=append, values=values)
        return counts | {"seen": seen.replace(tzinfo=timezone.utc).isoformat() if seen else None}

    def _put(self, rows: DataFrame, **other) -> None:
        """Commits changed rows of service_request, which are the table if there is none yet."""
        there = "service_request" in self.store.head()["tables"]
        self.store.commit(**({"upsert": {"service_request": (rows, "reference_number")}} if there else {"replace": {"service_request": rows}}), **other)

    def _empty_current(self, batch: DataFrame) -> DataFrame:
        stamp = F.lit(None).cast("timestamp")
        return batch.limit(0).withColumns({c: stamp for c in ("first_seen_utc", "last_seen_utc", "last_changed_utc", "source_removed_utc")})

    def _keep_pages(self, found: list[dict], job: str, now: datetime) -> None:
        """Raw pages are kept before, and apart from, what is made of them."""
        rows = [(job, now, bytearray(gzip.compress(body, mtime=0)), hashlib.sha256(body).hexdigest()) for body in map(body_of, found)]
        self.store.commit(append={"raw_page": self.spark.createDataFrame(rows, "pipeline string, fetched_utc timestamp, payload binary, sha256 string")})

    def _pull(self, run: dict, now: datetime, where: str, checkpoint: str | None = None, most: int | None = None, reclean: bool = False, after: int = 0) -> dict:
        """Applies the pages of where in batches; with a checkpoint each batch's last OBJECTID is kept in the same commit."""
        total: dict = {"pages": 0}
        held: list[dict] = []

        def flush(cursor: int) -> None:
            self._keep_pages(held, run["job"], now)
            mark = {checkpoint: {"where": where, "after": cursor}} if checkpoint else None
            got = self.apply(self._raw(held), run, now, reclean, mark)
            for k, v in got.items():
                total[k] = max(filter(None, (total.get(k), v)), default=None) if k == "seen" else total.get(k, 0) + v
            total["pages"] += len(held)
            held.clear()

        cursor = after
        for cursor, page in pages(self.ask, where, after, self.page_size, most):
            held.append(page)
            if len(held) >= self.batch_pages:
                flush(cursor)
        if held:
            flush(cursor)
        return total | {"done": most is None or total["pages"] < most}

    def _pull_ranges(self, run: dict, now: datetime, where: str, ranges: list[dict], checkpoint: str, most: int | None = None) -> dict:
        """Applies the pages of where, fetched by tasks in ranges of OBJECTID; each round is one commit, with each range's cursor.

        A round takes batch_pages pages, dealt to the ranges that aren't done. Pages go from tasks to tables, not through the driver.
        """
        total: dict = {"pages": 0}
        stamp = F.lit(now).cast("timestamp")
        while left := [r for r in ranges if not r["done"]]:
            if most is not None and total["pages"] >= most:
                return total | {"done": False}
            each = max(1, self.batch_pages // len(left))
            found = materialized(range_pages(self.spark, self.feed.query, where, left, each, self.page_size))
            got = {r["range"]: r for r in found.groupBy("range").agg(F.max("cursor").alias("cursor"), F.count(F.lit(1)).alias("n")).collect()}
            ranges = [r | ({"cursor": got[r["range"]]["cursor"]} if r["range"] in got else {}) | ({"done": got[r["range"]]["n"] < each if r["range"] in got else True} if not r["done"] else {}) for r in ranges]
            mark = {checkpoint: {"where": where, "ranges": ranges}}
            if not got:
                self.store.commit(values=mark)
                continue
            self.store.commit(append={"raw_page": found.select(F.lit(run["job"]).alias("pipeline"), stamp.alias("fetched_utc"), "payload", "sha256")})
            counts = self.apply(found.select(F.explode("features").alias("feature")), run, now, values=mark)
            for k, v in counts.items():
                total[k] = max(filter(None, (total.get(k), v)), default=None) if k == "seen" else total.get(k, 0) + v
            total["pages"] += sum(r["n"] for r in got.values())
        return total | {"done": True}

    def backfill(self, since: datetime | None = None, until: datetime | None = None, restart: bool = False, max_pages: int | None = None, ranges: int = 1) -> dict:
        """Reads a slice of the feed from where an earlier run of the same slice stopped; in ranges of OBJECTID at once, if there are several.

        A run that stopped with ranges goes on with each of them, whatever ranges says.
        """

        def work(run: dict, now: datetime) -> dict:
            where, mark = slice_where(since, until), self.store.value("checkpoint.backfill")
            if mark and not restart and mark["where"] != where:
                raise ValueError("a backfill of another slice isn't done; restart it or finish that one")
            mark = None if restart else mark
            after = mark["after"] if mark and "after" in mark else 0
            if mark and "ranges" in mark:
                parts = mark["ranges"]
            elif ranges > 1:
                if self.feed.last is None:
                    raise ValueError("a backfill in ranges needs the feed's last OBJECTID")
                last = max(after, with_retries(lambda: self.feed.last(where)) or 0)
                cuts = [after + (last - after) * k // ranges for k in range(ranges)]
                parts = [{"range": k, "cursor": a, "last": b, "done": False} for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], None])) if b is None or a < b]
            else:
                parts = None
            got = self._pull_ranges(run, now, where, parts, "checkpoint.backfill", max_pages) if parts else self._pull(run, now, where, "checkpoint.backfill", max_pages, after=after)
            if got["done"]:
                before = self.store.value("watermark")
                seed = seed_watermark(now, until, datetime.fromisoformat(before) if before else None)
                self.store.commit(values={"checkpoint.backfill": None, "watermark": seed.isoformat()})
            return got

        return self._run("backfill", work)

    def incremental(self) -> dict:
        """Rows updated after the watermark less the overlap; the watermark moves only when the run succeeds."""

        def work(run: dict, now: datetime) -> dict:
            mark = datetime.fromisoformat(self.store.value("watermark") or f"{FIRST_VALID}T00:00:00+00:00")
            got = self._pull(run, now, newer_where(mark - OVERLAP))
            seen = datetime.fromisoformat(got["seen"]) if got.get("seen") else None
            self.store.commit(values={"watermark": next_watermark(mark, seen, now).isoformat()})
            self.prune(now)
            return got

        return self._run("incremental", work)

    def reclean(self) -> dict:
        """Cleans the whole feed again, for rules that have changed; unchanged versions get no history."""

        def work(run: dict, now: datetime) -> dict:
            mark = self.store.value("checkpoint.reclean") or {"after": 0}
            got = self._pull(run, now, "1=1", "checkpoint.reclean", reclean=True, after=mark["after"])
            self.store.commit(values={"checkpoint.reclean": None})
            return got

        return self._run("reclean", work)

    def reconcile(self) -> dict:
        """Marks what the source no longer serves, restores what it serves again, and reads again what is missing or newer."""

        def work(run: dict, now: datetime) -> dict:
            stamp = F.lit(now).cast("timestamp")
            current = self.store.read("service_request")
            held = current.agg(F.coalesce(F.max("object_id"), F.lit(0)), F.count(F.lit(1))).first()
            ranges = max(1, math.ceil(held[1] / (self.page_size * self.batch_pages)))
            raw = from_features(key_scan(self.spark, self.feed.keys, held[0], ranges, self.page_size))
            ok = raw.filter(reject_reason(F.col("object_id"), F.col("reference_number"), F.col("date_updated")).isNull())
            keys = ok.select(null_if_blank(F.col("reference_number")).alias("reference_number"), epoch_time(F.col("date_updated"), stamp)[0].alias("updated_utc"))
            keys = materialized(keys.groupBy("reference_number").agg(F.max("updated_utc").alias("served_utc")))
            n = keys.count()
            good = [r["keys"] for r in self.store.runs() if r["job"] == "reconcile" and r["status"] == "Succeeded" and "keys" in r]
            if guard_fails(n, good[-1] if good else current.filter("source_removed_utc is null").count()):
                raise ValueError(f"only {n} keys served; nothing is marked as removed")
            rows = current.join(keys, "reference_number", "left")
            gone = F.col("source_removed_utc").isNull() & F.col("served_utc").isNull()
            back = F.col("source_removed_utc").isNotNull() & F.col("served_utc").isNotNull()
            counts = rows.agg(F.count_if(gone).alias("removed"), F.count_if(back).alias("restored")).first().asDict()
            table = rows.filter(gone | back).withColumn("last_seen_utc", F.when(back, stamp).otherwise(F.col("last_seen_utc"))).withColumn(
                "source_removed_utc", F.when(gone, stamp).when(~back, F.col("source_removed_utc"))
            )
            again = keys.join(current.select("reference_number", "updated_utc"), "reference_number", "left")
            again = again.filter(F.col("updated_utc").isNull() | (F.col("served_utc") > F.col("updated_utc"))).select("reference_number")
            again = materialized(again)
            wanted = again.count()
            if counts["removed"] or counts["restored"]:
                self._put(materialized(table.drop("served_utc")))
            total: dict = {}
            if wanted:
                found = materialized(fetched(again.repartition(math.ceil(wanted / (KEYS * self.batch_pages))), self.feed.query, self.page_size))
                kept = found.select(F.lit(run["job"]).alias("pipeline"), stamp.alias("fetched_utc"), "payload", "sha256")
                self.store.commit(append={"raw_page": kept})
                total = self.apply(found.select(F.explode("features").alias("feature")), run, now) | {"pages": found.count()}
                del total["seen"]
            return counts | total | {"keys": n, "refetched": wanted}

        return self._run("reconcile", work)

    def prune(self, now: datetime, age: timedelta = KEEP_PAGES) -> None:
        """Rewrites raw pages without those older than age, if there are any."""
        kept = self.store.read("raw_page")
        limit = F.lit(now - age).cast("timestamp")
        if kept is not None and kept.filter(F.col("fetched_utc") < limit).take(1):
            self.store.compact("raw_page", lambda df: materialized(df.filter(F.col("fetched_utc") >= limit)))

    # Figures.
    def described(self, table: DataFrame) -> DataFrame:
        """Requests as the cube takes them, with service and their type; bulk is the label that they have."""
        c = F.col
        rows = table.withColumns({
            "hundredths": F.round(c("days_to_close") * 100).cast("long"), "present": c("source_removed_utc").isNull(), "closed_ts": c("closed_utc"),
            "created_date": c("created_date_local"), "closed_date": c("closed_date_local"), "backlog_close_date": c("backlog_close_date_local"),
            "bulk": c("dq_flags").bitwiseAND(LABELS) != 0,
        })
        rows = rows.withColumn("timed", (c("dq_flags").bitwiseAND(DATE_PROBLEMS) == 0) & c("hundredths").isNotNull() & c("closed_date").isNotNull())
        pairs = materialized(classify.non_service_pairs(rows, self.maps[0], line_map(self.spark)))
        return classify.with_type(rows, pairs, "left").withColumn("service", c("type_label").isNull())

    def refresh(self, whole: bool = False) -> dict:
        """Labels requests and publishes every aggregate in one commit, if each satisfies its rules (else Violated).

        Counts are kept with what is published. They are moved by the requests that changed since, and only these are read; whole counts
        all requests again, as is done where the counts can't be told to belong to the table, the maps and an earlier day. To be called by
        the holder of the lock.
        """
        now, head = self.now(), self.store.head()
        table = self.store.read("service_request", at=head)
        day = self.spark.range(1).select(local_date(F.lit(now).cast("timestamp"))).first()[0]
        rules, last = self._rules(), head["values"].get("refresh", {})
        as_of, changes = F.lit(day), None
        if not whole and last.get("rules") == rules and last["as_of_date"] <= day.isoformat() and all(f"kept_{n}" in head["tables"] for n in kept.KEPT):
            changes = self.store.changes("service_request", last["version"], at=head)
        if changes is None:
            counts, rows = kept.build(materialized(self.described(table)), as_of)
        else:
            old, new = (materialized(df) for df in changes)

            def others(groups: DataFrame) -> DataFrame:
                days = groups.agg(F.min("closed_date"), F.max("closed_date")).first()
                rest = table.filter(F.col("closed_date_local").between(*days)).join(new.select("reference_number"), "reference_number", "left_anti")
                rest = self.described(rest).withColumn("closed_minute", F.date_trunc("minute", "closed_ts"))
                rest = rest.filter(classify.old_closure(rest, MEMBER_AGE))
                return rest.join(groups, list(kept.CLOSURE), "left_semi").drop("closed_minute")

            before = {n: self.store.read(f"kept_{n}", at=head) for n in kept.KEPT}
            since = F.lit(last["as_of_date"]).cast("date")
            counts, rows = kept.move(before, self.described(old), self.described(new), others, since)
            counts["open"] = counts["open"].filter(F.col("backlog_close_date").isNull() | (F.col("backlog_close_date") > as_of))
        age = F.greatest(F.lit(0).cast("long"), F.floor((F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis("created_utc")) / 864000 + 0.5).cast("long"))
        tables = {n: materialized(df) for n, df in kept.figures(counts, as_of, age, BACKLOG_START).items()}
        known = {r["category_group"] for r in self.maps[0].select("category_group").distinct().collect()}
        checked = {n: r._replace(known={c: [*v, *known] for c, v in r.known.items()}) for n, r in PUBLISHED.items()}
        require({n: (df, checked[n]) for n, df in tables.items()})
        total = counts["totals"].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        labels = rows.withColumn("flags_before", F.col("dq_flags")).withColumn("dq_flags", classify.label_flags(F.col("dq_flags"), F.col("bulk")))
        labels = materialized(labels.filter("dq_flags <> flags_before").select(*table.columns))
        relabelled, read = labels.count(), rows.count()
        info = {"as_of_utc": now.isoformat(), "as_of_date": day.isoformat(), "requests": total, "rules": rules, "read": read, "whole": changes is None}
        self.store.commit(
            replace=tables | {f"kept_{n}": df for n, df in counts.items()},
            upsert={"service_request": (labels, "reference_number")} if relabelled else {},
            values=lambda number: {"refresh": info | {"version": self.store.version("service_request", number, head)}},
        )
        return self.store.value("refresh")

    def _rules(self) -> str:
        """A hash of what figures depend on besides requests: the maps and the thresholds."""
        sums = [df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0] for df in (self.maps[0], line_map(self.spark))]
        return hashlib.sha256(repr((sums, MIN_COUNT, SWEEP_COUNT, DETECT_AGE, MEMBER_AGE, DATE_PROBLEMS)).encode()).hexdigest()[:16]

    def refresh_if_due(self, changed: int) -> None:
        last = self.store.value("refresh")
        today = self.spark.range(1).select(local_date(F.lit(self.now()).cast("timestamp"))).first()[0]
        if refresh_due(changed, date.fromisoformat(last["as_of_date"]) if last else None, today) and self.store.read("service_request") is not None:
            self.refresh()

    def published(self) -> api.Published:
        """The last refresh, all from one commit; NotFound before the first."""
        head = self.store.head()
        info = head["values"].get("refresh")
        if not info:
            raise api.NotFound("nothing is published yet")
        tables = {
            "stats": "stats_window", "open": "open_backlog", "backlog": "backlog_daily", "exclusions": "exclusion", "exclusions_open": "exclusion_open",
            "date_problems": "exclusion_flag", "clear_outs": "clear_out",
        }
        frames = {k: partial(self.store.read, t, at=head) for k, t in tables.items()}
        names = {slug_of(n): n for n in NEIGHBORHOODS}
        return api.Published(date.fromisoformat(info["as_of_date"]), date.fromisoformat(BACKLOG_START), api.service_categories(), names, **frames)

    def check(self, run: dict) -> list[dict]:
        """Data-quality checks after a refresh, so that labels are counted; results are kept with the run's id."""
        table = self.store.read("service_request")
        if table is None:
            return []
        day = F.lit(self.spark.range(1).select(local_date(F.lit(self.now()).cast("timestamp"))).first()[0])
        before = self.store.value("dq", [])
        counts = [r["observed"] for r in before if r["check"] == "source_count"]
        previous = {r["check"][5:]: r["observed"] for r in before if r["check"].startswith("flag.")}
        got = quality.checks(table, day, with_retries(lambda: self.feed.count("1=1")), max(counts, default=None), previous, run.get("rejected", 0))
        got = [{k: (float(v) if k in ("observed", "baseline", "limit") and v is not None else v) for k, v in r.items()} | {"run_id": run["id"]} for r in got]
        self.store.commit(values={"dq": [r for r in before if r["run_id"] > run["id"] - 10] + got})
        return got


def main(argv: list[str] | None = None) -> int:
    """curbstone.plans.jobs VERB --store PATH --feed MODULE:FUNCTION, which returns a Feed."""
    from importlib import import_module

    from curbstone.session import local_session

    parser = argparse.ArgumentParser(prog="curbstone")
    parser.add_argument("verb", choices=["backfill", "incremental", "reconcile", "reclean", "aggregates", "dq", "verify-source"])
    parser.add_argument("--store", required=True)
    parser.add_argument("--feed", required=True)
    parser.add_argument("--since", type=datetime.fromisoformat)
    parser.add_argument("--until", type=datetime.fromisoformat)
    parser.add_argument("--restart", action="store_true", help="begin a backfill anew, or count all requests again for the aggregates")
    parser.add_argument("--max-pages", type=int)
    parser.add_argument("--ranges", type=int, default=1, help="ranges of OBJECTID that a backfill reads at once")
    parser.add_argument("--profile", help="a Markdown profile whose row count verify-source compares with")
    a = parser.parse_args(argv)
    module, _, name = a.feed.partition(":")
    spark = local_session()
    jobs = Jobs(spark, Store(spark, a.store), getattr(import_module(module), name)())
    if a.verb == "verify-source":
        difference, served = compare(with_retries(jobs.feed.describe)), with_retries(lambda: jobs.feed.count("1=1"))
        baseline = spark.read.text(a.profile, wholetext=True).select(page_baseline(F.col("value"))).first()[0] if a.profile else None
        print(f"{difference}; {served:,} rows" + (f"; {quality.page_count_check(served, baseline)}: the profile has {baseline:,}" if baseline else ""))
        return EXIT["SchemaDrift"] if difference.drift else 0
    if a.verb == "aggregates":
        with jobs.store.lock("aggregates"):
            print(json.dumps(jobs.refresh(a.restart)))
        return 0
    if a.verb == "dq":
        print(json.dumps(jobs.check({"id": 0})))
        return 0
    run = jobs.backfill(a.since, a.until, a.restart, a.max_pages, a.ranges) if a.verb == "backfill" else getattr(jobs, a.verb)()
    print(json.dumps(run))
    return EXIT[run["status"]]


if __name__ == "__main__":
    sys.exit(main())
