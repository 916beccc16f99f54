"""Freshness, health and alerts from the run log."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: minutes after which the last good run is stale.
FRESH_MINUTES = 45
HEALTHY, DEGRADED, UNHEALTHY = "Healthy", "Degraded", "Unhealthy"


def is_fresh(last_success: datetime | None, now: datetime) -> bool:
    return last_success is not None and now - last_success <= timedelta(minutes=FRESH_MINUTES)


def fresh_column(last_success: Column, now: Column) -> Column:
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(last_success) <= FRESH_MINUTES * 60, F.lit(False))


def last(runs: list[dict], status: str | None = None) -> dict | None:
    """The newest finished run, of a status if given."""
    ended = [r for r in runs if r.get("finished") and status in (None, r["status"])]
    return max(ended, key=lambda r: (r["finished"], r["id"]), default=None)


def health(runs: list[dict], now: datetime, reachable: bool = True) -> dict[str, str]:
    """A state for the store, freshness and ingestion, and the worst of them as overall."""
    good, newest = last(runs, "Succeeded"), last([r for r in runs if r["status"] != "Skipped"])
    states = {
        "store": HEALTHY if reachable else UNHEALTHY,
        "freshness": HEALTHY if good and is_fresh(datetime.fromisoformat(good["finished"]), now) else DEGRADED,
        "ingestion": UNHEALTHY if newest and newest["status"] == "SchemaDrift" else DEGRADED if newest and newest["status"] == "Failed" else HEALTHY,
    }
    order = (HEALTHY, DEGRADED, UNHEALTHY)
    return states | {"overall": max(states.values(), key=order.index)}


class Alerts:
    """Tells of a change of state once: publish(health) sends what differs from the time before."""

    def __init__(self, send: Callable[[str, str, str], None]):
        self.send, self.before = send, {}

    def publish(self, states: dict[str, str]) -> None:
        for name, state in states.items():
            was = self.before.get(name, HEALTHY)
            if state != was:
                self.send(name, was, state)
        self.before = dict(states)


def summary(results: list[dict]) -> dict:
    """Counts of checks by status, and those that aren't passed or for information."""
    counts: dict[str, int] = {}
    for r in results:
        counts[r["status"]] = counts.get(r["status"], 0) + 1
    return {"counts": counts, "issues": [r for r in results if r["status"] in ("Warn", "Fail")]}
