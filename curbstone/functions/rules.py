"""The rules of runs and counts as column expressions, for tables of runs; the jobs apply the same rules to one run's values."""

from __future__ import annotations

from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_watermark(before: Column, seen: Column, began: Column) -> Column:
    """The newest time seen, but not after the run began, and never back."""
    return F.greatest(before, F.least(F.coalesce(seen, before), began))


def seed_watermark(began: Column, until: Column, existing: Column, overlap: timedelta = timedelta(hours=1)) -> Column:
    """The overlap before a backfill's end, and no later than the watermark is already; null times count for nothing."""
    return F.least(F.least(began, until) - F.lit(overlap), existing)


def guard_fails(keys: Column, baseline: Column, percent: int = 95) -> Column:
    """Whether so few keys are served that none may be marked as removed; not without a baseline."""
    return F.coalesce(keys * 100 < baseline * percent, F.lit(False))


def page_count(served: Column, baseline: Column) -> Column:
    """Within 5 % of the baseline, else Grew or Dropped."""
    return F.when(F.abs(served - baseline) * 20 <= baseline, "Within").when(served > baseline, "Grew").otherwise("Dropped")


def refresh_due(changed: Column, last_day: Column, today: Column) -> Column:
    return (changed > 0) | F.coalesce(last_day < today, F.lit(True))


def source_count(observed: Column, high: Column, floor: str = "0.98") -> Column:
    """Fail under 98 % of the recent high, rounded half to even; Info without one."""
    least = F.bround(high.cast("decimal(19,0)") * F.lit(Decimal(floor)), 0)
    return F.when(F.coalesce(high <= 0, F.lit(True)), "Info").when(observed < least, "Fail").otherwise("Pass")
