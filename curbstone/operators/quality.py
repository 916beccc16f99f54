"""Data-quality checks: numbers from single scans, and the rules that judge them."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstone.functions.maps import DQ_FLAGS

# Fixed values of the rules: floor of the source's count, points of a null rate, rows to judge it, and growth of a flag's
# count; requests at one address; days that are recent and those compared with.
FLOOR, POINTS, LEAST_ROWS, SHARE, LEAST_JUMP, REPEATS = Decimal("0.98"), Decimal(5), 30, Decimal("0.01"), 50, 100
RECENT, BASELINE = 7, 90
COLUMNS = ("neighborhood", "address", "zip", "category_level2", "district_number", "latitude")
PASS, INFO, WARN, FAIL = "Pass", "Info", "Warn", "Fail"


def _even(x: Decimal, digits: str = "1") -> Decimal:
    return x.quantize(Decimal(digits), ROUND_HALF_EVEN)


def result(check: str, status: str, observed, baseline=None, limit=None, detail: str = "") -> dict:
    return {"check": check, "status": status, "observed": observed, "baseline": baseline, "limit": limit, "detail": detail}


def source_count(observed: int, high: int | None) -> dict:
    """Fails under 98 % of the recent high, rounded half to even."""
    if not high or high <= 0:
        return result("source_count", INFO, observed, detail="no recent count to compare with")
    floor = _even(Decimal(high) * FLOOR)
    return result("source_count", FAIL if observed < floor else PASS, observed, high, floor)


def null_rate(column: str, recent_null: int, recent: int, base_null: int, base: int) -> dict:
    """Warns if the recent rate is over 5 points above the one before; few rows can't be judged."""
    rate = lambda k, n: _even(Decimal(100 * k) / n, "0.01") if n else None
    r, b = rate(recent_null, recent), rate(base_null, base)
    if recent < LEAST_ROWS or base < LEAST_ROWS:
        return result(f"null_rate.{column}", INFO, r, b, detail="too few rows to judge")
    return result(f"null_rate.{column}", WARN if r > b + POINTS else PASS, r, b, b + POINTS)


def flag_count(flag: str, observed: int, previous: int | None) -> dict:
    if previous is None:
        return result(f"flag.{flag}", INFO, observed, detail="first count")
    limit = previous + max(LEAST_JUMP, int(_even(previous * SHARE)))
    return result(f"flag.{flag}", WARN if observed > limit else PASS, observed, previous, limit)


def repeat_address(busiest: list[tuple[str, int]]) -> dict:
    if not busiest:
        return result("repeat_address", PASS, 0, limit=REPEATS, detail="no recent address")
    over = [f"{a} ({n:,})" for a, n in busiest if n >= REPEATS]
    return result("repeat_address", WARN if over else PASS, busiest[0][1], limit=REPEATS, detail="; ".join(over))


def rejects(n: int) -> dict:
    return result("rejects", WARN if n else PASS, n, limit=0)


def null_counts(requests: DataFrame, today: Column, recent: int = RECENT, baseline: int = BASELINE) -> DataFrame:
    """For recent and earlier requests, in one scan: n and nulls of COLUMNS; neighborhoods among city rows only."""
    rows = requests.filter(F.col("source_removed_utc").isNull() & (F.col("created_date_local") > F.date_sub(today, recent + baseline)) & (F.col("created_date_local") <= today))
    no = lambda c: F.col(c).isNull() & (F.coalesce(F.col("is_city"), F.lit(False)) if c == "neighborhood" else F.lit(True))
    return rows.groupBy((F.col("created_date_local") > F.date_sub(today, recent)).alias("recent")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("is_city"), F.lit(False))).alias("n_city"), *(F.count_if(no(c)).alias(c) for c in COLUMNS)
    )


def flag_counts(requests: DataFrame) -> DataFrame:
    """A count for each flag among present requests, in one scan."""
    rows = requests.filter(F.col("source_removed_utc").isNull())
    return rows.agg(*(F.count_if(F.col("dq_flags").bitwiseAND(b) != 0).alias(n) for b, n, _ in DQ_FLAGS))


def busiest_addresses(requests: DataFrame, today: Column, recent: int = RECENT, k: int = 5) -> DataFrame:
    rows = requests.filter(F.col("source_removed_utc").isNull() & F.col("address").isNotNull() & (F.col("created_date_local") > F.date_sub(today, recent)))
    return rows.groupBy("address").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "address").limit(k)


def checks(requests: DataFrame, today: Column, source_rows: int, high: int | None, previous: dict[str, int], rejected: int) -> list[dict]:
    """All checks of one run: source, null rates, address, flags, rejects."""
    rates = {r["recent"]: r for r in null_counts(requests, today).collect()}
    at = lambda recent, c: rates[recent][c] if recent in rates else 0
    size = lambda c: "n_city" if c == "neighborhood" else "n"
    flags = flag_counts(requests).first()
    return [
        source_count(source_rows, high),
        *(null_rate(c, at(True, c), at(True, size(c)), at(False, c), at(False, size(c))) for c in COLUMNS),
        repeat_address([tuple(r) for r in busiest_addresses(requests, today).collect()]),
        *(flag_count(n, flags[n] or 0, previous.get(n)) for _, n, _ in DQ_FLAGS),
        rejects(rejected),
    ]


def page_count_check(served: int, baseline: int) -> str:
    """Within 5 % of the baseline, else Grew or Dropped."""
    if 20 * abs(served - baseline) <= baseline:
        return "Within"
    return "Grew" if served > baseline else "Dropped"
