"""Checks of query parameters: all problems are found before a plan is built, and raised together."""

from __future__ import annotations

from datetime import date

WINDOWS, DEFAULT_WINDOW = (30, 90, 365), 90
GRAINS, BY = ("day", "week"), ("neighborhood", "category")
DEFAULT_LIMIT, MOST = 10, 50


class BadQuery(ValueError):
    """problems: parameter -> what is wrong with it."""

    def __init__(self, problems: dict[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in problems.items()))
        self.problems = problems


class NotFound(LookupError):
    """What was asked for isn't published."""


class Rules:
    """Collects problems while it turns texts into values; done() raises them."""

    def __init__(self):
        self.problems: dict[str, str] = {}

    def _whole(self, name: str, value, default, allowed: str, ok):
        if value is None or value == "":
            return default
        try:
            n = int(str(value).strip())
        except ValueError:
            n = None
        if n is None or not ok(n):
            self.problems[name] = f"must be {allowed}"
            return default
        return n

    def window(self, value) -> int:
        return self._whole("window", value, DEFAULT_WINDOW, "30, 90 or 365", lambda n: n in WINDOWS)

    def district(self, value) -> int:
        """1 to 8; 0 for all."""
        return self._whole("district", value, 0, "1 to 8", lambda n: 1 <= n <= 8)

    def limit(self, value) -> int:
        return self._whole("limit", value, DEFAULT_LIMIT, f"1 to {MOST}", lambda n: 1 <= n <= MOST)

    def known(self, name: str, value, stored) -> str | None:
        """A stored name in its own spelling, found in any case; None if not asked for."""
        if value is None or not str(value).strip():
            return None
        found = {s.lower(): s for s in stored}.get(str(value).strip().lower())
        if found is None:
            self.problems[name] = "is not known"
        return found

    def one_of(self, name: str, value, allowed: tuple[str, ...]) -> str:
        if value is None or str(value).strip() == "":
            return allowed[0]
        got = str(value).strip().lower()
        if got not in allowed:
            self.problems[name] = "must be " + " or ".join(allowed)
            return allowed[0]
        return got

    def day(self, name: str, value) -> date | None:
        if value is None or value == "":
            return None
        if isinstance(value, date):
            return value
        try:
            return date.fromisoformat(str(value))
        except ValueError:
            self.problems[name] = "must be a date as YYYY-MM-DD"
            return None

    def order(self, first: date | None, last: date | None) -> None:
        if first and last and first > last:
            self.problems["from"] = "must not be after to"

    def not_both(self, condition: bool, name: str, why: str) -> None:
        if condition:
            self.problems[name] = why

    def done(self) -> None:
        if self.problems:
            raise BadQuery(self.problems)
