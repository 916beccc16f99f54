"""Text cleaners as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_blank(s: Column) -> Column:
    """Trimmed, with runs of Unicode white space as one space; null if nothing is left."""
    return F.nullif(unspaced(s), F.lit(""))


def all_of(cleaner: Callable[[Column], Column], texts: list[Column]) -> Column:
    """The array of texts, each through a cleaner: that is one expression however many they are, so that a task's code stays small
    enough to be compiled. cleaner gives '' for what all_of() makes null."""
    return F.transform(F.transform(F.array(*texts), cleaner), lambda t: F.when(t != "", t))


def unspaced(s: Column) -> Column:
    """null_if_blank() with '' for null."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def bare(s: Column) -> Column:
    """map_key() with '' for null."""
    return F.lower(F.regexp_replace(s, "[^A-Za-z0-9]", ""))


def map_key(s: Column) -> Column:
    """ASCII letters and digits in lower case; null if there are none."""
    return F.nullif(bare(s), F.lit(""))


def slug(s: Column) -> Column:
    """Lower-case words of a name joined by hyphens, apostrophes dropped; null if nothing is left."""
    plain = F.translate(F.lower(s), "'\u2019", "")
    return F.nullif(F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-")), F.lit(""))


def escape_html(s: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(plain), F.lit(safe))
    return s
