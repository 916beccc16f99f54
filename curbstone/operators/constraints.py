"""What published tables must satisfy, checked before they are shown."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rules(NamedTuple):
    """key: columns that only one row has, null equal to null; counts: columns that are never null or negative; ordered: pairs of columns
    of which the first is never above the second, and both are null or neither is; known: the values that a column may have."""

    key: tuple[str, ...]
    counts: tuple[str, ...] = ()
    ordered: tuple[tuple[str, str], ...] = ()
    known: dict[str, list] = {}


class Violated(ValueError):
    """A table that was to be published breaks a rule."""


def violations(tables: dict[str, tuple[DataFrame, Rules]]) -> DataFrame:
    """(table, rule, n): how many rows break each rule; rules that none breaks have n 0. One grouping for each table, one job for all."""

    def of(name: str, df: DataFrame, rules: Rules) -> DataFrame:
        broken: dict[str, Column] = {f"negative {c}": F.col(c).isNull() | (F.col(c) < 0) for c in rules.counts}
        broken |= {f"order of {a}, {b}": (F.col(a).isNull() != F.col(b).isNull()) | F.coalesce(F.col(a) > F.col(b), F.lit(False)) for a, b in rules.ordered}
        broken |= {f"unknown {c}": ~F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in rules.known.items()}
        names = list(broken)
        rows = df.groupBy(*rules.key).agg((F.count(F.lit(1)) - 1).alias("r0"), *(F.count_if(broken[n]).alias(f"r{k}") for k, n in enumerate(names, 1)))
        sums = rows.agg(*(F.coalesce(F.sum(f"r{k}"), F.lit(0)).alias(f"r{k}") for k in range(len(names) + 1)))
        each = [F.struct(F.lit(n).alias("rule"), F.col(f"r{k}").alias("n")) for k, n in enumerate(["doubled", *names])]
        return sums.select(F.lit(name).alias("table"), F.explode(F.array(*each)).alias("e")).select("table", "e.*")

    return reduce(DataFrame.unionByName, (of(n, *x) for n, x in tables.items()))


def require(tables: dict[str, tuple[DataFrame, Rules]]) -> None:
    """Violated, with what is broken, unless all rules hold."""
    found = violations(tables).filter("n > 0").collect()
    if found:
        raise Violated("; ".join(f"{r['table']}: {r['n']} rows, {r['rule']}" for r in found))
