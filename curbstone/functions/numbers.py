"""Exact percentiles and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The median and the 90th percentile, as fractions.
MEDIAN, P90 = (1, 2), (9, 10)
# Fixed values of the trend rule: fewest requests in either period, and the steady band.
LEAST_REQUESTS, STEADY = 30, 0.05


def exact_percentiles(values: DataFrame, by: list[str], value: str, count: str, wanted: dict[str, tuple[int, int]], sums: tuple[str, ...] | None = None) -> DataFrame:
    """by, n and a column for each of wanted: continuous percentiles a/b of integer values, rounded half away from zero.

    With sums, values has one row for each by and value already; rows of a null value count for these sums alone, and a group
    with no other has n 0 and null percentiles.

    values has rows (by, value, count): how often each value occurs. Positions come from running counts over distinct values, so
    no group's values are gathered: a group costs at most as many rows as there are different values. Values aren't negative.
    """
    over = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = values.groupBy(*by, value).agg(F.sum(count).alias("__n")) if sums is None else values.withColumnRenamed(count, "__n")
    rows = rows.withColumn("__upto", F.sum("__n").over(over)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    picks = []
    for k, (a, b) in enumerate(wanted.values()):
        place = F.floor(F.lit(a) * (F.col("__all") - 1) / b)
        picks += [F.min(F.when(F.col("__upto") > place, F.col(value))).alias(f"__lo{k}"), F.min(F.when(F.col("__upto") > F.least(place + 1, F.col("__all") - 1), F.col(value))).alias(f"__hi{k}")]
    sums = sums or ()
    got = rows.groupBy(*by).agg(F.max("__all").alias("n"), *picks, *(F.sum(s).cast("long").alias(s) for s in sums))
    out = []
    for k, (name, (a, b)) in enumerate(wanted.items()):
        part = (F.lit(a) * (F.col("n") - 1)) % b
        x = b * F.col(f"__lo{k}") + part * (F.col(f"__hi{k}") - F.col(f"__lo{k}"))
        out.append(F.floor((2 * x + b) / (2 * b)).cast("long").alias(name))
    return got.select(*by, "n", *sums, *out)


def percentile_of_array(sorted_values: Column, a: int, b: int) -> Column:
    """The same for one row's sorted array of integers; null if it is empty."""
    n = F.size(sorted_values)
    k = a * (n - 1)
    lo = F.floor(k / b).cast("int")
    at = lambda i: F.get(sorted_values, i)
    x = b * at(lo) + (k % b) * (at(F.least(lo + 1, n - 1)) - at(lo))
    return F.when(n > 0, F.floor((2 * x + b) / (2 * b)).cast("long"))


def trend(n1: Column, m1: Column, n0: Column, m0: Column) -> Column:
    """struct(direction, pct) of current against prior medians, in hundredths; null with too few requests or no median.

    From a prior median of 0 a change is steady or slower without a percentage. pct has one digit, half away from zero.
    """
    known = (n1 >= LEAST_REQUESTS) & (n0 >= LEAST_REQUESTS) & m1.isNotNull() & m0.isNotNull()
    far = F.abs(m1 - m0) * 20 >= m0  # |change| >= 5 %
    zero = F.when(m1 == 0, F.lit("steady")).otherwise(F.lit("slower"))
    direction = F.when(m0 == 0, zero).when(~far, "steady").when(m1 > m0, "slower").otherwise("faster")
    pct = F.when(m0 != 0, F.round((m1 - m0).cast("decimal(20,0)") * 100 / F.when(m0 != 0, m0).cast("decimal(20,0)"), 1).cast("double"))
    return F.when(known, F.struct(direction.alias("direction"), pct.alias("pct")))
