"""Profiles of a source: value counts, match rates, order contradictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstone.functions.text import map_key
from curbstone.sources.feed import StatisticsSource, measure, measures, with_functions


def attribute_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n), most frequent first."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def match_rate(counted: DataFrame, names: DataFrame, name: str = "neighborhood") -> DataFrame:
    """(n, matched, unmatched_names, rate): rows of counted (name, n) whose key a name has, weighted by n."""
    keys = names.select(map_key(F.col("name")).alias("__k"), F.lit(True).alias("__m")).distinct()
    rows = counted.join(F.broadcast(keys), map_key(F.col(name)) == F.col("__k"), "left").withColumn("m", F.coalesce("__m", F.lit(False)))
    got = rows.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("m"), F.col("n"))).alias("matched"), F.count_if(~F.col("m")).alias("unmatched_names"))
    return got.withColumn("rate", F.col("matched").cast("double") / F.col("n"))


def served_statistics(spark: SparkSession, statistics: str | Callable, asked: str, group: str | None = None, where: str = "1=1", argument: str | None = None, first: int | None = None, last: int | None = None, ranges: int = 1) -> DataFrame:
    """(value, if there is a group, and a column for each measure): figures of a feed's rows that the feed itself works out.

    With first and last, tasks ask for ranges of ids, and Spark merges what comes back: counts are added up, the least and greatest kept. Numbers of
    different values can't be merged, so they are asked for with a single range. See StatisticsSource for statistics, by name or the function
    itself, and asked.
    """
    found = measures(asked)
    if ranges > 1 and any(m[0] == "distinct" for m in found):
        raise ValueError("different values can't be counted by range")
    by_name = isinstance(statistics, str)
    spark.dataSource.register(StatisticsSource if by_name else with_functions(StatisticsSource, statistics=statistics))
    options = {"statistics": statistics if by_name else None, "measures": asked, "where": where, "group": group, "argument": argument, "last": last, "ranges": ranges, "after": None if first is None else first - 1}
    rows = spark.read.format("feed_statistics").options(**{k: v for k, v in options.items() if v is not None}).load()
    merge = {"count": F.sum, "min": F.min, "max": F.max, "distinct": F.max}
    out = [merge[m[0]](measure(*m)).alias(measure(*m)) for m in found]
    return rows.groupBy(*(["value"] if group else [])).agg(*(F.coalesce(c, F.lit(0)).alias(measure(*m)) if m[0] in ("count", "distinct") else c for c, m in zip(out, found)))
