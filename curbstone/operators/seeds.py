"""Stored reference maps brought up to their seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(stored: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """The rows of both by key, with change: inserted, updated, deleted (in stored alone) or unchanged; values are the seed's where it has the key.

    Nulls equal nulls. Keys are unique in each; a null key matches none. The next stored map is what isn't deleted.
    """
    values = [c for c in seed.columns if c != key]
    t = stored.select(F.col(key).alias("__t"), F.struct(*values).alias("t"))
    s = seed.select(F.col(key).alias("__s"), F.struct(*values).alias("s"))
    change = F.when(F.col("__s").isNull(), "deleted").when(F.col("__t").isNull(), "inserted").when(F.col("t").eqNullSafe(F.col("s")), "unchanged").otherwise("updated")
    rows = t.join(s, F.col("__t") == F.col("__s"), "full").withColumn("change", change)
    return rows.select(F.coalesce("__s", "__t").alias(key), *(F.coalesce("s", "t")[c].alias(c) for c in values), "change")
