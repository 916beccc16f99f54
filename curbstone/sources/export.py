"""What is written for people and tests: samples of rows by predicate, and features as compact GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def capture(rows: DataFrame, predicates: dict[str, Column], n: int, key: str = "object_id") -> DataFrame:
    """(fixture, rows' columns): the n rows with the smallest key of each predicate; a row stands once, under the first predicate that takes it.

    Predicates are evaluated in one scan; a row that several take is taken by each before it is shown under one, so that a
    predicate never gives way to another.
    """
    names = F.array_compact(F.array(*(F.when(p, F.struct(F.lit(k).alias("place"), F.lit(name).alias("fixture"))) for k, (name, p) in enumerate(predicates.items()))))
    taken = rows.withColumn("__f", F.explode(names)).withColumn("__rn", F.row_number().over(Window.partitionBy("__f.place").orderBy(key))).filter(F.col("__rn") <= n)
    first = F.row_number().over(Window.partitionBy(key).orderBy("__f.place"))
    return taken.withColumn("__rn", first).filter("__rn = 1").select(F.col("__f.fixture").alias("fixture"), *rows.columns)


def geojson(rows: DataFrame, longitude: str = "longitude", latitude: str = "latitude", digits: int = 6) -> DataFrame:
    """(feature): each row as a GeoJSON point without white space, coordinates rounded, other columns as properties, nulls left out."""
    others = [c for c in rows.columns if c not in (longitude, latitude)]
    at = F.array(*(F.round(F.col(c).cast("double"), digits) for c in (longitude, latitude)))
    point = F.when(F.col(longitude).isNotNull() & F.col(latitude).isNotNull(), F.struct(F.lit("Point").alias("type"), at.alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*others).alias("properties"))
    return rows.select(F.to_json(feature).alias("feature"))
