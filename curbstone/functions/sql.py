"""The text and time cleaners as SQL functions: bodies that Spark inlines, so queries in SQL run without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from curbstone.functions.clean import ZONE

_BLANK = r"nullif(regexp_replace(regexp_replace(s, r'(?U)^\s+|\s+$', ''), r'(?U)\s+', ' '), '')"
#: Name: (arguments, type, body). They say what the functions of the same name in text.py and clean.py say.
FUNCTIONS = {
    "null_if_blank": ("s STRING", "STRING", _BLANK),
    "map_key": ("s STRING", "STRING", "nullif(lower(regexp_replace(s, '[^A-Za-z0-9]', '')), '')"),
    "slug": ("s STRING", "STRING", "nullif(regexp_replace(regexp_replace(regexp_replace(lower(s), r\"['’]\", ''), '[^a-z0-9]+', '-'), '^-+|-+$', ''), '')"),
    "clean_zip": ("s STRING", "STRING", r"nullif(regexp_extract(null_if_blank(s), r'^(\d{5})(?:[- ]?\d{4})?$', 1), '')"),
    "local_date": ("t TIMESTAMP", "DATE", f"to_date(from_utc_timestamp(t, '{ZONE}'))"),
    "week_start": ("d DATE", "DATE", "to_date(date_trunc('week', d))"),
}


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS temporary functions of the session; those that are there under these names are replaced."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
