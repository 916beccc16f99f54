import hashlib
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from curbstone.functions import clean as C
from curbstone.functions import maps as M
from curbstone.functions.text import escape_html, map_key, null_if_blank, slug


def one(spark, value, kind, *columns):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return tuple(df.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


@pytest.mark.parametrize(("text", "want"), [(None, None), ("", None), (" \t ", None), ("  a   b ", "a b")])
def test_null_if_blank(spark, text, want):
    assert one(spark, text, "string", null_if_blank(F.col("v"))) == (want,)


@pytest.mark.parametrize(("text", "want"), [(None, None), ("Google AI", "googleai"), ("GoogleAI", "googleai"), ("--", None), ("Homeless Camp - Primary", "homelesscampprimary"), ("İx", "x")])
def test_map_key(spark, text, want):
    assert one(spark, text, "string", map_key(F.col("v"))) == (want,)
    assert text is None or M.key_of(text) == want


@pytest.mark.parametrize(("text", "want"), [("A/B", "a-b"), ("A / B", "a-b"), ("Z'berg Park", "zberg-park"), ("Z’berg", "zberg"), ("--", None), ("Village 12", "village-12")])
def test_slug(spark, text, want):
    assert one(spark, text, "string", slug(F.col("v"))) == (want,)
    assert M.slug_of(text) == want


@pytest.mark.parametrize(("text", "want"), [("", (None, 0)), (None, (None, 0)), ("N/A", (None, 16)), ("Zoom", (None, 16)), ("12", (None, 16)), ("12345", (None, 16)), ("ab", (None, 16)), ("--- -", (None, 16)), (" 915  I St ", ("915 I St", 0))])
def test_address(spark, text, want):
    assert one(spark, text, "string", *C.clean_address(F.col("v"))) == want


@pytest.mark.parametrize(("text", "want"), [("District 4", (4, True, 0)), ("4", (4, True, 0)), ("District 04", (4, True, 0)), ("Non City", (None, False, 0)), ("District 9", (None, None, 1024)), (None, (None, None, 1024))])
def test_district(spark, text, want):
    assert one(spark, text, "string", *C.parse_district(F.col("v"))) == want


@pytest.mark.parametrize(("text", "want"), [("95814", ("95814", 0)), ("95814-1234", ("95814", 0)), ("958141234", ("95814", 0)), ("9581", (None, 2048)), (" ", (None, 0)), (None, (None, 0))])
def test_zip(spark, text, want):
    assert one(spark, text, "string", *C.clean_zip(F.col("v"))) == want


@pytest.mark.parametrize(("text", "want"), [("NEW", "Open"), ("In Progress", "Open"), ("CLOSED", "Closed"), ("Canceled", "Cancelled"), ("Cancelled", "Cancelled"), (None, "Unknown"), ("??", "Unknown")])
def test_status(spark, text, want):
    assert one(spark, text, "string", *C.status_group(F.col("v"))) == (want, 512 if want == "Unknown" else 0)


NOW = datetime(2026, 1, 2, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    ("ms", "bits", "there"), [(None, 0, False), (-2209161600000, 1, False), (-(1 << 63), 1, False), ((1 << 63) - 1, 1, False), (946684800000, 0, True), (946684799999, 1, False), (1767398400001, 2, True), (1767398400000, 0, True)]
)
def test_epoch_time(spark, ms, bits, there):
    value, flags = one(spark, ms, "bigint", *C.epoch_time(F.col("v"), F.lit(NOW)))
    assert (value is not None, flags) == (there, bits)


@pytest.mark.parametrize(("x", "y", "want"), [(-122.0, 38.2, (Decimal("38.200000"), Decimal("-122.000000"), 0)), (-122.000001, 38.5, (None, None, 64)), (float("nan"), 38.5, (None, None, 0)), (None, 38.5, (None, None, 0)), (-121.4954330978, 38.5217122067, (Decimal("38.521712"), Decimal("-121.495433"), 0))])
def test_point(spark, x, y, want):
    df = spark.createDataFrame([(x, y)], "x double, y double")
    lat, lon, bits = C.clean_point(F.col("x"), F.col("y"))
    assert tuple(df.select(lat.alias("a"), lon.alias("b"), bits.alias("c")).first()) == want


def test_local_date_follows_daylight_saving(spark):
    df = spark.sql("select timestamp'2024-03-10 07:59:59' a, timestamp'2024-03-10 08:00:00' b, timestamp'2024-07-01 06:59:59' c, timestamp'2024-07-01 07:00:00' d")
    assert tuple(df.select(*[C.local_date(F.col(c)) for c in "abcd"]).first()) == (date(2024, 3, 9), date(2024, 3, 10), date(2024, 6, 30), date(2024, 7, 1))


@pytest.mark.parametrize(
    ("status", "created", "updated", "closed", "want"),
    [
        ("Closed", "2024-01-01 12:00:00", "2024-01-05 12:00:00", "2024-01-02 13:12:00", (Decimal("1.05"), date(2024, 1, 2), 0)),
        ("Closed", "2024-01-02 12:00:00", "2024-01-05 12:00:00", "2024-01-01 12:00:00", (None, date(2024, 1, 2), 4)),
        ("Closed", "2024-01-02 12:00:00", "2024-01-05 12:00:00", None, (None, date(2024, 1, 5), 8)),
        ("Cancelled", "2024-01-02 12:00:00", "2024-01-05 12:00:00", None, (None, date(2024, 1, 5), 0)),
        ("Open", "2024-01-02 12:00:00", "2024-01-05 12:00:00", "2024-01-06 12:00:00", (None, None, 0)),
        ("Unknown", None, "2024-01-05 12:00:00", "2024-01-06 12:00:00", (None, date(2024, 1, 6), 0)),
    ],
)
def test_resolution(spark, status, created, updated, closed, want):
    df = spark.createDataFrame([(status, created, updated, closed)], "s string, a string, b string, c string")
    df = df.select("s", *[F.col(x).cast("timestamp").alias(x) for x in "abc"])
    days, day, bits = C.resolution(F.col("s"), F.col("a"), F.col("b"), F.col("c"))
    assert tuple(df.select(days.alias("x"), day.alias("y"), bits.alias("z")).first()) == want


@pytest.mark.parametrize(("object_id", "ref", "updated", "want"), [(0, "a", 1767225600000, "InvalidObjectId"), (1, " ", 1767225600000, "MissingReferenceNumber"), (1, "x" * 51, 1767225600000, "ReferenceNumberTooLong"), (1, "a", None, "MissingDateUpdated"), (1, "a", 0, "InvalidDateUpdated"), (1, "a", 946684800000, None)])
def test_reject_reason(spark, object_id, ref, updated, want):
    df = spark.createDataFrame([(object_id, ref, updated)], "o bigint, r string, u bigint")
    assert df.select(C.reject_reason(F.col("o"), F.col("r"), F.col("u"))).first()[0] == want


def test_row_hash_is_over_named_values(spark):
    values = {c: f"v{k}" for k, (_, c) in enumerate(C.HASHED)} | {"date_created": 5, "date_updated": 6, "date_closed": None, "x": -121.5, "y": 38.0, "cross_street": ""}
    schema = ", ".join(f"{c} {'bigint' if c.startswith('date_') else 'double' if c in 'xy' else 'string'}" for _, c in C.HASHED)
    df = spark.createDataFrame([tuple(values[c] for _, c in C.HASHED)], schema)
    text = "".join(f"{n}\x1f" + ("\x00" if values[c] is None else "\x01" + {"y": "38"}.get(c, str(values[c]))) + "\x1e" for n, c in C.HASHED)
    assert df.select(C.row_hash(df)).first()[0] == hashlib.sha256(text.encode()).hexdigest()


def test_maps_are_whole_and_agree_with_their_rules(spark):
    assert (len(M.CATEGORIES), len(M.SOURCES), len(M.NON_SERVICE_LINES), len(M.NEIGHBORHOODS), len(M.DQ_FLAGS)) == (27, 18, 15, 129, 13)
    assert sum(why is not None for _, _, why in M.CATEGORIES) == 8 and len({c for _, c in M.SOURCES}) == 7
    for rows, key in ((M.category_map(spark), "category_key"), (M.source_map(spark), "source_key"), (M.neighborhood_map(spark), "alias_key")):
        assert rows.select(key).distinct().count() == rows.count() and not rows.filter(F.col(key).isNull()).count()
    assert [b for b, _, _ in M.DQ_FLAGS] == [1 << k for k in range(13)]


def test_escape_html(spark):
    assert one(spark, "<a href=\"x\">O'B & C</a>", "string", escape_html(F.col("v"))) == ("&lt;a href=&quot;x&quot;&gt;O&#39;B &amp; C&lt;/a&gt;",)


def test_rules_as_columns_say_what_the_jobs_say(spark):
    """Each rule on values at, beside and without its bound, against the function that a job calls."""
    from datetime import datetime, timedelta, timezone

    from pyspark.sql import functions as F

    from curbstone.functions import rules
    from curbstone.operators import quality
    from curbstone.operators.reconcile import guard_fails
    from curbstone.plans import jobs

    times = [datetime(2026, 1, 2, tzinfo=timezone.utc) + timedelta(hours=h) for h in (-30, -1, 0, 5)]
    numbers = [0, 1, 23, 24, 25, 94, 95, 96, 100, 105, 106]
    plain = lambda t: t and t.replace(tzinfo=None)
    rows = [(plain(a), plain(b), plain(c)) for a in times for b in (None, *times) for c in (None, *times)]
    t = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz")
    utc = lambda x: x and x.replace(tzinfo=timezone.utc)
    for r in t.select("*", rules.next_watermark(F.col("a"), F.col("b"), F.coalesce("c", "a")).alias("w"), rules.seed_watermark(F.col("a"), F.col("b"), F.col("c")).alias("s"), rules.refresh_due(F.lit(0), F.to_date("b"), F.to_date("a")).alias("d")).collect():
        a, b, c = utc(r["a"]), utc(r["b"]), utc(r["c"])
        assert utc(r["w"]) == jobs.next_watermark(a, b, c or a) and utc(r["s"]) == jobs.seed_watermark(a, b, c) and r["d"] == jobs.refresh_due(0, b and b.date(), a.date())
    t = spark.createDataFrame([(n, b) for n in numbers for b in (None, *numbers)], "n long, b long")
    for r in t.select("*", rules.guard_fails(F.col("n"), F.col("b")).alias("g"), rules.source_count(F.col("n"), F.col("b")).alias("s"), rules.page_count(F.col("n"), F.col("b")).alias("p")).collect():
        assert r["g"] == guard_fails(r["n"], r["b"]) and r["s"] == quality.source_count(r["n"], r["b"])["status"]
        assert r["b"] is None or r["p"] == quality.page_count_check(r["n"], r["b"])


def test_code_of_cleaning_is_short_enough_to_be_compiled(spark, tmp_path):
    """The JVM doesn't compile methods over 8,000 bytes, which made cleaning twice as slow."""
    import re

    from curbstone.functions.clean import HASHED, clean

    kinds = {"date_created": "long", "date_updated": "long", "date_closed": "long", "x": "double", "y": "double"}
    schema = "object_id long, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for _, c in HASHED)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "raw"))
    rows = clean(spark.read.schema(schema).parquet(str(tmp_path / "raw")), F.current_timestamp()).drop("row_hash")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000
