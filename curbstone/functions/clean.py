"""Cleaners of one request's fields: each gives a value and, where it applies, data-quality bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbstone.functions.maps import FLAG
from curbstone.functions.text import all_of, bare, map_key, null_if_blank, slug, unspaced

# Fixed values of the feed: zone of local days, first valid date, bounding box, placeholders, longest key.
ZONE, FIRST_VALID = "America/Los_Angeles", "2000-01-01"
WEST, EAST, SOUTH, NORTH = "-122.0", "-120.9", "38.2", "39.0"
JUNK_ADDRESSES = ("na", "tbd", "ok", "zoom", "none", "unknown")
LONGEST_REFERENCE = 50

#: Raw values that make up a row's hash, in order; the name as served and our column.
HASHED = (
    ("ReferenceNumber", "reference_number"), ("CategoryLevel1", "category_level1"), ("CategoryLevel2", "category_level2"),
    ("CategoryName", "category_name"), ("CouncilDistrictNumber", "council_district"), ("SourceLevel1", "source_level1"),
    ("Neighborhood", "neighborhood"), ("DateCreated", "date_created"), ("DateUpdated", "date_updated"), ("DateClosed", "date_closed"),
    ("CrossStreet", "cross_street"), ("ZIP", "zip"), ("SFTicketID", "sf_ticket_id"), ("Address", "address"),
    ("Data_Source", "data_source"), ("PublicStatus", "public_status"), ("x", "x"), ("y", "y"),
)


def _bit(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(FLAG[name])).otherwise(F.lit(0))


def local_date(ts: Column) -> Column:
    """The calendar day in ZONE of a UTC time; follows daylight saving."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def clean_address(s: Column) -> tuple[Column, Column]:
    """Blank: null without a bit. A placeholder, bare digits or under 3 characters: null with AddressJunk."""
    return _address(null_if_blank(s), map_key(null_if_blank(s)))


def _address(text: Column, key: Column) -> tuple[Column, Column]:
    junk = text.isNotNull() & ((F.char_length(text) < 3) | key.isNull() | key.isin(*JUNK_ADDRESSES) | key.rlike("^[0-9]+$"))
    return F.when(~junk, text), _bit(junk, "AddressJunk")


def parse_district(s: Column) -> tuple[Column, Column, Column]:
    """(number 1 to 8, whether in the city, bits); outside the city there is no number."""
    key = F.coalesce(map_key(s), F.lit(""))
    return _district(key, _district_number(key))


def _district_number(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, "^(?:district)?0*([1-8])$", 1), F.lit("")).cast("int")


def _district(key: Column, number: Column) -> tuple[Column, Column, Column]:
    in_city = F.when(key == "noncity", F.lit(False)).when(number.isNotNull(), F.lit(True))
    return number, in_city, _bit(in_city.isNull(), "UnknownDistrict")


def epoch_time(ms: Column, now: Column) -> tuple[Column, Column]:
    """A time of epoch milliseconds: null with SentinelDate before FIRST_VALID or out of range; FutureDate a day after now."""
    value = _time(ms)
    return value, _time_bits(ms, value, now)


def _time(ms: Column) -> Column:
    inside = ms.between(F.lit(-62135596800000), F.lit(253402300799999))
    ts = F.when(inside, F.timestamp_millis(F.when(inside, ms)))
    return F.when(inside & (ts >= F.lit(FIRST_VALID).cast("timestamp")), ts)


def _time_bits(ms: Column, value: Column, now: Column) -> Column:
    late = value > now + F.expr("INTERVAL 1 DAY")
    return _bit(ms.isNotNull() & value.isNull(), "SentinelDate") + _bit(F.coalesce(late, F.lit(False)), "FutureDate")


def clean_point(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """(latitude, longitude, bits): rounded to 6 digits inside the box, null with GeoOutOfBounds outside, null if missing."""
    there = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    inside = there & x.between(F.lit(float(WEST)), F.lit(float(EAST))) & y.between(F.lit(float(SOUTH)), F.lit(float(NORTH)))
    digits = lambda v: F.when(inside, F.round(F.when(inside, v).cast("decimal(20,15)"), 6).cast("decimal(9,6)"))
    return digits(y), digits(x), _bit(there & ~inside, "GeoOutOfBounds")


def clean_neighborhood(s: Column, in_city: Column) -> tuple[Column, Column, Column, Column]:
    """(name, key, slug, bits); backslashes are slashes. Missing within the city: NeighborhoodMissingInCity."""
    name = null_if_blank(F.translate(s, "\\", "/"))
    return name, map_key(name), slug(name), _neighborhood_bits(name, in_city)


def _neighborhood_bits(name: Column, in_city: Column) -> Column:
    return _bit(name.isNull() & F.coalesce(in_city, F.lit(False)), "NeighborhoodMissingInCity")


def clean_zip(s: Column) -> tuple[Column, Column]:
    """The 5 digits of a ZIP or ZIP+4 code; null with InvalidZip for other text, null for blank."""
    text = null_if_blank(s)
    return _zip(text, _five(text))


def _five(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^(\d{5})(?:[- ]?\d{4})?$", 1), F.lit(""))


def _zip(text: Column, five: Column) -> tuple[Column, Column]:
    return five, _bit(text.isNotNull() & five.isNull(), "InvalidZip")


def status_group(s: Column) -> tuple[Column, Column]:
    group = _status(map_key(s))
    return group, _status_bits(group)


def _status(key: Column) -> Column:
    return (
        F.when(key.isin("new", "inprogress"), "Open").when(key == "closed", "Closed").when(key.isin("cancelled", "canceled"), "Cancelled").otherwise("Unknown")
    )


def _status_bits(group: Column) -> Column:
    return _bit(group == "Unknown", "UnknownStatus")


def resolution(status: Column, created: Column, updated: Column, closed: Column, days_of: dict[str, Column] | None = None) -> tuple[Column, Column, Column]:
    """(days to close as decimal(9,2), local day on which it left the backlog, bits).

    Days are there only for closed requests with both dates in order. A closed or cancelled request leaves the backlog when it
    closed, else when it was updated last; an unknown one when it closed; never before it was created. days_of has the local days
    of created and closed, if they are at hand.
    """
    wrong = F.coalesce(closed < created, F.lit(False))
    undated = (status == "Closed") & closed.isNull()
    hundredths = F.round((F.unix_millis(closed) - F.unix_millis(created)).cast("decimal(20,0)") / F.lit(86400000).cast("decimal(20,0)"), 2)
    days = F.when((status == "Closed") & ~wrong, hundredths.cast("decimal(9,2)"))
    of = days_of or {"created": local_date(created), "closed": local_date(closed)}
    left = F.when(status.isin("Closed", "Cancelled"), F.coalesce(of["closed"], local_date(updated))).when(status == "Unknown", of["closed"])
    day = F.when(left.isNotNull(), F.greatest(left, of["created"]))
    return days, day, _bit(wrong, "InvalidCloseOrder") + _bit(undated, "ClosedMissingDate")


def reject_reason(object_id: Column, reference: Column, updated_ms: Column) -> Column:
    """Why a row can't be identified or ordered; null if it can."""
    name = null_if_blank(reference)
    return (
        F.when(F.coalesce(object_id, F.lit(0)) <= 0, "InvalidObjectId")
        .when(name.isNull(), "MissingReferenceNumber")
        .when(F.char_length(name) > LONGEST_REFERENCE, "ReferenceNumberTooLong")
        .when(updated_ms.isNull(), "MissingDateUpdated")
        .when(updated_ms < F.unix_millis(F.lit(FIRST_VALID).cast("timestamp")), "InvalidDateUpdated")
    )


def row_hash(df: DataFrame) -> Column:
    """SHA-256 in hex of the raw values: each as name, US, NUL or SOH and the value, RS. Null and empty differ."""
    parts = []
    for name, column in HASHED:
        value = F.regexp_replace(F.col(column).cast("string"), r"\.0$", "") if name in ("x", "y") else F.col(column).cast("string")
        parts += [F.lit(name + "\x1f"), F.coalesce(F.concat(F.lit("\x01"), value), F.lit("\x00")), F.lit("\x1e")]
    return F.sha2(F.concat(*parts), 256)


#: Raw texts that are cleaned alike, and those of which a key is made.
TEXTS = (
    "reference_number", "sf_ticket_id", "category_level1", "category_level2", "category_name", "source_level1", "neighborhood", "address", "cross_street", "zip", "public_status",
)
KEYED = ("category_level1", "source_level1", "neighborhood", "address", "public_status", "council_district")


def clean(raw: DataFrame, now: Column) -> DataFrame:
    """One row for each raw row that can be identified: cleaned columns, keys for the maps, dq_flags and row_hash.

    Texts and keys come first, keys as one array, and what several columns are made of is worked out once for each row: with an
    expression for each column that holds the others, the code of a task is too long for the JVM to compile.
    """
    c = F.col
    rows = raw.filter(reject_reason(c("object_id"), c("reference_number"), c("date_updated")).isNull())
    plain = {f"__{n}_text": unspaced(F.translate(c(n), "\\", "/") if n == "neighborhood" else c(n)) for n in TEXTS}
    times = {f"__{d}": _time(c(f"date_{d}")) for d in ("created", "updated", "closed")}
    point = dict(zip(("latitude", "longitude", "__point_bits"), clean_point(c("x"), c("y"))))
    rows = rows.withColumns(plain | times | point | {"__k": all_of(bare, [c(n) for n in KEYED])})
    text = lambda n: F.when(c(f"__{n}_text") != "", c(f"__{n}_text"))
    key = lambda n: c("__k")[KEYED.index(n)]
    district_key = F.coalesce(key("council_district"), F.lit(""))
    rows = rows.withColumns({"__district": district_key, "__five": _five(text("zip"))})
    created, updated, closed = c("__created"), c("__updated"), c("__closed")
    rows = rows.withColumns({"__group": _status(key("public_status")), "__number": _district_number(c("__district"))} | {"__created_day": local_date(created), "__closed_day": local_date(closed)})
    status, day = c("__group"), {"created": c("__created_day"), "closed": c("__closed_day")}
    district, in_city, _ = _district(c("__district"), c("__number"))
    address, address_bits = _address(text("address"), key("address"))
    rows = rows.withColumns({"__in_city": in_city, "__clean_address": address, "__address_bits": address_bits})
    name_bits = _neighborhood_bits(text("neighborhood"), c("__in_city"))
    zip_code, zip_bits = _zip(text("zip"), c("__five"))
    time_bits = [_time_bits(c(f"date_{d}"), c(f"__{d}"), now) for d in ("created", "updated", "closed")]
    days, left, resolution_bits = resolution(status, created, updated, closed, day)
    bits = _status_bits(status)
    for more in (_bit(c("__in_city").isNull(), "UnknownDistrict"), name_bits, c("__address_bits"), zip_bits, c("__point_bits"), *time_bits, resolution_bits):
        bits = bits.bitwiseOR(more)
    return rows.select(
        text("reference_number").alias("reference_number"), "object_id", *(text(n).alias(n) for n in ("sf_ticket_id", "category_level1", "category_level2", "category_name")),
        key("category_level1").alias("category_key"), text("source_level1").alias("source_channel_raw"), key("source_level1").alias("source_key"),
        district.alias("district_number"), c("__in_city").alias("is_city"), text("neighborhood").alias("neighborhood"), key("neighborhood").alias("neighborhood_key"),
        slug(text("neighborhood")).alias("neighborhood_slug"), c("__clean_address").alias("address"), text("cross_street").alias("cross_street"), zip_code.alias("zip"),
        "latitude", "longitude", text("public_status").alias("public_status"), status.alias("status_group"),
        created.alias("created_utc"), updated.alias("updated_utc"), closed.alias("closed_utc"),
        day["created"].alias("created_date_local"), day["closed"].alias("closed_date_local"), left.alias("backlog_close_date_local"),
        days.alias("days_to_close"), bits.alias("dq_flags"), row_hash(raw).alias("row_hash"),
    )
