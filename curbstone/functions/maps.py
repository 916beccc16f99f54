"""Reference data: flags, maps and rule constants, as rows for small broadcast frames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Data-quality bits, names and meanings.
DQ_FLAGS = (
    (1, "SentinelDate", "A date before 2000 was set to null."),
    (2, "FutureDate", "A date more than one day after the time of cleaning."),
    (4, "InvalidCloseOrder", "The close date is earlier than the created date."),
    (8, "ClosedMissingDate", "The status is closed but there is no close date."),
    (16, "AddressJunk", "The address was a placeholder and was set to null."),
    (32, "NeighborhoodMissingInCity", "A row inside the city has no neighborhood."),
    (64, "GeoOutOfBounds", "The point is outside the bounding box and was set to null."),
    (128, "UnmappedCategory", "The category has no row in the category map."),
    (256, "UnmappedSource", "The source has no row in the source map."),
    (512, "UnknownStatus", "The status is not a known one."),
    (1024, "UnknownDistrict", "The district is neither a number nor outside the city."),
    (2048, "InvalidZip", "The ZIP code was not valid and was set to null."),
    (4096, "BulkClosure", "Label: closed in a clear-out; counted as recorded."),
)
FLAG = {name: bit for bit, name, _ in DQ_FLAGS}
#: Date problems, which leave a request out of timing; and labels, which classification sets after cleaning.
DATE_PROBLEMS, LABELS = 1 | 2 | 4 | 8, 4096

_OTHER = "Too few requests to report on its own, so grouped as Other."
# Category as served, group, and why it isn't a request for service (None: it is).
CATEGORIES = (
    ("Solid Waste", "Solid Waste", None),
    ("Other", "Other", "Information and referral calls."),
    ("Animal Control", "Animal Control", None),
    ("Homeless Camp", "Homeless Camp", None),
    ("Code Enforcement", "Code Enforcement", None),
    ("Homeless Camp - Primary", "Homeless Camp", None),
    ("Parking", "Parking", None),
    ("Streets", "Streets", None),
    ("Review", "Process/Unclassified", "An inbox bucket, not requests for service."),
    ("Building and Planning", "Building and Planning", None),
    ("Water", "Water", None),
    ("Facilities", "Facilities", None),
    ("Urban Forestry", "Urban Forestry", None),
    ("Parks", "Parks", None),
    ("Utility Billing", "Utility Billing", None),
    ("Shared Rideables", "Shared Rideables", None),
    ("Sewer", "Sewer", None),
    ("Drains", "Drains", None),
    ("Park Rangers", "Park Rangers", None),
    ("Escalation", "Process/Unclassified", "A routing bucket: how a call was handled."),
    ("Web Form", "Process/Unclassified", "A form bucket: correspondence."),
    ("Business Resources", "Business Resources", None),
    ("Measure O notice and Demand", "Measure O", None),
    ("Community Tag", "Other", _OTHER),
    ("Homeless Services", "Other", _OTHER),
    ("DCR", "Other", _OTHER),
    ("CDD-Planning", "Other", _OTHER),
)

# Source as served and channel.
SOURCES = (
    ("Phone", "Phone"),
    ("Web", "Web"),
    ("Email", "Email"),
    ("GoogleAI", "Google AI"),
    ("Public_Works_Facilities_Work_Order_Request_Form", "Web Form"),
    ("Mayor_Form_City_Web", "Web Form"),
    ("Mayor_Form_EngageSac", "Web Form"),
    *((f"Council District {n} Form", "Web Form") for n in range(1, 9)),
    ("DCR AB130 Form", "Web Form"),
    ("Archive Mobile App", "Mobile App"),
    ("Mayor's Office", "Other"),
)

# Category and line in it that isn't a request for service, and why.
NON_SERVICE_LINES = (
    ("Animal Control", "General - Other", "Information call on another topic."),
    ("Animal Control", "General - Duplicate Request", "A duplicate of a request already logged."),
    ("Animal Control", "General - After Hours Call", "An after-hours call logged for the record."),
    ("Animal Control", "General - Adoption", "Information call about adoption."),
    ("Animal Control", "General - Spay/ Neuter", "A question about having a pet neutered."),
    ("Animal Control", "General - Investigation", "Information call about an investigation."),
    ("Animal Control", "General - License", "Information call about pet licenses."),
    ("Animal Control", "General - Found Animal", "Information call about a found animal."),
    ("Animal Control", "General - Barking", "Information call about barking."),
    ("Building and Planning", "General", "Information call."),
    ("Parking", "General", "Information call."),
    ("Parks", "General", "Information call."),
    ("Urban Forestry", "General", "Information call."),
    ("Shared Rideables", "Lime", "Referred to the operator."),
    ("Shared Rideables", "Bird", "Referred to the operator."),
)

# Names of neighborhoods.
NEIGHBORHOODS = (
    "Airport", "Alhambra Triangle", "Alkali Flat", "American River Parkway", "Arden Fair",
    "Avondale", "Belvedere", "Ben Ali", "Boulevard Park", "Brentwood",
    "CSUS", "Cal Expo", "Campus Commons", "Cannon Industrial Park", "Carleton Tract",
    "Central Oak Park", "College Town", "College/Glen", "Colonial Heights", "Colonial Manor",
    "Colonial Village", "Creekside", "Curtis Park", "Del Paso Heights", "Del Paso Park",
    "Depot Park", "Dos Rios Triangle", "Downtown", "East Del Paso Heights", "East Sacramento",
    "Elder Creek", "Elmhurst", "Erikson Industrial Park", "Fairgrounds", "Florin Fruitridge Industrial Park",
    "Freeport Manor", "Fruitridge Manor", "Gardenland", "Gateway Center", "Gateway West",
    "Glen Elder", "Glenwood Meadows", "Golf Course Terrace", "Granite Regional Park", "Greenbriar",
    "Greenhaven", "Hagginwood", "Hansen Park Golf Course Site", "Heritage Park", "Hollywood Park",
    "Johnson Business Park", "Johnson Heights", "Land Park", "Lawrence Park", "Little Pocket",
    "Mangan Park", "Mansion Flats", "Marshall School", "Meadowview", "Med Center",
    "Metro Center", "Midtown / Winn Park / Capital Avenue", "Morrison Creek", "Natomas Corporate Center", "Natomas Creek",
    "Natomas Crossing", "Natomas Park", "New Brighton", "New Era Park", "Newton Booth",
    "Noralto", "North City Farms", "North Oak Park", "Northgate", "Northpointe",
    "Norwood I-80", "Norwood Tech", "Oak Knoll", "Old North Sacramento", "Old Sacramento",
    "Parker Homes", "Parkway", "Pell/Main Industrial Park", "Pocket", "Point West",
    "Power Ridge", "RP - Sports Complex", "Raley Industrial Park", "Ramona Village", "Regency Park",
    "Richardson Village", "Richmond Grove", "River Gardens", "River Park", "Robla",
    "SCC", "Sierra Oaks", "South City Farms", "South Hagginwood", "South Land Park",
    "South Natomas", "South Oak Park", "Southeast Village", "Southern Pacific / Richards", "Southside Park",
    "Strawberry Manor", "Sundance Lake", "Swanston Estates", "Tahoe Park", "Tahoe Park East",
    "Tahoe Park South", "Tallac Village", "Upper Land Park", "Valley Hi / North Laguna", "Valleyview Acres",
    "Village 12", "Village 14", "Village 5", "Village 7", "Village Green",
    "West Del Paso Heights", "West Tahoe Park", "Westlake", "Willowcreek", "Wills Acres",
    "Woodbine", "Woodlake", "Youngs Heights", "Z'berg Park",
)

# Closures older than DETECT_AGE days make a clear-out day (MIN_COUNT in a category) or a sweep minute
# (SWEEP_COUNT in any); members are older than MEMBER_AGE days.
MIN_COUNT, SWEEP_COUNT, DETECT_AGE, MEMBER_AGE = 100, 50, 180, 90
# Days of the windows, and the first day of the backlog series.
WINDOWS, BACKLOG_START = (30, 90, 365), "2024-01-01"
UNMAPPED = "Unmapped"


def key_of(text: str) -> str | None:
    """As functions.text.map_key, for the driver."""
    return re.sub("[^a-z0-9]", "", "".join(c.lower() if c.isascii() else "" for c in text)) or None


def slug_of(name: str) -> str | None:
    """As functions.text.slug, for the driver."""
    return re.sub("[^a-z0-9]+", "-", re.sub("['\u2019]", "", name.lower())).strip("-") or None


def category_map(spark: SparkSession, rows: tuple = CATEGORIES) -> DataFrame:
    found = [(key_of(v), v, g, why is None, why) for v, g, why in rows]
    return spark.createDataFrame(found, "category_key string, source_value string, category_group string, is_service boolean, reason string")


def source_map(spark: SparkSession, rows: tuple = SOURCES) -> DataFrame:
    return spark.createDataFrame([(key_of(v), v, c) for v, c in rows], "source_key string, source_value string, source_channel string")


def neighborhood_map(spark: SparkSession, names: tuple = NEIGHBORHOODS) -> DataFrame:
    return spark.createDataFrame([(key_of(n), n, slug_of(n)) for n in names], "alias_key string, neighborhood string, neighborhood_slug string")


def line_map(spark: SparkSession, rows: tuple = NON_SERVICE_LINES) -> DataFrame:
    found = [(key_of(a), key_of(b), a, b, why) for a, b, why in rows]
    return spark.createDataFrame(found, "category_key string, category_level2_key string, source_level1 string, source_level2 string, reason string")


def flag_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DQ_FLAGS), "bit int, name string, description string")
