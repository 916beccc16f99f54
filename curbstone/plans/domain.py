"""Service requests made from the star-schema test tables, in Spark and as a DuckDB prologue that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbstone.functions.maps import CATEGORIES, DATE_PROBLEMS, DQ_FLAGS, NON_SERVICE_LINES, SOURCES, UNMAPPED, category_map, key_of, line_map, source_map
from curbstone.functions.text import map_key, slug
from curbstone.operators.classify import clear_out_days, non_service_pairs, sweep_minutes, with_bulk, with_service
from curbstone.session import materialized

AS_OF, BACKLOG_FROM, WINDOWS = "2001-06-30", "2001-01-01", (30, 90, 365)
#: Thresholds of clear-outs on these tables, where days have few closures.
DAY_LEAST, SWEEP_LEAST = 3, 8

# What stands in for served values.
TYPES = {"STANDARD": "Solid Waste", "MEDIUM": "Animal Control", "PROMO": "Other", "LARGE": "Parking", "SMALL": "Homeless Camp - Primary", "ECONOMY": "Oddments"}
BRANDS = {"Brand#1": "General", "Brand#2": "General - Adoption", "Brand#3": None}
SEGMENTS = {"MACHINERY": "Phone", "BUILDING": "GoogleAI", "AUTOMOBILE": "Mayor_Form_City_Web", "HOUSEHOLD": "Web", "FURNITURE": "Fax"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(day: str = AS_OF):
    return F.lit(day).cast("date")


def _choice(column: str, values: dict):
    out = F.col(column)
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of lineitem and orders that versions are made of."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_linestatus")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("updated_ts", F.greatest("o_orderdate", "l_shipdate"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") != 24, F.col("n_name"))
    return load(spark, sf_dir, "nation").select(
        "n_nationkey", F.when(F.col("n_regionkey") != 4, F.col("n_regionkey") + 1).alias("district_number"), (F.col("n_regionkey") != 4).alias("is_city"),
        name.alias("neighborhood"), slug(name).alias("neighborhood_slug"),
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", _choice("c_mktsegment", SEGMENTS).alias("source_level1"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", _choice("p_type", TYPES).alias("category_level1"), _choice("p_brand", BRANDS).alias("category_level2"))


def _as_requests(rows: DataFrame, *more: str) -> DataFrame:
    """Lines with their order, part, customer and nation as requests; more are further columns to keep."""
    status = F.when(F.col("l_linestatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "P", "IN PROGRESS").otherwise("NEW")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("reference_number"), F.col("l_partkey").alias("object_id"), "category_level1", "category_level2", "source_level1",
        "district_number", "is_city", "neighborhood", "neighborhood_slug", status.alias("public_status"),
        F.col("o_orderdate").alias("created_ts"), "updated_ts", F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("closed_ts"), "l_shipdate", "l_linestatus", *more,
    )


def _described(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Requests of lines; what is said of a nation, a customer or a part is worked out once for each."""
    customer = _customers(spark, sf_dir).join(F.broadcast(_nations(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = lines.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(_parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return _as_requests(rows)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every request, one for each lineitem: about one in four repeats a reference number."""
    return _described(spark, sf_dir, _lines(spark, sf_dir))


def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """latest(versions()), found before versions are described, where the join of the lines has put a request's versions together."""
    order = [F.desc(c) for c in ("updated_ts", "l_partkey", "l_shipdate", "l_linestatus")]
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order))
    return _described(spark, sf_dir, _lines(spark, sf_dir).withColumn("rn", place).filter("rn = 1").drop("rn"))


def latest(rows: DataFrame) -> DataFrame:
    """The newest version of each reference number; ties by object and then by all that can differ."""
    order = [F.desc(c) for c in ("updated_ts", "object_id", "l_shipdate", "l_linestatus")]
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("reference_number").orderBy(*order))).filter("rn = 1").drop("rn")


def _with_group(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows with g, the group of their category or null."""
    categories = category_map(spark).select("category_key", F.col("category_group").alias("g"))
    return rows.join(F.broadcast(categories), map_key(F.col("category_level1")) == F.col("category_key"), "left").drop("category_key")


def _with_channel(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows with s, the channel of their source or null."""
    sources = source_map(spark).select("source_key", F.col("source_channel").alias("s"))
    return rows.join(F.broadcast(sources), map_key(F.col("source_level1")) == F.col("source_key"), "left").drop("source_key")


def _with_days(rows: DataFrame) -> DataFrame:
    """Requests that have g and s with days and bits."""
    c = F.col
    wrong = F.coalesce(c("closed_ts") < c("created_ts"), F.lit(False))
    late = F.greatest("created_ts", "updated_ts", "closed_ts") > F.lit(AS_OF).cast("timestamp") + F.expr("INTERVAL 1 DAY")
    bit = lambda cond, b: F.when(cond, b).otherwise(0)
    status = F.when(c("public_status") == "CLOSED", "Closed").otherwise("Open")
    flags = bit(late, 2) + bit(wrong, 4) + bit(c("is_city") & c("neighborhood").isNull(), 32) + bit(c("g").isNull(), 128) + bit(c("s").isNull(), 256)
    rows = rows.select(
        "*", F.coalesce("g", F.lit(UNMAPPED)).alias("category_group"), F.coalesce("s", F.lit(UNMAPPED)).alias("source_channel"), status.alias("status_group"),
        F.to_date("created_ts").alias("created_date"), F.to_date("closed_ts").alias("closed_date"),
        F.when(status == "Closed", F.greatest(F.to_date("closed_ts"), F.to_date("created_ts"))).alias("backlog_close_date"),
        F.when((status == "Closed") & ~wrong, F.datediff("closed_ts", "created_ts").cast("long") * 100).alias("hundredths"),
        flags.alias("dq_flags"), F.lit(True).alias("present"),
    )
    timed = (c("dq_flags").bitwiseAND(DATE_PROBLEMS) == 0) & c("hundredths").isNotNull() & c("closed_date").isNotNull()
    return rows.withColumn("timed", timed).drop("g", "s", "l_shipdate", "l_linestatus")


def cleaned(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Newest versions, or such rows, with maps resolved, days, bits and groups; without classification."""
    rows = newest_versions(spark, sf_dir) if rows is None else rows
    return _with_days(_with_channel(spark, _with_group(spark, rows)))


def held_and_newest(spark: SparkSession, sf_dir: str, known: Column) -> DataFrame:
    """cleaned() of latest(versions()), now, and of the latest of those versions for which known says so by l_partkey, held: a row for each
    request where both are the same version, else one for each. service is whether it is for service.

    One pass finds both: lines meet their parts and orders their customers first, so that the join by order, after which a request's
    versions are together, is the last. Groups, service and channels are worked out once for each part and customer.
    """
    about = _parts(spark, sf_dir)
    about = with_service(_with_group(spark, about), non_service_pairs(about, category_map(spark), line_map(spark)))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_linestatus")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    lines = lines.join(about, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    orders = orders.join(_with_channel(spark, _customers(spark, sf_dir)), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("updated_ts", F.greatest("o_orderdate", "l_shipdate"))
    order = [F.desc(c) for c in ("updated_ts", "l_partkey", "l_shipdate", "l_linestatus")]
    over = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order)
    upto = F.sum(F.when(known, 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"now": F.row_number().over(over) == 1, "held": F.coalesce(known, F.lit(False)) & (upto == 1)}).filter("now or held")
    rows = rows.join(F.broadcast(_nations(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    return _with_days(_as_requests(rows, "g", "s", "service", "now", "held"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cleaned() with service and bulk."""
    rows = materialized(cleaned(spark, sf_dir))  # read once for the pairs, the days, the minutes and the result
    rows = with_service(rows, non_service_pairs(rows, category_map(spark), line_map(spark)))
    return with_bulk(rows, clear_out_days(rows, DAY_LEAST), sweep_minutes(rows, SWEEP_LEAST))


def _q(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + ")"


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in values.items()) + f" ELSE {column} END"


def key_sql(column: str) -> str:
    return f"nullif(lower(regexp_replace({column}, '[^A-Za-z0-9]', '', 'g')), '')"


#: CTEs category_map, source_map, line_map, flag_map, versions, latest, cleaned, pairs, served, clear_days, sweeps and requests.
SQL = f"""
WITH {_values("category_map", "k, v, g, reason", [(key_of(v), v, g, why) for v, g, why in CATEGORIES])},
{_values("source_map", "k, c", [(key_of(v), c) for v, c in SOURCES])},
{_values("line_map", "k1, k2, v, reason", [(key_of(a), key_of(b), f"{a} / {b}", why) for a, b, why in NON_SERVICE_LINES])},
{_values("flag_map", "bit, name, description", DQ_FLAGS)},
versions AS (
  SELECT l_orderkey || '-' || l_linenumber AS reference_number, l_partkey AS object_id, {_case("p_type", TYPES)} AS category_level1,
    {_case("p_brand", BRANDS)} AS category_level2, {_case("c_mktsegment", SEGMENTS)} AS source_level1,
    CASE WHEN n_regionkey <> 4 THEN n_regionkey + 1 END AS district_number, n_regionkey <> 4 AS is_city,
    CASE WHEN n_nationkey <> 24 THEN n_name END AS neighborhood,
    CASE WHEN n_nationkey <> 24 THEN lower(replace(n_name, '_', '-')) END AS neighborhood_slug,
    CASE WHEN l_linestatus = 'F' THEN 'CLOSED' WHEN o_orderstatus = 'P' THEN 'IN PROGRESS' ELSE 'NEW' END AS public_status,
    o_orderdate AS created_ts, greatest(o_orderdate, l_shipdate) AS updated_ts,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS closed_ts, l_shipdate, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
latest AS (
  SELECT * FROM versions
  QUALIFY row_number() OVER (PARTITION BY reference_number ORDER BY updated_ts DESC, object_id DESC, l_shipdate DESC, l_linestatus DESC) = 1),
mapped AS (
  SELECT l.*, coalesce(m.g, 'Unmapped') AS category_group, coalesce(s.c, 'Unmapped') AS source_channel,
    CASE WHEN public_status = 'CLOSED' THEN 'Closed' ELSE 'Open' END AS status_group,
    coalesce(closed_ts < created_ts, false) AS wrong, m.g IS NULL AS no_g, s.c IS NULL AS no_s
  FROM latest l LEFT JOIN category_map m ON m.k = {key_sql("l.category_level1")} LEFT JOIN source_map s ON s.k = {key_sql("l.source_level1")}),
cleaned AS (
  SELECT *, created_ts::DATE AS created_date, closed_ts::DATE AS closed_date,
    CASE WHEN status_group = 'Closed' THEN greatest(closed_ts::DATE, created_ts::DATE) END AS backlog_close_date,
    CASE WHEN status_group = 'Closed' AND NOT wrong THEN (closed_ts::DATE - created_ts::DATE) * 100 END AS hundredths,
    CASE WHEN greatest(created_ts, updated_ts, closed_ts) > TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY THEN 2 ELSE 0 END + CASE WHEN wrong THEN 4 ELSE 0 END
      + CASE WHEN is_city AND neighborhood IS NULL THEN 32 ELSE 0 END + CASE WHEN no_g THEN 128 ELSE 0 END + CASE WHEN no_s THEN 256 ELSE 0 END AS dq_flags
  FROM mapped),
pairs AS (
  SELECT p.category_level1, p.category_level2, coalesce(c.g, t.g) AS category_group, coalesce(c.v, n.v) AS label, coalesce(c.reason, n.reason) AS reason
  FROM (SELECT DISTINCT category_level1, category_level2 FROM cleaned) p
  LEFT JOIN category_map c ON c.k = {key_sql("p.category_level1")} AND c.reason IS NOT NULL
  LEFT JOIN line_map n ON n.k1 = {key_sql("p.category_level1")} AND n.k2 = {key_sql("p.category_level2")}
  LEFT JOIN category_map t ON t.k = n.k1
  WHERE c.k IS NOT NULL OR n.k1 IS NOT NULL),
served AS (
  SELECT c.*, c.dq_flags & {DATE_PROBLEMS} = 0 AND hundredths IS NOT NULL AND closed_date IS NOT NULL AS timed,
    NOT EXISTS (SELECT 1 FROM pairs p WHERE p.category_level1 = c.category_level1 AND p.category_level2 IS NOT DISTINCT FROM c.category_level2) AS service
  FROM cleaned c),
old AS (SELECT * FROM served WHERE service AND dq_flags & {DATE_PROBLEMS} = 0 AND hundredths > 18000),
clear_days AS (SELECT closed_date, category_group, count(*) AS old_closures FROM old GROUP BY ALL HAVING count(*) >= {DAY_LEAST}),
sweeps AS (SELECT date_trunc('minute', closed_ts) AS closed_minute, count(*) AS old_closures FROM old GROUP BY ALL HAVING count(*) >= {SWEEP_LEAST}),
requests AS (
  SELECT s.*, coalesce(service AND dq_flags & {DATE_PROBLEMS} = 0 AND hundredths > 9000
    AND (EXISTS (SELECT 1 FROM clear_days d WHERE d.closed_date = s.closed_date AND d.category_group = s.category_group)
      OR EXISTS (SELECT 1 FROM sweeps w WHERE w.closed_minute = date_trunc('minute', s.closed_ts))), false) AS bulk
  FROM served s)
"""
