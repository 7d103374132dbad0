"""The reference's concepts derived from the given tables: as DataFrames, and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import with_address
from ..functions.geo import spread
from ..session import load

#: The zone whose days count.
ZONE = "America/Maceio"


def local_day(instant) -> F.Column:
    return F.to_date(F.from_utc_timestamp(F.col(instant).cast("timestamp"), ZONE))


def epoch_ms(instant) -> F.Column:
    """Milliseconds of an instant, rounded to the nearest as DuckDB's epoch_ms does; Spark's unix_millis cuts them off."""
    return F.floor((F.unix_micros(instant) + 500) / 1000)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), F.regexp_extract("props", r"(\d+)", 1).alias("place"), F.col("user_id").alias("driver"), F.col("ts").cast("timestamp").alias("happened"), local_day("ts").alias("day"),
        kind.isin("signup", "purchase").alias("correction"), (kind == "signup").alias("admin"), (kind == "click").alias("pinned"), (F.col("event_id") % 11 == 0).alias("pending"), (F.col("event_id") % 13 == 0).alias("refused"),
        (F.col("user_id") % 7 != 0).alias("active"), (F.floor("value") / 10000 - 10.9).alias("lat"), ((F.col("event_id") % 3) / 10000 - 37.05).alias("lng"), kind.alias("kind"), F.col("value"),
    )


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("stop"), (F.col("l_linestatus") == "F").alias("delivered"),
        F.col("l_shipdate").cast("timestamp").alias("delivered_at"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("minutes"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("route"), (F.col("o_custkey") % 50).alias("driver"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("lane"), F.col("o_orderstatus").alias("state"))


def doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("door"), F.col("c_nationkey").alias("cep"), (F.col("c_custkey") % 500).alias("number"), F.col("c_mktsegment").alias("district"), (F.col("c_acctbal") / 100000 - 9.5).alias("lat"), ((F.col("c_custkey") % 97) / 1000 - 35.7).alias("lng"))


EVIDENCE = """evidence AS (
  SELECT event_id AS id, regexp_extract(props, '(\\d+)', 1) AS place, user_id AS driver, ts AS happened, CAST(ts - INTERVAL 3 HOUR AS DATE) AS day,
    event_type IN ('signup', 'purchase') AS correction, event_type = 'signup' AS admin, event_type = 'click' AS pinned, event_id % 11 = 0 AS pending, event_id % 13 = 0 AS refused,
    user_id % 7 <> 0 AS active, floor(value) / 10000 - 10.9::DOUBLE AS lat, (event_id % 3) / 10000 - 37.05::DOUBLE AS lng, event_type AS kind, value
  FROM events)"""
PACKAGES = """packages AS (
  SELECT l_orderkey AS route, l_linenumber AS seq, l_partkey AS item, l_suppkey AS stop, l_linestatus = 'F' AS delivered, l_shipdate AS delivered_at, l_returnflag AS flag, l_quantity AS minutes
  FROM lineitem)"""
ROUTES = """routes AS (
  SELECT o_orderkey AS route, o_custkey % 50 AS driver, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS lane, o_orderstatus AS state FROM orders)"""
DOORS = """doors AS (
  SELECT c_custkey AS door, c_nationkey AS cep, c_custkey % 500 AS number, c_mktsegment AS district, c_acctbal / 100000 - 9.5::DOUBLE AS lat, (c_custkey % 97) / 1000 - 35.7::DOUBLE AS lng FROM customer)"""


def flat(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"(111320 * sqrt(pow({lat2} - {lat1}, 2) + pow(({lng2} - {lng1}) * cos(radians({lat1})), 2)))"


def standing(driver: int | None = None, source: str = "evidence") -> str:
    """The standing marks of a CTE of evidence, as a query."""
    shown = "NOT pending" if driver is None else f"(NOT pending OR driver = {driver})"
    return f"""
  SELECT * EXCLUDE (r) REPLACE (false AS pinned) FROM (
    SELECT *, row_number() OVER (PARTITION BY place, driver ORDER BY happened DESC, id DESC) AS r FROM {source} WHERE active AND {shown} AND correction) WHERE r = 1
  UNION ALL
  SELECT * EXCLUDE (r) REPLACE (false AS admin) FROM (
    SELECT *, row_number() OVER (PARTITION BY place, driver, day ORDER BY happened DESC, id DESC) AS r FROM {source} WHERE active AND {shown} AND NOT correction AND NOT refused) WHERE r = 1"""


def consensus_sql(marks: str) -> str:
    """The consensus over a CTE of marks, as a query."""
    return f"""
  SELECT place, lat, lng, CASE WHEN sure THEN 'confirmed' WHEN correction THEN 'suggested' END AS status,
    CASE WHEN admin THEN 'admin' WHEN nc > 0 THEN 'correction' ELSE 'delivery' END AS source, nc AS n_corrections, np AS n_passages
  FROM (
    SELECT *, row_number() OVER (PARTITION BY place ORDER BY admin DESC, sure DESC, nc * 2 + np DESC, correction DESC, happened DESC, id DESC) AS r
    FROM (
      SELECT *, admin OR nc >= 2 OR (nc >= 1 AND np >= 1) OR np >= 2 OR npp >= 1 AS sure
      FROM (
        SELECT a.*, count(*) FILTER (WHERE b.correction) AS nc, count(*) FILTER (WHERE NOT b.correction) AS np, count(*) FILTER (WHERE b.pinned) AS npp
        FROM {marks} a JOIN {marks} b ON a.place = b.place AND {flat('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 30 GROUP BY ALL)))
  WHERE r = 1 AND (sure OR correction)"""


#: Scalar definitions that both engines read alike: column -> expression over customer.
_STOP = {
    "stop": "c_custkey",
    "route": "CAST(floor(c_custkey / 60) AS BIGINT)",
    "seq": "c_custkey % 60",
    "carrier": "CAST(floor(c_custkey % 60 / 2) AS BIGINT)",
    "driver": "c_custkey % 12",
    "district": "c_mktsegment",
    "lat": "c_acctbal / 100000 - 9.5e0",
    "lng": "(c_custkey % 97) / 1000 - 35.7e0",
    "number": "c_custkey % 500",
    "cep": "CAST(49000000 + c_nationkey * 1000 + c_custkey % 3 AS BIGINT)",
    "street": "CASE c_custkey % 4 WHEN 0 THEN 'Rua ' WHEN 1 THEN 'Av. ' WHEN 2 THEN 'Travessa ' ELSE 'R ' END || CASE CAST(floor(c_custkey / 4) AS BIGINT) % 8"
    " WHEN 0 THEN 'das Flores' WHEN 1 THEN 'Vinte e Cinco' WHEN 2 THEN 'Dr Carlos Firpo' WHEN 3 THEN 'Palmeiras do Norte' WHEN 4 THEN 'A'"
    " WHEN 5 THEN 'Eng Jorge Neto' WHEN 6 THEN 'Mangueiras' ELSE 'Cento e Dez' END",
    "precision": "CASE c_custkey % 8 WHEN 0 THEN 'confirmado' WHEN 1 THEN 'rua' WHEN 2 THEN 'bairro' WHEN 3 THEN 'censo' WHEN 4 THEN 'manual' ELSE 'planilha' END",
    "delivered": "c_custkey % 5 = 0",
    "additional": "c_custkey % 11 = 0",
    "units": "1 + c_custkey % 3",
    "extra": "CASE c_custkey % 6 WHEN 0 THEN 'Apto 0' || (c_custkey % 30) WHEN 1 THEN 'Bloco B Casa 3' WHEN 2 THEN 'perto da padaria' WHEN 3 THEN 'Conjunto Orlando Dantas' ELSE '' END",
}
STOPS = "stops0 AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _STOP.items()) + " FROM customer), stops AS (SELECT *, {} AS address FROM stops0)".format(
    "street || ', ' || number || CASE WHEN extra = '' THEN '' ELSE ', ' || extra END || ', ' || district || ', ' || substr(CAST(cep AS VARCHAR), 1, 5) || '-' || substr(CAST(cep AS VARCHAR), 6, 3)"
)


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of routes: where they are, what the sheet says, and how sure the position is."""
    base = load(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {n}" for n, e in _STOP.items()))
    cep = F.col("cep").cast("string")
    extra = F.when(F.col("extra") == "", F.lit("")).otherwise(F.concat(F.lit(", "), "extra"))
    comma = F.lit(", ")
    line = F.concat("street", comma, F.col("number").cast("string"), extra, comma, "district", comma, F.substring(cep, 1, 5), F.lit("-"), F.substring(cep, 6, 3))
    return base.withColumn("address", line)


def addressed(lines: DataFrame, line: str = "address") -> DataFrame:
    """lines with their address in parts (with_address), dealt over all shuffle partitions first.

    A line takes far longer to take apart than to read, and a table of one small file would be one task.
    """
    return with_address(spread(lines), line)


_SEGMENT = {
    "seg": "s_suppkey",
    "name_key": "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'rua ' || (s_suppkey % 9) END",
    "city": "s_nationkey",
    "source": "CASE s_suppkey % 3 WHEN 0 THEN 'osm' WHEN 1 THEN 'prefeitura' ELSE 'entregas' END",
    "district": "'district ' || (s_suppkey % 7)",
    "lat0": "s_acctbal / 100000 - 9.5e0",
    "lng0": "((s_suppkey * 37) % 97) / 1000 - 35.7e0",
}
SEGMENTS = f"segments AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _SEGMENT.items())} FROM supplier)"
_VERTEX = ("lat0 + i * 0.0008e0", "lng0 + i * 0.001e0 + (seg % 3 - 1) * i * i * 0.0002e0")
VERTICES = f"{SEGMENTS}, vertices AS (SELECT seg, i, {_VERTEX[0]} AS lat, {_VERTEX[1]} AS lng FROM segments, unnest(range(4)) AS t(i))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in _SEGMENT.items()))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seg, i, lat, lng: four vertices for each segment."""
    each = segments(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return each.selectExpr("seg", "i", f"{_VERTEX[0]} AS lat", f"{_VERTEX[1]} AS lng")


_AREA = {
    "area": "n_nationkey",
    "kind": "CASE WHEN n_nationkey % 3 = 0 THEN 'complex' ELSE 'district' END",
    "lat": "-9.5e0 + (n_nationkey % 5) * 0.02e0",
    "lng": "-35.69e0 + CAST(floor(n_nationkey / 5) AS BIGINT) * 0.02e0",
    "half": "0.008e0 + 0.003e0 * (n_nationkey % 4)",
}
AREAS = f"areas AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _AREA.items())} FROM nation)"
#: Corners of an area around its centre, in halves of its size, in order.
CORNERS = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (0.0, 0.5), (-1.0, 1.0)]


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").selectExpr(*(f"{e} AS {n}" for n, e in _AREA.items()))


PROFILES = "profiles AS (SELECT DISTINCT user_id AS driver, 'Driver ' || (user_id % 40) AS name, user_id % 7 <> 0 AS active, user_id % 5 = 0 AS reviewed FROM events)"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.selectExpr("user_id AS driver", "'Driver ' || (user_id % 40) AS name", "user_id % 7 <> 0 AS active", "user_id % 5 = 0 AS reviewed").distinct()


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    half = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2)"
    return f"(2 * 6371000 * asin(least(1e0, sqrt({half}))))"
