"""Listings, regions, places, journeys, snapshots, history and postcodes derived from the sample tables.

Each view is one SELECT whose text means the same in Spark and in DuckDB. Tables are
written ``{orders}``: Spark gets DataFrames there, DuckDB the table names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.joins import beside_all

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

VIEWS = {
    "wl_listings": """
SELECT o_orderkey AS id,
  CAST(1 + o_orderkey % 5 AS INT) AS bedrooms,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 3 AS INT) END AS bathrooms,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 1e2) AS INT) END AS amount,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'daily' WHEN '2-HIGH' THEN 'weekly'
       WHEN '5-LOW' THEN 'yearly' ELSE 'monthly' END AS frequency,
  51e0 + CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1e3 AS latitude,
  CAST((o_orderkey * 104729) % 997 AS DOUBLE) / 997e0 - 1e0 AS longitude,
  o_orderstatus = 'F' AS let_agreed,
  o_orderkey % 13 = 0 AS students, o_orderkey % 29 = 0 AS commercial,
  o_orderkey % 31 = 0 AS development, o_orderkey % 37 = 0 AS auction,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL
       WHEN o_orderkey % 4 = 1 THEN '55 sq. m.'
       WHEN 300 + o_orderkey % 1500 >= 1000
         THEN '1,' || lpad(CAST(300 + o_orderkey % 1500 - 1000 AS VARCHAR(9)), 3, '0') || ' sq. ft.'
       ELSE CAST(300 + o_orderkey % 1500 AS VARCHAR(9)) || ' sq. ft.' END AS display_size,
  CASE o_orderkey % 5 WHEN 0 THEN 'flat' WHEN 1 THEN 'detached' WHEN 2 THEN 'semi-detached'
       WHEN 3 THEN 'terraced' ELSE 'land' END AS property_type,
  o_custkey AS agent_id, o_orderdate AS first_visible_date
FROM {orders}""",
    "wl_regions": """
SELECT n_name AS region,
  CAST(n_nationkey % 5 AS DOUBLE) / 5e0 - 1e0 AS min_lon,
  51e0 + CAST(floor(n_nationkey / 5e0) AS DOUBLE) / 5e0 AS min_lat,
  CAST(n_nationkey % 5 + 1 AS DOUBLE) / 5e0 - 1e0 AS max_lon,
  51e0 + CAST(floor(n_nationkey / 5e0) + 1 AS DOUBLE) / 5e0 AS max_lat
FROM {nation}""",
    "wl_places": """
SELECT r_name AS name,
  51e0 + CAST(r_regionkey * 2 + 1 AS DOUBLE) / 1e1 AS latitude,
  CAST(r_regionkey * 2 + 1 AS DOUBLE) / 1e1 - 1e0 AS longitude
FROM {region}""",
    "wl_snapshots": """
SELECT l_orderkey AS id, l_shipdate AS snapshot_ts, l_linenumber AS tie1, l_partkey AS tie2,
  l_suppkey AS tie3, CAST(floor(l_extendedprice / 1e2) AS INT) AS amount,
  l_returnflag = 'R' AS let_agreed
FROM {lineitem}""",
    "wl_history": """
SELECT o_orderkey AS id, o_orderstatus = 'F' AS let_agreed FROM {orders} WHERE o_orderkey % 7 = 0""",
    "wl_postcodes": """
SELECT c_custkey AS site_key,
  CASE c_custkey % 5 WHEN 0 THEN 'E' WHEN 1 THEN 'SW' WHEN 2 THEN 'N' WHEN 3 THEN 'EC' ELSE 'bad' END
    || CASE WHEN c_custkey % 5 = 4 THEN '' ELSE CAST(1 + c_custkey % 19 AS VARCHAR(9)) END
    || CASE WHEN c_custkey % 15 IN (3, 6) AND c_custkey % 19 < 9 THEN 'A' ELSE '' END
    || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END
    || CAST(c_custkey % 10 AS VARCHAR(9)) || 'A' || substring('BDEFGHJLNP', CAST(1 + c_custkey % 7 AS INT), 1) AS postcode,
  CAST((c_custkey * 37) % 101 AS DOUBLE) / 101e0 - 1e0 AS longitude,
  51e0 + CAST((c_custkey * 53) % 11 AS DOUBLE) / 11e0 AS latitude
FROM {customer}""",
    # Places to search for, with stations and areas, and the texts people look them up by.
    "wl_search_places": """
SELECT p_partkey AS position,
  CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE p_name || ' ' || p_brand END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN 'REGION^' ELSE 'STATION^' END || CAST(p_partkey AS VARCHAR(18)) AS identifier
FROM {part}""",
    "wl_lookups": """
SELECT p_name AS query FROM {part}
UNION SELECT split_part(p_name, ' ', 2) AS query FROM {part}
UNION SELECT p_type AS query FROM {part}""",
    # A price cap for some of the places.
    "wl_place_caps": """
SELECT r_name AS name, CAST(1500 + 500 * r_regionkey AS INT) AS cap FROM {region} WHERE r_regionkey % 2 = 0""",
    # A price cap for every other region.
    "wl_caps": """
SELECT n_name AS name, CAST(1000 + 100 * n_nationkey AS INT) AS cap FROM {nation} WHERE n_nationkey % 2 = 0""",
}

# DuckDB only: Spark builds the same rows from a short list of regions (``journeys`` below).
ORACLE_JOURNEYS = """
SELECT l_orderkey AS id, r_name AS name, l_linenumber AS position,
  CAST(10 + (l_orderkey * 31 + r_regionkey * 17 + l_linenumber * 7 + l_partkey) % 70 AS INT) AS duration,
  CASE l_partkey % 4 WHEN 0 THEN 'bus' WHEN 1 THEN 'tube' WHEN 2 THEN 'walking' ELSE 'dlr' END AS mode,
  l_partkey AS tie, l_partkey AS station
FROM lineitem CROSS JOIN region
WHERE (l_orderkey + r_regionkey + l_linenumber) % 4 <> 0"""


class Workload:
    """The views over one directory of sample tables, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def listings(self) -> DataFrame:
        return self.view("wl_listings")

    def journeys(self) -> DataFrame:
        rows = beside_all(
            self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"),
            self.table("region").select("r_name", "r_regionkey"),
        ).where("(l_orderkey + r_regionkey + l_linenumber) % 4 <> 0")
        return rows.select(
            F.col("l_orderkey").alias("id"), F.col("r_name").alias("name"), F.col("l_linenumber").alias("position"),
            F.expr("CAST(10 + (l_orderkey * 31 + r_regionkey * 17 + l_linenumber * 7 + l_partkey) % 70 AS INT)").alias("duration"),
            F.expr("CASE l_partkey % 4 WHEN 0 THEN 'bus' WHEN 1 THEN 'tube' WHEN 2 THEN 'walking' ELSE 'dlr' END").alias("mode"),
            F.col("l_partkey").alias("tie"), F.col("l_partkey").alias("station"),
        )


def oracle(body: str) -> str:
    """A DuckDB statement: the views ``body`` names, as CTEs, then ``body``."""
    texts = {name: text.format(**{t: t for t in TABLES}) for name, text in VIEWS.items()}
    texts["wl_journeys"] = ORACLE_JOURNEYS
    used = [f"{name} AS ({text})" for name, text in texts.items() if name in body]
    body = body.strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(used) + ", " + body[len("WITH RECURSIVE"):].strip()
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join(used) + ", " + body[len("WITH"):].strip()
    return "WITH " + ", ".join(used) + " " + body
