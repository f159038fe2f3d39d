"""Listing-domain views over the sample tables (see FIXTURES.md).

One text serves Spark and the SQL that checks it; only the type names and the
way to double a row differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark import schemas

AS_OF = "2024-01-31 00:00:00"
TABLES = ["orders", "nation", "region", "customer", "events"]

VIEWS: dict[str, str] = {}

VIEWS["raw_listings"] = """
SELECT CAST(o_orderkey AS {string}) AS property_listing_id, o_custkey AS agent_id, o_orderkey % 25 AS key_location,
 'Listing ' || CAST(o_orderkey AS {string}) AS property_title,
 CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'Apartment' WHEN '2' THEN ' Villa ' WHEN '3' THEN 'townhouse' WHEN '4' THEN 'Penthouse' ELSE 'land' END AS property_type,
 CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END || CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END AS offering_type,
 CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 8 = 0 THEN 'Studio' ELSE CAST(o_orderkey % 8 AS {string}) || ' Beds' END AS bedrooms,
 CASE WHEN o_orderkey % 103 = 0 THEN NULL ELSE CAST(o_orderkey % 5 + 1 AS {string}) || ' Baths' END AS bathrooms,
 CASE WHEN o_orderkey % 50 = 0 THEN '0' WHEN o_orderkey % 53 = 0 THEN 'n/a'
   WHEN o_orderkey % 9 = 0 THEN CAST(CAST(floor(o_totalprice*20/1000) AS BIGINT) AS {string}) || ',000'
   ELSE CAST(CAST(floor(o_totalprice*20) AS BIGINT) AS {string}) END AS pp_price,
 CASE WHEN o_orderkey % 60 = 0 THEN 0 ELSE (o_orderkey*31) % 4000 + 300 END AS property_sqft,
 CASE WHEN o_orderkey % 40 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(24.5 AS DOUBLE) + n_nationkey*CAST(0.4 AS DOUBLE) + ((o_orderkey*7) % 120)*CAST(0.001 AS DOUBLE) END AS latitude,
 CASE WHEN o_orderkey % 40 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(54 AS DOUBLE) + r_regionkey*CAST(0.5 AS DOUBLE) END AS longitude,
 n_name AS location_name, r_name || ' - ' || n_name AS full_location_path, n_nationkey AS location_id,
 CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'partly' WHEN 3 THEN NULL WHEN 4 THEN 'furnished' ELSE 'unfurnished' END AS furnished_flag,
 CASE o_orderkey % 4 WHEN 0 THEN 'Ready' WHEN 1 THEN 'off_plan_primary' WHEN 2 THEN 'completed_primary' ELSE 'off_plan' END AS completion_status,
 o_orderkey % 3 = 0 AS is_verified, (o_orderkey*17) % 251 AS property_serp_score,
 CASE WHEN o_orderkey % 20 = 0 THEN 'offline' ELSE 'online' END AS property_listing_status,
 {timestamp} '2024-01-31 00:00:00' - INTERVAL '1' DAY * CAST((o_orderkey*37) % 240 AS INT) AS start_time, dup AS ingest_seq
FROM {orders} JOIN {nation} ON n_nationkey = o_orderkey % 25 JOIN {region} ON r_regionkey = n_regionkey
{twice_25}
"""

VIEWS["src_price"] = """
SELECT CAST(o_orderkey AS {string}) AS web_id, CASE WHEN o_orderkey % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE floor(o_totalprice*20) + dup END AS pp_price
FROM {orders} {twice_77}
"""

VIEWS["src_location"] = """
SELECT n_nationkey AS key_location, n_nationkey AS location_id,
 CASE WHEN n_nationkey = 13 THEN CAST(0 AS DOUBLE) ELSE CAST(24.5 AS DOUBLE) + n_nationkey*CAST(0.4 AS DOUBLE) END AS coordinates_lat,
 CAST(54 AS DOUBLE) + r_regionkey*CAST(0.5 AS DOUBLE) AS coordinates_lon,
 CASE WHEN n_nationkey = 7 THEN NULL ELSE n_name END AS location_name_english, n_name || ' (primary)' AS location_name_primary,
 CASE WHEN n_nationkey % 4 = 0 THEN n_name || ' Tower' END AS location_tower_name, r_name || ' - ' || n_name AS location_path_name_primary
FROM {nation} JOIN {region} ON r_regionkey = n_regionkey
"""

VIEWS["src_agent"] = """
SELECT c_custkey AS agent_id, c_acctbal/100 AS super_agent_score FROM {customer} WHERE c_acctbal >= 0
"""

VIEWS["src_event"] = """
SELECT CASE WHEN event_id % 211 = 0 THEN NULL ELSE CAST(user_id*100 + CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS {string}) END AS listing_web_id,
 CASE event_type WHEN 'view' THEN 'content_view' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'lead_click' ELSE 'new_projects_lead_click' END
  WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'lead_send' WHEN 1 THEN 'new_projects_lead_send' ELSE 'instapage_lead' END
  WHEN 'signup' THEN 'favorite' ELSE 'impression' END AS event_name, ts AS derived_timestamp
FROM {events}
"""

VIEWS["rec_requests"] = """
SELECT request_id,
 CASE idx % 4 WHEN 0 THEN 'sale' WHEN 1 THEN 'rent' WHEN 2 THEN 'Buy' ELSE 'lease' END AS offering_type,
 CASE idx % 6 WHEN 0 THEN 'Villa' WHEN 1 THEN 'apartment' WHEN 2 THEN 'townhouse' WHEN 3 THEN 'penthouse' WHEN 4 THEN 'land' ELSE 'unknown' END AS property_type,
 CASE idx % 3 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(2000000 AS DOUBLE) ELSE CAST(60000 AS DOUBLE) END AS price,
 CASE idx % 5 WHEN 0 THEN 'Studio' WHEN 1 THEN '2 Beds' WHEN 2 THEN '4 Beds' WHEN 3 THEN '8 Beds' ELSE '15 Beds' END AS bedrooms,
 CASE idx % 7 WHEN 0 THEN '' WHEN 6 THEN 'non_existent_city' ELSE 'nation_' || CAST(idx % 25 AS {string}) END AS location_name,
 CASE WHEN idx % 8 = 7 THEN CAST(0 AS DOUBLE) ELSE CAST(24.5 AS DOUBLE) + (idx % 25)*CAST(0.4 AS DOUBLE) END AS latitude,
 CASE WHEN idx % 8 = 7 THEN CAST(0 AS DOUBLE) ELSE CAST(54 AS DOUBLE) + ((idx % 25) % 5)*CAST(0.5 AS DOUBLE) END AS longitude,
 CASE WHEN idx % 2 = 0 THEN idx % 15 END AS user_id
FROM (SELECT c_custkey AS request_id, CAST(floor(c_custkey/25.0) AS BIGINT) AS idx FROM {customer} WHERE c_custkey % 25 = 0) t
"""

VIEWS["rec_history"] = """
SELECT DISTINCT user_id, CAST(user_id*100 + CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS {string}) AS property_listing_id
FROM {events} WHERE event_type IN ('view','click')
"""

VIEWS["search_requests"] = """
SELECT request_id,
 CASE idx % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 9 END AS category_id,
 CASE idx % 4 WHEN 1 THEN {array}(35) WHEN 2 THEN {array}(1, 22) WHEN 3 THEN {array}(99) END AS property_type_ids,
 CASE idx % 5 WHEN 1 THEN 0 WHEN 2 THEN 100000 WHEN 3 THEN 5000000 END AS min_price,
 CASE idx % 6 WHEN 1 THEN 3000000 WHEN 2 THEN 8000000 END AS max_price,
 CASE idx % 8 WHEN 1 THEN 1000 END AS min_area, CASE idx % 8 WHEN 2 THEN 2500 END AS max_area,
 CASE idx % 3 WHEN 1 THEN {array}(1, 2) WHEN 2 THEN {array}(3) END AS number_of_bedrooms,
 CASE idx % 9 WHEN 1 THEN {array}(2, 3) END AS number_of_bathrooms,
 idx % 10 = 3 AS is_super_agent, idx % 10 = 4 AS is_verified,
 CASE idx % 11 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 END AS furnished,
 CASE idx % 11 WHEN 5 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 2 END AS completion_status,
 CASE idx % 12 WHEN 5 THEN 2592000 WHEN 6 THEN 0 END AS listed_within,
 CASE idx % 6 WHEN 0 THEN {array}('Nation_3') WHEN 1 THEN {array}('tion_2') WHEN 2 THEN {array}('NATION_12', 'NATION_1') WHEN 3 THEN {array}('nowhere') END AS keywords,
 CASE WHEN idx % 13 = 4 THEN CAST(26.1 AS DOUBLE) END AS near_lat, CASE WHEN idx % 13 = 4 THEN CAST(56.0 AS DOUBLE) END AS near_lon,
 CASE WHEN idx % 13 = 4 THEN CAST(5 AS DOUBLE) END AS near_radius,
 CASE idx % 6 WHEN 0 THEN 'priceAsc' WHEN 1 THEN 'priceDesc' WHEN 2 THEN 'bedroomAsc' WHEN 3 THEN 'bedroomDesc' WHEN 4 THEN 'newest' ELSE 'featured' END AS sort,
 CASE WHEN idx % 14 = 13 THEN 0 ELSE 1 + idx % 2 END AS page, CASE WHEN idx % 2 = 0 THEN 20 ELSE 5 END AS page_limit
FROM (SELECT c_custkey AS request_id, CAST(floor(c_custkey/25.0) AS BIGINT) AS idx FROM {customer} WHERE c_custkey % 25 = 0) t
"""

_SPARK_WORDS = {
    "string": "STRING", "timestamp": "TIMESTAMP_NTZ", "array": "array",
    "twice_25": "LATERAL VIEW explode(CASE WHEN o_orderkey % 25 = 0 THEN array(0, 1) ELSE array(0) END) d AS dup",
    "twice_77": "LATERAL VIEW explode(CASE WHEN o_orderkey % 77 = 0 THEN array(0, 1) ELSE array(0) END) d AS dup",
}
_ANSI_WORDS = {
    "string": "VARCHAR", "timestamp": "TIMESTAMP", "array": "list_value",
    "twice_25": "JOIN (SELECT 0 AS dup UNION ALL SELECT 1) d ON dup = 0 OR o_orderkey % 25 = 0",
    "twice_77": "JOIN (SELECT 0 AS dup UNION ALL SELECT 1) d ON dup = 0 OR o_orderkey % 77 = 0",
}


def ansi_text(view: str) -> str:
    """The view's SQL for an engine where the tables are registered by name."""
    return VIEWS[view].format(**_ANSI_WORDS, **{t: t for t in TABLES}).strip()


class SampleTables:
    """The source tables of the jobs, derived from one folder of sample data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        used = [t for t in TABLES if "{" + t + "}" in VIEWS[name]]
        text = VIEWS[name].format(**_SPARK_WORDS, **{t: "{" + t + "}" for t in TABLES})
        return self.spark.sql(text, **{t: self._table(t) for t in used})

    def raw_listings(self) -> DataFrame:
        return self.view("raw_listings")

    def listing(self) -> DataFrame:
        first = self.raw_listings().filter("ingest_seq = 0")
        return schemas.conform(first, schemas.LISTING, fill_nulls=False)

    def price(self) -> DataFrame:
        return schemas.conform(self.view("src_price"), schemas.PRICE, fill_nulls=False)

    def location(self) -> DataFrame:
        return schemas.conform(self.view("src_location"), schemas.LOCATION, fill_nulls=False)

    def agent_score(self) -> DataFrame:
        return schemas.conform(self.view("src_agent"), schemas.AGENT_SCORE, fill_nulls=False)

    def event(self) -> DataFrame:
        return schemas.conform(self.view("src_event"), schemas.EVENT, fill_nulls=False)

    def rec_requests(self) -> DataFrame:
        return self.view("rec_requests")

    def rec_history(self) -> DataFrame:
        return self.view("rec_history")

    def odd_requests(self) -> DataFrame:
        """The search requests as text from outside: limits beyond 32 bits, and words, fractions and NaN where numbers belong."""
        price = "CASE request_id % 3 WHEN 0 THEN '3000000000' WHEN 1 THEN 'about 5' ELSE CAST(min_price AS STRING) END"
        page = "CASE WHEN (request_id DIV 25) % 5 = 0 THEN 1.5D ELSE CAST(page AS DOUBLE) END"
        kinds = "CASE WHEN (request_id DIV 25) % 7 = 3 THEN array('35', 'x') ELSE CAST(property_type_ids AS ARRAY<STRING>) END"
        near = (
            "CASE WHEN (request_id DIV 25) % 11 = 2 THEN named_struct('radius', double('NaN'), 'lat', 26.1D, 'lon', 56D)"
            " ELSE named_struct('radius', near_radius, 'lat', near_lat, 'lon', near_lon) END"
        )
        odd = {"min_price": price, "page": page, "property_type_ids": kinds, "near_by": f"CASE WHEN near_lat IS NOT NULL OR (request_id DIV 25) % 11 = 2 THEN {near} END"}
        return self.view("search_requests").withColumns({c: F.expr(x) for c, x in odd.items()})

    def search_requests(self) -> DataFrame:
        raw = self.view("search_requests")
        near = F.struct(
            F.col("near_lat").alias("lat"), F.col("near_lon").alias("lon"), F.col("near_radius").alias("radius")
        )
        packed = raw.withColumn("near_by", F.when(F.col("near_lat").isNotNull(), near))
        return schemas.conform(packed, schemas.SEARCH_REQUEST, fill_nulls=False)
