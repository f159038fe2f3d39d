"""SQL that computes what the queries should return, from the same tables.

Written for an engine that runs it at small scale, row against row: it shares
no step of the Spark jobs' pruning.
"""

from __future__ import annotations

from hearthspark.functions import codes
from hearthspark.operators.ranker import LISTING_FEATURES
from hearthspark.sources.sample_views import AS_OF, VIEWS, ansi_text

NOW = f"TIMESTAMP '{AS_OF}'"
CHECKS: dict[str, str] = {}

# name -> (tables it reads, text)
PARTS: dict[str, tuple[list[str], str]] = {name: ([], ansi_text(name)) for name in VIEWS}


def part(name: str, reads: list[str], text: str) -> None:
    PARTS[name] = (reads, text)


def check(name: str, reads: list[str], text: str) -> None:
    order: list[str] = []

    def need(table: str) -> None:
        for other in PARTS[table][0]:
            need(other)
        if table not in order:
            order.append(table)

    for table in reads:
        need(table)
    tables = ",\n".join(f"{t} AS ({PARTS[t][1]})" for t in order)
    CHECKS[name] = f"WITH {tables}\n{text}" if order else text


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(sin((radians({lat2}) - radians({lat1})) / 2) * sin((radians({lat2}) - radians({lat1})) / 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * sin((radians({lon2}) - radians({lon1})) / 2) * sin((radians({lon2}) - radians({lon1})) / 2))"
    )
    return f"(2 * 6371.0 * asin(sqrt(least({a}, 1.0))))"


def count_of(names: list[str]) -> str:
    return f"count(*) FILTER (event_name IN ({quoted(names)}))"


# --- cleaning ----------------------------------------------------------------------

NUMBER = "coalesce(try_cast(replace({0}, ',', '') AS DOUBLE), 0)"
BEDS = (
    "CASE WHEN contains(lower(bedrooms), 'studio') THEN 0"
    " ELSE coalesce(try_cast(regexp_extract(bedrooms, '([0-9]+)', 1) AS BIGINT), 0) END"
)
BATHS = "coalesce(try_cast(regexp_extract(bathrooms, '([0-9]+)', 1) AS BIGINT), 1)"
TEXT = "coalesce(lower(trim({0})), 'unknown')"
OFFERING = "regexp_replace(coalesce(lower(trim(offering_type)), 'unknown'), '\\.0$', '')"
FURNISHED = (
    "CASE WHEN lower(furnished_flag) IN ('yes', 'furnished', 'true') THEN '1'"
    " WHEN furnished_flag IS NULL OR lower(furnished_flag) IN ('no', 'unfurnished', 'false', 'none', 'nan') THEN '0'"
    " ELSE lower(furnished_flag) END"
)
COMPLETION = (
    "CASE WHEN lower(completion_status) IN ('completed_primary', 'ready') THEN 'completed'"
    " WHEN lower(completion_status) = 'off_plan_primary' THEN 'off_plan' ELSE lower(completion_status) END"
)
DAYS = "CAST(floor((epoch_us({now}) - epoch_us({col})) / 86400000000.0) AS BIGINT)"
STEPS = "CASE WHEN {0} <= 7 THEN 1.0 WHEN {0} <= 30 THEN 0.7 WHEN {0} <= 90 THEN 0.4 ELSE 0.1 END"


def days(column: str) -> str:
    return DAYS.format(now=NOW, col=column)


part("signals", ["src_event"], f"""
SELECT listing_web_id AS property_listing_id, {count_of(['impression'])} AS impression_count,
 {count_of(codes.VIEW_EVENTS)} AS view_count, {count_of(['favorite'])} AS favorite_count,
 {count_of(codes.CLICK_EVENTS)} AS lead_click_count, {count_of(codes.LEAD_EVENTS)} AS lead_submission_count
FROM src_event WHERE derived_timestamp >= {NOW} - INTERVAL 90 DAY AND listing_web_id IS NOT NULL GROUP BY 1""")
part("deduped", ["raw_listings"], """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY property_listing_id ORDER BY ingest_seq) AS nth FROM raw_listings)
WHERE nth = 1""")
part("standard", ["deduped", "signals", "src_agent"], f"""
SELECT d.property_listing_id, property_title, {TEXT.format('property_type')} AS property_type, {OFFERING} AS offering_type,
 {TEXT.format('location_name')} AS location_name, {TEXT.format('full_location_path')} AS full_location_path,
 CAST(location_id AS VARCHAR) AS location_id, {NUMBER.format('pp_price')} AS price,
 CAST(property_sqft AS DOUBLE) AS size_sqft, latitude, longitude, {BEDS} AS beds_int, {BATHS} AS bath_int,
 {FURNISHED} AS furnished_flag, {COMPLETION} AS completion_status, is_verified, start_time AS listing_date,
 CAST(property_serp_score AS DOUBLE) AS quality_score, super_agent_score,
 coalesce(CAST(impression_count AS DOUBLE), 0) AS impression_count, coalesce(CAST(view_count AS DOUBLE), 0) AS view_count,
 coalesce(CAST(favorite_count AS DOUBLE), 0) AS favorite_count, coalesce(CAST(lead_click_count AS DOUBLE), 0) AS lead_click_count,
 coalesce(CAST(lead_submission_count AS DOUBLE), 0) AS lead_submission_count
FROM deduped d LEFT JOIN signals s ON s.property_listing_id = d.property_listing_id
LEFT JOIN src_agent a ON a.agent_id = d.agent_id""")
part("model_table", ["standard"], f"""
SELECT * EXCLUDE (price, size_sqft),
 CASE WHEN price = 0 THEN (SELECT median(price) FROM standard WHERE price > 0) ELSE price END AS price,
 CASE WHEN size_sqft = 0 THEN (SELECT median(size_sqft) FROM standard WHERE size_sqft > 0) ELSE size_sqft END AS size_sqft,
 {days('listing_date')} AS days_old, CAST({STEPS.format(days('listing_date'))} AS DOUBLE) AS freshness_score,
 impression_count * 0.01::DOUBLE + view_count * 1.0::DOUBLE + favorite_count * 5.0::DOUBLE
  + lead_click_count * 15.0::DOUBLE + lead_submission_count * 50.0::DOUBLE AS smart_popularity_score,
 coalesce(super_agent_score / (SELECT max(super_agent_score) FROM standard), 0) AS trust_score,
 CAST(lead_submission_count > 0 AS BIGINT) AS target_is_lead
FROM standard""")

part("dirty", ["raw_listings"], """
SELECT * REPLACE (CASE CAST(property_listing_id AS BIGINT) % 8 WHEN 0 THEN '  ' || property_title || ' '
 WHEN 1 THEN property_title || chr(10) || 'line two' WHEN 2 THEN '"' || property_title || '", said "she"' WHEN 3 THEN ''
 WHEN 4 THEN NULL WHEN 5 THEN chr(92) || property_title || chr(92) WHEN 6 THEN chr(13) || chr(10) || property_title || chr(9)
 ELSE property_title END AS property_title) FROM raw_listings""")
check("csv_scan", ["dirty"], """
SELECT property_type, count(*) AS n, count(bedrooms) AS with_bedrooms, count(property_title) AS with_title,
 CAST(sum(length(property_title)) AS BIGINT) AS title_length, CAST(sum(property_sqft) AS BIGINT) AS total_sqft,
 max(start_time) AS latest FROM dirty GROUP BY 1""")
check("csv_roundtrip", ["dirty"], """
SELECT property_listing_id, CAST(ingest_seq AS BIGINT) AS ingest_seq, property_title, property_type, bedrooms, location_name, start_time
FROM dirty""")
check("serving_roundtrip", ["model_table"], """
SELECT property_listing_id, offering_type, property_type, location_name, price, CAST(beds_int AS DOUBLE) AS beds_int, is_verified
FROM model_table""")
check("merge_signals", ["raw_listings", "signals"], """
SELECT r.property_listing_id, CAST(ingest_seq AS BIGINT) AS ingest_seq, view_count, impression_count, favorite_count,
 lead_click_count, lead_submission_count
FROM raw_listings r LEFT JOIN signals s ON s.property_listing_id = r.property_listing_id""")
check("conform_schema", ["raw_listings"], """
SELECT property_listing_id, coalesce(try_cast(pp_price AS DOUBLE), 0) AS price, CAST(0 AS DOUBLE) AS beds_int,
 CAST(property_sqft AS DOUBLE) AS size_sqft, CAST(property_serp_score AS DOUBLE) AS quality_score, CAST(0 AS DOUBLE) AS trust_score,
 CAST(location_id AS VARCHAR) AS location_id, CAST(NULL AS VARCHAR) AS image_url, is_verified FROM raw_listings""")
check("validate_requests", ["search_requests"], """
SELECT request_id, odd, CAST(min_price AS DOUBLE) AS min_price, reject_reason IS NULL AS accepted, reject_reason FROM (
 SELECT request_id, FALSE AS odd, min_price, CASE WHEN page < 1 THEN 'page must be 1 or more' END AS reject_reason FROM search_requests
 UNION ALL SELECT request_id, TRUE, CASE request_id % 3 WHEN 0 THEN 3000000000 WHEN 2 THEN min_price END,
 CASE WHEN request_id % 3 = 1 THEN 'min_price does not fit its type'
  WHEN (request_id // 25) % 5 = 0 THEN 'page does not fit its type'
  WHEN (request_id // 25) % 7 = 3 THEN 'property_type_ids does not fit its type'
  WHEN (request_id // 25) % 11 = 2 THEN 'near_by does not fit its type'
  WHEN page < 1 THEN 'page must be 1 or more' END FROM search_requests)""")
check("serving_columns", ["model_table"], """
SELECT property_listing_id, property_title, location_name, price, beds_int, bath_int, latitude, longitude, listing_date,
 property_type, offering_type, is_verified, completion_status FROM model_table""")
check("active_listings", ["raw_listings"], f"""
SELECT property_listing_id, agent_id, key_location, property_type, start_time FROM raw_listings
WHERE ingest_seq = 0 AND property_listing_status = 'online' AND start_time >= {NOW} - INTERVAL 6 MONTH""")
for _name, _days in (("engagement", 90), ("engagement_14d", 14)):
    check(_name, ["src_event"], f"""
SELECT *, view_count * 1.0::DOUBLE + lead_click_count * 10.0::DOUBLE + lead_submission_count * 50.0::DOUBLE AS popularity_score
FROM (SELECT listing_web_id AS property_listing_id, {count_of(codes.VIEW_EVENTS)} AS view_count,
 {count_of(codes.CLICK_EVENTS)} AS lead_click_count, {count_of(codes.LEAD_EVENTS)} AS lead_submission_count
FROM src_event WHERE derived_timestamp >= {NOW} - INTERVAL {_days} DAY AND listing_web_id IS NOT NULL GROUP BY 1)""")
check("etl_inventory", ["raw_listings", "src_price", "src_location", "src_agent", "signals"], f"""
SELECT l.property_listing_id, coordinates_lat AS latitude, coordinates_lon AS longitude,
 coalesce(location_name_english, location_name_primary) AS location_name, property_title, property_type,
 bedrooms AS beds_int, bathrooms AS bath_int, CAST(property_sqft AS BIGINT) AS size_sqft, p.pp_price AS price,
 start_time AS listing_date, CAST(property_serp_score AS BIGINT) AS quality_score, coalesce(super_agent_score, 0) AS trust_score,
 '{codes.DEFAULT_IMAGE}' AS image_url, '{codes.DEFAULT_AGENT}' AS agent_name, offering_type, furnished_flag,
 completion_status, is_verified, CAST(g.location_id AS VARCHAR) AS location_id,
 coalesce(location_tower_name, location_path_name_primary) AS full_location_path,
 coalesce(view_count, 0) AS view_count, coalesce(lead_click_count, 0) AS lead_click_count,
 coalesce(lead_submission_count, 0) AS lead_submission_count,
 coalesce(view_count * 1.0::DOUBLE + lead_click_count * 10.0::DOUBLE + lead_submission_count * 50.0::DOUBLE, 0) AS popularity_score,
 round(coalesce(impression_count * 0.01::DOUBLE + view_count * 1.0::DOUBLE + favorite_count * 5.0::DOUBLE
  + lead_click_count * 15.0::DOUBLE + lead_submission_count * 50.0::DOUBLE, 0), 6) AS smart_popularity_score
FROM raw_listings l JOIN src_price p ON p.web_id = l.property_listing_id AND p.pp_price > 0
JOIN src_location g ON g.key_location = l.key_location AND coordinates_lat IS NOT NULL AND coordinates_lat <> 0
LEFT JOIN src_agent a ON a.agent_id = l.agent_id LEFT JOIN signals s ON s.property_listing_id = l.property_listing_id
WHERE ingest_seq = 0 AND property_listing_status = 'online' AND start_time >= {NOW} - INTERVAL 6 MONTH""")
check("dedup_listings", ["deduped"], """
SELECT property_listing_id, CAST(ingest_seq AS BIGINT) AS ingest_seq, pp_price FROM deduped""")
SEQ = "property_listing_id, CAST(ingest_seq AS BIGINT) AS ingest_seq"
part("numbers", ["raw_listings"], f"""
SELECT {SEQ}, {NUMBER.format('pp_price')} AS price, CAST(property_sqft AS DOUBLE) AS size_sqft, latitude, longitude
FROM raw_listings""")
check("clean_numbers", ["numbers"], "SELECT * FROM numbers")
check("impute_median", ["numbers"], """
SELECT property_listing_id, ingest_seq,
 CASE WHEN price = 0 THEN (SELECT median(price) FROM numbers WHERE price > 0) ELSE price END AS price,
 CASE WHEN size_sqft = 0 THEN (SELECT median(size_sqft) FROM numbers WHERE size_sqft > 0) ELSE size_sqft END AS size_sqft
FROM numbers""")
check("parse_beds_baths", ["raw_listings"], f"SELECT {SEQ}, {BEDS} AS beds_int, {BATHS} AS bath_int FROM raw_listings")
check("clean_text", ["raw_listings"], f"""
SELECT {SEQ}, {TEXT.format('property_type')} AS property_type, {TEXT.format('location_name')} AS location_name,
 {TEXT.format('full_location_path')} AS full_location_path, {OFFERING} AS offering_type FROM raw_listings""")
check("parse_dates", ["raw_listings"], f"""
SELECT {SEQ}, CASE WHEN CAST(property_listing_id AS BIGINT) % 7 <> 0 THEN start_time END AS listing_date FROM raw_listings""")
check("normalize_flags", ["raw_listings"], f"""
SELECT {SEQ}, {FURNISHED} AS furnished_flag, {COMPLETION} AS completion_status, is_verified FROM raw_listings""")
CATEGORY = " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.OFFERING_BY_CATEGORY.items())
TYPE = " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.TYPE_BY_ID.items())
WORD = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.OFFERING_BY_WORD.items())
check("map_codes", ["search_requests", "rec_requests"], f"""
SELECT s.request_id, CASE category_id {CATEGORY} END AS offering_type, names AS property_types,
 coalesce(CASE lower(r.offering_type) {WORD} END, lower(r.offering_type)) AS asked_offering
FROM search_requests s JOIN rec_requests r ON r.request_id = s.request_id
LEFT JOIN (SELECT request_id, string_agg(CASE id {TYPE} END, ',' ORDER BY nth) AS names
 FROM (SELECT request_id, unnest(property_type_ids) AS id, generate_subscripts(property_type_ids, 1) AS nth FROM search_requests)
 GROUP BY 1) t ON t.request_id = s.request_id""")

# --- features and profile ------------------------------------------------------------

check("model_table", ["model_table"], """
SELECT property_listing_id, property_type, offering_type, location_name, full_location_path, price, size_sqft, latitude, longitude,
 beds_int, bath_int, furnished_flag, completion_status, is_verified, listing_date, days_old, freshness_score, quality_score,
 view_count, round(smart_popularity_score, 6) AS smart_popularity_score, trust_score, target_is_lead FROM model_table""")
check("model_input", ["raw_listings"], f"""
SELECT {SEQ}, property_serp_score / 250.0::DOUBLE AS quality_score,
 CASE WHEN lower(furnished_flag) IN ('yes', 'furnished', 'true', 'partly') THEN '1' ELSE '0' END AS furnished_flag,
 CASE lower(completion_status) WHEN 'off_plan_primary' THEN 'off_plan' WHEN 'ready' THEN 'completed'
  ELSE coalesce(lower(completion_status), 'unknown') END AS completion_status,
 {OFFERING} AS offering_type, {TEXT.format('property_type')} AS property_type, CAST(location_id AS VARCHAR) AS location_id
FROM raw_listings""")
check("freshness", ["raw_listings"], f"""
SELECT {SEQ}, {days('start_time')} AS days_old, CAST({STEPS.format(days('start_time'))} AS DOUBLE) AS freshness_score,
 1 / (1 + greatest({days('start_time')}, 0) / 30.0::DOUBLE) AS search_freshness FROM raw_listings""")
check("smart_popularity", ["signals"], """
SELECT property_listing_id, round(impression_count * 0.01::DOUBLE + view_count * 1.0::DOUBLE + favorite_count * 5.0::DOUBLE
 + lead_click_count * 15.0::DOUBLE + lead_submission_count * 50.0::DOUBLE, 6) AS smart_popularity_score FROM signals""")
check("trust_score", ["raw_listings", "src_agent"], """
SELECT property_listing_id, coalesce(super_agent_score / (SELECT max(super_agent_score) FROM raw_listings JOIN src_agent USING (agent_id)), 0)
 AS trust_score FROM raw_listings l LEFT JOIN src_agent a ON a.agent_id = l.agent_id WHERE ingest_seq = 0""")
NUMERIC = ["price", "size_sqft", "beds_int", "bath_int"]
part("fit", ["model_table"], "SELECT " + ", ".join(
    f"CAST(min({c}) AS DOUBLE) AS min_{c}, CAST(max({c}) AS DOUBLE) AS max_{c}" for c in NUMERIC) + " FROM model_table")


def scaled(column: str, source: str) -> str:
    return f"(CAST({source}{column} AS DOUBLE) - f.min_{column}) / (f.max_{column} - f.min_{column})"


part("listed", ["model_table", "fit"], "SELECT m.*, " + ", ".join(
    f"{scaled(c, 'm.')} AS x_{c}" for c in NUMERIC) + " FROM model_table m, fit f")
check("feature_scaling", ["listed"], "SELECT property_listing_id, " + ", ".join(
    f"round(x_{c}, 9) AS x_{c}" for c in NUMERIC) + " FROM listed")
CATEGORIES = ["property_type", "offering_type", "location_id", "furnished_flag", "completion_status"]
part("vocabulary", ["model_table"], " UNION ".join(
    f"SELECT '{c}' AS feature, {c} AS value FROM model_table WHERE {c} IS NOT NULL" for c in CATEGORIES))
check("category_vocab", ["vocabulary"], "SELECT * FROM vocabulary")
check("history_seeds", ["model_table"], """
SELECT * FROM (SELECT 'luxury' AS seed, property_listing_id FROM model_table WHERE property_type = 'villa' ORDER BY price DESC, property_listing_id LIMIT 2)
UNION ALL SELECT * FROM (SELECT 'budget', property_listing_id FROM model_table WHERE property_type = 'apartment' ORDER BY price, property_listing_id LIMIT 2)
UNION ALL SELECT * FROM (SELECT 'first', property_listing_id FROM model_table ORDER BY property_listing_id LIMIT 2)""")
part("centroids", ["model_table"], """
SELECT location_name, avg(latitude) AS latitude, avg(longitude) AS longitude FROM model_table WHERE latitude <> 0 GROUP BY 1""")
check("haversine", ["model_table", "centroids"], f"""
SELECT property_listing_id, round({km('c.latitude', 'c.longitude', 'm.latitude', 'm.longitude')}, 6) AS dist_km
FROM model_table m JOIN centroids c ON c.location_name = m.location_name""")
check("profile_duplicates", ["raw_listings"], """
SELECT count(*) - count(DISTINCT property_listing_id) AS duplicate_rows FROM raw_listings""")
part("merged", ["raw_listings", "signals"], """
SELECT r.*, pp_price AS price, view_count FROM raw_listings r LEFT JOIN signals s ON s.property_listing_id = r.property_listing_id""")
check("profile_nulls", ["merged"], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count FROM merged"
    for c in ("price", "location_name", "latitude", "view_count", "bedrooms", "bathrooms", "furnished_flag")))
check("value_counts", ["model_table"], """
SELECT 'quality_score' AS column_name, CAST(CAST(quality_score AS BIGINT) AS VARCHAR) AS value, count(*) AS n FROM model_table GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'property_type', property_type, count(*) FROM model_table GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)""")
check("profile_price", ["model_table"], """
SELECT round(avg(price), 3) AS mean_price,
 (SELECT location_name FROM model_table GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_location FROM model_table""")
check("price_histogram", ["model_table"], """
SELECT CAST(least(floor((x - lo) / (hi - lo) * 30) + 1, 30) AS BIGINT) AS bin, count(*) AS n
FROM (SELECT log10(price) AS x FROM model_table WHERE price > 0),
 (SELECT min(log10(price)) AS lo, max(log10(price)) AS hi FROM model_table WHERE price > 0) GROUP BY 1""")

# --- search --------------------------------------------------------------------------

part("threshold", ["model_table"], """
SELECT CASE WHEN q = 0 THEN 0.1 ELSE q END AS threshold FROM (SELECT quantile_cont(trust_score, 0.95) AS q FROM model_table)""")
check("location_centroids", ["centroids"], """
SELECT location_name, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM centroids""")
check("super_agent_threshold", ["threshold"], "SELECT round(threshold, 9) AS threshold FROM threshold")
part("ring_requests", ["model_table", "centroids"], f"""
SELECT CAST(property_listing_id AS BIGINT) * 10 + ring + 1000000000 AS request_id, CAST(price AS INT) AS price, location_name
FROM (SELECT *, row_number() OVER (PARTITION BY location_name, ring ORDER BY CAST(property_listing_id AS BIGINT)) AS nth
 FROM (SELECT m.property_listing_id, m.price, m.location_name,
   CASE WHEN d BETWEEN 2 AND 3 THEN 1 WHEN d BETWEEN 5 AND 6 THEN 2 WHEN latitude = 0 THEN 3 END AS ring
  FROM (SELECT m.*, {km('c.latitude', 'c.longitude', 'm.latitude', 'm.longitude')} AS d, count(*) OVER (PARTITION BY price) AS same
   FROM model_table m JOIN centroids c ON c.location_name = m.location_name) m WHERE same = 1 AND price = floor(price))
 WHERE ring IS NOT NULL) WHERE nth = 1""")


def search_parts(prefix: str, requests: str, reads: list[str]) -> None:
    """Row-against-row search over a request table."""
    part(f"{prefix}asked", [*reads, "centroids", "threshold"], f"""
SELECT r.*, lower(keywords[1]) AS term, CASE category_id {CATEGORY} END AS q_offering,
 CASE WHEN near_lat IS NOT NULL THEN 'near' WHEN c.location_name IS NOT NULL THEN 'centroid'
  WHEN keywords[1] IS NOT NULL THEN 'text' ELSE 'none' END AS mode,
 coalesce(near_lat, c.latitude) AS q_lat, coalesce(near_lon, c.longitude) AS q_lon, coalesce(near_radius, 10) AS q_radius,
 t.threshold
FROM ({requests}) r LEFT JOIN centroids c ON lower(c.location_name) = lower(keywords[1]), threshold t WHERE page >= 1""")
    known = ", ".join(str(i) for i in codes.TYPE_BY_ID)
    types = " OR ".join(
        f"(list_contains(property_type_ids, {i}) AND contains(l.property_type, '{name}'))" for i, name in codes.TYPE_BY_ID.items()
    )
    furnished = " OR ".join(f"(furnished = {k} AND l.furnished_flag IN ({quoted(v)}))" for k, v in codes.FURNISHED_BY_CODE.items())
    completion = " OR ".join(
        f"(r.completion_status = {k} AND l.completion_status IN ({quoted(v)}))" for k, v in codes.COMPLETION_BY_CODE.items())
    part(f"{prefix}filtered", [f"{prefix}asked", "model_table"], f"""
SELECT r.request_id, r.mode, r.term, r.q_lat, r.q_lon, r.q_radius, r.sort, r.page, r.page_limit, r.threshold, r.is_super_agent,
 r.min_price, l.* EXCLUDE (is_verified)
FROM {prefix}asked r JOIN model_table l ON (q_offering IS NULL OR l.offering_type = q_offering)
 AND (property_type_ids IS NULL OR NOT list_has_any(property_type_ids, [{known}]) OR {types})
 AND (coalesce(min_price, 0) = 0 OR l.price >= min_price) AND (coalesce(max_price, 0) = 0 OR l.price <= max_price)
 AND (coalesce(min_area, 0) = 0 OR l.size_sqft >= min_area) AND (coalesce(max_area, 0) = 0 OR l.size_sqft <= max_area)
 AND (number_of_bedrooms IS NULL OR list_contains(number_of_bedrooms, l.beds_int))
 AND (number_of_bathrooms IS NULL OR list_contains(number_of_bathrooms, l.bath_int))
 AND (NOT coalesce(is_super_agent, FALSE) OR l.trust_score >= threshold)
 AND (NOT coalesce(r.is_verified, FALSE) OR l.is_verified)
 AND (coalesce(furnished, 0) = 0 OR {furnished})
 AND (r.completion_status IS NULL OR {completion})
 AND (coalesce(listed_within, 0) = 0 OR l.listing_date >= {NOW} - listed_within * INTERVAL 1 SECOND)""")
    part(f"{prefix}placed", [f"{prefix}filtered"], f"""
SELECT *, CASE WHEN mode <> 'centroid' THEN 0 WHEN dist_km <= 1.5 THEN 1 WHEN dist_km <= 3.5 THEN 2 ELSE 3 END AS rung
FROM (SELECT *, CASE WHEN mode IN ('near', 'centroid') THEN round({km('q_lat', 'q_lon', 'latitude', 'longitude')}, 9) END AS dist_km
 FROM {prefix}filtered) WHERE (dist_km IS NULL OR dist_km <= q_radius) AND (mode <> 'text' OR contains(lower(location_name), term))""")
    part(f"{prefix}hits", [f"{prefix}placed"], f"""
SELECT * FROM (SELECT *, min(rung) OVER (PARTITION BY request_id) AS best FROM {prefix}placed) WHERE rung = best""")
    part(f"{prefix}ordered", [f"{prefix}hits"], f"""
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY key, property_listing_id) AS position
FROM (SELECT *, CASE sort WHEN 'priceAsc' THEN price WHEN 'priceDesc' THEN -price WHEN 'bedroomAsc' THEN beds_int
  WHEN 'bedroomDesc' THEN -beds_int WHEN 'newest' THEN -epoch_us(listing_date) ELSE coalesce(dist_km * 0.1::DOUBLE, 0) END AS key
 FROM {prefix}hits)""")
    part(f"{prefix}meta", [f"{prefix}asked", f"{prefix}filtered", f"{prefix}hits"], f"""
SELECT a.request_id, coalesce(h.n, 0) AS total_count, a.page,
 CASE WHEN mode = 'near' THEN 'geo_radius_' || CAST(q_radius AS VARCHAR) || 'km'
  WHEN mode = 'none' OR f.n IS NULL THEN CASE WHEN is_super_agent THEN 'filters_only_trusted' ELSE 'filters_only' END
  WHEN mode = 'text' THEN 'text_match' WHEN best = 1 THEN 'exact_radius_1.5km' WHEN best = 2 THEN 'nearby_radius_3.5km'
  ELSE 'wider_radius_10km' END
 || CASE WHEN h.n IS NULL THEN '' ELSE CASE WHEN min_price >= 5000000 THEN '_luxury' ELSE '' END
  || CASE sort WHEN 'priceAsc' THEN '_sort_price_low' WHEN 'priceDesc' THEN '_sort_price_high'
   WHEN 'bedroomAsc' THEN '_sort_beds_least' WHEN 'bedroomDesc' THEN '_sort_beds_most' WHEN 'newest' THEN '_sort_newest'
   ELSE '' END END AS search_method
FROM {prefix}asked a LEFT JOIN (SELECT request_id, count(*) AS n FROM {prefix}filtered GROUP BY 1) f ON f.request_id = a.request_id
LEFT JOIN (SELECT request_id, count(*) AS n, min(best) AS best FROM {prefix}hits GROUP BY 1) h ON h.request_id = a.request_id""")


search_parts("s_", "SELECT * FROM search_requests", ["search_requests"])
search_parts("w_", """
SELECT * FROM search_requests UNION ALL BY NAME
SELECT request_id, price AS min_price, price AS max_price, [location_name] AS keywords, FALSE AS is_super_agent, FALSE AS is_verified,
 'featured' AS sort, 1 AS page, 20 AS page_limit FROM ring_requests""", ["search_requests", "ring_requests"])

check("search_filters", ["s_asked", "s_filtered"], """
SELECT a.request_id, count(f.request_id) AS filtered_count FROM s_asked a LEFT JOIN s_filtered f ON f.request_id = a.request_id GROUP BY 1""")
check("search_text", ["s_hits"], "SELECT request_id, count(*) AS total_count FROM s_hits WHERE mode = 'text' GROUP BY 1")
check("search_nearby", ["s_ordered"], """
SELECT request_id, position, property_listing_id, round(dist_km, 6) AS dist_km FROM s_ordered
WHERE mode = 'near' AND position <= page * page_limit""")
check("search_keyword_radius", ["w_hits"], """
SELECT request_id, CAST(rung AS BIGINT) AS rung, count(*) AS total_count FROM w_hits WHERE mode = 'centroid' GROUP BY 1, 2""")
check("search_counts", ["s_meta"], "SELECT request_id, total_count FROM s_meta")
check("search_sorted", ["s_ordered"], """
SELECT request_id, sort, position, property_listing_id FROM s_ordered WHERE position <= page * page_limit""")
part("s_page", ["s_ordered", "s_meta"], """
SELECT o.*, m.total_count, m.search_method FROM s_ordered o JOIN s_meta m ON m.request_id = o.request_id
WHERE position BETWEEN (o.page - 1) * page_limit + 1 AND o.page * page_limit""")
check("search_page", ["s_page"], """
SELECT request_id, position, property_listing_id, price, beds_int, round(dist_km, 6) AS dist_km, total_count,
 CAST(page AS BIGINT) AS page, search_method FROM s_page""")
check("search_method", ["w_meta"], "SELECT request_id, search_method FROM w_meta")


def shown(value: str, places: int = 2) -> str:
    """Rounds the decimal text of a number, half up."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 12)), {places}) AS DOUBLE)"


check("search_response", ["s_page"], f"""
SELECT request_id, position, total_count, property_listing_id AS id, property_title AS title, location_name AS location,
 {shown('latitude')} AS lat, {shown('longitude')} AS lon, {shown('price')} AS price, 'AED' AS currency,
 CASE WHEN offering_type = '2' THEN 'rent' ELSE 'sell' END AS period, beds_int AS bedrooms, '{codes.DEFAULT_IMAGE}' AS image,
 search_method AS tag, 'dist: ' || CAST({shown('coalesce(dist_km, 0)')} AS VARCHAR) || 'km' AS distance_tag,
 CASE WHEN min_price >= 5000000 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS ai_match_percentage,
 CASE WHEN 1 / (1 + greatest(days_old, 0) / 30.0::DOUBLE) >= 0.7 THEN 'Active' ELSE 'Standard' END AS freshness_boost,
 '{codes.DEFAULT_AGENT}' AS agent, {shown('trust_score')} >= threshold AS is_super_agent FROM s_page""")

check("search_json", ["s_page"], f"""
SELECT request_id, position, total_count, search_method, property_listing_id AS id, {shown('price')} AS price,
 '{codes.DEFAULT_IMAGE}' AS image, '{codes.DEFAULT_AGENT}' AS agent FROM s_page""")

# --- recommendation ------------------------------------------------------------------

part("all_requests", ["rec_requests", "model_table"], """
SELECT request_id, offering_type, property_type, price, bedrooms, location_name, latitude, longitude, user_id FROM rec_requests
UNION ALL
SELECT CAST(property_listing_id AS BIGINT) + 1000000000, offering_type, property_type, price * 0.9::DOUBLE, CAST(beds_int AS VARCHAR), '',
 0.0::DOUBLE, 0.0::DOUBLE, NULL
FROM (SELECT *, row_number() OVER (PARTITION BY offering_type, property_type ORDER BY price, property_listing_id) AS nth FROM model_table)
WHERE nth = 1""")
part("wants", ["all_requests", "fit"], f"""
SELECT a.request_id, user_id, price AS cap, beds, coalesce(CASE lower(offering_type) {WORD} END, lower(offering_type)) AS offering_type,
 lower(trim(property_type)) AS property_type, lower(trim(location_name)) AS place, latitude, longitude,
 (price - f.min_price) / (f.max_price - f.min_price) AS q_price, (0 - f.min_size_sqft) / (f.max_size_sqft - f.min_size_sqft) AS q_size_sqft,
 (beds - f.min_beds_int) / (f.max_beds_int - f.min_beds_int) AS q_beds_int, (0 - f.min_bath_int) / (f.max_bath_int - f.min_bath_int) AS q_bath_int
FROM (SELECT *, coalesce(try_cast(regexp_extract(bedrooms, '([0-9]+)', 1) AS BIGINT), 0) AS beds FROM all_requests) a, fit f""")
part("pool", ["wants", "listed"], """
SELECT * FROM (SELECT *, min(level) OVER (PARTITION BY request_id) AS best FROM (
 SELECT r.request_id, r.user_id, r.cap, r.q_price, r.q_size_sqft, r.q_beds_int, r.q_bath_int, r.latitude AS from_lat, r.longitude AS from_lon,
  l.*, CASE WHEN CASE WHEN cap > 0 THEN l.price <= cap ELSE l.price > 0 END THEN
    CASE WHEN l.beds_int = r.beds AND contains(full_location_path, place) THEN 1 WHEN l.beds_int = r.beds THEN 2 ELSE 3 END
   WHEN cap > 0 AND l.price <= cap * 1.25::DOUBLE THEN 4 END AS level
 FROM wants r JOIN listed l ON l.offering_type = r.offering_type AND (r.property_type = 'unknown' OR l.property_type = r.property_type)
  AND l.beds_int BETWEEN r.beds - 1 AND r.beds + 1) WHERE level IS NOT NULL) WHERE level = best""")
check("fallback_levels", ["wants", "pool", "model_table"], """
SELECT w.request_id, CASE WHEN p.level IS NOT NULL THEN 'ok' WHEN EXISTS (SELECT 1 FROM model_table m WHERE m.offering_type = w.offering_type
  AND (w.property_type = 'unknown' OR m.property_type = w.property_type)) THEN 'no_match' ELSE 'no_inventory' END AS status,
 CAST(p.level AS BIGINT) AS level
FROM wants w LEFT JOIN (SELECT request_id, min(level) AS level FROM pool GROUP BY 1) p ON p.request_id = w.request_id""")
part("own_vectors", ["wants", "vocabulary"], """
SELECT w.request_id, w.user_id, property_type, q_price, q_size_sqft, q_beds_int, q_bath_int,
 CASE WHEN v.value IS NOT NULL THEN 1 ELSE 0 END AS known
FROM wants w LEFT JOIN vocabulary v ON v.feature = 'property_type' AND v.value = w.property_type""")
SQUARES = "x_price * x_price + x_size_sqft * x_size_sqft + x_beds_int * x_beds_int + x_bath_int * x_bath_int"
ASKED_SQUARES = "p.q_price * p.q_price + p.q_size_sqft * p.q_size_sqft + p.q_beds_int * p.q_beds_int + p.q_bath_int * p.q_bath_int"
DOT = "x_price * p.q_price + x_size_sqft * p.q_size_sqft + x_beds_int * p.q_beds_int + x_bath_int * p.q_bath_int"
part("own_similar", ["pool", "own_vectors"], f"""
SELECT p.*, FALSE AS personalized, (CASE WHEN p.property_type = v.property_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + {DOT})
 / (sqrt(5.0::DOUBLE + {SQUARES}) * sqrt({ASKED_SQUARES} + v.known)) AS similarity_score
FROM pool p JOIN own_vectors v ON v.request_id = p.request_id""")


def neighbours(name: str, source: str) -> None:
    part(name, [source], f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY similarity_score DESC, property_listing_id) AS nearest
 FROM {source}) WHERE nearest <= 50""")
    part(f"{name}_final", [name, "model_table"], f"""
SELECT *, similarity_score * 0.40::DOUBLE + geo_score * 0.30::DOUBLE + pop_score * 0.20::DOUBLE + freshness_score * 0.10::DOUBLE AS final_score
FROM (SELECT *, CASE WHEN level = 2 THEN 1 / (dist_km + 1) ELSE 1.0::DOUBLE END AS geo_score,
  ln(1 + smart_popularity_score) / ln(1 + (SELECT max(smart_popularity_score) FROM model_table)) AS pop_score
 FROM (SELECT *, {km('from_lat', 'from_lon', 'latitude', 'longitude')} AS dist_km FROM {name}) WHERE level <> 2 OR dist_km <= 5.0)""")


def recommended(name: str) -> str:
    return f"""
SELECT request_id, position, property_listing_id, property_type, price, beds_int,
 CASE level WHEN 1 THEN 'Exact Match' WHEN 2 THEN 'Nearby (Radius Fallback)' WHEN 3 THEN 'Similar Layout (+/- 1 Bed)'
  ELSE 'Higher Budget Options' END || CASE WHEN personalized THEN ' (Personalized)' ELSE '' END AS match_reason,
 round(final_score, 6) AS final_score, substr(full_location_path, 1, 40) AS display_location
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, property_listing_id) AS position FROM {name}_final)
WHERE position <= 5"""


neighbours("own_nearest", "own_similar")
check("knn_similarity", ["own_nearest"], """
SELECT request_id, nearest, property_listing_id, round(similarity_score, 6) AS similarity_score FROM own_nearest""")
check("recommend", ["own_nearest_final"], recommended("own_nearest"))
part("seen", ["rec_history", "listed"], """
SELECT h.user_id, l.* FROM (SELECT DISTINCT user_id, property_listing_id FROM rec_history) h
JOIN listed l ON l.property_listing_id = h.property_listing_id""")
part("means", ["seen"], """
SELECT user_id, count(*) AS n, avg(x_price) AS x_price, avg(x_size_sqft) AS x_size_sqft, avg(x_beds_int) AS x_beds_int,
 avg(x_bath_int) AS x_bath_int FROM seen GROUP BY 1""")
part("shares", ["seen", "means"], "SELECT u.user_id, feature, value, c / n::DOUBLE AS share FROM (" + " UNION ALL ".join(
    f"SELECT user_id, '{c}' AS feature, {c} AS value, count(*) AS c FROM seen GROUP BY ALL" for c in CATEGORIES
) + ") s JOIN means u ON u.user_id = s.user_id")
part("norms", ["shares"], "SELECT user_id, sum(share * share) AS squares FROM shares GROUP BY 1")
check("user_centroid", ["means", "norms", "shares"], """
SELECT m.user_id, n, round(x_price, 9) AS x_price, round(x_size_sqft, 9) AS x_size_sqft, round(x_beds_int, 9) AS x_beds_int,
 round(x_bath_int, 9) AS x_bath_int, round(coalesce(share, 0), 9) AS villa_share, round(squares, 9) AS share_squares
FROM means m JOIN norms USING (user_id)
LEFT JOIN shares s ON s.user_id = m.user_id AND s.feature = 'property_type' AND s.value = 'villa'""")
SHARE_JOINS = " ".join(
    f"LEFT JOIN shares s{i} ON s{i}.user_id = p.user_id AND s{i}.feature = '{c}' AND s{i}.value = p.{c}"
    for i, c in enumerate(CATEGORIES))
SHARE_SUM = " + ".join(f"coalesce(s{i}.share, 0)" for i in range(len(CATEGORIES)))
part("their_similar", ["own_similar", "means", "norms", "shares"], f"""
SELECT * FROM own_similar WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM means)
UNION ALL
SELECT p.* EXCLUDE (personalized, similarity_score), TRUE,
 ({SHARE_SUM} + p.x_price * u.x_price + p.x_size_sqft * u.x_size_sqft + p.x_beds_int * u.x_beds_int + p.x_bath_int * u.x_bath_int)
 / (sqrt(5.0::DOUBLE + {SQUARES.replace('x_', 'p.x_')})
  * sqrt({SQUARES.replace('x_', 'u.x_')} + squares))
FROM own_similar p JOIN means u ON u.user_id = p.user_id JOIN norms q ON q.user_id = p.user_id {SHARE_JOINS}""")
neighbours("their_nearest", "their_similar")
check("recommend_personalized", ["their_nearest_final"], recommended("their_nearest"))

# --- learning to rank ----------------------------------------------------------------

check("training_set", ["src_event", "model_table"], f"""
SELECT e.listing_web_id AS property_listing_id, count(*) AS n, count(*) FILTER (event_name IN ({quoted(codes.LEAD_EVENTS)})) AS leads,
 max(price) AS price, max(view_count) AS view_count
FROM src_event e JOIN model_table m ON m.property_listing_id = e.listing_web_id GROUP BY 1""")
def digest(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


SPLIT = f"{digest('property_listing_id')} % 5 = 0"
check("train_split", ["model_table"], f"SELECT property_listing_id, {SPLIT} AS is_test FROM model_table")
check("train_interactions", ["src_event", "model_table"], f"""
SELECT count(*) AS n, count(*) FILTER (event_name IN ({quoted(codes.LEAD_EVENTS)})) AS leads, TRUE AS auc_known
FROM src_event e JOIN (SELECT * FROM model_table WHERE {SPLIT}) m ON m.property_listing_id = e.listing_web_id""")
check("train_listings", ["model_table"], f"""
SELECT leak, count(*) AS n, CAST(sum(target_is_lead) AS BIGINT) AS leads, TRUE AS auc_known
FROM model_table, (SELECT unnest([TRUE, FALSE]) AS leak) WHERE {SPLIT} GROUP BY 1""")
check("feature_importance", [], f"SELECT unnest([{quoted(LISTING_FEATURES)}]) AS feature, TRUE AS valid, 1.0::DOUBLE AS total")
check("model_roundtrip", ["model_table"], "SELECT count(*) AS n, 0 AS differing FROM model_table")
check("sample_interactions", ["model_table"], f"""
SELECT i AS interaction_id, property_listing_id, CASE WHEN {digest("i || ':43'")} % 100 < 10 THEN 1 ELSE 0 END AS target_is_lead
FROM (SELECT i, {digest("i || ':42'")} % (SELECT count(*) FROM model_table) AS spot FROM range(1000) r(i)) d
JOIN (SELECT *, sum(size) OVER (ORDER BY bucket) AS upto FROM (SELECT bucket, count(*) AS size FROM
  (SELECT {digest('property_listing_id')} % 1024 AS bucket FROM model_table) GROUP BY 1)) b ON spot < upto AND spot >= upto - size
JOIN (SELECT property_listing_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY property_listing_id) AS place FROM
  (SELECT property_listing_id, {digest('property_listing_id')} % 1024 AS bucket FROM model_table)) m
 ON m.bucket = b.bucket AND m.place = upto - spot""")
# The columns of the raw listings and their types.
part("kinds", [], """
SELECT * FROM (VALUES
 ('property_listing_id', 'string'), ('agent_id', 'bigint'), ('key_location', 'bigint'), ('property_title', 'string'),
 ('property_type', 'string'), ('offering_type', 'string'), ('bedrooms', 'string'), ('bathrooms', 'string'),
 ('pp_price', 'string'), ('property_sqft', 'bigint'), ('latitude', 'double'), ('longitude', 'double'),
 ('location_name', 'string'), ('full_location_path', 'string'), ('location_id', 'int'), ('furnished_flag', 'string'),
 ('completion_status', 'string'), ('is_verified', 'boolean'), ('property_serp_score', 'bigint'), ('property_listing_status', 'string'),
 ('start_time', 'timestamp_ntz'), ('ingest_seq', 'int')
) k(column_name, column_type)""")
check("profile_schema", ["raw_listings", "kinds"], """
SELECT column_name, column_type, (SELECT count(*) FROM raw_listings) AS row_count, (SELECT count(*) FROM kinds) AS column_count
FROM kinds""")
check("search_scored", ["s_page"], """
SELECT request_id, total_count, search_method, count(*) AS n, TRUE AS ranked, TRUE AS ordered, TRUE AS in_range
FROM s_page GROUP BY 1, 2, 3""")
check("recommend_ai", ["their_nearest_final"], """
SELECT request_id, least(count(*), 5) AS n, TRUE AS blended, TRUE AS ordered FROM their_nearest_final GROUP BY 1""")
check("auc", ["model_table"], """
SELECT round((sum(r) FILTER (target_is_lead = 1) - count(*) FILTER (target_is_lead = 1) * (count(*) FILTER (target_is_lead = 1) + 1) / 2.0::DOUBLE)
 / (count(*) FILTER (target_is_lead = 1) * count(*) FILTER (target_is_lead = 0)), 6) AS auc
FROM (SELECT target_is_lead, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r
 FROM (SELECT target_is_lead, (freshness_score + trust_score) / 2 AS s FROM model_table))""")
