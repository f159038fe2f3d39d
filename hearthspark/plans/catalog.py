"""Every operator as a query over one folder of sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthspark import schemas
from hearthspark.functions import cleaning, codes, geo, scoring
from hearthspark.operators import clean, etl, features, profile, ranker, recommend, search
from hearthspark.plans.jobs import Workspace
from hearthspark.schemas import conform
from hearthspark.session import stage_path
from hearthspark.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FEATURE_LIST = ["price", "size_sqft", "beds_int", "bath_int"]


def query(make: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    QUERIES[make.__name__] = lambda spark, sf_dir: make(Workspace(spark, sf_dir))
    return make


def _long(name: str):
    return F.col(name).cast("bigint").alias(name)


def _round(name: str, places: int = 6):
    return F.round(F.col(name), places).alias(name)


# --- sources and sinks -----------------------------------------------------------

def dirty_text(ws: Workspace) -> DataFrame:
    """Raw listings whose titles have edge spaces, line ends, quotes, commas, no characters, or are missing."""
    title = F.expr(
        """CASE CAST(property_listing_id AS BIGINT) % 8 WHEN 0 THEN '  ' || property_title || ' ' WHEN 1 THEN property_title || chr(10) || 'line two'
        WHEN 2 THEN '"' || property_title || '", said "she"' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN chr(92) || property_title || chr(92)
        WHEN 6 THEN chr(13) || chr(10) || property_title || chr(9) ELSE property_title END"""
    )
    return ws.sources.raw_listings().withColumn("property_title", title)


@query
def csv_scan(ws: Workspace) -> DataFrame:
    """Raw listings written as CSV and read back under their schema."""
    raw = dirty_text(ws)
    path = stage_path(ws.spark, f"{ws.sf_dir}|csv_scan")
    files.write_csv(raw, path)
    back = files.read_csv(ws.spark, path, raw.schema)
    return back.groupBy("property_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("bedrooms").alias("with_bedrooms"),
        F.count("property_title").alias("with_title"),
        F.sum(F.length("property_title")).alias("title_length"),
        F.sum("property_sqft").cast("bigint").alias("total_sqft"),
        F.max("start_time").alias("latest"),
    )


@query
def csv_roundtrip(ws: Workspace) -> DataFrame:
    """Raw text, dirty titles included, and dates through the CSV sink."""
    table = dirty_text(ws).select(
        "property_listing_id", _long("ingest_seq"), "property_title", "property_type", "bedrooms", "location_name", "start_time"
    )
    path = stage_path(ws.spark, f"{ws.sf_dir}|csv_roundtrip")
    files.write_csv(table, path)
    return files.read_csv(ws.spark, path, table.schema)


@query
def serving_roundtrip(ws: Workspace) -> DataFrame:
    """The serving table through the partitioned Parquet sink."""
    path = stage_path(ws.spark, f"{ws.sf_dir}|serving")
    files.write_serving(ws.serving(), path)
    return files.read_serving(ws.spark, path, schemas.SERVING).select(
        "property_listing_id", "offering_type", "property_type", "location_name", "price", "beds_int", "is_verified"
    )


@query
def merge_signals(ws: Workspace) -> DataFrame:
    """Listings with their signals file; a missing file leaves listings alone."""
    path = stage_path(ws.spark, f"{ws.sf_dir}|signals")
    files.write_csv(etl.signals(ws.sources.event(), ws.as_of), path)
    raw = ws.sources.raw_listings()
    found = files.read_optional(lambda: files.read_csv(ws.spark, path, schemas.SIGNALS))
    missing = files.read_optional(lambda: files.read_parquet(ws.spark, path + "-none"))
    merged = files.merge_signals(files.merge_signals(raw, found), missing)
    return merged.select(
        "property_listing_id", _long("ingest_seq"), "view_count", "impression_count", "favorite_count",
        "lead_click_count", "lead_submission_count",
    )


@query
def conform_schema(ws: Workspace) -> DataFrame:
    """Raw listings made to fit the serving schema."""
    raw = clean.rename_source(ws.sources.raw_listings())
    fitted = conform(raw, schemas.SERVING, schemas.SERVING_DEFAULTS)
    return fitted.select(
        "property_listing_id", "price", "beds_int", "size_sqft", "quality_score", "trust_score",
        "location_id", "image_url", "is_verified",
    )


@query
def validate_requests(ws: Workspace) -> DataFrame:
    """Requests as they are, and with limits beyond 32 bits, fractions and words where numbers belong."""
    plain = ws.sources.search_requests().withColumn("odd", F.lit(False))
    odd = ws.sources.odd_requests().withColumn("odd", F.lit(True))
    checked = [search.validate(r).withColumn("odd", F.lit(o)) for r, o in ((plain, False), (odd, True))]
    return checked[0].unionByName(checked[1]).select(
        "request_id", "odd", "min_price", F.col("reject_reason").isNull().alias("accepted"), "reject_reason"
    )


@query
def sample_interactions(ws: Workspace) -> DataFrame:
    return ranker.sample_interactions(ws.model_table())


@query
def serving_columns(ws: Workspace) -> DataFrame:
    return features.serving_columns(ws.model_table()).select(
        "property_listing_id", "property_title", "location_name", "price", _long("beds_int"), _long("bath_int"),
        "latitude", "longitude", "listing_date", "property_type", "offering_type", "is_verified", "completion_status",
    )


# --- ETL ---------------------------------------------------------------------------

@query
def active_listings(ws: Workspace) -> DataFrame:
    return etl.active_listings(ws.sources.listing(), ws.as_of).select(
        "property_listing_id", "agent_id", "key_location", "property_type", "start_time"
    )


@query
def engagement(ws: Workspace) -> DataFrame:
    return etl.engagement(ws.sources.event(), ws.as_of)


@query
def engagement_14d(ws: Workspace) -> DataFrame:
    return etl.engagement(ws.sources.event(), ws.as_of, days=14)


@query
def etl_inventory(ws: Workspace) -> DataFrame:
    return ws.inventory().select(
        "property_listing_id", "latitude", "longitude", "location_name", "property_title", "property_type",
        "beds_int", "bath_int", "size_sqft", "price", "listing_date", "quality_score", "trust_score", "image_url",
        "agent_name", "offering_type", "furnished_flag", "completion_status", "is_verified", "location_id",
        "full_location_path", "view_count", "lead_click_count", "lead_submission_count", "popularity_score",
        _round("smart_popularity_score"),
    )


# --- cleaning ------------------------------------------------------------------------

@query
def dedup_listings(ws: Workspace) -> DataFrame:
    return clean.keep_first(ws.sources.raw_listings()).select("property_listing_id", _long("ingest_seq"), "pp_price")


@query
def clean_numbers(ws: Workspace) -> DataFrame:
    df = clean.clean_numbers(clean.rename_source(ws.sources.raw_listings()))
    return df.select("property_listing_id", _long("ingest_seq"), "price", "size_sqft", "latitude", "longitude")


@query
def impute_median(ws: Workspace) -> DataFrame:
    df = clean.clean_numbers(clean.rename_source(ws.sources.raw_listings()))
    return clean.impute_median(df).select("property_listing_id", _long("ingest_seq"), "price", "size_sqft")


@query
def parse_beds_baths(ws: Workspace) -> DataFrame:
    return clean.parse_rooms(ws.sources.raw_listings()).select(
        "property_listing_id", _long("ingest_seq"), _long("beds_int"), _long("bath_int")
    )


@query
def clean_text(ws: Workspace) -> DataFrame:
    return clean.clean_text(ws.sources.raw_listings()).select(
        "property_listing_id", _long("ingest_seq"), "property_type", "location_name", "full_location_path",
        "offering_type",
    )


@query
def parse_dates(ws: Workspace) -> DataFrame:
    """Dates as text, every seventh of them broken, parsed back."""
    broken = F.when(F.col("property_listing_id").cast("bigint") % 7 == 0, F.lit("not a date"))
    text = ws.sources.raw_listings().select(
        "property_listing_id", "ingest_seq", F.coalesce(broken, F.col("start_time").cast("string")).alias("listing_date")
    )
    return clean.parse_dates(text).select("property_listing_id", _long("ingest_seq"), "listing_date")


@query
def normalize_flags(ws: Workspace) -> DataFrame:
    return clean.normalize_flags(ws.sources.raw_listings()).select(
        "property_listing_id", _long("ingest_seq"), "furnished_flag", "completion_status", "is_verified"
    )


@query
def map_codes(ws: Workspace) -> DataFrame:
    """Codes of both request tables in their own terms."""
    searches = ws.sources.search_requests().select(
        "request_id",
        codes.lookup(codes.OFFERING_BY_CATEGORY, F.col("category_id")).alias("offering_type"),
        F.array_join(codes.type_names(F.col("property_type_ids")), ",").alias("property_types"),
    )
    words = ws.sources.rec_requests().select(
        "request_id", codes.offering_word(F.lower("offering_type")).alias("asked_offering")
    )
    return searches.join(words, "request_id")


# --- features ------------------------------------------------------------------------

@query
def model_table(ws: Workspace) -> DataFrame:
    return ws.model_table().select(
        "property_listing_id", "property_type", "offering_type", "location_name", "full_location_path", "price",
        "size_sqft", "latitude", "longitude", _long("beds_int"), _long("bath_int"), "furnished_flag",
        "completion_status", "is_verified", "listing_date", _long("days_old"), "freshness_score", "quality_score",
        "view_count", _round("smart_popularity_score"), "trust_score", _long("target_is_lead"),
    )


@query
def model_input(ws: Workspace) -> DataFrame:
    """The model's columns straight from the raw flags."""
    raw = clean.clean_text(clean.rename_source(ws.sources.raw_listings()))
    names = ["quality_score", "furnished_flag", "completion_status", "offering_type", "property_type", "location_id"]
    return features.model_input(raw, names).select("property_listing_id", _long("ingest_seq"), *names)


@query
def freshness(ws: Workspace) -> DataFrame:
    table = features.add_freshness(clean.rename_source(ws.sources.raw_listings()), ws.as_of)
    return table.select(
        "property_listing_id", _long("ingest_seq"), _long("days_old"), "freshness_score",
        features.search_freshness(table, ws.as_of).alias("search_freshness"),
    )


@query
def smart_popularity(ws: Workspace) -> DataFrame:
    scored = features.add_popularity(etl.signals(ws.sources.event(), ws.as_of))
    return scored.select("property_listing_id", _round("smart_popularity_score"))


@query
def trust_score(ws: Workspace) -> DataFrame:
    listing = ws.sources.listing().select("property_listing_id", "agent_id")
    scored = features.add_trust(listing.join(ws.sources.agent_score(), "agent_id", "left"))
    return scored.select("property_listing_id", "trust_score")


@query
def feature_scaling(ws: Workspace) -> DataFrame:
    table = ws.model_table()
    return features.with_scaling(table, features.fit_scaling(table)).select(
        "property_listing_id", *[_round(f"x_{c}", 9) for c in FEATURE_LIST]
    )


@query
def category_vocab(ws: Workspace) -> DataFrame:
    return features.category_vocabulary(ws.model_table())


@query
def history_seeds(ws: Workspace) -> DataFrame:
    return features.history_seeds(ws.model_table())


@query
def haversine(ws: Workspace) -> DataFrame:
    """Every listing's distance from its location's centroid."""
    serving = ws.serving()
    centers = search.location_centroids(serving).select(
        "location_name", F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon")
    )
    km = geo.haversine("c_lat", "c_lon", "latitude", "longitude")
    return serving.join(centers, "location_name").select("property_listing_id", F.round(km, 6).alias("dist_km"))


# --- profile -------------------------------------------------------------------------

@query
def profile_duplicates(ws: Workspace) -> DataFrame:
    return profile.duplicates(ws.sources.raw_listings())


@query
def profile_nulls(ws: Workspace) -> DataFrame:
    """Missing values of the listings joined with their signals."""
    merged = files.merge_signals(ws.sources.raw_listings(), etl.signals(ws.sources.event(), ws.as_of))
    names = ["price", "location_name", "latitude", "view_count", "bedrooms", "bathrooms", "furnished_flag"]
    return profile.nulls(clean.rename_source(merged), names)


@query
def profile_schema(ws: Workspace) -> DataFrame:
    return profile.schema(ws.sources.raw_listings())


@query
def value_counts(ws: Workspace) -> DataFrame:
    """All quality scores, and the five most frequent property types."""
    table = ws.model_table()
    quality = profile.value_counts(table, "quality_score").select(
        F.lit("quality_score").alias("column_name"), F.col("quality_score").cast("bigint").cast("string").alias("value"), "n"
    )
    types = profile.value_counts(table, "property_type", 5).select(
        F.lit("property_type").alias("column_name"), F.col("property_type").alias("value"), "n"
    )
    return quality.unionByName(types)


@query
def profile_price(ws: Workspace) -> DataFrame:
    return profile.price_summary(ws.model_table()).select(_round("mean_price", 3), "top_location")


@query
def price_histogram(ws: Workspace) -> DataFrame:
    return profile.price_histogram(ws.model_table()).select(_long("bin"), "n")


# --- search --------------------------------------------------------------------------

def ring_requests(ws: Workspace) -> DataFrame:
    """Searches that need the wider rungs: a location's keyword and the price of a
    listing 2-3 km or 5-6 km from its centroid that no other listing has."""
    serving = ws.serving()
    unique = serving.groupBy("price").count().filter("count = 1").select("price")
    centers = search.location_centroids(serving).select(
        "location_name", F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon")
    )
    km = geo.haversine("c_lat", "c_lon", "latitude", "longitude")
    ring = F.when(km.between(2, 3), 1).when(km.between(5, 6), 2).when(F.col("latitude") == 0, 3)
    first = Window.partitionBy("location_name", "ring").orderBy(F.col("property_listing_id").cast("bigint"))
    picked = (
        serving.join(unique, "price")
        .join(centers, "location_name")
        .withColumn("ring", ring)
        .filter("ring IS NOT NULL AND price = floor(price)")
        .withColumn("nth", F.row_number().over(first))
        .filter("nth = 1")
    )
    rows = picked.select(
        (F.col("property_listing_id").cast("bigint") * 10 + F.col("ring") + 1_000_000_000).alias("request_id"),
        F.col("price").alias("min_price"),
        F.col("price").alias("max_price"),
        F.array("location_name").alias("keywords"),
    )
    return conform(rows, schemas.SEARCH_REQUEST, fill_nulls=False)


@query
def location_centroids(ws: Workspace) -> DataFrame:
    return search.location_centroids(ws.serving()).select("location_name", _round("latitude"), _round("longitude"))


@query
def super_agent_threshold(ws: Workspace) -> DataFrame:
    return search.trust_threshold(ws.serving()).select(_round("threshold", 9))


@query
def search_filters(ws: Workspace) -> DataFrame:
    return search.filtered_counts(ws.sources.search_requests(), ws.search_index(), ws.as_of)


def _by_mode(ws: Workspace, requests: DataFrame, mode: str) -> tuple[DataFrame, search.SearchIndex]:
    index = ws.search_index()
    return search.resolve(requests, index, ws.as_of).filter(F.col("mode") == mode), index


@query
def search_text(ws: Workspace) -> DataFrame:
    resolved, index = _by_mode(ws, ws.sources.search_requests(), "text")
    return search.count_matches(resolved, index).select("request_id", "total_count")


@query
def search_nearby(ws: Workspace) -> DataFrame:
    resolved, index = _by_mode(ws, ws.sources.search_requests(), "near")
    return search.top_matches(resolved, index).select(
        "request_id", _long("position"), "property_listing_id", _round("dist_km")
    )


@query
def search_keyword_radius(ws: Workspace) -> DataFrame:
    both = ws.sources.search_requests().unionByName(ring_requests(ws))
    resolved, index = _by_mode(ws, both, "centroid")
    return search.count_matches(resolved, index).select("request_id", _long("rung"), "total_count")


@query
def search_counts(ws: Workspace) -> DataFrame:
    return search.counts(ws.sources.search_requests(), ws.search_index(), ws.as_of)


@query
def search_sorted(ws: Workspace) -> DataFrame:
    """The listings up to the end of each request's page, in its order."""
    resolved = search.resolve(ws.sources.search_requests(), ws.search_index(), ws.as_of)
    return search.top_matches(resolved, ws.search_index()).join(
        resolved.select("request_id", "sort"), "request_id"
    ).select("request_id", "sort", _long("position"), "property_listing_id")


@query
def search_page(ws: Workspace) -> DataFrame:
    return search.search(ws.sources.search_requests(), ws.search_index(), ws.as_of).select(
        "request_id", _long("position"), "property_listing_id", "price", _long("beds_int"), _round("dist_km"),
        "total_count", _long("page"), "search_method",
    )


@query
def search_method(ws: Workspace) -> DataFrame:
    requests = ws.sources.search_requests().unionByName(ring_requests(ws))
    return search.meta(requests, ws.search_index(), ws.as_of).select("request_id", "search_method")


@query
def search_response(ws: Workspace) -> DataFrame:
    index = ws.search_index()
    found = search.search(ws.sources.search_requests(), index, ws.as_of)
    p = F.col("property")
    return search.response(found, index, ws.as_of).select(
        "request_id", _long("position"), F.col("meta.total_count").alias("total_count"),
        p["id"].alias("id"), p["title"].alias("title"), p["location"]["name"].alias("location"),
        p["location"]["lat"].alias("lat"), p["location"]["lon"].alias("lon"), p["price"]["value"].alias("price"),
        p["price"]["currency"].alias("currency"), p["price"]["period"].alias("period"),
        p["bedrooms"]["value"].cast("bigint").alias("bedrooms"), p["images"][0]["medium"].alias("image"),
        p["tags"][0].alias("tag"), p["tags"][1].alias("distance_tag"),
        p["scores"]["ai_match_percentage"].alias("ai_match_percentage"),
        p["scores"]["freshness_boost"].alias("freshness_boost"), p["agent"]["name"].alias("agent"),
        p["agent"]["is_super_agent"].alias("is_super_agent"),
    )


@query
def search_json(ws: Workspace) -> DataFrame:
    """The response as JSON text, read back by path."""
    index = ws.search_index()
    found = search.search(ws.sources.search_requests(), index, ws.as_of)
    sent = search.response_json(search.response(found, index, ws.as_of))
    return sent.select(
        "request_id", _long("position"),
        F.get_json_object("meta", "$.total_count").cast("bigint").alias("total_count"),
        F.get_json_object("meta", "$.search_method").alias("search_method"),
        F.get_json_object("property", "$.id").alias("id"),
        F.get_json_object("property", "$.price.value").cast("double").alias("price"),
        F.get_json_object("property", "$.images[0].medium").alias("image"),
        F.get_json_object("property", "$.agent.name").alias("agent"),
    )


@query
def search_scored(ws: Workspace) -> DataFrame:
    """Pages ranked by the listing model: how many rows, and whether rank and order follow from score and distance."""
    requests = ws.sources.search_requests()
    found = search.search(requests, ws.scored_index(), ws.as_of).join(
        requests.select("request_id", F.coalesce("sort", F.lit("featured")).alias("sort")), "request_id"
    )
    rank = F.col("ai_score") - F.coalesce("dist_km", F.lit(0.0)) * search.RANK_PER_KM
    before = F.lag("final_rank").over(Window.partitionBy("request_id").orderBy("position"))
    falls = (F.col("sort") != "featured") | before.isNull() | (before >= F.col("final_rank") - 1e-9)
    return (
        found.withColumns({"ranked": F.abs(F.col("final_rank") - rank) < 1e-9, "ordered": falls})
        .groupBy("request_id", "total_count", "search_method")
        .agg(
            F.count(F.lit(1)).alias("n"), F.every("ranked").alias("ranked"), F.every("ordered").alias("ordered"),
            F.every(F.col("ai_score").between(0, 110)).alias("in_range"),
        )
    )


# --- recommendation --------------------------------------------------------------------

def stretched_requests(ws: Workspace) -> DataFrame:
    """For every offering and type a request just below the cheapest listing."""
    cheapest = ws.model_table().groupBy("offering_type", "property_type").agg(
        F.min_by(F.struct("property_listing_id", "price", "beds_int"), F.struct("price", "property_listing_id")).alias("c")
    )
    return cheapest.select(
        (F.col("c.property_listing_id").cast("bigint") + 1_000_000_000).alias("request_id"),
        "offering_type", "property_type", (F.col("c.price") * 0.9).alias("price"),
        F.col("c.beds_int").cast("string").alias("bedrooms"), F.lit("").alias("location_name"),
        F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.lit(None).cast("bigint").alias("user_id"),
    )


def all_rec_requests(ws: Workspace) -> DataFrame:
    return ws.sources.rec_requests().unionByName(stretched_requests(ws))


@query
def fallback_levels(ws: Workspace) -> DataFrame:
    return recommend.statuses(all_rec_requests(ws), ws.recommend_index()).select("request_id", "status", _long("level"))


@query
def knn_similarity(ws: Workspace) -> DataFrame:
    return recommend.candidates(all_rec_requests(ws), ws.recommend_index()).select(
        "request_id", _long("nearest"), "property_listing_id", _round("similarity_score")
    )


@query
def user_centroid(ws: Workspace) -> DataFrame:
    index = ws.recommend_index()
    users = recommend.user_centroids(ws.sources.rec_history(), ws.model_table(), index.scaling)
    shares = recommend.user_shares(ws.sources.rec_history(), ws.model_table(), index.scaling)
    is_villa = (F.col("feature") == "property_type") & (F.col("value") == "villa")
    villa = F.coalesce(F.max(F.when(is_villa, F.col("share"))), F.lit(0.0))
    by_user = shares.groupBy("user_id").agg(
        F.round(villa, 9).alias("villa_share"), F.round(F.sum(F.col("share") * F.col("share")), 9).alias("share_squares")
    )
    return users.join(by_user, "user_id").select(
        "user_id", "n", *[_round(f"x_{c}", 9) for c in FEATURE_LIST], "villa_share", "share_squares"
    )


def _recommended(found: DataFrame) -> DataFrame:
    return found.select(
        "request_id", _long("position"), "property_listing_id", "property_type", "price", _long("beds_int"),
        "match_reason", _round("final_score"), "display_location",
    )


@query
def recommendations(ws: Workspace) -> DataFrame:
    return _recommended(recommend.recommend(all_rec_requests(ws), ws.recommend_index()))


@query
def recommend_personalized(ws: Workspace) -> DataFrame:
    return _recommended(
        recommend.recommend(
            all_rec_requests(ws), ws.recommend_index(), ws.sources.rec_history(), ws.model_table()
        )
    )


@query
def recommend_ai(ws: Workspace) -> DataFrame:
    """Re-ranked recommendations: how many rows, and whether blend and order follow from both scores."""
    pool = recommend.recommend(
        all_rec_requests(ws), ws.recommend_index(), ws.sources.rec_history(), ws.model_table(), recommend.NEIGHBOURS
    )
    ranked = ranker.rerank(pool, ws.model_table(), ws.interaction_model())
    both = ranked.join(pool.select("request_id", "property_listing_id", "final_score"), ["request_id", "property_listing_id"])
    blend = F.col("final_score") * ranker.CANDIDATE_SHARE + F.col("ai_conversion_score") * ranker.LEAD_SHARE
    before = F.lag("final_hybrid_score").over(Window.partitionBy("request_id").orderBy("position"))
    return (
        both.withColumns(
            {
                "blended": F.abs(F.col("final_hybrid_score") - blend) < 1e-9,
                "ordered": before.isNull() | (before >= F.col("final_hybrid_score")),
            }
        )
        .groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("n"), F.every("blended").alias("blended"), F.every("ordered").alias("ordered"))
    )


# --- learning to rank --------------------------------------------------------------------

@query
def training_set(ws: Workspace) -> DataFrame:
    """Lead events as interactions, joined with their listings."""
    interactions = ranker.event_interactions(ws.sources.event())
    table = ranker.training_set(interactions, ws.model_table())
    return table.groupBy("property_listing_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("target_is_lead").alias("leads"), F.max("price").alias("price"),
        F.max("view_count").alias("view_count"),
    )


@query
def train_split(ws: Workspace) -> DataFrame:
    """A fifth of the listings held out, as training holds them out."""
    return ws.split_listings().select("property_listing_id", "is_test")


def area_report(test: DataFrame, model) -> DataFrame:
    """Rows, leads and the area under the curve of a model on held-out rows."""
    area = ranker.auc(ranker.probability(test, model))
    totals = test.agg(F.count(F.lit(1)).alias("n"), F.sum("target_is_lead").cast("bigint").alias("leads"))
    return totals.withColumn("auc", area.scalar())


def interaction_report(ws: Workspace) -> DataFrame:
    return area_report(ws.training_set().filter("is_test"), ws.interaction_model())


def listing_report(ws: Workspace) -> DataFrame:
    """With and without the popularity that counts a listing's own leads."""
    test = ws.split_listings().filter("is_test")
    leak, clean_fit = (
        area_report(test, ws.listing_model_held_out(leak)).withColumn("leak", F.lit(leak)) for leak in (True, False)
    )
    return leak.unionByName(clean_fit)


@query
def train_interactions(ws: Workspace) -> DataFrame:
    """The interaction model on held-out listings; the area depends on the learner's draws, so only its range shows."""
    return interaction_report(ws).select("n", "leads", F.col("auc").between(0, 1).alias("auc_known"))


@query
def train_listings(ws: Workspace) -> DataFrame:
    """The listing model on held-out listings, with and without the popularity that counts a listing's leads."""
    return listing_report(ws).select("leak", "n", "leads", F.col("auc").between(0, 1).alias("auc_known"))


@query
def feature_importance(ws: Workspace) -> DataFrame:
    """The listing model's inputs; their importances are not negative and add up to one."""
    found = ranker.importances(ws.spark, ws.listing_model())
    total = found.agg(F.round(F.sum("importance"), 9)).scalar()
    return found.select("feature", (F.col("importance") >= 0).alias("valid"), total.alias("total"))


@query
def model_roundtrip(ws: Workspace) -> DataFrame:
    """Listings whose score differs once the model is saved and read back."""
    names = ["property_listing_id", "lead_probability"]
    first = ranker.probability(ws.model_table(), ws.listing_model()).select(*names)
    loaded = ranker.load(ws.model_path("listing"))
    again = ranker.probability(ws.model_table(), loaded).select(names[0], F.col(names[1]).alias("again"))
    differs = ~F.col("again").eqNullSafe(F.col("lead_probability"))
    return first.join(again, names[0]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(differs).alias("differing")
    )


@query
def auc(ws: Workspace) -> DataFrame:
    """How well freshness and trust alone order listings by leads."""
    table = ws.model_table().withColumn("s", (F.col("freshness_score") + F.col("trust_score")) / 2)
    return ranker.auc(table, "s").select(_round("auc"))


QUERIES["recommend"] = QUERIES.pop("recommendations")
