"""Warehouse tables to one inventory table with engagement counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspark.functions import codes, scoring


def active_listings(listing: DataFrame, as_of) -> DataFrame:
    """Online listings that started within the last six months."""
    since = scoring.moment(as_of) - F.expr("INTERVAL 6 MONTHS")
    return listing.filter((F.col("property_listing_status") == "online") & (F.col("start_time") >= since))


def valid_prices(price: DataFrame) -> DataFrame:
    return price.filter(F.col("pp_price") > 0)


def places(location: DataFrame) -> DataFrame:
    """Locations with coordinates, under their display names."""
    return location.filter(F.col("coordinates_lat").isNotNull() & (F.col("coordinates_lat") != 0)).select(
        "key_location",
        F.col("location_id").cast("string").alias("location_id"),
        F.col("coordinates_lat").alias("latitude"),
        F.col("coordinates_lon").alias("longitude"),
        F.coalesce("location_name_english", "location_name_primary").alias("location_name"),
        F.coalesce("location_tower_name", "location_path_name_primary").alias("full_location_path"),
    )


def _recent(event: DataFrame, as_of, days: int) -> DataFrame:
    since = scoring.moment(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return event.filter((F.col("derived_timestamp") >= since) & F.col("listing_web_id").isNotNull())


def _count(names: list[str]):
    return F.count_if(F.col("event_name").isin(*names))


def engagement(event: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Views, clicks, leads and their weighted score per listing.

    Counting starts before the shuffle, so a listing with a third of all
    events still sends one row per input partition.
    """
    return (
        _recent(event, as_of, days)
        .groupBy(F.col("listing_web_id").alias("property_listing_id"))
        .agg(
            _count(codes.VIEW_EVENTS).alias("view_count"),
            _count(codes.CLICK_EVENTS).alias("lead_click_count"),
            _count(codes.LEAD_EVENTS).alias("lead_submission_count"),
        )
        .withColumn(
            "popularity_score",
            scoring.popularity(F.col("view_count"), F.col("lead_click_count"), F.col("lead_submission_count")),
        )
    )


def signals(event: DataFrame, as_of, days: int = 90) -> DataFrame:
    """The five counts that the model's popularity score weighs."""
    return (
        _recent(event, as_of, days)
        .groupBy(F.col("listing_web_id").alias("property_listing_id"))
        .agg(
            _count(["impression"]).alias("impression_count"),
            _count(codes.VIEW_EVENTS).alias("view_count"),
            _count(["favorite"]).alias("favorite_count"),
            _count(codes.CLICK_EVENTS).alias("lead_click_count"),
            _count(codes.LEAD_EVENTS).alias("lead_submission_count"),
        )
    )


def build_inventory(
    listing: DataFrame,
    price: DataFrame,
    location: DataFrame,
    agent_score: DataFrame,
    event: DataFrame,
    as_of,
    image_url: str = codes.DEFAULT_IMAGE,
) -> DataFrame:
    """One row per active listing and valid price, with 90-day engagement.

    No join is hinted.  Spark broadcasts a side only after it has seen that
    side's size; above the threshold it sorts and merges, and adaptive
    execution splits the partitions of hot locations, agents or ids.
    """
    counts = signals(event, as_of).withColumn(
        "popularity_score",
        scoring.popularity(F.col("view_count"), F.col("lead_click_count"), F.col("lead_submission_count")),
    )
    joined = (
        active_listings(listing, as_of)
        .join(valid_prices(price), F.col("property_listing_id") == F.col("web_id"))
        .join(places(location), "key_location")
        .join(agent_score, "agent_id", "left")
    )
    inventory = joined.select(
        F.col("property_listing_id").cast("string").alias("property_listing_id"),
        "latitude",
        "longitude",
        "location_name",
        "property_title",
        "property_type",
        F.col("bedrooms").alias("beds_int"),
        F.col("bathrooms").alias("bath_int"),
        F.col("property_sqft").alias("size_sqft"),
        F.col("pp_price").alias("price"),
        F.col("start_time").alias("listing_date"),
        F.col("property_serp_score").alias("quality_score"),
        F.coalesce("super_agent_score", F.lit(0.0)).alias("trust_score"),
        F.lit(image_url).alias("image_url"),
        F.lit(codes.DEFAULT_AGENT).alias("agent_name"),
        "offering_type",
        "furnished_flag",
        "completion_status",
        "is_verified",
        "location_id",
        "full_location_path",
    )
    counted = ["view_count", "lead_click_count", "lead_submission_count", "impression_count", "favorite_count"]
    return (
        inventory.join(counts, "property_listing_id", "left")
        .fillna(0, subset=counted + ["popularity_score"])
        .withColumn(
            "smart_popularity_score",
            scoring.smart_popularity(
                F.col("impression_count"), F.col("view_count"), F.col("favorite_count"),
                F.col("lead_click_count"), F.col("lead_submission_count"),
            ),
        )
    )
