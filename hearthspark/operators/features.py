"""Scores and features on top of clean listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthspark.functions import cleaning, scoring

ENGAGEMENT = ["impression_count", "view_count", "favorite_count", "lead_click_count", "lead_submission_count"]
NUMERIC = ["price", "size_sqft", "beds_int", "bath_int"]
CATEGORIES = ["property_type", "offering_type", "location_id", "furnished_flag", "completion_status"]
SERVING_COLUMNS = [
    "property_listing_id", "property_title", "location_name", "price", "beds_int", "bath_int", "size_sqft",
    "latitude", "longitude", "listing_date", "trust_score", "smart_popularity_score", "quality_score",
    "property_type", "offering_type", "video_url", "image_url", "agent_name", "is_verified",
    "furnished_flag", "completion_status", "location_id", "view_count",
]
QUALITY_SCALE = 250.0


def add_freshness(df: DataFrame, as_of) -> DataFrame:
    """The training formula: four steps by age."""
    if "listing_date" not in df.columns:
        return df.withColumn("freshness_score", F.lit(0.0))
    return df.withColumn("days_old", scoring.age_days(F.col("listing_date"), as_of)).withColumn(
        "freshness_score", scoring.freshness_bucket(F.col("days_old"))
    )


def search_freshness(df: DataFrame, as_of) -> Column:
    """The search formula: decay by age."""
    if "listing_date" not in df.columns:
        return F.lit(0.5)
    return scoring.freshness_decay(scoring.age_days(F.col("listing_date"), as_of))


def add_popularity(df: DataFrame) -> DataFrame:
    counts = {
        c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
        for c in ENGAGEMENT
    }
    return df.withColumns(counts).withColumn(
        "smart_popularity_score", scoring.smart_popularity(*[F.col(c) for c in ENGAGEMENT])
    )


def add_trust(df: DataFrame) -> DataFrame:
    """Agent score relative to the best one; 0.5 when there are no agent scores."""
    if "super_agent_score" not in df.columns:
        return df.withColumn("trust_score", F.lit(0.5))
    largest = df.agg(F.max("super_agent_score")).scalar()
    return df.withColumn("trust_score", scoring.relative(F.col("super_agent_score"), largest))


def add_label(df: DataFrame) -> DataFrame:
    return df.withColumn("target_is_lead", (F.col("lead_submission_count") > 0).cast("int"))


def build(df: DataFrame, as_of) -> DataFrame:
    df = add_label(add_trust(add_popularity(add_freshness(df, as_of))))
    quality = (
        F.coalesce(F.col("quality_score").try_cast("double"), F.lit(0.0))
        if "quality_score" in df.columns
        else F.lit(0.0)
    )
    return df.withColumn("quality_score", quality)


def serving_columns(df: DataFrame) -> DataFrame:
    return df.select([c for c in SERVING_COLUMNS if c in df.columns])


def fit_scaling(df: DataFrame) -> DataFrame:
    """One row with the smallest and largest value of each numeric feature."""
    return df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"min_{c}") for c in NUMERIC],
        *[F.max(F.col(c).cast("double")).alias(f"max_{c}") for c in NUMERIC],
    )


def scale(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; a constant column scales to ``value - low``, as it does
    when the fitted range is taken as 1."""
    width = F.when(high == low, 1.0).otherwise(high - low)
    return (value.cast("double") - low) / width


def with_scaling(df: DataFrame, scaling: DataFrame) -> DataFrame:
    """Adds x_<feature> columns; the fitted row arrives as a scalar subquery."""
    fitted = scaling.select(F.struct("*")).scalar()
    df = df.withColumn("_fit", fitted)
    return df.withColumns(
        {f"x_{c}": scale(F.col(c), F.col(f"_fit.min_{c}"), F.col(f"_fit.max_{c}")) for c in NUMERIC}
    ).drop("_fit")


def category_vocabulary(df: DataFrame) -> DataFrame:
    """The distinct values of each category column, as (feature, value) rows."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in CATEGORIES])
    ).alias("pair")
    return df.select(pairs).select("pair.*").filter(F.col("value").isNotNull()).distinct()


def model_input(df: DataFrame, features: list[str]) -> DataFrame:
    """The columns the model reads: scaled quality, mapped flags, no nulls."""
    columns = []
    for name in features:
        if name not in df.columns:
            columns.append(F.lit(0.0).alias(name))
            continue
        value = F.col(name)
        if name == "quality_score":
            value = F.coalesce(value.try_cast("double"), F.lit(0.0)) / QUALITY_SCALE
        elif name == "furnished_flag":
            value = cleaning.furnished_model_input(value)
        elif name == "completion_status":
            value = F.coalesce(cleaning.completion_model_input(value), F.lit("unknown"))
        elif name in CATEGORIES:
            value = F.coalesce(value.cast("string"), F.lit("unknown"))
        else:
            value = F.coalesce(value.cast("double"), F.lit(0.0))
        columns.append(value.alias(name))
    rest = [c for c in df.columns if c not in features]
    return df.select(*rest, *columns)


def history_seeds(df: DataFrame) -> DataFrame:
    """Ids to start a history from: dear villas, cheap apartments, first ids."""
    ident = F.col("property_listing_id")

    def pick(rows: DataFrame, seed: str, *order) -> DataFrame:
        return rows.orderBy(*order, ident).limit(2).select(F.lit(seed).alias("seed"), ident)

    return (
        pick(df.filter("property_type = 'villa'"), "luxury", F.desc("price"))
        .unionByName(pick(df.filter("property_type = 'apartment'"), "budget", F.asc("price")))
        .unionByName(pick(df, "first"))
    )
