"""From raw listings to typed, de-duplicated, standardised ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthspark.functions import cleaning
from hearthspark.operators import quantiles

NUMBERS = ["price", "size_sqft", "latitude", "longitude", "view_count"]
IMPUTED = ["price", "size_sqft"]
TEXTS = ["property_type", "location_name", "full_location_path", "offering_type"]

# Source names of the columns that the jobs know by other names.
RENAMES = {
    "pp_price": "price", "property_sqft": "size_sqft", "start_time": "listing_date",
    "property_serp_score": "quality_score",
}


def rename_source(df: DataFrame) -> DataFrame:
    for source, name in RENAMES.items():
        if source in df.columns and name not in df.columns:
            df = df.withColumnRenamed(source, name)
    return df


def keep_first(df: DataFrame, key: str = "property_listing_id", order: str = "ingest_seq") -> DataFrame:
    """The earliest row of each id.

    Spark trims every partition to one row per id before the shuffle, so an id
    with very many copies does not fill one task.  Rows that share id and
    order are settled by a hash of the whole row.
    """
    first = Window.partitionBy(key).orderBy(F.col(order), F.xxhash64(*df.columns))
    return df.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def clean_numbers(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: cleaning.number(F.col(c), df.schema[c].dataType) for c in NUMBERS if c in df.columns}
    )


def impute_median(df: DataFrame, columns: list[str] = IMPUTED) -> DataFrame:
    """Zeros become the median of the positive values."""
    medians = quantiles.exact_quantiles(df, {c: quantiles.positives(c) for c in columns if c in df.columns}, 0.5)
    return df.withColumns({c: F.when(F.col(c) == 0, F.lit(median).cast("double")).otherwise(F.col(c)) for c, median in medians.items()})


def parse_rooms(df: DataFrame) -> DataFrame:
    rooms = {}
    if "bedrooms" in df.columns:
        rooms["beds_int"] = cleaning.bedrooms(F.col("bedrooms"))
    if "bathrooms" in df.columns:
        rooms["bath_int"] = cleaning.bathrooms(F.col("bathrooms"))
    return df.withColumns(rooms) if rooms else df


def clean_text(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            c: cleaning.offering(F.col(c)) if c == "offering_type" else cleaning.text(F.col(c))
            for c in TEXTS
            if c in df.columns
        }
    )


def parse_dates(df: DataFrame, column: str = "listing_date") -> DataFrame:
    return df.withColumn(column, cleaning.date(F.col(column))) if column in df.columns else df


def normalize_flags(df: DataFrame) -> DataFrame:
    rules = {
        "furnished_flag": cleaning.furnished, "completion_status": cleaning.completion, "is_verified": cleaning.flag,
    }
    df = df.withColumns({c: rule(F.col(c)) for c, rule in rules.items() if c in df.columns})
    return df if "is_verified" in df.columns else df.withColumn("is_verified", F.lit(False))


def standardise(df: DataFrame) -> DataFrame:
    """All of the cleaning but imputation, which needs the cleaned table twice."""
    df = keep_first(rename_source(df))
    return normalize_flags(clean_text(parse_rooms(clean_numbers(parse_dates(df)))))


def clean(df: DataFrame) -> DataFrame:
    return impute_median(standardise(df))
