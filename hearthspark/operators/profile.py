"""Data profile: duplicates, nulls, types, value counts, price figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: str = "property_listing_id") -> DataFrame:
    """Rows beyond the first of their id; a null id is an id like any other."""
    per_key = df.groupBy(key).count()
    return per_key.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its number of nulls."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in columns]
    )
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def schema(df: DataFrame) -> DataFrame:
    """One row per column: its type, and the table's size."""
    size = df.agg(F.count(F.lit(1)).alias("row_count"))
    rows = F.array(
        *[
            F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"))
            for f in df.schema.fields
        ]
    )
    return size.select("row_count", F.lit(len(df.columns)).alias("column_count"), F.explode(rows).alias("r")).select(
        "r.*", "row_count", "column_count"
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return counted if top is None else counted.limit(top)


def price_summary(df: DataFrame) -> DataFrame:
    """Mean price, and the most common location (the smallest name among equals)."""
    common = value_counts(df.filter(F.col("location_name").isNotNull()), "location_name", 1)
    return df.agg(F.avg("price").alias("mean_price")).withColumn(
        "top_location", common.select("location_name").scalar()
    )


def price_histogram(df: DataFrame, bins: int = 30, column: str = "price") -> DataFrame:
    """Counts over equal ranges of log10(price); the top edge is in the last bin.

    If all prices are equal they lie in the middle of a range of their own.
    """
    logs = df.filter(F.col(column) > 0).select(F.log10(column).alias("x"))
    edges = logs.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high"))).scalar()
    spot = F.floor(F.try_divide(F.col("x") - F.col("e.low"), F.col("e.high") - F.col("e.low")) * bins)
    return (
        logs.withColumn("e", edges)
        .groupBy(F.when(spot.isNull(), bins // 2 + 1).otherwise(F.least(spot + 1, F.lit(bins))).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
