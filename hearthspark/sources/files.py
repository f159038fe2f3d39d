"""CSV and Parquet scans and sinks, and the optional signals file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


# Null is written as a marker that begins with a control character, empty text as a quoted empty field.
_WHOLE = {
    "escape": '"', "nullValue": "\x00N", "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; the schema is given, so the file is read once."""
    return spark.read.options(**_WHOLE).csv(path, header=True, schema=schema, multiLine=True, emptyValue="")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV from which ``read_csv`` gets back every value: edge spaces, line ends, quotes, empty text and null."""
    df.write.mode("overwrite").options(**_WHOLE).csv(path, header=True, emptyValue='""')


def write_serving(df: DataFrame, path: str) -> None:
    """Partitioned by offering type: that filter then prunes whole folders."""
    df.write.mode("overwrite").partitionBy("offering_type").parquet(path)


def read_serving(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The folder name keeps ``offering_type`` a string only if the schema says so."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_optional(read) -> DataFrame | None:
    """``read()`` or None when the path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def merge_signals(listings: DataFrame, signals: DataFrame | None, key: str = "property_listing_id") -> DataFrame:
    """Left join the signals, or pass listings through when they cannot be joined."""
    if signals is None or key not in listings.columns or key not in signals.columns:
        return listings
    return listings.join(signals, key, "left")
