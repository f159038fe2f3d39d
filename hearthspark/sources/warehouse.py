"""Source tables from a warehouse over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int = 64,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """One table; with a partition column it is read by many tasks at once.

    Filters and column lists on the result are pushed into the warehouse.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for name, value in (properties or {}).items():
        reader = reader.option(name, value)
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return reader.load()
