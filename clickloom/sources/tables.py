"""Typed table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickloom.plans.swap import TableFiles
from clickloom.schemas import SCHEMAS, TRAFFIC_LOG_NAMES


# Partition columns of stored tables, in the order of their folders.
_PARTITIONS = {"batch_id": "string", "dt": "date"}


def partition_schema(spark: SparkSession, path: str) -> str:
    """Declaration of the partition columns that a stored table has, by the names of its folders; each starts with a comma."""
    files, found, level = TableFiles(spark, path), "", [""]
    while level:
        inside = [f"{at}/{name}".lstrip("/") for at in level for name in files.names(at) if not name.startswith(("_", "."))]
        column = inside[0].rpartition("/")[2].partition("=")[0] if inside else ""
        if column not in _PARTITIONS:
            break
        found += f", {column} {_PARTITIONS[column]}"
        # One folder shows the next level; others are asked only while it is empty.
        level = next(([folder] for folder in inside if files.names(folder)), [])
    return found


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Parquet table with its declared schema, so no footer is read to infer one.

    A table written by this package also carries its ``dt`` and ``batch_id`` partition columns, as far as it has them.
    A column that the files lack is null; one that they hold beside the schema is not read.
    """
    table = f"{path.rstrip('/')}/{name}"
    return spark.read.schema(SCHEMAS[name] + partition_schema(spark, table)).parquet(table)


def load_jdbc(
    spark: SparkSession, url: str, name: str, low: int, high: int, parts: int, options: dict[str, str] | None = None
) -> DataFrame:
    """Live table through JDBC, read in parallel by ranges of its numeric id."""
    reader = spark.read.format("jdbc").options(**(options or {})).option("url", url).option("dbtable", name)
    reader = reader.option("partitionColumn", "id").option("lowerBound", low).option("upperBound", high)
    return reader.option("numPartitions", parts).option("customSchema", _jdbc_schema(name)).load()


def _jdbc_schema(name: str) -> str:
    return SCHEMAS[name]


def from_traffic_logs(df: DataFrame) -> DataFrame:
    """Older decision log under the current column names."""
    return df.withColumnsRenamed(TRAFFIC_LOG_NAMES)
