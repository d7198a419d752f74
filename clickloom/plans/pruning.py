"""Time predicates that also prune date partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400
DATE_COLUMN = "dt"


def midnight(as_of: int) -> int:
    """Start of the UTC day of a Unix second."""
    return as_of - as_of % DAY


def utc_date(ts: Column) -> Column:
    """UTC date of a Unix second, whatever the session time zone is."""
    return F.date_from_unix_date(F.floor(ts / DAY).cast("int"))


def with_date(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(DATE_COLUMN, utc_date(F.col(ts)))


def since(df: DataFrame, cutoff: int, ts: str = "ts", strict: bool = False) -> DataFrame:
    """Rows at or after the cutoff. On a table partitioned by date, older directories are not read."""
    kept = df.where(F.col(ts) > cutoff if strict else F.col(ts) >= cutoff)
    if DATE_COLUMN in df.columns:
        kept = kept.where(F.col(DATE_COLUMN) >= F.date_from_unix_date(F.lit(cutoff // DAY)))
    return kept
