"""Newest-first pages, searches and filters of the log tables. Every order ends in a unique column."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.stats import today
from clickloom.plans.pruning import DATE_COLUMN, DAY

RECEIVED_COLUMNS = [
    "id", "ts", "status", "country_code", "traffic_type", "payout", "click_id", "network", "ip_address",
    "query_string",
]
SENT_COLUMNS = [
    "id", "ts", "country_code", "traffic_type", "payout", "postback_url", "response_code", "response_body", "success",
]


def page_size(limit: int, most: int | None = None) -> int:
    """The limit itself. A ceiling exists only where the caller sets one; a limit outside is an error, never changed."""
    if limit < 1 or most is not None and limit > most:
        raise ValueError(f"limit must be from 1 to {most or 'any number'}: {limit}")
    return limit


def page(df: DataFrame, limit: int, offset: int, as_of: int) -> DataFrame:
    """Today's rows, newest id first. Planned as a top-k of offset + limit rows per task, not a full sort."""
    return today(df, as_of).orderBy(F.desc("id")).offset(max(0, offset)).limit(page_size(limit))


def page_info(df: DataFrame, limit: int, offset: int, as_of: int) -> DataFrame:
    size, start = page_size(limit), max(0, offset)
    return today(df, as_of).agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(size).cast("bigint").alias("limit"), F.lit(start).cast("bigint").alias("offset"), "total",
        (F.lit(start + size) < F.col("total")).alias("has_more"))


def recent_postbacks(df: DataFrame, limit: int = 20, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    columns = [c for c in SENT_COLUMNS if c in df.columns]
    ordered = df.orderBy(F.desc("ts"), *[F.desc(c) for c in ties])
    return ordered.limit(page_size(limit)).select(*columns)


def recent_received(df: DataFrame, limit: int = 50) -> DataFrame:
    columns = [c for c in RECEIVED_COLUMNS if c in df.columns]
    return df.select(*columns).orderBy(F.desc("ts"), F.desc("id")).limit(page_size(limit))


def postbacks_by_status(df: DataFrame, success: bool, limit: int = 20, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    kept = df.where(F.col("success") == success)
    return kept.orderBy(F.desc("ts"), *[F.desc(c) for c in ties]).limit(page_size(limit))


def traffic_by_country(df: DataFrame, country: str, limit: int = 50) -> DataFrame:
    return df.where(F.col("country_code") == country.upper()).orderBy(F.desc("id")).limit(page_size(limit))


def traffic_by_decision(df: DataFrame, decision: str, limit: int = 50) -> DataFrame:
    kept = df.where(F.col("decision") == decision if decision in ("A", "B") else F.lit(False))
    return kept.orderBy(F.desc("id")).limit(page_size(limit))


def search(df: DataFrame, term: str) -> DataFrame:
    """Rows with the term, in any case, inside click id, country, address or landing page."""
    if len(term) < 2:
        return df.where(F.lit(False))
    hit = F.lit(False)
    for column in ("click_id", "country_code", "ip", "user_lp"):
        hit = hit | F.coalesce(F.lower(column).contains(term.lower()), F.lit(False))
    return df.where(hit)


def filter_traffic(
    df: DataFrame, country: str | None = None, date_from: str | None = None, date_to: str | None = None
) -> DataFrame:
    """Rows of a country and of UTC dates, both inclusive. A dated table is pruned to those partitions."""
    if country:
        df = df.where(F.col("country_code") == country.upper())
    for text, after in ((date_from, False), (date_to, True)):
        if text:
            # The plain bound on the second reaches the scan; the date bound prunes partitions.
            day = date.fromisoformat(text)
            second = (day - date(1970, 1, 1)).days * DAY
            df = df.where(F.col("ts") < second + DAY if after else F.col("ts") >= second)
            if DATE_COLUMN in df.columns:
                df = df.where(F.col(DATE_COLUMN) <= day if after else F.col(DATE_COLUMN) >= day)
    return df
