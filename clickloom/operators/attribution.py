"""Joins between traffic and conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.geo import UNKNOWN_COUNTRY
from clickloom.plans.keyed import latest_per_key
from clickloom.plans.lookup import lookup_join


def conversions(logs: DataFrame, postbacks: DataFrame) -> DataFrame:
    """Per country: distinct clicks, clicks whose latest postback is confirmed, conversion rate, confirmed payout.

    A click id counts once, under the country of its first log row (by time, then id), so its payout counts once too.
    Both sides are folded to unique click ids before they meet.
    """
    country = F.coalesce(F.nullif("country_code", F.lit("")), F.lit(UNKNOWN_COUNTRY))
    clicks = logs.where("click_id is not null").groupBy("click_id").agg(
        F.min_by(country, F.struct("ts", "id")).alias("country"))
    latest = latest_per_key(postbacks.select("click_id", "ts", "id", "status", "payout"), ["click_id"], ["ts", "id"])
    good = latest.where(F.col("status") == "confirmed").select("click_id", F.col("payout").alias("_payout"))
    per_country = clicks.join(good, "click_id", "left").groupBy("country").agg(
        F.count(F.lit(1)).alias("clicks"),
        F.count("_payout").alias("converted"),
        F.coalesce(F.sum("_payout").cast("double"), F.lit(0.0)).alias("payout"))
    return per_country.withColumn("rate", F.round(F.col("converted") / F.col("clicks") * 100, 2))


def with_user(df: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Adds the user name. An id without a user becomes null, as a deleted user's rows do."""
    side = users.select(F.col("id").alias(key), F.col("username"), F.lit(True).alias("_known"))
    joined = lookup_join(df, side, key)
    return joined.withColumn(key, F.when(F.col("_known"), F.col(key))).drop("_known").select(*df.columns, "username")
