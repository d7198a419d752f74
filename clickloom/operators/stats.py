"""Payout, delivery, traffic and country statistics. ``as_of`` is the Unix second that counts as now."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.geo import UNKNOWN_COUNTRY
from clickloom.plans.pruning import DAY, midnight, since, utc_date

WEEK_SHIFT = 25200
BYTES_PER_LOG = 500


def stats_cutoff(days: int, as_of: int) -> int:
    """Any positive number of days is taken as it is."""
    if days < 1:
        raise ValueError(f"days must be positive: {days}")
    return as_of - days * DAY


def period_start(ts: Column, view: str) -> Column:
    """UTC date of a second, or the Monday of the week that starts Monday 07:00 UTC."""
    if view != "weekly":
        return utc_date(ts)
    day = utc_date(ts - WEEK_SHIFT)
    return F.date_sub(day, F.weekday(day))


def payout_stats(
    df: DataFrame, days: int, as_of: int, view: str = "daily", max_periods: int | None = None
) -> DataFrame:
    """Count, payout sum, mean, minimum, maximum and distinct types, countries and networks per period.

    Rows are first folded to one per period and combination, so that the three exact distinct counts expand those
    few rows and not the table. All periods in range are returned, newest first; ``max_periods`` keeps the newest ones.
    """
    recent = since(df, stats_cutoff(days, as_of)).withColumn("date", period_start(F.col("ts"), view))
    folded = recent.groupBy("date", "traffic_type", "country_code", "network").agg(
        F.count(F.lit(1)).alias("n"), F.sum("payout").alias("total"), F.count("payout").alias("paid"),
        F.min("payout").alias("low"), F.max("payout").alias("high"))
    total = F.sum("total").cast("double")
    stats = folded.groupBy("date").agg(
        F.sum("n").alias("total_postbacks"),
        total.alias("total_payout"),
        (total / F.nullif(F.sum("paid"), F.lit(0))).alias("avg_payout"),
        F.min("low").cast("double").alias("min_payout"),
        F.max("high").cast("double").alias("max_payout"),
        F.countDistinct("traffic_type").alias("unique_traffic_types"),
        F.countDistinct("country_code").alias("unique_countries"),
        F.countDistinct("network").alias("unique_networks"),
    )
    if view == "weekly":
        stats = stats.withColumn("week_end", F.date_add("date", 6))
    ordered = stats.orderBy(F.desc("date"))
    return ordered if max_periods is None else ordered.limit(max_periods)


def payout_summary(stats: DataFrame) -> DataFrame:
    """Totals over the returned periods, and the mean per period that has rows."""
    total = F.coalesce(F.sum("total_payout"), F.lit(0.0))
    return stats.agg(
        F.coalesce(F.sum("total_postbacks"), F.lit(0)).alias("total_postbacks"),
        F.round(total, 2).alias("total_payout"),
        F.coalesce(F.round(total / F.nullif(F.count(F.lit(1)), F.lit(0)), 2), F.lit(0.0)).alias("avg_daily_payout"),
        F.count(F.lit(1)).alias("days_count"),
    )


def _percent(part: Column, whole: Column) -> Column:
    """Share in percent, 0.0 when there is nothing to share."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)) * 100, F.lit(0.0))


def postback_delivery_stats(df: DataFrame) -> DataFrame:
    total, good = F.count(F.lit(1)), F.count_if("success")
    return df.agg(
        total.alias("total"),
        good.alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.round(_percent(good, total), 2).alias("success_rate"),
        F.coalesce(F.sum("payout").cast("double"), F.lit(0.0)).alias("total_payout"),
    )


def _traffic_stats(as_of: int, ts: str) -> list[Column]:
    total = F.count(F.lit(1))

    def age(edge: Column) -> Column:
        # Whole days toward zero; a missing or zero time counts as no age.
        days = (F.lit(as_of) - edge) / DAY
        return F.coalesce(F.when(edge != 0, days.cast("bigint")), F.lit(0).cast("bigint"))

    return [total.alias("total"), age(F.min(ts)).alias("oldest_days"), age(F.max(ts)).alias("newest_days"),
            (total * BYTES_PER_LOG).alias("size_estimate")]


def traffic_stats(df: DataFrame, as_of: int, ts: str = "ts") -> DataFrame:
    """Row count, whole days since the oldest and the newest row, estimated bytes."""
    return df.agg(*_traffic_stats(as_of, ts))


def today(df: DataFrame, as_of: int) -> DataFrame:
    return since(df, midnight(as_of))


def count_by_decision(df: DataFrame, as_of: int) -> DataFrame:
    """Today's rows per decision; both decisions are always listed."""
    counts = today(df, as_of).agg(
        F.count_if(F.col("decision") == "A").alias("a"), F.count_if(F.col("decision") == "B").alias("b"))
    return counts.select(F.expr("stack(2, 'A', a, 'B', b) AS (decision, n)"))


def count_today(df: DataFrame, as_of: int) -> DataFrame:
    return today(df, as_of).agg(F.count(F.lit(1)).alias("n"))


def country_stats(df: DataFrame) -> DataFrame:
    """Rows, A rows and other rows per country."""
    country = F.coalesce(F.nullif("country_code", F.lit("")), F.lit(UNKNOWN_COUNTRY))
    good = F.col("decision").eqNullSafe("A")
    return df.groupBy(country.alias("country")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("decision_a"), F.count_if(~good).alias("decision_b"))


def top_countries(df: DataFrame, n: int = 10) -> DataFrame:
    """The busiest countries with the shares of both decisions in percent; ties go by country."""
    top = country_stats(df).orderBy(F.desc("total"), "country").limit(n)
    return top.withColumns({
        "share_a": F.col("decision_a") / F.col("total") * 100,
        "share_b": F.col("decision_b") / F.col("total") * 100,
    })


def decision_totals(df: DataFrame) -> DataFrame:
    """A and B rows (others ignored), their sum, and shares rounded half up to whole percents."""
    counts = df.agg(
        F.count_if(F.col("decision") == "A").alias("total_a"), F.count_if(F.col("decision") == "B").alias("total_b"))
    total = F.col("total_a") + F.col("total_b")
    return counts.withColumns({
        "total": total,
        "percent_a": F.floor(_percent(F.col("total_a"), total) + 0.5),
        "percent_b": F.floor(_percent(F.col("total_b"), total) + 0.5),
    })


def decision_rates(df: DataFrame) -> DataFrame:
    """A and B rates over all rows with two decimals, and the number of countries seen."""
    total = F.count(F.lit(1))
    return df.agg(
        F.round(_percent(F.count_if(F.col("decision") == "A"), total), 2).alias("rate_a"),
        F.round(_percent(F.count_if(F.col("decision") == "B"), total), 2).alias("rate_b"),
        F.countDistinct(F.nullif("country_code", F.lit(""))).alias("active_countries"),
    )


def unique_countries(df: DataFrame) -> DataFrame:
    named = df.where("country_code is not null and country_code <> ''")
    return named.select("country_code").distinct().orderBy("country_code")


# Sketches have 2^12 registers; their relative standard error is about 1.04 / 64.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def daily_sketches(df: DataFrame, columns: list[str], ts: str = "ts") -> DataFrame:
    """One row per UTC day with a mergeable sketch of the distinct values of each column; null and empty values do not
    count. Stored once, it answers any range of days without reading the log again."""
    return df.groupBy(utc_date(F.col(ts)).alias("day")).agg(*[
        F.hll_sketch_agg(F.nullif(F.col(c), F.lit("")), SKETCH_BITS).alias(c) for c in columns])


def distinct_between(sketches: DataFrame, columns: list[str], first: str, last: str) -> DataFrame:
    """Estimated distinct values over a range of days, both included."""
    days = sketches.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return days.agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in columns])


def trailing_distinct(sketches: DataFrame, columns: list[str], days: int) -> DataFrame:
    """Estimated distinct values of each day together with the ``days - 1`` before it, for all days up to ``days - 1``
    after the last one."""
    ends = sketches.select("*", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("_k"))
    ends = ends.withColumn("day", F.date_add("day", F.col("_k")))
    return ends.groupBy("day").agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


def estimated_revenue(df: DataFrame, default_payout: Decimal) -> DataFrame:
    hits = F.count_if(F.col("decision") == "A").cast("decimal(18,0)")
    return df.agg((hits * F.lit(default_payout).cast("decimal(10,2)")).alias("revenue"))


def dashboard(df: DataFrame, as_of: int, limit: int = 50) -> DataFrame:
    """Newest rows of today, table statistics and today's decision counts as one tall result.

    Columns: section, name, value. Log rows carry their content as JSON. Two scans: today's rows for the newest ones,
    and one over the whole table for all numbers.
    """
    from clickloom.operators.browse import page

    rows = page(df, limit, 0, as_of)
    logs = rows.select(F.lit("log").alias("section"), F.col("id").cast("string").alias("name"),
                       F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    of_today = F.col("ts") >= midnight(as_of)
    counts = [F.count_if(of_today & (F.col("decision") == d)).alias(f"decision_{d}") for d in ("A", "B")]
    lines = [("stat", n, n) for n in ("total", "oldest_days", "newest_days", "size_estimate")]
    lines += [("decision", d, f"decision_{d}") for d in ("A", "B")]
    numbers = df.agg(*_traffic_stats(as_of, "ts"), *counts).select(F.inline(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), F.col(c).cast("string").alias("value"))
        for section, name, c in lines])))
    return logs.unionByName(numbers)
