"""Streaming transformations. Sources and sinks stay with the caller; see ``sinks`` for the ones used here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clickloom.operators.routing import Settings, decide
from clickloom.operators.security import RATE_LIMIT_MAX, RATE_LIMIT_WINDOW
from clickloom.operators.stats import WEEK_SHIFT

# Stateful jobs keep their state in RocksDB, so that it need not fit in executor memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def decide_stream(requests: DataFrame, settings: Settings, reputation: DataFrame) -> DataFrame:
    """Decisions on a stream of requests: stateless, with a static reputation table."""
    return decide(requests, settings, reputation)


def rate_windows_stream(
    requests: DataFrame, max_requests: int = RATE_LIMIT_MAX, window: int = RATE_LIMIT_WINDOW,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Clock-aligned attempts per address and endpoint, for update mode.

    Every window is reported, again whenever it grows; its last report is final once the watermark has passed it.
    """
    timed = requests.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", watermark)
    slot = F.window("at", f"{window} seconds")
    counts = timed.groupBy("ip", "endpoint", slot).agg(F.count(F.lit(1)).alias("attempts"))
    return counts.select(
        "ip", "endpoint", F.unix_timestamp("window.start").alias("window_start"), "attempts",
        F.unix_timestamp("window.end").alias("window_end"),
        F.when(F.col("attempts") > max_requests, F.unix_timestamp("window.end")).alias("blocked_until"))


def payout_stats_stream(postbacks: DataFrame, view: str = "daily", watermark: str = "2 days") -> DataFrame:
    """Payout statistics per period. Streams have no exact distinct counts, so those are approximate here."""
    weekly = view == "weekly"
    shift = WEEK_SHIFT if weekly else 0
    timed = postbacks.withColumn("at", F.timestamp_seconds(F.col("ts") - shift)).withWatermark("at", watermark)
    # The epoch was a Thursday: four days later is a Monday.
    period = F.window("at", "7 days", "7 days", "4 days") if weekly else F.window("at", "1 day")
    stats = timed.groupBy(period).agg(
        F.count(F.lit(1)).alias("total_postbacks"),
        F.sum("payout").cast("double").alias("total_payout"),
        F.count("payout").alias("_paid"),
        F.min("payout").cast("double").alias("min_payout"),
        F.max("payout").cast("double").alias("max_payout"),
        F.approx_count_distinct("traffic_type").alias("unique_traffic_types"),
        F.approx_count_distinct("country_code").alias("unique_countries"),
        F.approx_count_distinct("network").alias("unique_networks"))
    day = F.date_from_unix_date(F.floor(F.unix_timestamp("window.start") / 86400).cast("int"))
    out = stats.select(
        day.alias("date"), "total_postbacks", "total_payout",
        (F.col("total_payout") / F.nullif(F.col("_paid"), F.lit(0))).alias("avg_payout"),
        "min_payout", "max_payout", "unique_traffic_types", "unique_countries", "unique_networks")
    return out.withColumn("week_end", F.date_add("date", 6)) if weekly else out


_COMBINATION = ["traffic_type", "country_code", "network"]
COMBINATIONS = ("date date, traffic_type string, country_code string, network string, n bigint, total decimal(38,2), "
                "paid bigint, low decimal(10,2), high decimal(10,2), combination string, ts bigint")


def payout_combinations_stream(postbacks: DataFrame, view: str = "daily", watermark: str = "2 days") -> DataFrame:
    """Counts and payouts per period and combination of type, country and network, for update mode.

    Each report replaces the one before of the same ``combination`` (the key), and ``n`` says which is later. Kept in a
    ``LatestStore``, they are the deduplicated values from which ``payout_stats_of`` counts exactly.
    """
    shift = WEEK_SHIFT if view == "weekly" else 0
    timed = postbacks.withColumn("at", F.timestamp_seconds(F.col("ts") - shift)).withWatermark("at", watermark)
    # The epoch was a Thursday: four days later is a Monday.
    period = F.window("at", "7 days", "7 days", "4 days") if view == "weekly" else F.window("at", "1 day")
    sums = timed.groupBy(period, *_COMBINATION).agg(
        F.count(F.lit(1)).alias("n"), F.sum("payout").cast("decimal(38,2)").alias("total"), F.count("payout").alias("paid"),
        F.min("payout").alias("low"), F.max("payout").alias("high"))
    start = F.unix_timestamp("window.start")
    rows = sums.withColumns({"date": F.date_from_unix_date(F.floor(start / 86400).cast("int")), "ts": start}).drop("window")
    key = F.to_json(F.struct("date", *_COMBINATION), {"ignoreNullFields": "false"})
    return rows.withColumn("combination", key)


def payout_stats_of(combinations: DataFrame, view: str = "daily") -> DataFrame:
    """Payout statistics per period with exact distinct counts, from one row per period and combination."""
    total = F.sum("total").cast("double")
    out = combinations.groupBy("date").agg(
        F.sum("n").alias("total_postbacks"), total.alias("total_payout"),
        (total / F.nullif(F.sum("paid"), F.lit(0))).alias("avg_payout"),
        F.min("low").cast("double").alias("min_payout"), F.max("high").cast("double").alias("max_payout"),
        F.countDistinct("traffic_type").alias("unique_traffic_types"),
        F.countDistinct("country_code").alias("unique_countries"), F.countDistinct("network").alias("unique_networks"))
    return out.withColumn("week_end", F.date_add("date", 6)) if view == "weekly" else out


def latest_postback_stream(postbacks: DataFrame) -> DataFrame:
    """Latest postback per click, for update mode. State is one row per click id; rows fold before the shuffle."""
    best = F.max_by(F.struct("status", "payout", "ts", "id"), F.struct("ts", "id")).alias("last")
    return postbacks.where("click_id is not null").groupBy("click_id").agg(best).select("click_id", "last.*")


class RequestWindow(StatefulProcessor):
    """Start and request count of an address's current window."""

    def __init__(self, max_requests: int, window: int, idle_ms: int | None):
        self.max_requests, self.window, self.idle_ms = max_requests, window, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start bigint, requests bigint", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "id"], ignore_index=True)
        ts = batch["ts"].to_numpy(dtype=np.int64)
        start, used = self.state.get() if self.state.exists() else (None, 0)
        allowed = np.zeros(len(ts), dtype=bool)
        at = 0
        while at < len(ts):
            if start is None or ts[at] - start > self.window:
                start, used = int(ts[at]), 0
            end = int(np.searchsorted(ts, start + self.window, side="right"))
            passed = min(end - at, self.max_requests - used)
            allowed[at:at + passed] = True
            used += passed
            at = end
        self.state.update((start, used))
        yield pd.DataFrame({
            "ip": np.full(len(ts), key[0], dtype=object), "id": batch["id"], "ts": ts, "allowed": allowed,
        }).astype({"ip": object})

    def close(self) -> None:
        pass


def rate_limit_stream(
    requests: DataFrame, max_requests: int = RATE_LIMIT_MAX, window: int = RATE_LIMIT_WINDOW,
    idle_ms: int | None = None,
) -> DataFrame:
    """Requests (ip, id, ts) with ``allowed``. ``idle_ms`` lets the state of idle addresses expire.

    One address's rows of one micro-batch go to one task, in time order: size the trigger accordingly
    (``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger``). The batch job has no such limit.
    """
    processor = RequestWindow(max_requests, window, idle_ms)
    return requests.select("ip", "id", "ts").where("ip is not null").groupBy("ip").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType="ip string, id bigint, ts bigint, allowed boolean",
        outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime")
