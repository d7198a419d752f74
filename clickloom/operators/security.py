"""Security summary, rate limits and outage detection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from clickloom.plans.lookup import fits_broadcast, lookup_join
from clickloom.plans.pruning import DAY, since
from clickloom.plans.workspace import staged

RATE_LIMIT_MAX = 120
RATE_LIMIT_WINDOW = 60
STREAK_THRESHOLD = 5
STREAK_GAP = 60
_RUNS_PER_GROUP = 10000


def security_summary(attempts: DataFrame, logins: DataFrame, limits: DataFrame, as_of: int) -> DataFrame:
    """Three rows: postback attempts and failed logins of 24 hours, rate limits that ended within one hour.

    Sums over no rows are null, counts are 0.
    """
    def line(df: DataFrame, name: str, good: Column, bad: Column, last: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("total_count"), good.alias("success_count"), bad.alias("failure_count"),
            F.countDistinct("ip").alias("unique_ips"), F.max(last).alias("last_activity"),
        ).select(F.lit(name).alias("metric_type"), "*")

    def ones(test: Column) -> Column:
        return F.sum(F.when(test, F.lit(1).cast("bigint")).otherwise(0))

    failed, blocked = ~F.col("success"), F.col("blocked_until").isNotNull()
    tried = since(attempts, as_of - DAY, strict=True)
    missed = since(logins, as_of - DAY, "attempted_at", strict=True)
    limited = since(limits, as_of - 3600, "window_end", strict=True)
    return (
        line(tried, "postback_attempts", ones(F.col("success")), ones(failed), "ts")
        .unionByName(line(missed, "failed_logins", F.lit(0).cast("bigint"), F.count(F.lit(1)), "attempted_at"))
        .unionByName(line(limited, "rate_limits", ones(~blocked), ones(blocked), "window_start"))
    )


def rate_windows(
    df: DataFrame, max_requests: int = RATE_LIMIT_MAX, window: int = RATE_LIMIT_WINDOW
) -> DataFrame:
    """Attempts per address, endpoint and clock-aligned window; over the limit, blocked until the window ends."""
    start = (F.col("ts") - F.pmod(F.col("ts"), F.lit(window))).alias("window_start")
    counts = df.groupBy("ip", "endpoint", start).agg(F.count(F.lit(1)).alias("attempts"))
    return _with_block(counts.withColumn("window_end", F.col("window_start") + window), max_requests)


def _with_block(counts: DataFrame, max_requests: int) -> DataFrame:
    over = F.when(F.col("attempts") > max_requests, F.col("window_end"))
    return counts.withColumn("blocked_until", over)


# --- request windows anchored at the first request -----------------------------------------------------------------
#
# A window opens with an address's first request and covers ``window`` more seconds; the next request after it opens
# the next window. Where a window starts depends on the one before, so an address must be followed through time. To
# keep any address out of a single task, rows are first counted per second; each (address, day) then holds at most
# 86,400 rows. A day can only be entered with the previous window reaching 0 to ``window`` - 1 seconds into it, or not
# at all, so every day is mapped from each possible entry to its exit in parallel, the short lists of days are chained
# per address, and every day is replayed from its true entry.


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    """Text columns as plain objects: chunked string columns do not go back through Arrow."""
    texts = [c for c in df.columns if pd.api.types.is_string_dtype(df[c])]
    return df.astype({c: object for c in texts})


def _follow(seconds: np.ndarray, window: int, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the next window start for every second, and the first start for every entry state."""
    after = np.searchsorted(seconds, seconds + window, side="right")
    return after, np.searchsorted(seconds, covered, side="right")


def _day_exits(window: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seconds = np.sort(rows["ts"].to_numpy(dtype=np.int64) - key[1] * DAY)
        entries = np.arange(-1, window)
        after, at = _follow(seconds, window, entries)
        reach = entries.copy()
        while True:
            live = at < len(seconds)
            if not live.any():
                break
            reach[live] = seconds[at[live]] + window
            at[live] = after[at[live]]
        exits = np.maximum(reach - DAY, -1)
        return pd.DataFrame({"ip": [key[0]], "day": [key[1]], "exits": [exits.tolist()]})

    return run


def _chain_days(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("day")
    entries, covered, last = [], -1, None
    for day, exits in zip(rows["day"], rows["exits"], strict=True):
        if last is None or day != last + 1:
            covered = -1
        entries.append(covered)
        covered, last = int(exits[covered + 1]), day
    return _plain(pd.DataFrame({"ip": rows["ip"], "day": rows["day"], "entry": entries}))


def _replay_day(window: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        seconds = rows["ts"].to_numpy(dtype=np.int64) - key[1] * DAY
        entry = int(rows["entry"].iloc[0])
        after, first = _follow(seconds, window, np.array([entry]))
        starts, at = [], int(first[0])
        while at < len(seconds):
            starts.append(at)
            at = int(after[at])
        # Seconds before the first start belong to the window that reached into this day.
        group = np.searchsorted(np.array(starts, dtype=np.int64), np.arange(len(seconds)), side="right")
        opened = np.concatenate([[entry - window], seconds[starts]]) if starts else np.array([entry - window])
        return _plain(pd.DataFrame({
            "ip": rows["ip"], "ts": rows["ts"], "n": rows["n"], "window_start": opened[group] + key[1] * DAY}))

    return run


def request_windows(
    df: DataFrame, window: int = RATE_LIMIT_WINDOW, at_least: int = 0, carried: DataFrame | None = None
) -> DataFrame:
    """Requests per address and second with the start of their window: ip, ts, n, window_start.

    ``carried`` (ip, ts, n) holds requests that were counted before, from the start of a window on, and are no rows of
    ``df``; their seconds are part of the result.

    ``at_least`` drops addresses that never have more than that many requests within a window length; it is tested on
    pairs of neighbouring clock slots, which cover any window.
    """
    if not 0 < window <= DAY:
        raise ValueError("window must be between one second and one day")
    seconds = df.where("ip is not null").groupBy("ip", "ts").agg(F.count(F.lit(1)).alias("n"))
    if carried is not None:
        seconds = seconds.unionByName(carried)
    if at_least:
        slots = seconds.groupBy("ip", F.floor(F.col("ts") / (window + 1)).alias("slot")).agg(F.sum("n").alias("n"))
        # Each slot counts for itself and for the one after it.
        pairs = slots.select("ip", F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"), "n")
        busy = pairs.groupBy("ip", "slot").agg(F.sum("n").alias("n")).where(F.col("n") > at_least)
        seconds = seconds.join(busy.select("ip").distinct(), "ip", "left_semi")
    seconds = seconds.withColumn("day", F.floor(F.col("ts") / DAY))
    exits = seconds.select("ip", "day", "ts").groupBy("ip", "day").applyInPandas(
        _day_exits(window), "ip string, day bigint, exits array<bigint>")
    entries = exits.groupBy("ip").applyInPandas(_chain_days, "ip string, day bigint, entry bigint")
    return seconds.join(entries, ["ip", "day"]).groupBy("ip", "day").applyInPandas(
        _replay_day(window), "ip string, ts bigint, n bigint, window_start bigint")


def _denied_seconds(df: DataFrame, max_requests: int, window: int, carried: DataFrame | None) -> DataFrame:
    """Seconds with denied requests: ip, ts, window_start, room (requests of that second that still pass)."""
    counted = request_windows(df, window, max_requests, carried)
    # At most window + 1 rows per window.
    earlier = Window.partitionBy("ip", "window_start").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    room = F.greatest(F.lit(max_requests) - before, F.lit(0))
    return counted.withColumn("room", room).where("n > room").select("ip", "ts", "window_start", "room")


def rate_limit(
    df: DataFrame, max_requests: int = RATE_LIMIT_MAX, window: int = RATE_LIMIT_WINDOW, order: str = "id",
    carried: DataFrame | None = None,
) -> DataFrame:
    """Adds ``allowed`` and, for denied requests, ``window_start``. Requests of one second go by ``order`` (unique).

    ``carried``: requests counted before, see ``request_windows``; no second of theirs is met in ``df``.

    Only the second in which a window fills up needs an order among its requests; there the first ``max_requests``
    per task are kept before the shuffle, so a second with very many requests is not gathered. The seconds with
    denied requests are found once and written, so that their number is known: where they are few, the requests
    themselves are not shuffled.
    """
    full = staged(_denied_seconds(df, max_requests, window, carried).withColumn("_slot", _slot()), "denied")
    spread = ["ip", "ts", order]
    slotted = df.withColumn("_slot", _slot())
    split = full.where("room > 0").select("_slot", "room")
    ranked = lookup_join(slotted.select("_slot", *spread), split, "_slot", spread)
    place = F.row_number().over(Window.partitionBy("_slot").orderBy(order))
    ranked = ranked.where("room is not null").withColumn("_place", place).where(F.col("_place") <= max_requests)
    edge = ranked.where("_place = room").select("_slot", F.col(order).alias("_last"))
    # One row per row of ``full`` at most in both, so its size bounds theirs, which Catalyst cannot know.
    small = fits_broadcast(full)
    limits = full.join(F.broadcast(edge) if small else edge, "_slot", "left").select(
        "_slot", "_last", "window_start", F.lit(True).alias("_full"))
    joined = slotted.join(F.broadcast(limits), "_slot", "left") if small else lookup_join(slotted, limits, "_slot", spread)
    denied = F.col("_full").isNotNull() & (F.col("_last").isNull() | (F.col(order) > F.col("_last")))
    out = joined.withColumn("allowed", ~denied)
    return out.select(*df.columns, "allowed", F.when(~F.col("allowed"), F.col("window_start")).alias("window_start"))


def _slot() -> Column:
    """One text key for address and second; null without an address."""
    return F.concat(F.col("ip"), F.lit("|"), F.col("ts").cast("string"))


def rate_limit_violations(
    df: DataFrame, max_requests: int = RATE_LIMIT_MAX, window: int = RATE_LIMIT_WINDOW, order: str = "id"
) -> DataFrame:
    """The denied requests."""
    return rate_limit(df, max_requests, window, order).where("not allowed").drop("allowed")


def rate_limit_usage(
    df: DataFrame, max_requests: int = RATE_LIMIT_MAX, window: int = RATE_LIMIT_WINDOW
) -> DataFrame:
    """Requests, passed and denied ones per address and window."""
    per_window = request_windows(df, window).groupBy("ip", "window_start").agg(F.sum("n").alias("requests"))
    passed = F.least(F.col("requests"), F.lit(max_requests).cast("bigint"))
    return per_window.withColumn("passed", passed).withColumn("denied", F.col("requests") - F.col("passed"))


# --- failure streaks -----------------------------------------------------------------------------------------------
#
# Attempts are sorted over the whole cluster by host and time with a range partitioning, which cuts a busy host into
# as many partitions as its size asks for. Each partition streams over its rows and settles every host that lies fully
# inside it. Only its first and last host can go on in a neighbour; those leave one short edge record each.

_PIECES = (
    "edge boolean, route string, host string, part int, whole boolean, "
    "head_n bigint, head_first bigint, head_last bigint, tail_n bigint, tail_first bigint, tail_last bigint"
)
_STREAKS = "host string, started bigint, ended bigint, failures bigint"


def _segments(batch: pd.DataFrame, carry: tuple | None, gap: int) -> pd.DataFrame:
    """Runs of equal outcome: host, fail, first, last, n. A failure more than ``gap`` after the last one starts anew."""
    host = batch["host"].to_numpy(dtype=object)
    ts = batch["ts"].to_numpy(dtype=np.int64)
    fail = batch["fail"].to_numpy(dtype=bool)
    cut = np.ones(len(ts), dtype=bool)
    cut[1:] = (host[1:] != host[:-1]) | (fail[1:] != fail[:-1]) | (fail[1:] & (ts[1:] - ts[:-1] > gap))
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(ts)) - 1
    parts = pd.DataFrame({"host": host[at], "fail": fail[at], "first": ts[at], "last": ts[ends], "n": ends - at + 1})
    if carry is not None:
        c_host, c_fail, c_first, c_last, c_n = carry
        same = parts.at[0, "host"] == c_host and parts.at[0, "fail"] == c_fail
        if same and not (c_fail and parts.at[0, "first"] - c_last > gap):
            parts.loc[0, ["first", "n"]] = [c_first, c_n + parts.at[0, "n"]]
        else:
            head = pd.DataFrame([carry], columns=parts.columns)
            parts = pd.concat([head, parts], ignore_index=True)
    return parts


class _PartitionStreaks:
    """Streak bookkeeping of one sorted partition."""

    def __init__(self, threshold: int, part: int):
        self.threshold, self.part = threshold, part
        self.sections = 0
        self.open: dict | None = None
        self.rows: list[tuple] = []
        self.settled = 0

    def _run(self, host: str, run: tuple) -> None:
        if run is not None and run[0] >= self.threshold:
            route = f"{self.part}:{self.settled // _RUNS_PER_GROUP}"
            self.settled += 1
            self.rows.append((False, route, host, self.part, False, *run, 0, 0, 0))

    def _edge(self, s: dict) -> None:
        blank = (0, 0, 0)
        self.rows.append((True, s["host"], s["host"], self.part, s["whole"], *(s["head"] or blank), *(s["tail"] or blank)))

    def close(self, last: bool) -> None:
        s = self.open
        if s is None:
            return
        if s["index"] == 0 or last:
            self._edge(s)
        else:
            self._run(s["host"], s["head"])
            self._run(s["host"], s["tail"])
        self.open = None

    def add(self, host: str, fail: bool, run: tuple, opens: bool, closes: bool) -> None:
        if opens:
            self.close(last=False)
            self.open = {"host": host, "index": self.sections, "head": None, "tail": None, "whole": False}
            self.sections += 1
        if not fail:
            return
        if opens:
            self.open["head"], self.open["whole"] = run, closes
        elif closes:
            self.open["tail"] = run
        else:
            self._run(host, run)

    def take(self) -> pd.DataFrame:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        rows, self.rows = self.rows, []
        return _plain(pd.DataFrame(rows, columns=names))


def _partition_streaks(threshold: int, gap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = _PartitionStreaks(threshold, TaskContext.get().partitionId())
        carry, before = None, None

        def feed(parts: pd.DataFrame, following: str | None) -> None:
            """Enter finished segments; ``following`` is the host of the segment after them."""
            nonlocal before
            host = parts["host"].to_numpy(dtype=object)
            opens = np.array([before is None or host[0] != before, *(host[1:] != host[:-1])], dtype=bool)
            closes = np.array([*(host[1:] != host[:-1]), following is None or host[-1] != following], dtype=bool)
            before = host[-1]
            fail, n = parts["fail"].to_numpy(dtype=bool), parts["n"].to_numpy()
            for i in np.flatnonzero(opens | closes | (fail & (n >= threshold))):
                piece = (int(n[i]), int(parts["first"].iat[i]), int(parts["last"].iat[i]))
                book.add(host[i], bool(fail[i]), piece, bool(opens[i]), bool(closes[i]))

        for batch in batches:
            if batch.empty:
                continue
            parts = _segments(batch, carry, gap)
            carry = tuple(parts.iloc[-1])
            if len(parts) > 1:
                feed(parts.iloc[:-1], carry[0])
            yield book.take()
        if carry is not None:
            feed(pd.DataFrame([carry], columns=["host", "fail", "first", "last", "n"]), None)
            book.close(last=True)
            yield book.take()

    return run


def _join_edges(threshold: int, gap: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if not key[0]:
            return _plain(pd.DataFrame({
                "host": rows["host"], "started": rows["head_first"], "ended": rows["head_last"],
                "failures": rows["head_n"]}))
        found, current = [], None

        def extend(n: int, first: int, last: int) -> None:
            nonlocal current
            if current is not None and first - current[2] <= gap:
                current = (current[0] + n, current[1], last)
            else:
                end()
                current = (n, first, last)

        def end() -> None:
            nonlocal current
            if current is not None and current[0] >= threshold:
                found.append(current)
            current = None

        for r in rows.sort_values("part").itertuples():
            if r.head_n:
                extend(r.head_n, r.head_first, r.head_last)
            if not r.whole:
                end()
            if r.tail_n:
                extend(r.tail_n, r.tail_first, r.tail_last)
        end()
        runs = np.array(found, dtype=np.int64).reshape(-1, 3)
        return pd.DataFrame({"host": np.full(len(runs), key[1], dtype=object), "started": runs[:, 1],
                             "ended": runs[:, 2], "failures": runs[:, 0]})

    return run


def failure_streaks(
    attempts: DataFrame, threshold: int = STREAK_THRESHOLD, gap: int = STREAK_GAP, order: tuple[str, ...] = ("id",)
) -> DataFrame:
    """Runs of at least ``threshold`` failures of a host, no success between and neighbours at most ``gap`` s apart.

    Columns read: host, ts, success and the ``order`` columns that settle attempts of the same second.
    """
    rows = attempts.where("host is not null").select(
        "host", "ts", (~F.coalesce("success", F.lit(False))).alias("fail"), *order)
    line = ["host", "ts", *order]
    pieces = rows.repartitionByRange(*line).sortWithinPartitions(*line).select("host", "ts", "fail").mapInPandas(
        _partition_streaks(threshold, gap), _PIECES)
    # Edge records are at most two per partition; settled runs go through in groups of fixed size.
    return pieces.groupBy("edge", "route").applyInPandas(_join_edges(threshold, gap), _STREAKS)
