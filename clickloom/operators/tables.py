"""Sinks, keyed changes, deletion and retention.

Parquet tables have no row updates. A change gives the rows that stay and the rows that go; ``apply_split`` then makes
the table on disk agree, touching only the partitions that lose rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.geo import is_country
from clickloom.functions.net import is_ip
from clickloom.functions.numbers import money
from clickloom.functions.text import empty_to_null, matches, sanitize
from clickloom.plans.keyed import latest_per_key
from clickloom.plans.lookup import fits_broadcast
from clickloom.plans.pruning import DATE_COLUMN, DAY, midnight, since, with_date
from clickloom.plans.swap import replace

# Table, time column, days kept.
RETENTION_DAYS = (
    ("postback_security_log", "ts", 30),
    ("failed_login_attempts", "attempted_at", 30),
    ("rate_limit_tracking", "window_end", 1),
    ("traffic_logs", "ts", 7),
    ("postback_logs", "ts", 30),
    ("postback_received", "ts", 30),
    ("audit_log", "created_at", 90),
)


BATCH_COLUMN = "batch_id"


class Split(NamedTuple):
    """Rows that stay and rows that go. Count the second lazily; nothing runs before that."""

    kept: DataFrame
    removed: DataFrame

    def removed_count(self) -> DataFrame:
        return self.removed.agg(F.count(F.lit(1)).alias("removed"))


# --- sinks ---------------------------------------------------------------------------------------------------------


def traffic_rows(df: DataFrame) -> DataFrame:
    """Rows the decision log takes: decision A or B, address empty or valid; empty optional texts become null."""
    ip = sanitize(F.coalesce("ip", F.lit("")), 45)
    rows = df.withColumns({
        "ip": ip,
        "ua": sanitize(F.coalesce("ua", F.lit("")), 500),
        "click_id": empty_to_null(sanitize(F.col("click_id"), 100)),
        "country_code": empty_to_null(sanitize(F.col("country_code"), 10)),
        "user_lp": empty_to_null(sanitize(F.col("user_lp"), 100)),
    })
    return rows.where(F.col("decision").isin("A", "B") & ((F.col("ip") == "") | is_ip(F.col("ip"))))


def postback_log_rows(df: DataFrame) -> DataFrame:
    """Rows the sent-postback log takes: four fields present, country empty or valid, texts cut to their columns."""
    present = [F.col(c).isNotNull() for c in ("country_code", "traffic_type", "payout", "postback_url")]
    rows = df.where(present[0] & present[1] & present[2] & present[3]).withColumns({
        "country_code": sanitize(F.col("country_code"), 10),
        "traffic_type": sanitize(F.col("traffic_type"), 50),
        "payout": money(F.col("payout")),
        "postback_url": sanitize(F.col("postback_url"), 2048),
        "response_body": sanitize(F.col("response_body"), 500),
        "success": F.coalesce(F.col("success"), F.lit(False)),
    })
    country = F.col("country_code")
    return rows.where((country == "") | is_country(country))


def received_rows(df: DataFrame) -> DataFrame:
    """Accepted output of the postback receivers, ready to store."""
    rows = df.where("reject_reason is null").drop("reject_reason")
    return rows.withColumn("payout", F.col("payout").cast("decimal(10,2)"))


def append_dated(
    df: DataFrame, path: str, ts: str = "ts", compression: str = "zstd", batch_id: str | None = None, dated: bool = True
) -> None:
    """Append to a table partitioned by UTC date (not so if ``dated`` is false: for few rows over very many dates).

    Rows of a date are gathered by a rebalance, which splits a date that holds most rows over several files. With a
    ``batch_id`` (letters, digits, ``_`` and ``-``) a batch has one folder, with its dates inside, and a job that runs
    again with the same id replaces all rows of its batch, also with rows of other dates or with none. Either all
    batches of a table have an id or none has.
    """
    rows = with_date(df, ts).hint("rebalance", DATE_COLUMN) if dated else df
    if batch_id is None:
        rows.write.mode("append").option("compression", compression).partitionBy(*[DATE_COLUMN] * dated).parquet(path)
        return
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
        raise ValueError(f"not a batch id: {batch_id}")
    unit = f"{BATCH_COLUMN}={batch_id}"

    def write(folder: str) -> None:
        target = rows.write.option("compression", compression)
        target.partitionBy(*[DATE_COLUMN] * dated).parquet(f"{folder}/{unit}")

    replace(df.sparkSession, path, write, [unit])


def append_traffic(df: DataFrame, path: str, batch_id: str | None = None, dated: bool = True) -> None:
    append_dated(traffic_rows(df), path, batch_id=batch_id, dated=dated)


def append_postback_log(df: DataFrame, path: str, batch_id: str | None = None, dated: bool = True) -> None:
    append_dated(postback_log_rows(df), path, batch_id=batch_id, dated=dated)


def append_postbacks(df: DataFrame, path: str, batch_id: str | None = None, dated: bool = True) -> None:
    append_dated(received_rows(df), path, batch_id=batch_id, dated=dated)


def replace_dates(df: DataFrame, path: str) -> None:
    """Overwrite only the date partitions that ``df`` holds."""
    writer = df.hint("rebalance", DATE_COLUMN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DATE_COLUMN).parquet(path)


def _unit(parts: list[str], values: tuple) -> str:
    return "/".join(f"{p}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for p, v in zip(parts, values, strict=True))


def _in_partitions(parts: list[str], values: list[tuple]) -> Column:
    """Rows of the listed partitions; the last part is a list per value of the parts before it."""
    groups: dict[tuple, list] = {}
    for v in values:
        groups.setdefault(v[:-1], []).append(v[-1])
    hit = F.lit(False)
    for head, tails in groups.items():
        known = [t for t in tails if t is not None]
        test = F.col(parts[-1]).isin(known) if known else F.lit(False)
        if len(known) < len(tails):
            test = test | F.col(parts[-1]).isNull()
        for part, value in zip(parts, head, strict=False):
            test = test & F.col(part).eqNullSafe(F.lit(value))
        hit = hit | test
    return hit


def apply_split(split: Split, path: str) -> int:
    """Make the table at ``path``, from which the split was read, hold the kept rows only.

    Partitions (by batch and date, as far as the table has them) that lose rows are written anew beside the table and
    swapped in; the others are not touched. A table without partitions is written anew as a whole, if it loses any row.
    A job that breaks off at any step leaves all old or all new rows, once ``plans.swap.recover``, or the next change of
    the table, has run. Returns the number of partitions changed.
    """
    spark = split.kept.sparkSession
    parts = [c for c in (BATCH_COLUMN, DATE_COLUMN) if c in split.kept.columns]

    def write(rows: DataFrame, folder: str) -> None:
        rows.write.option("compression", "zstd").partitionBy(*parts).parquet(folder)

    if not parts:
        if split.removed.isEmpty():
            return 0
        replace(spark, path, lambda folder: write(split.kept, folder))
        return 1
    changed = [tuple(r) for r in split.removed.select(*parts).distinct().collect()]  # one row per partition
    if not changed:
        return 0
    kept = split.kept.where(_in_partitions(parts, changed))
    if DATE_COLUMN in parts:
        kept = kept.hint("rebalance", *parts)
    replace(spark, path, lambda folder: write(kept, folder), [_unit(parts, c) for c in changed])
    return len(changed)


def to_json_rows(df: DataFrame, column: str = "json", escape_slashes: bool = True) -> DataFrame:
    """Rows as JSON objects with nulls kept and Unicode left as it is."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select((F.replace(text, F.lit("/"), F.lit("\\/")) if escape_slashes else text).alias(column))


def json_export(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.mode("overwrite").option("compression", compression).option("ignoreNullFields", "false").json(path)


# --- keyed changes -------------------------------------------------------------------------------------------------


def update_clicks(clicks: DataFrame, postbacks: DataFrame) -> DataFrame:
    """Clicks with status, payout and time of their latest postback. Postbacks without a click change nothing.

    Postbacks are folded to one row per click first, so the join has unique keys on both sides.
    """
    latest = latest_per_key(postbacks.select("click_id", "ts", "id", "status", "payout"), ["click_id"], ["ts", "id"])
    news = latest.select("click_id", F.col("status").alias("_status"), F.col("payout").alias("_payout"),
                         F.col("ts").alias("_ts"))
    joined = clicks.join(news, "click_id", "left")
    hit = F.col("_ts").isNotNull()
    changed = {
        "postback_status": F.when(hit, F.col("_status")).otherwise(F.col("postback_status")),
        "postback_payout": F.when(hit, F.col("_payout")).otherwise(F.col("postback_payout")),
        "postback_ts": F.when(hit, F.col("_ts")).otherwise(F.col("postback_ts")),
    }
    return joined.withColumns(changed).select(*clicks.columns)


def upsert(
    base: DataFrame, changes: DataFrame, key: str, cols: list[str], order: list[str], key_pattern: str | None = None
) -> DataFrame:
    """Base rows with ``cols`` taken from the last change of their key, plus rows for new keys.

    ``order`` says which change is last. Keys that do not match the pattern are skipped.
    """
    if key_pattern is not None:
        changes = changes.where(matches(F.col(key), key_pattern))
    last = latest_per_key(changes, [key], order)
    news = last.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"),
                       *[F.col(c).alias(f"_new_{c}") for c in last.columns if c != key and c in base.columns])

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(key, "_key").alias(c)
        if c in cols:
            return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_known").isNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in last.columns else F.col(c)

    known = base.withColumn("_known", F.lit(True))
    if not fits_broadcast(last):
        # Both sides are unique on the key, so one outer join reads, moves and writes every row once.
        return known.join(news, F.col(key) == F.col("_key"), "full").select(*[value(c) for c in base.columns])
    # A few changes: the base is updated where it lies, without a shuffle, and its keys alone are read again.
    updated = known.join(F.broadcast(news), F.col(key) == F.col("_key"), "left").select(*[value(c) for c in base.columns])
    present = base.select(key).join(F.broadcast(last.select(key)), key, "left_semi").distinct()
    added = last.join(present, key, "left_anti").select(*[c for c in base.columns if c in last.columns])
    return updated.unionByName(added, allowMissingColumns=True)


def delete_by_ids(df: DataFrame, ids: DataFrame | Iterable[int], key: str = "id") -> Split:
    """Split off the listed ids; a short list is a literal filter, a table an anti join."""
    if isinstance(ids, DataFrame):
        listed = ids.select(F.col(ids.columns[0]).try_cast("bigint").alias(key)).where(F.col(key).isNotNull()).distinct()
        return Split(df.join(listed, key, "left_anti"), df.join(listed, key, "left_semi"))
    hit = F.coalesce(F.col(key).isin([int(i) for i in ids]), F.lit(False))
    return Split(df.where(~hit), df.where(hit))


def clear(df: DataFrame) -> Split:
    return Split(df.where(F.lit(False)), df)


# --- retention -----------------------------------------------------------------------------------------------------


def retention_cutoff(days: int, as_of: int) -> int:
    """Any positive number of days is taken as it is."""
    if days < 1:
        raise ValueError(f"days must be positive: {days}")
    return as_of - days * DAY


def _split_at(df: DataFrame, ts: str, cutoff: int) -> Split:
    old = df.where(F.col(ts) < cutoff)
    if DATE_COLUMN in df.columns:
        old = old.where(F.col(DATE_COLUMN) <= F.date_from_unix_date(F.lit(cutoff // DAY)))
    return Split(since(df, cutoff, ts), old)


def apply_retention(df: DataFrame, ts: str, days: int, as_of: int) -> Split:
    """Keep the last days. On a dated table both sides read only their own partitions."""
    return _split_at(df, ts, retention_cutoff(days, as_of))


def keep_today(df: DataFrame, as_of: int, ts: str = "ts") -> Split:
    return _split_at(df, ts, midnight(as_of))


def apply_policy(tables: dict[str, DataFrame], as_of: int) -> dict[str, Split]:
    """Retention of every table of the policy that is given."""
    return {
        name: apply_retention(tables[name], ts, days, as_of) for name, ts, days in RETENTION_DAYS if name in tables
    }
