"""Left lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# At most this many keys are treated as hot. Any other key then holds less than 1/HOT_KEYS of the rows.
HOT_KEYS = 1000
_SPREAD = 4096
# On streams every key is split into so many shares; a key with a third of a batch then gives a task 1/48 of it.
STREAM_SHARES = 16


def broadcast_limit(df: DataFrame) -> int:
    """The session's own bound for broadcast sides, in bytes (-1 turns broadcasting off)."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    return int(float(text[:-1]) * units[text[-1]]) if text[-1] in units else int(text)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's upper estimate for the size of a frame; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame) -> bool:
    return estimated_bytes(df) <= broadcast_limit(df)


def dealt(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the share of a row, by a hash of the columns."""
    return df.withColumn("_share", F.pmod(F.xxhash64(*columns), F.lit(STREAM_SHARES)).cast("int"))


def lookup_join(left: DataFrame, right: DataFrame, key: str, spread: list[str] | None = None) -> DataFrame:
    """Left join to a frame that is unique on ``key``, keeping every left row once.

    A right side under the session's broadcast bound is broadcast. A larger one is shuffled, and then a hot or
    missing key would send its rows to one task: the keys with most rows (a fixed number of them) are answered by a
    broadcast of their few right rows, and the rows they leave behind join on a spread key that matches nothing.
    A stream cannot be counted first: there the right side is repeated once per share, and the rows of every key are
    dealt over the shares by a hash of ``spread``.
    """
    if fits_broadcast(right):
        return left.join(F.broadcast(right), key, "left")
    columns = spread or [f.name for f in left.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    if left.isStreaming:
        shares = F.explode(F.sequence(F.lit(0), F.lit(STREAM_SHARES - 1)))
        return dealt(left, columns).join(right.withColumn("_share", shares), [key, "_share"], "left").drop("_share")
    values = [c for c in right.columns if c != key]
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
    hot = counts.orderBy(F.desc("count"), key).limit(HOT_KEYS).select(key)
    hot_rows = right.join(F.broadcast(hot), key, "left_semi")
    answers = hot.join(F.broadcast(hot_rows), key, "left").select(
        key, F.lit(True).alias("_hot"), F.struct(*values).alias("_hot_values"))
    tagged = left.join(F.broadcast(answers), key, "left")
    cold = F.col("_hot").isNull() & F.col(key).isNotNull()
    salt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*columns), F.lit(_SPREAD)).cast("string"))
    tagged = tagged.withColumn("_key", F.when(cold, F.concat(F.lit("="), F.col(key).cast("string"))).otherwise(salt))
    side = right.select(
        F.concat(F.lit("="), F.col(key).cast("string")).alias("_key"), F.struct(*values).alias("_cold_values"))
    joined = tagged.join(side, "_key", "left")
    picked = [
        F.when(F.col("_hot"), F.col(f"_hot_values.{v}")).otherwise(F.col(f"_cold_values.{v}")).alias(v) for v in values
    ]
    rest = [c for c in left.columns if c != key]
    return joined.select(key, *rest, *picked)
