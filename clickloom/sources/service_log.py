"""Service log lines to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.numbers import number_prefix
from clickloom.functions.text import empty_to_null

# Line formats of the log.
_LINE = r"(?s)\A\[([0-9]{2}-[A-Za-z]{3}-[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) UTC\] (.*)\z"
_RECEIVED = r"\APostback received from IP: (.*)\z"
_SAVED = r"\APostback saved: Status=(.*), Country=(.*), Payout=(.*)\z"
_ATTEMPT = r"\A\[POSTBACK (OK|FAIL)\] (.*?) \| IP: (.*?) \| Data: "
_DB_FAILURE = r"\A(?:Database connection failed|Connection params): "


def parse_service_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Columns ts, kind, ip, status, country, payout, message. Lines of another shape keep a null ts."""
    text = F.regexp_extract(column, _LINE, 2)
    message = F.when(text == "", F.col(column)).otherwise(text)
    stamp = F.try_to_timestamp(empty_to_null(F.regexp_extract(column, _LINE, 1)), F.lit("dd-MMM-yyyy HH:mm:ss"))
    df = lines.select(F.unix_timestamp(stamp).alias("ts"), message.alias("message"))
    m = F.col("message")
    kind = (
        F.when(m.rlike(_RECEIVED), "received")
        .when(m.rlike(_SAVED), "saved")
        .when(m.rlike(_ATTEMPT), "secure-attempt")
        .when(m.rlike(_DB_FAILURE), "db_failure")
        .otherwise("other")
    )
    df = df.withColumn("kind", kind)
    k = F.col("kind")
    return df.select(
        "ts",
        "kind",
        F.when(k == "received", F.regexp_extract(m, _RECEIVED, 1))
        .when(k == "secure-attempt", F.regexp_extract(m, _ATTEMPT, 3)).alias("ip"),
        F.when(k == "saved", F.regexp_extract(m, _SAVED, 1))
        .when(k == "secure-attempt", F.regexp_extract(m, _ATTEMPT, 1)).alias("status"),
        F.when(k == "saved", F.regexp_extract(m, _SAVED, 2)).alias("country"),
        F.when(k == "saved", number_prefix(F.regexp_extract(m, _SAVED, 3))).alias("payout"),
        "message",
    )


def scan_service_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_service_log(spark.read.text(path))
