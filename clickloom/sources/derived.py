"""Traffic tables derived from the benchmark tables, in the shapes of ``schemas``.

``since`` (Unix second) is an optional lower time bound. It only narrows the scan by a pushed-down predicate on the
source's own time column; callers still apply their exact filter.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream. A pattern lets the source be a directory or a single file."""
    schema = read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _epoch(c: Column) -> Column:
    """Unix second of a zone-less timestamp read as UTC, whatever the session zone is."""
    day = F.unix_date(c.cast("date")).cast("bigint")
    return day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def _from(c: str, cutoff: int | None) -> Column:
    if cutoff is None:
        return F.lit(True)
    text = datetime.fromtimestamp(cutoff, UTC).strftime("%Y-%m-%d %H:%M:%S")
    return F.col(c) >= F.lit(text).cast("timestamp_ntz")


def _country(x: Column) -> Column:
    slot = x % 9
    names = ["US", "DE", "BR", "IN", "NG", "XX", "UNITED STA", ""]
    out = F.when(slot == 0, names[0])
    for i, name in enumerate(names[1:], start=1):
        out = out.when(slot == i, name)
    return out


def _text(c: Column) -> Column:
    return c.cast("string")


def requests_from(events: DataFrame) -> DataFrame:
    """Decision requests."""
    e, u = F.col("event_id"), F.col("user_id")
    agents = ["Mozilla/5.0 (iPhone OS 17_0)", "Mozilla/5.0 (Android 14) Mobile", "Mozilla/5.0 (Windows NT 10.0)",
              "Mozilla/5.0 (iPad OS 17_0)", "ExampleBot/1.0", "wap", "", "Desktop"]
    agent = F.when(e % 8 == 0, agents[0])
    for i, name in enumerate(agents[1:], start=1):
        agent = agent.when(e % 8 == i, name)
    ip = (
        F.when(u % 11 == 0, "not-an-ip")
        .when(u % 7 == 0, F.concat(F.lit("10.0."), _text(u % 256), F.lit("."), _text(e % 256)))
        .otherwise(F.concat(F.lit("203.0."), _text(u % 256), F.lit(".9")))
    )
    return events.select(
        e.alias("id"), _epoch(F.col("ts")).alias("ts"), F.concat(F.lit("c"), _text(e)).alias("click_id"),
        _country(u).alias("country_code"), agent.alias("user_agent"), ip.alias("ip"),
        F.concat(F.lit("lp"), _text(e % 5)).alias("user_lp"), u.alias("user_id"), "event_type")


def requests(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    events = read(spark, sf_dir, "events").where(_from("ts", since))
    return requests_from(events).drop("user_id", "event_type")


def logs(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    """Stored decisions."""
    rows = requests_from(read(spark, sf_dir, "events").where(_from("ts", since))).where("ip <> 'not-an-ip'")
    return rows.select(
        "id", "ts", "ip", F.col("user_agent").alias("ua"), "click_id",
        F.nullif("country_code", F.lit("")).alias("country_code"), "user_lp",
        F.when(F.col("event_type").isin("purchase", "signup"), "A").otherwise("B").alias("decision"))


def received_from(orders: DataFrame, customer: DataFrame) -> DataFrame:
    o, status, kind = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderkey") % 4
    rows = orders.join(customer.select("c_custkey", "c_nationkey", "c_mktsegment"), F.expr("o_custkey = c_custkey"))
    return rows.select(
        o.alias("id"), (_epoch(F.col("o_orderdate")) + o % 86400).alias("ts"),
        F.when(status == "F", "confirmed").when(status == "O", "pending").otherwise("rejected").alias("status"),
        F.coalesce(_country(F.col("c_nationkey")), F.lit("XX")).alias("country_code"),
        F.when(kind == 0, "WAP").when(kind == 1, "WEB").when(kind == 2, "TABLET").otherwise("BOT").alias("traffic_type"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("payout"),
        F.concat(F.lit("c"), _text(o % 5000)).alias("click_id"), F.col("c_mktsegment").alias("network"))


def received(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    """Received postbacks; their second lies up to a day after the order date."""
    orders = read(spark, sf_dir, "orders").where(_from("o_orderdate", None if since is None else since - 86400))
    return received_from(orders, read(spark, sf_dir, "customer"))


def sent(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    """Sent postbacks. The id is not unique: order by ts, id, payout, part_key."""
    items = read(spark, sf_dir, "lineitem").where(_from("l_shipdate", None if since is None else since - 60))
    o, good = F.col("l_orderkey"), F.col("l_returnflag") == "N"
    return items.select(
        (o * 10 + F.col("l_linenumber")).alias("id"), (_epoch(F.col("l_shipdate")) + o % 60).alias("ts"),
        _country(F.col("l_suppkey")).alias("country_code"), F.col("l_returnflag").alias("traffic_type"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("payout"), F.col("l_partkey").alias("part_key"),
        F.concat(F.lit("host"), _text(F.col("l_suppkey") % 2)).alias("host"),
        F.when(good, 200).otherwise(503).alias("response_code"), good.alias("success"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing rules, one per customer: some for one landing page, some for all, about a sixth of them switched off."""
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "mobile").when(k % 4 == 1, "desktop").when(k % 4 == 2, "tablet").otherwise("bot")
    return read(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat(F.lit("rule "), _text(k)).alias("rule_name"),
        F.lower(_country(F.col("c_nationkey"))).alias("country_code"), kind.alias("device_type"),
        F.when(k % 5 != 0, F.concat(F.lit("lp"), _text(k % 701))).alias("user_lp"),
        F.concat(F.lit("https://t"), _text(k % 9), F.lit(".example.net/"), _text(k)).alias("redirect_url"),
        (k % 17).cast("int").alias("priority"), (k % 6 != 0).alias("is_active"))


def failed_logins(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    rows = read(spark, sf_dir, "events").where((F.col("event_type") == "error") & _from("ts", since))
    return rows.select(
        F.col("event_id").alias("id"), _epoch(F.col("ts")).alias("attempted_at"),
        F.concat(F.lit("203.0."), _text(F.col("user_id") % 256), F.lit(".9")).alias("ip"))


def squeezed_from(events: DataFrame) -> DataFrame:
    start = 1704067200
    second = F.lit(start) + F.floor((_epoch(F.col("ts")) - start) / 2160).cast("bigint")
    return events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("ip"), _text(F.col("user_id") % 3)).alias("ip"),
        second.alias("ts"))


def squeezed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of 30 days squeezed into 20 minutes and three addresses, so that rate limits are reached."""
    return squeezed_from(read(spark, sf_dir, "events"))
