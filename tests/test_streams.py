"""Streams in several micro-batches give what the batch jobs give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickloom.operators import security, stats
from clickloom.operators.routing import decide
from clickloom.plans import lookup, workspace
from clickloom.plans.keyed import latest_per_key
from clickloom.registry import SETTINGS
from clickloom.sources import derived
from clickloom.streaming import jobs, sinks

PARTS = 4


def _replay(spark, df, path):
    """The frame as a file stream of several batches in time order."""
    edges = df.approxQuantile("ts", [i / PARTS for i in range(1, PARTS)], 0.001)
    low = None
    for high in [*edges, None]:
        part = df.where((F.lit(True) if low is None else F.col("ts") > low)
                        & (F.lit(True) if high is None else F.col("ts") <= high))
        part.coalesce(1).write.mode("append").parquet(path)
        low = high
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _same(a, b):
    b = b.select(*a.columns)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).isEmpty()


@pytest.fixture(scope="module")
def received(spark, sf_dir):
    return derived.received(spark, sf_dir)


def test_decide(spark, sf_dir, tmp_path):
    requests = derived.requests(spark, sf_dir)
    reputation = requests.where("ip like '203.%'").select("ip", F.lit("N").alias("answer")).distinct()
    out = jobs.decide_stream(_replay(spark, requests, f"{tmp_path}/in"), SETTINGS, reputation)
    done = spark.read.schema(out.schema).parquet(sinks.run_available(out, "t"))
    _same(done, decide(requests, SETTINGS, reputation))


def test_lookup_of_a_hot_key(spark, setting, tmp_path):
    """A key with a third of all rows, missing and unmatched keys, beyond the broadcast bound."""
    rows = spark.range(6000).select("id", F.expr("id div 1500").alias("ts"), F.expr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 <> 0 THEN concat('k', id % 40) END").alias("k"))
    right = spark.createDataFrame([("hot", 1, "h")] + [(f"k{i}", i, None) for i in range(0, 40, 2)], "k string, a int, b string")
    stream = _replay(spark, rows, f"{tmp_path}/in")
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = lookup.lookup_join(stream, right, "k")
    assert out.columns == ["k", "id", "ts", "a", "b"]
    done = spark.read.schema(out.schema).parquet(sinks.run_available(out, "t"))
    _same(done, rows.join(right, "k", "left"))
    split = lookup.dealt(rows.where("k = 'hot'"), ["id"]).groupBy("_share").count().collect()
    assert len(split) == lookup.STREAM_SHARES and max(r["count"] for r in split) < 2000 / 8


def test_rate_limit(spark, sf_dir, tmp_path):
    requests = derived.squeezed(spark, sf_dir)
    for most in (3, 120):
        out = jobs.rate_limit_stream(_replay(spark, requests, f"{tmp_path}/in{most}"), most)
        done = spark.read.schema("ip string, id bigint, ts bigint, allowed boolean").parquet(sinks.run_available(out, "t"))
        _same(done, security.rate_limit(requests, most))
        assert done.where("not allowed").count() > 0 or most == 120


def test_rate_windows(spark, sf_dir, tmp_path):
    requests = derived.squeezed(spark, sf_dir).withColumn("endpoint", F.lit("/x"))
    out = jobs.rate_windows_stream(_replay(spark, requests, f"{tmp_path}/in"), 10, watermark="1 minute")
    done = spark.read.schema(out.schema).parquet(sinks.run_available(out, "t"))
    last = requests.agg(F.max("ts")).first()[0]
    _same(done, security.rate_windows(requests, 10).where(F.col("window_end") <= last - 60))


def test_payouts(spark, received, tmp_path):
    days = received.agg(F.max("ts")).first()[0]
    for view in ("daily", "weekly"):
        source = _replay(spark, received.where(F.col("ts") > days - 300 * 86400), f"{tmp_path}/{view}")
        out = jobs.payout_stats_stream(source, view)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
        rows = spark.read.schema(f"{columns}, batch_id bigint").parquet(sinks.run_available(out, "t", "update"))
        last = F.max_by(F.struct(*[c for c in out.columns if c != "date"]), "batch_id").alias("last")
        final = rows.groupBy("date").agg(last).select("date", "last.*")
        exact = stats.payout_stats(received.where(F.col("ts") > days - 300 * 86400), 365, days, view)
        _same(final, exact)


def test_latest(spark, received, tmp_path):
    out = jobs.latest_postback_stream(_replay(spark, received, f"{tmp_path}/in"))
    rows = spark.read.parquet(sinks.run_available(out, "t", "update"))
    final = rows.groupBy("click_id").agg(F.max_by(F.struct("status", "payout", "ts", "id"), F.struct("ts", "id")).alias("l"))
    exact = latest_per_key(received, ["click_id"], ["ts", "id"]).select("click_id", "status", "payout", "ts", "id")
    _same(final.select("click_id", "l.*"), exact)


def test_every_window_is_reported(spark, sf_dir, tmp_path):
    requests = derived.squeezed(spark, sf_dir).withColumn("endpoint", F.lit("/x"))
    out = jobs.rate_windows_stream(_replay(spark, requests, f"{tmp_path}/in"), 10)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(sinks.run_available(out, "t", "update"))
    key = ["ip", "endpoint", "window_start"]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in out.columns if c not in key]), "batch_id").alias("l"))
    _same(last.select(*key, "l.*"), security.rate_windows(requests, 10))


def test_shared_folder_is_used(spark):
    folder = workspace.work_folder(spark, "x")
    assert folder.startswith((spark.conf.get("spark.checkpoint.dir", None) or "/").rstrip("/"))

    class Conf:
        def __init__(self, master):
            self.master = master

        def get(self, key, default=None):
            return {"spark.master": self.master}.get(key, default)

    class Session:
        conf = Conf("yarn")

    with pytest.raises(ValueError):
        workspace.work_folder(Session(), "x")
