"""Sinks read back, keyed changes, retention."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clickloom import registry
from clickloom.operators import tables
from clickloom.plans.pruning import since
from clickloom.sources import derived
from clickloom.sources.tables import from_traffic_logs, load

DAY = 86400


def test_append_and_load(spark, sf_dir, tmp_path):
    logs = derived.logs(spark, sf_dir)
    for _ in range(2):
        tables.append_traffic(logs, f"{tmp_path}/logs")
    back = load(spark, str(tmp_path), "logs")
    assert back.count() == 2 * logs.count()
    assert back.select(*logs.columns).exceptAll(logs.unionAll(logs)).isEmpty()
    kept = since(back, 1706572800)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert kept.count() == 2 * logs.where("ts >= 1706572800").count()


def test_traffic_rows(spark):
    rows = [("1.2.3.4", "", "A"), ("", "c", "B"), ("bad", "c", "A"), ("1.2.3.4", "c", "C"), (None, None, "A")]
    df = spark.createDataFrame(rows, "ip string, click_id string, decision string").withColumns({
        "ua": F.lit(" ua "), "country_code": F.lit(""), "user_lp": F.lit(None).cast("string")})
    out = tables.traffic_rows(df).collect()
    assert [(r.ip, r.click_id, r.decision, r.ua, r.country_code) for r in out] == [
        ("1.2.3.4", None, "A", "ua", None), ("", "c", "B", "ua", None), ("", None, "A", "ua", None)]


def test_postback_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 0, "US", "WAP", Decimal("1.50"), "https://x.de", 200, "ok", True),
         (2, 0, "ZQ", "WAP", Decimal("1.50"), "https://x.de", None, None, None),
         (3, 0, "", "WAP", Decimal("1.50"), "https://x.de", None, None, None),
         (4, 0, "US", None, Decimal("1.50"), "https://x.de", None, None, None)],
        "id bigint, ts bigint, country_code string, traffic_type string, payout decimal(10,2), postback_url string, "
        "response_code int, response_body string, success boolean")
    tables.append_postback_log(df, f"{tmp_path}/postback_logs")
    assert sorted((r.id, r.success) for r in load(spark, str(tmp_path), "postback_logs").collect()) == [
        (1, True), (3, False)]


def test_replace_dates_touches_only_given_dates(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(1, 10), (2, DAY + 10), (3, 2 * DAY)], "id bigint, ts bigint")
    tables.append_dated(df, path)
    changed = spark.read.parquet(path).where("id = 2").withColumn("id", F.lit(20).cast("bigint"))
    tables.replace_dates(changed, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3, 20]


def test_old_names(spark):
    df = spark.createDataFrame([("c", "US", "lp")], "cid string, cc string, lp string")
    assert from_traffic_logs(df).columns == ["click_id", "country_code", "user_lp"]


def test_update_clicks_keeps_every_click(spark, sf_dir):
    clicks = derived.logs(spark, sf_dir).select("id", "click_id", F.lit("old").alias("postback_status"),
                                                F.lit(None).cast("decimal(10,2)").alias("postback_payout"),
                                                F.lit(None).cast("bigint").alias("postback_ts"))
    out = tables.update_clicks(clicks, derived.received(spark, sf_dir))
    assert out.count() == clicks.count() and out.columns == clicks.columns
    assert out.where("postback_ts is null and postback_status <> 'old'").isEmpty()


def test_upsert_large_and_small_changes(spark, setting):
    base = spark.createDataFrame([("A", 1, "x"), ("B", 2, "y")], "k string, v int, kind string")
    changes = spark.createDataFrame(
        [("B", 3, 1), ("B", 4, 2), ("C", 5, 1), ("C", None, 3), ("bad", 9, 1)], "k string, v int, at int")
    for limit in ("10485760", "-1"):
        setting("spark.sql.autoBroadcastJoinThreshold", limit)
        out = tables.upsert(base, changes, "k", ["v"], ["at"], key_pattern="config_key")
        assert sorted(map(tuple, out.collect()), key=str) == [("A", 1, "x"), ("B", 4, "y"), ("C", None, None)]


def test_delete(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id bigint")
    split = tables.delete_by_ids(df, [2, 5])
    assert sorted(str(r.id) for r in split.kept.collect()) == ["1", "None"]
    assert split.removed_count().first().removed == 1
    split = tables.delete_by_ids(df, spark.createDataFrame([("1",), ("x",), ("1",)], "ids string"))
    assert sorted(str(r.id) for r in split.kept.collect()) == ["2", "None"] and split.removed.count() == 1
    assert tables.clear(df).kept.isEmpty() and tables.clear(df).removed_count().first().removed == 3


def test_retention_partitions_the_input(spark):
    df = spark.createDataFrame([(i * DAY // 2,) for i in range(40)], "ts bigint")
    for days, kept in ((1, 3), (5, 11), (9999, 40)):
        split = tables.apply_retention(df, "ts", days, 39 * DAY // 2)
        assert (split.kept.count(), split.removed.count()) == (kept, 40 - kept)
    today = tables.keep_today(df, 3 * DAY + 5)
    assert today.kept.count() == 34 and today.removed.count() == 6


def test_policy_covers_given_tables(spark):
    df = spark.createDataFrame([(0,), (100 * DAY,)], "ts bigint")
    out = tables.apply_policy({"postback_logs": df, "unlisted": df}, 100 * DAY)
    assert list(out) == ["postback_logs"] and out["postback_logs"].kept.count() == 1


def test_json(spark, tmp_path):
    df = spark.createDataFrame([("é/", None)], "a string, b int")
    assert tables.to_json_rows(df).first().json == '{"a":"é\\/","b":null}'
    tables.json_export(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().a == "é/"


def _files(path):
    return sorted(p.relative_to(path).parent.as_posix() for p in path.rglob("*.parquet"))


def test_splits_change_the_stored_table(spark, tmp_path):
    day = 86400
    rows = spark.createDataFrame([(i, 19_700 * day + (i % 5) * day + i) for i in range(50)], "id bigint, ts bigint")
    path = tmp_path / "t"
    tables.append_dated(rows, str(path))

    def load():
        return spark.read.schema("id bigint, ts bigint, dt date").parquet(str(path))

    before = set(path.rglob("*.parquet"))
    assert tables.apply_split(tables.delete_by_ids(load(), [3, 8]), str(path)) == 1
    assert load().count() == 48 and not load().where("id in (3, 8)").count()
    assert len(before & set(path.rglob("*.parquet"))) == 4  # the other dates keep their files
    as_of = 19_704 * day
    assert tables.apply_split(tables.apply_retention(load(), "ts", 2, as_of), str(path)) == 2
    assert load().agg({"ts": "min"}).first()[0] >= as_of - 2 * day
    assert len(set(_files(path))) == 3  # emptied dates are gone from disk
    assert tables.apply_split(tables.clear(load()), str(path)) == 3
    assert load().count() == 0 and _files(path) == []
    assert tables.apply_split(tables.clear(load()), str(path)) == 0


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (2, 90_000)], "id bigint, ts bigint")
    for batch in ("a", "a", "b"):
        tables.append_dated(rows, str(tmp_path / "t"), batch_id=batch)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_days_are_taken_as_given():
    assert tables.retention_cutoff(400, 0) == -400 * 86400
    with pytest.raises(ValueError):
        tables.retention_cutoff(0, 0)


def test_policy_reads_stored_tables_only(spark, sf_dir):
    """Every table of the policy is cut in storage: nothing is counted from the given tables."""
    files = registry.queries()["retention_policy"](spark, sf_dir).inputFiles()
    assert files and not [f for f in files if f"{sf_dir}/" in f]
