"""Plans that must hold at any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom import registry
from clickloom.operators import stats, tables
from clickloom.sources import derived, postbacks

STREAMS = {n for n in registry.queries() if n.endswith("_stream")}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pairwise_joins(spark, sf_dir, setting):
    # Without broadcasts a join that lacks an equality shows up as a product.
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name, query in registry.queries().items():
        if name not in STREAMS:
            plan = _plan(query(spark, sf_dir))
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_time_bounds_reach_the_scan(spark, sf_dir):
    for name, column in (("daily_payout_stats", "o_orderdate"), ("count_today", "ts"), ("recent_traffic", "ts")):
        assert f"GreaterThanOrEqual({column}" in _plan(registry.queries()[name](spark, sf_dir)), name
    logs = derived.logs(spark, sf_dir, tables.retention_cutoff(7, registry.EVENTS_NOW))
    assert "GreaterThanOrEqual(ts" in _plan(tables.apply_retention(logs, "ts", 7, registry.EVENTS_NOW).kept)


def test_scans_read_only_needed_columns(spark, sf_dir):
    plan = _plan(registry.queries()["count_by_decision"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan \
        or "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    assert "html" not in _plan(registry.queries()["url_check"](spark, sf_dir)).split("ReadSchema")[1]


def test_top_k_is_not_a_full_sort(spark, sf_dir):
    for name in ("recent_traffic", "recent_postbacks", "recent_received", "traffic_by_country", "top_countries"):
        assert "TakeOrderedAndProject" in _plan(registry.queries()[name](spark, sf_dir)), name
    newest = stats.payout_stats(derived.received(spark, sf_dir), 30, registry.ORDERS_NOW, max_periods=10)
    assert "TakeOrderedAndProject" in _plan(newest)


def test_row_jobs_do_not_shuffle(spark, sf_dir):
    for name in ("ingest_decisions", "ingest_external", "detect_device", "fallback_url", "json_export", "append_traffic",
                 "client_ip", "filter_traffic", "search_traffic", "mute_window"):
        assert "Exchange" not in _plan(registry.queries()[name](spark, sf_dir)), name


def test_group_limit_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in _plan(registry.queries()["rate_limit_violations"](spark, sf_dir))


def test_limits_are_followed_once(spark, sf_dir):
    plan = _plan(registry.queries()["rate_limit_violations"](spark, sf_dir))
    assert "InPandas" not in plan and plan.count("Join") == plan.count("BroadcastHashJoin") == 3


def test_dashboard_scans_twice(spark, sf_dir):
    assert _plan(registry.queries()["dashboard"](spark, sf_dir)).count("FileScan parquet") == 2


def test_cleaning_runs_once_under_a_filter(spark, sf_dir):
    given = F.create_map(F.lit("status"), F.col("status"), F.lit("payout"), F.col("payout").cast("string"),
                         F.lit("country"), F.col("country_code"), F.lit("click_id"), F.col("click_id"))
    rows = derived.received(spark, sf_dir).select("id", "ts", given.alias("params"))
    plan = _plan(tables.received_rows(postbacks.ingest_postbacks(rows, "tracking")).select("id", "ts", "status", "payout"))
    assert plan.count("regexp_extract(") == 1
