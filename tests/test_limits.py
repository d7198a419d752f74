"""Bounds of readers: what was cut, and nothing cut without bounds."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from clickloom.sources import postbacks, requests
from clickloom.sources.limits import UNLIMITED, Limits

REPORT = Limits().reported()


def test_long_bodies(spark):
    long_agent = {"ip_address": "1.2.3.4", "user_agent": "a" * 20_000, "click_id": "c" * 101}
    bodies = [json.dumps(long_agent), '{"ip_address":"1.2.3.4","user_agent":" ' + "b" * 500 + ' "}', "", None, "{}",
              json.dumps({"ip_address": "1.2.3.4", "user_lp": "\u0001" + "x" * 101, "country_code": "u" * 11})]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    told = requests.ingest_decisions(df, limits=REPORT).orderBy("i").collect()
    assert [r.reject_reason for r in told] == ["body_too_long", None, "missing_ip", "missing_ip", "missing_ip", None]
    assert [r.cut_fields for r in told] == [[], [], [], [], [], ["country_code", "user_lp"]]
    whole = requests.ingest_decisions(df, limits=UNLIMITED.reported()).orderBy("i").collect()
    assert len(whole[0].user_agent) == 20_000 and len(whole[0].click_id) == 101 and whole[0].reject_reason is None
    assert len(whole[5].user_lp) == 101 and all(r.cut_fields == [] for r in whole)
    plain = requests.ingest_decisions(df)
    assert "cut_fields" not in plain.columns
    assert [r.reject_reason for r in plain.orderBy("i").collect()][0] == "missing_ip"


def test_long_parameters(spark):
    df = spark.createDataFrame([(1, {"ip": "1.2.3.4", "ua": "u" * 501, "cid": "c" * 100}), (2, {"ip": "1" * 46}), (3, None)],
                               "i int, params map<string,string>")
    told = requests.ingest_external(df, limits=REPORT).orderBy("i").collect()
    assert [r.cut_fields for r in told] == [["user_agent"], ["ip_address"], []]
    whole = requests.ingest_external(df, limits=UNLIMITED).orderBy("i").collect()
    assert len(whole[0].user_agent) == 501 and whole[1].ip_address == "1" * 46


def test_postbacks(spark):
    """Every profile: each field cut on its own, long bodies and query strings, amounts beyond the stored decimal."""
    long = {"status": "s" * 51, "country": "c" * 11, "device": "d" * 51, "click_id": "i" * 101, "network": "n" * 101,
            "payout": "1e9"}
    rows = [(1, long, "q" * 501, "b" * 1000), (2, {"click_id": "x", "payout": "2", "network": "n" * 60}, "q", "b"),
            (3, {}, None, None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "i int, params map<string,string>, query_string string, body string")
    df = df.withColumn("client_ip", F.lit("203.0.113.9"))
    fields = ["click_id", "country_code", "network", "payout", "status", "traffic_type"]
    expected = {"secure": (sorted([*fields, "query_string"]), ["network"]), "tracking": (fields, []),
                "flexible": (sorted([*fields, "body", "query_string"]), ["network"])}
    for profile, (first, second) in expected.items():
        if profile == "flexible":  # letters are no digits there, so the amount is written out
            df = df.withColumn("params", F.when(F.col("i") == 1, F.map_concat(
                F.map_filter("params", lambda k, _: k != "payout"), F.create_map(F.lit("payout"), F.lit("1000000000")))
            ).otherwise(F.col("params")))
        told = postbacks.ingest_postbacks(df, profile, limits=REPORT).orderBy("i").collect()
        assert [r.cut_fields for r in told] == [first, second, [], []], profile
        whole = postbacks.ingest_postbacks(df, profile, limits=UNLIMITED).orderBy("i").collect()
        assert len(whole[0].status) == 51 and len(whole[0].network) == 101 and len(whole[0].click_id) == 101
        if profile == "flexible":
            assert whole[0].query_string == "METHOD=GET | " + "q" * 501 + " | BODY: " + "b" * 1000
        same = postbacks.ingest_postbacks(df, profile)
        assert [r[:] for r in same.orderBy("i").collect()] == [
            r[:] for r in postbacks.ingest_postbacks(df, profile, limits=REPORT).drop("cut_fields").orderBy("i").collect()]
