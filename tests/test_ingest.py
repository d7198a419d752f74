"""Readers: accepted and rejected rows by hand."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clickloom.functions.secure import hmac_sha256
from clickloom.operators.quality import check_schema, has_filled
from clickloom.sources import postbacks, requests, service_log

MAP = "i int, params map<string,string>"


def test_decisions(spark):
    ok = '{"click_id":" a!b_1 ","country_code":"u s","user_agent":"UA","ip_address":"1.2.3.4","user_lp":"l/p"}'
    bodies = [ok, '{"ip_address":"nope"}', '{"click_id":"x"}', "not json", ok[:50], "", None,
              '{"ip_address":"::1","country_code":null}', '{"ip_address":"1.2.3.4","pad":"' + "x" * 10240 + '"}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    out = requests.ingest_decisions(df).orderBy("i").collect()
    assert [r.reject_reason for r in out] == [
        None, "invalid_ip", "missing_ip", "missing_ip", "missing_ip", "missing_ip", "missing_ip", None, "missing_ip"]
    assert (out[0].click_id, out[0].country_code, out[0].user_lp) == ("ab_1", "US", "lp")
    assert out[7].country_code == "XX" and out[7].click_id == ""
    both = requests.ingest_decisions(df)
    assert requests.accepted(both).count() + requests.quarantined(both).count() == len(bodies)


def test_decisions_need_json_content_type(spark):
    df = spark.createDataFrame(
        [('{"ip_address":"1.2.3.4"}', "application/json; charset=utf-8"), ('{"ip_address":"1.2.3.4"}', "text/plain")],
        "body string, kind string")
    out = requests.ingest_decisions(df, content_type="kind").collect()
    assert sorted(str(r.reject_reason) for r in out) == ["None", "missing_ip"]


def test_external(spark):
    rows = [(1, {"cid": "c1", "cc": "de", "device": "wap", "ip": "1.2.3.4", "campaign": "x"}),
            (2, {"click_id": "", "cid": "c2", "ip_address": ""}), (3, {"ip": "bad"})]
    df = spark.createDataFrame(rows, MAP).withColumn("own", F.lit("9.9.9.9"))
    out = requests.ingest_external(df, client_address="own").orderBy("i").collect()
    assert (out[0].click_id, out[0].country_code, out[0].user_agent, out[0].user_lp) == ("c1", "DE", "wap", "x")
    assert out[1].click_id == "" and out[1].ip_address == "9.9.9.9" and out[1].country_code == ""
    assert [r.reject_reason for r in out] == [None, None, "invalid_ip"]


def _ingest(spark, profile, rows, config=None, **extra):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(rows)], MAP)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return postbacks.ingest_postbacks(df, profile, config).orderBy("i").collect()


def test_flexible(spark):
    rows = [
        {"country": "US", "device": "WAP", "payout": "0.50", "status": "confirmed"},
        {"c": "us", "d": "wap", "p": "0.50", "s": "confirmed"},
        {"geo": "US", "traffic_type": "mobile", "revenue": "0.50", "click_id": "ABC123"},
        {"x": "1"}, {"payout": "-5"}, {"p": "1e3"}, {"p": "1.2.3"}, {"payout": "0"}, {"txid": "t"},
        {"country": "", "c": "united states"}]
    out = _ingest(spark, "flexible", rows, query_string="q=1", body="b", method="POST", client_ip="1.2.3.4")
    assert [r.reject_reason for r in out] == [
        None, None, None, "no_data", None, None, None, "no_data", None, None]
    assert [r.payout for r in out[:7]] == [Decimal(x) for x in ("0.50", "0.50", "0.50", "0.00", "5.00", "13.00", "1.20")]
    assert out[1].traffic_type == "WAP" and out[2].click_id == "ABC123" and out[0].click_id is None
    assert out[9].country_code == "UNITED STA"
    assert out[0].query_string == "METHOD=POST | q=1 | BODY: b" and out[0].status == "confirmed"
    long = _ingest(spark, "flexible", rows[:1], query_string="ä" * 400)
    assert len(long[0].query_string.encode()) <= 502


def test_tracking(spark):
    rows = [{"payout": p} for p in ("10000", "10000.01", "-1", "12abc", "")] + [
        {"status": ""}, {"country": "", "country_code": "US"}, {"device": "wap", "click_id": ""}]
    out = _ingest(spark, "tracking", rows, client_ip="1.2.3.4")
    assert [r.reject_reason for r in out] == [
        None, "invalid_payout", "invalid_payout", None, None, "missing_fields", "missing_fields", None]
    assert out[0].status == "unknown" and out[0].country_code == "XX" and out[0].network == "unknown"
    assert out[3].payout == Decimal("12.00") and out[7].click_id is None and out[7].traffic_type == "wap"
    assert set(out[7].query_string.split("&")) == {"device=wap", "click_id="}


def test_secure_order_of_checks(spark):
    config = postbacks.ReceiverConfig(api_key="key", hmac_secret="secret")
    signed = spark.range(1).select(hmac_sha256(F.lit("click_id=c+1&country=UNITED+STA&payout=1&status=confirmed"), "secret"))
    good = {"cid": "c 1", "payout": "1.0", "geo": "United States", "signature": signed.first()[0]}
    cases = [(good, "203.0.113.9", "key"), (good, "8.8.8.8", "bad"), (good, "192.0.2.1", "bad"),
             ({**good, "signature": "0"}, "198.51.100.1", "key"), (good | {"cid": "", "click_id": "0"}, "192.0.2.1", "key")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], MAP + ", client_ip string, api_key string")
    out = postbacks.ingest_postbacks(df, "secure", config).orderBy("i").collect()
    assert [r.reject_reason for r in out] == [
        None, "ip_not_allowed", "invalid_api_key", "invalid_signature", "invalid_signature"]
    assert out[0].country_code == "XX" and out[0].click_id == "c 1"
    unsigned = postbacks.ReceiverConfig()
    out = _ingest(spark, "secure", [{"click_id": "0"}, {"s2": "x"}], unsigned, client_ip="192.0.2.1")
    assert [r.reject_reason for r in out] == ["missing_click_id", None]


def test_unknown_profile(spark):
    with pytest.raises(ValueError):
        _ingest(spark, "other", [{}])


def test_service_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(
        "[26-Nov-2025 10:14:55 UTC] Postback received from IP: 192.0.2.7\n"
        "[26-Nov-2025 10:14:56 UTC] Postback saved: Status=confirmed, Country=UNITED STA, Payout=0.285\n"
        "[26-Nov-2025 10:14:57 UTC] [POSTBACK OK] Postback received successfully | IP: 192.0.2.8 | Data: {}\n"
        "[28-Nov-2025 03:09:51 UTC] Database connection failed: no\n"
        "[28-Nov-2025 03:09:51 UTC] Connection params: host=h\nfree text\n")
    out = service_log.scan_service_log(spark, str(tmp_path)).collect()
    assert [r.kind for r in out] == ["received", "saved", "secure-attempt", "db_failure", "db_failure", "other"]
    assert out[0].ip == "192.0.2.7" and out[0].ts == 1764152095
    assert (out[1].status, out[1].country, out[1].payout) == ("confirmed", "UNITED STA", 0.285)
    assert (out[2].status, out[2].ip) == ("OK", "192.0.2.8")
    assert out[5].ts is None and out[5].message == "free text"


def test_schema_check(spark):
    docs = ['{"k":1,"s":"x"}', '{"k":1.5,"s":"x"}', '{"k":null,"s":"x"}', '{"s":"x"}', "broken", '{"k":1,"s":2}', None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string")
    out = check_schema(df, "doc", {"k": "int", "s": "string"}).orderBy("i").collect()
    assert [r.schema_ok for r in out] == [True, False, False, False, False, False, False]
    out = check_schema(df, "doc", {}, ["k"]).orderBy("i").collect()
    assert [r.schema_ok for r in out] == [True, True, True, False, False, True, False]
    filled = spark.createDataFrame([({"a": "1"},), ({"a": ""},), ({"b": "1"},)], "m map<string,string>")
    assert [r[0] for r in filled.select(has_filled(F.col("m"), ["a"])).collect()] == [True, False, False]
