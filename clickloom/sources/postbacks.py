"""Received postbacks under three receiver profiles.

Input columns: ``params`` map, and for some profiles ``method``, ``query_string``, ``body``, ``client_ip``,
``api_key`` (header) and ``signature`` (header). Missing ones read as null. Every input row is kept;
``reject_reason`` is null for the rows a receiver stores. ``Limits`` has the bounds of all values, and tells on demand which
ones were cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.geo import norm_country
from clickloom.functions.net import in_any_cidr
from clickloom.functions.numbers import money, number_prefix
from clickloom.functions.secure import hmac_ok
from clickloom.functions.text import (
    ascii_upper, empty_to_null, first_bytes, is_blank_or_zero, sanitize,
)
from clickloom.plans.barrier import computed_once
from clickloom.sources.limits import Limits, cut_bytes, cut_chars, cut_fields, cut_money
from clickloom.sources.params import first_filled, first_present, to_query_string

# Networks a receiver accepts unless configured otherwise.
DEFAULT_ALLOWLIST = ("203.0.113.0/24", "198.51.100.0/24", "192.0.2.0/24")
MAX_PAYOUT = 10000
STORED_COLUMNS = [
    "status", "country_code", "traffic_type", "payout", "click_id", "network", "ip_address", "query_string",
]


@dataclass(frozen=True)
class ReceiverConfig:
    """Settings of the secure profile. No API key or no secret means that check is off."""

    allowlist: tuple[str, ...] = DEFAULT_ALLOWLIST
    api_key: str | None = None
    hmac_secret: str = ""


def ingest_postbacks(df: DataFrame, profile: str, config: ReceiverConfig | None = None,
                     limits: Limits = Limits()) -> DataFrame:
    for name in ("method", "query_string", "body", "client_ip", "api_key", "signature"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    if profile == "secure":
        return _secure(df, config or ReceiverConfig(), limits)
    if profile == "flexible":
        return _flexible(df, limits)
    if profile == "tracking":
        return _tracking(df, limits)
    raise ValueError(f"unknown profile: {profile}")


def _finish(df: DataFrame, fields: dict[str, Column], reason: Column, limits: Limits,
            cuts: dict[str, Column]) -> DataFrame:
    if limits.report:
        fields = {**fields, "cut_fields": cut_fields(cuts)}
    raw = {"params", "method", "query_string", "body", "client_ip", "api_key", "signature"}
    carried = [c for c in df.columns if c not in raw | set(fields) and not c.startswith("_")]
    return df.select(*carried, *[c.alias(n) for n, c in fields.items()], computed_once(reason).alias("reject_reason"))


def _cut_texts(texts: dict[str, Column], limits: Limits) -> dict[str, Column]:
    return {name: cut_chars(text, getattr(limits, name)) for name, text in texts.items()}


def _secure(df: DataFrame, config: ReceiverConfig, limits: Limits) -> DataFrame:
    p = F.col("params")
    texts = {
        "click_id": first_filled(p, ["click_id", "clickid", "cid", "s2"], ""),
        "status": first_filled(p, ["status", "conversion_status", "action"], "confirmed"),
        "country_code": ascii_upper(first_filled(p, ["country", "country_code", "geo"], "XX")),
        "traffic_type": first_filled(p, ["device", "device_type", "traffic_type"], "unknown"),
        "network": first_filled(p, ["network", "source", "partner"], "unknown"),
    }
    query = F.coalesce(F.col("query_string"), F.lit(""))
    # Values that both the checks and the stored row use are computed once, in a step of their own.
    df = df.withColumns({
        "_click_id": sanitize(texts["click_id"], limits.click_id),
        "_status": sanitize(texts["status"], limits.status),
        "_payout": number_prefix(first_filled(p, ["payout", "amount", "revenue", "commission"], "0")),
        "_country": sanitize(texts["country_code"], limits.country_code),
        "_key": F.coalesce(F.col("api_key"), p["api_key"]),
        "_signature": F.coalesce(p["signature"], F.col("signature"), F.lit("")),
    })
    click_id, status, payout, country = (F.col(c) for c in ("_click_id", "_status", "_payout", "_country"))
    reason = F.when(~in_any_cidr(F.col("client_ip"), config.allowlist), "ip_not_allowed")
    if config.api_key is not None:
        wrong = is_blank_or_zero(F.col("_key")) | (F.col("_key") != config.api_key)
        reason = reason.when(wrong, "invalid_api_key")
    signed = hmac_ok(F.col("_signature"), click_id, country, payout, status, config.hmac_secret)
    reason = reason.when(~signed, "invalid_signature").when(is_blank_or_zero(click_id), "missing_click_id")
    fields = {
        "status": status,
        "country_code": norm_country(country),
        "traffic_type": sanitize(texts["traffic_type"], limits.traffic_type),
        "payout": money(payout),
        "click_id": click_id,
        "network": sanitize(texts["network"], limits.network),
        "ip_address": F.col("client_ip"),
        "query_string": first_bytes(query, limits.query_bytes),
    }
    cuts = {**_cut_texts(texts, limits), "payout": cut_money(payout), "query_string": cut_bytes(query, limits.query_bytes)}
    return _finish(df, fields, reason, limits, cuts)


def _flexible(df: DataFrame, limits: Limits) -> DataFrame:
    p = F.col("params")
    texts = {
        "country_code": first_filled(p, ["country", "c", "geo", "country_code", "cc"], ""),
        "traffic_type": first_filled(p, ["device", "d", "traffic_type", "type", "t", "dt"], ""),
        "click_id": first_filled(p, ["click_id", "cid", "clickid", "transaction_id", "txid"], None),
        "status": first_filled(p, ["status", "s", "state", "st"], "confirmed"),
        "network": first_filled(p, ["network", "source", "src", "net"], "unknown"),
    }
    digits = F.regexp_replace(first_filled(p, ["payout", "p", "revenue", "amount", "rev", "a"], "0.00"), "[^0-9.]", "")
    filled = (F.octet_length("body") > 0) & (F.col("body") != "0")
    long_body = cut_bytes(F.col("body"), limits.logged_body_bytes)
    body = F.when(filled & ~long_body, F.concat(F.lit(" | BODY: "), "body"))
    df = df.withColumns({
        "_country": ascii_upper(sanitize(texts["country_code"], limits.country_code)),
        "_kind": ascii_upper(sanitize(texts["traffic_type"], limits.traffic_type)),
        "_payout": number_prefix(digits),
        "_click_id": sanitize(texts["click_id"], limits.click_id),
        "_line": F.concat(
            F.lit("METHOD="), F.coalesce(F.col("method"), F.lit("GET")), F.lit(" | "),
            F.coalesce(F.col("query_string"), F.lit("")), F.coalesce(body, F.lit(""))),
    })
    country, kind, payout, click_id = (F.col(c) for c in ("_country", "_kind", "_payout", "_click_id"))
    fields = {
        "status": sanitize(texts["status"], limits.status),
        "country_code": country,
        "traffic_type": kind,
        "payout": money(payout),
        "click_id": click_id,
        "network": sanitize(texts["network"], limits.network),
        "ip_address": F.coalesce(F.col("client_ip"), F.lit("unknown")),
        "query_string": first_bytes(F.col("_line"), limits.query_bytes),
    }
    cuts = {**_cut_texts(texts, limits), "payout": cut_money(payout), "body": filled & long_body,
            "query_string": cut_bytes(F.col("_line"), limits.query_bytes)}
    useful = (country != "") | (kind != "") | (payout > 0) | click_id.isNotNull()
    return _finish(df, fields, F.when(~useful, "no_data"), limits, cuts)


def _tracking(df: DataFrame, limits: Limits) -> DataFrame:
    p = F.col("params")
    texts = {
        "status": first_present(p, ["status"], "unknown"),
        "country_code": first_present(p, ["country", "country_code"], "XX"),
        "traffic_type": first_present(p, ["traffic_type", "device"], "unknown"),
        "click_id": first_present(p, ["click_id", "cid"], ""),
    }
    network = first_present(p, ["network"], "unknown")
    df = df.withColumns({
        "_status": sanitize(texts["status"], limits.status),
        "_country": ascii_upper(sanitize(texts["country_code"], limits.country_code)),
        "_kind": sanitize(texts["traffic_type"], limits.traffic_type),
        "_payout": number_prefix(first_present(p, ["payout"], "0")),
    })
    status, country, kind, payout = (F.col(c) for c in ("_status", "_country", "_kind", "_payout"))
    reason = (
        F.when((status == "") | (country == "") | (kind == ""), "missing_fields")
        .when((payout < 0) | (payout > MAX_PAYOUT), "invalid_payout")
    )
    fields = {
        "status": status,
        "country_code": country,
        "traffic_type": kind,
        "payout": money(payout),
        "click_id": empty_to_null(sanitize(texts["click_id"], limits.click_id)),
        "network": sanitize(network, limits.tracked_network),
        "ip_address": F.coalesce(F.col("client_ip"), F.lit("127.0.0.1")),
        "query_string": to_query_string(p),
    }
    cuts = {**_cut_texts(texts, limits), "network": cut_chars(network, limits.tracked_network), "payout": cut_money(payout)}
    return _finish(df, fields, reason, limits, cuts)
