"""Decision requests: JSON bodies and query parameters to clean typed rows.

Both readers keep every input row and add ``reject_reason``; ``accepted`` and ``quarantined`` split on it. ``Limits`` has the
bounds of all values, and tells on demand which ones were cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.net import NO_ADDRESS, is_ip
from clickloom.functions.text import ascii_upper, keep_id_chars, keep_letters, sanitize
from clickloom.plans.barrier import computed_once
from clickloom.sources.limits import Limits, cut_chars, cut_fields
from clickloom.sources.params import first_present

_BODY = (
    "click_id string, country_code string, user_agent string, ip_address string, user_lp string, _unreadable string"
)
REQUEST_COLUMNS = ["click_id", "country_code", "user_agent", "ip_address", "user_lp"]


def _clean(fields: dict[str, Column], limits: Limits) -> dict[str, Column]:
    clean = {
        "click_id": keep_id_chars(sanitize(fields["click_id"], limits.click_id)),
        "country_code": ascii_upper(keep_letters(sanitize(fields["country_code"], limits.country_code))),
        "user_agent": sanitize(fields["user_agent"], limits.user_agent),
        "ip_address": sanitize(fields["ip_address"], limits.ip_address),
        "user_lp": keep_id_chars(sanitize(fields["user_lp"], limits.user_lp)),
    }
    if limits.report:
        clean["cut_fields"] = cut_fields({c: cut_chars(fields[c], getattr(limits, c)) for c in REQUEST_COLUMNS})
    return clean


def ingest_decisions(raw: DataFrame, body: str = "body", content_type: str | None = None,
                     limits: Limits = Limits()) -> DataFrame:
    """Requests from JSON bodies. A body that is not JSON, or too long, counts as empty and so lacks its address."""
    fits = F.lit(True) if limits.body_bytes is None else F.octet_length(body) <= limits.body_bytes
    readable = fits
    if content_type is not None:
        readable = readable & F.coalesce(F.col(content_type).contains("application/json"), F.lit(False))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unreadable"}
    parsed = raw.withColumn("_in", F.from_json(F.when(readable, F.col(body)), _BODY, options))
    whole = F.col("_in._unreadable").isNull()
    defaults = dict.fromkeys(REQUEST_COLUMNS, "") | {"country_code": "XX"}
    fields = {c: F.coalesce(F.when(whole, F.col(f"_in.{c}")), F.lit(d)) for c, d in defaults.items()}
    out = parsed.withColumns(_clean(fields, limits)).drop("_in")
    reason = _address_reason(F.col("ip_address"))
    if limits.report:
        reason = F.when(~fits, "body_too_long").otherwise(reason)
    return out.select("*", computed_once(reason).alias("reject_reason"))


def ingest_external(df: DataFrame, params: str = "params", client_address: str | None = None,
                    limits: Limits = Limits()) -> DataFrame:
    """Requests from query parameters and their aliases; a missing address falls back to the client's own."""
    p = F.col(params)
    fields = {
        "click_id": first_present(p, ["click_id", "cid"], ""),
        "country_code": first_present(p, ["country_code", "country", "cc"], ""),
        "user_agent": first_present(p, ["user_agent", "device", "ua"], ""),
        "ip_address": first_present(p, ["ip_address", "ip"], ""),
        "user_lp": first_present(p, ["user_lp", "lp", "campaign"], ""),
    }
    clean = _clean(fields, limits)
    own = F.col(client_address) if client_address is not None else F.lit(NO_ADDRESS)
    clean["ip_address"] = F.when(clean["ip_address"] == "", own).otherwise(clean["ip_address"])
    out = df.withColumns(clean)
    return out.select("*", computed_once(_address_reason(F.col("ip_address"))).alias("reject_reason"))


def _address_reason(ip: Column) -> Column:
    return F.when(F.coalesce(ip, F.lit("")) == "", "missing_ip").when(~is_ip(ip), "invalid_ip")


def accepted(df: DataFrame) -> DataFrame:
    return df.where("reject_reason is null").drop("reject_reason")


def quarantined(df: DataFrame) -> DataFrame:
    return df.where("reject_reason is not null")
