"""URL expressions.

Accepted URL grammar: printable ASCII URL characters only; a scheme; for http and https an authority whose host is a
dotted name of letters, digits and inner hyphens (or a bracketed IPv6 address), with optional user info and port;
for other schemes any non-empty authority; mailto, news and file need none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.geo import is_country
from clickloom.functions.net import is_blocked
from clickloom.functions.numbers import money_text
from clickloom.functions.text import ascii_lower, ascii_upper, trimmed

MAX_URL_BYTES = 2048
FALLBACK_PATH = "/_meetups/?"

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_USER = r"(?:[A-Za-z0-9._~!$&'()*+,;=%-]+(?::[A-Za-z0-9._~!$&'()*+,;=%:-]*)?@)?"
_PORT = r"(?::[0-9]{1,5})?"
_REST = r"(?:[/?#].*)?"
_CHARS = r"[A-Za-z0-9$\-_.+!*'(),{}|\\^~\[\]`<>#%\";/?:@&=]"

URL_PATTERN = (
    rf"\A(?={_CHARS}+\z)(?:"
    rf"[hH][tT][tT][pP][sS]?://{_USER}(?:{_LABEL}(?:\.{_LABEL})*\.?|\[[0-9A-Fa-f:.]+\]){_PORT}{_REST}"
    rf"|(?![hH][tT][tT][pP][sS]?:)[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+{_REST}"
    r"|(?:mailto|news|file):.+"
    r")\z"
)


def valid_url(c: Column, https_only: bool = False) -> Column:
    ok = F.coalesce(c.rlike(URL_PATTERN), F.lit(False))
    return ok & c.startswith("https:") if https_only else ok


def valid_url_text(url: str) -> bool:
    """The same test for a configured URL."""
    return re.match(URL_PATTERN.replace(r"\z", r"\Z"), url) is not None


def clean_url(c: Column, https_only: bool = False) -> Column:
    return F.when(valid_url(trimmed(c), https_only), trimmed(c))


def url_host(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("HOST"))


def form_encode(c: Column) -> Column:
    """Form encoding: space becomes plus, everything but letters, digits, ``-_.`` is escaped."""
    return F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A"))


def percent_encode(c: Column) -> Column:
    """RFC 3986 encoding: letters, digits and ``-_.~`` stay."""
    spaced = F.replace(form_encode(c), F.lit("+"), F.lit("%20"))
    return F.replace(spaced, F.lit("%7E"), F.lit("~"))


def url_list(c: Column) -> Column:
    """A JSON array of URLs, or a single one, to the array of its valid members."""
    text = F.coalesce(c, F.lit(""))
    parsed = F.from_json(text, "array<string>")
    many = F.when(text == "", F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(text)))
    return F.filter(many, lambda u: valid_url(u))


def fallback_url(click_id: Column, country: Column, device: Column, ip: Column, user_lp: Column) -> Column:
    fields = [
        ("click_id", ascii_lower(click_id)),
        ("country_code", ascii_lower(country)),
        ("user_agent", ascii_lower(device)),
        ("ip_address", ip),
        ("user_lp", ascii_lower(user_lp)),
    ]
    pairs = [F.concat(F.lit(f"{name}="), percent_encode(F.coalesce(c, F.lit("")))) for name, c in fields]
    return F.concat(F.lit(FALLBACK_PATH), F.concat_ws("&", *pairs))


def render_url(template: Column, country: Column, traffic_type: Column, payout: Column) -> Column:
    """Outgoing postback URL; null when the country or the finished URL is not valid."""
    url = template
    for name, value in (
        ("{country}", form_encode(ascii_upper(country))),
        ("{traffic_type}", form_encode(traffic_type)),
        ("{payout}", money_text(payout)),
    ):
        url = F.replace(url, F.lit(name), value)
    return F.when(is_country(country) & valid_url(url), url)


def render_forward_url(
    template: Column, click_id: Column, status: Column, payout_text: Column, country: Column, device: Column
) -> Column:
    """Forwarding template of a received postback: the values go in as they are."""
    url = template
    for name, value in (
        ("{click_id}", click_id), ("{status}", status), ("{payout}", payout_text),
        ("{country}", country), ("{device}", device),
    ):
        url = F.replace(url, F.lit(name), value)
    return url


def success_flag(transport_ok: Column, code: Column) -> Column:
    return F.coalesce(transport_ok & (code >= 200) & (code < 300), F.lit(False))


def check_redirect_urls(df: DataFrame, dns: DataFrame, url: str = "url") -> DataFrame:
    """Reject reason per redirect URL, null when it may be used.

    ``dns`` holds (host, ip) answers and is folded to one row per host before the join. Hosts without an answer pass.
    """
    from clickloom.plans.lookup import lookup_join

    answers = dns.groupBy("host").agg(F.bool_or(is_blocked(F.col("ip"))).alias("_blocked"))
    u = trimmed(F.col(url))
    host = url_host(u)
    joined = lookup_join(df.withColumn("host", host), answers, "host")
    reason = (
        F.when(u == "", None)
        .when(~valid_url(u), "invalid_format")
        .when(~u.startswith("https:"), "not_https")
        .when(~F.coalesce(F.col("host").rlike(r"(?d)(?i)^[a-z0-9.-]+$"), F.lit(False)), "invalid_host")
        .when(F.coalesce(F.col("_blocked"), F.lit(False)), "blocked_address")
        .when(F.octet_length(u) > MAX_URL_BYTES, "too_long")
    )
    return joined.withColumn("reject_reason", reason).drop("_blocked")
