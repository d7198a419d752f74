"""Device classes from user agents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions.text import ascii_lower, sanitize

# User-agent patterns, tried in this order.
BOT_PATTERN = r"(?i)bot|crawl|spider|facebook|whatsapp|telegram"
TABLET_PATTERN = r"(?i)tablet|ipad"
MOBILE_PATTERN = r"(?i)mobile|android|iphone|ipod|blackberry|iemobile|opera mini|windows phone"


def device(ua: Column) -> Column:
    """WAP, WEB, TABLET or BOT. A client may send the class itself instead of a user agent."""
    ua = F.coalesce(ua, F.lit(""))
    word = ascii_lower(ua)
    return (
        F.when(word.isin("wap", "mobile"), "WAP")
        .when(word.isin("", "web", "desktop"), "WEB")
        .when(word == "tablet", "TABLET")
        .when(ua.rlike(BOT_PATTERN), "BOT")
        .when(ua.rlike(TABLET_PATTERN), "TABLET")
        .when(ua.rlike(MOBILE_PATTERN), "WAP")
        .otherwise("WEB")
    )


def client_device(ua: Column, override: Column | None = None) -> Column:
    """Landing-page variant: lower case, tablets count as phones, a valid override wins."""
    clean = sanitize(F.coalesce(ua, F.lit("")), 500)
    found = (
        F.when(clean.rlike(BOT_PATTERN), "bot")
        .when(clean.rlike(TABLET_PATTERN) | clean.rlike(MOBILE_PATTERN), "wap")
        .otherwise("web")
    )
    if override is None:
        return found
    word = ascii_lower(override)
    wanted = F.when(word == "mobile", "wap").when(word == "desktop", "web").otherwise(word)
    return F.when(wanted.isin("wap", "web", "bot"), wanted).otherwise(found)
