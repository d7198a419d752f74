"""Country code expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.text import ascii_upper, trimmed

UNKNOWN_COUNTRY = "XX"


# Lists of more codes than this are not broadcast.
_MAX_CODES = 10_000


@cache
def country_codes() -> tuple[str, ...]:
    """Assigned ISO 3166-1 alpha-2 codes, as the JVM's locale data lists them, plus the unknown code."""
    locale = SparkSession.active()._jvm.java.util.Locale
    return tuple(sorted({*locale.getISOCountries(), UNKNOWN_COUNTRY}))


def is_country(c: Column) -> Column:
    return F.coalesce(ascii_upper(c).isin(*country_codes()), F.lit(False))


def norm_country(c: Column) -> Column:
    """The code itself, or the unknown code when it is not a listed one (also for cut full names)."""
    return F.when(is_country(c), c).otherwise(F.lit(UNKNOWN_COUNTRY))


def country_allowed(c: Column, mode: str, codes: Sequence[str]) -> Column:
    """Whitelist admits the listed codes, blacklist all others, any other mode everything."""
    listed = [x.upper() for x in codes]
    inside = F.coalesce(ascii_upper(c).isin(listed), F.lit(False)) if listed else F.lit(False)
    if mode == "whitelist":
        return inside
    if mode == "blacklist":
        return ~inside
    return F.lit(True)


def countries_allowed(df: DataFrame, column: str, mode: str, codes: DataFrame) -> DataFrame:
    """Rows that a list in a table (its first column) admits, by the same rules: an empty whitelist admits none, an
    empty blacklist all; a missing country is in no list. The list is folded to distinct codes before the join."""
    if mode not in ("whitelist", "blacklist"):
        return df
    listed = codes.select(ascii_upper(F.col(codes.columns[0])).alias("_code")).where("_code is not null").distinct()
    side = F.broadcast(listed) if listed.limit(_MAX_CODES + 1).count() <= _MAX_CODES else listed
    return df.join(side, ascii_upper(df[column]) == side["_code"], "left_semi" if mode == "whitelist" else "left_anti")


def country_of(header: Column, param: Column) -> Column:
    """First valid code of the edge header and the query parameter."""
    choices = [ascii_upper(trimmed(c)) for c in (header, param)]
    return F.coalesce(*[F.when(is_country(c), c) for c in choices], F.lit(UNKNOWN_COUNTRY))
