"""Widths and sizes that readers cut values to, in one place, and which values of a row were cut."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions.numbers import MAX_MONEY
from clickloom.functions.text import cleaned


@dataclass(frozen=True)
class Limits:
    """Longest values that are kept whole: characters of fields, bytes of bodies and query strings; None has no bound.

    With ``report`` the readers tell what the bounds did: rows get ``cut_fields``, the sorted names of the fields that
    lost something, and a request body over its bound is rejected as ``body_too_long``, not for want of an address.
    """

    body_bytes: int | None = 10240
    click_id: int | None = 100
    country_code: int | None = 10
    user_agent: int | None = 500
    ip_address: int | None = 45
    user_lp: int | None = 100
    status: int | None = 50
    traffic_type: int | None = 50
    network: int | None = 50
    tracked_network: int | None = 100
    query_bytes: int | None = 500
    logged_body_bytes: int | None = 999
    report: bool = False

    def reported(self) -> Limits:
        return replace(self, report=True)


UNLIMITED = Limits(**{f.name: None for f in fields(Limits) if f.name != "report"})


def cut_chars(value: Column, bound: int | None) -> Column:
    """The cleaned text is longer than its bound."""
    return F.lit(False) if bound is None else F.length(cleaned(value)) > bound


def cut_bytes(value: Column, bound: int | None) -> Column:
    return F.lit(False) if bound is None else F.octet_length(value) > bound


def cut_money(value: Column) -> Column:
    """The amount does not fit the stored decimal and is kept as the largest one."""
    return F.abs(value) > float(MAX_MONEY)


def cut_fields(cuts: dict[str, Column]) -> Column:
    """Names of the conditions that hold, sorted; an empty array where none does."""
    return F.filter(F.array(*(F.when(cuts[name], F.lit(name)) for name in sorted(cuts))), F.isnotnull)
