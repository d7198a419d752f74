"""Query strings and form bodies as maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions.text import empty_to_null
from clickloom.functions.web import form_encode


def query_params(get_qs: Column, post_qs: Column | None = None) -> Column:
    """Decoded parameters of a query string and a form body. The last value of a name wins, the body over the query.

    Dots and spaces in names become underscores, as form parsers of the web tier do.
    """
    text = F.concat_ws("&", empty_to_null(get_qs), *([empty_to_null(post_qs)] if post_qs is not None else []))
    pairs = F.filter(F.split(text, "&"), lambda p: (p != "") & ~p.startswith("="))

    def decoded(part: Column) -> Column:
        escaped = part.contains("%") | part.contains("+")
        return F.when(escaped, F.coalesce(F.try_url_decode(part), part)).otherwise(part)

    def name(pair: Column) -> Column:
        return F.translate(decoded(F.substring_index(pair, "=", 1)), ". ", "__")

    def value(pair: Column) -> Column:
        return F.when(pair.contains("="), decoded(_after_equals(pair))).otherwise("")

    # Reversed, so that the first entry of a name is the one that wins.
    found = F.struct(F.reverse(F.transform(pairs, name)).alias("names"), F.reverse(F.transform(pairs, value)).alias("values"))

    def as_map(e: Column) -> Column:
        names, values = e["names"], e["values"]
        unique = F.array_distinct(names)
        winners = F.transform(unique, lambda n: F.get(values, (F.array_position(names, n) - 1).cast("int")))
        return F.when(F.size(unique) == F.size(names), F.map_from_arrays(names, values)).otherwise(
            F.map_from_arrays(unique, winners))

    # The one-element array binds the decoded entries once, however often they are used.
    return F.get(F.transform(F.array(found), as_map), F.lit(0))


def _after_equals(pair: Column) -> Column:
    return F.substr(pair, F.instr(pair, "=") + 1)


def first_filled(params: Column, names: Sequence[str], default: str | None) -> Column:
    """First of the names with a value that is neither missing nor empty."""
    return F.coalesce(*[empty_to_null(params[n]) for n in names], F.lit(default))


def first_present(params: Column, names: Sequence[str], default: str | None) -> Column:
    """First of the names that is present, even when its value is empty."""
    return F.coalesce(*[params[n] for n in names], F.lit(default))


def to_query_string(params: Column) -> Column:
    """Parameters back as a form-encoded string."""
    pairs = F.transform(
        F.map_entries(params), lambda e: F.concat(form_encode(e["key"]), F.lit("="), form_encode(e["value"])))
    return F.array_join(pairs, "&")
