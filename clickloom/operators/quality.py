"""Whole-table validation jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.text import MARKUP_PATTERNS

# JSON value types by the name a schema uses for them.
_JSON_TYPES = {
    "string": r"^STRING",
    "int": r"^(?:BIGINT|INT|SMALLINT|TINYINT)",
    "float": r"^(?:DOUBLE|FLOAT|DECIMAL)",
    "bool": r"^BOOLEAN",
    "array": r"^(?:ARRAY|OBJECT|STRUCT)",
}


def _passed(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def quality_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows passing and failing each rule (rule, passed, failed), all counted in one scan."""
    names = list(rules)
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(_passed(rules[n])).alias(f"r{i}") for i, n in enumerate(names)])
    lines = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("passed"), (F.col("total") - F.col(f"r{i}")).alias("failed"))
        for i, n in enumerate(names)])
    return counts.select(F.inline(lines))


def failing_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that fail any rule, with the names of those rules."""
    names = F.array(*[F.when(~_passed(rule), F.lit(n)) for n, rule in rules.items()])
    return df.withColumn("failed_rules", F.array_compact(names)).where(F.size("failed_rules") > 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def scan_markup(df: DataFrame, column: str) -> DataFrame:
    """Adds one flag per script pattern and ``suspicious`` for any of them. Missing text has no hit."""
    flags = {f"has_{n}": _passed(F.col(column).rlike(p)) for n, p in MARKUP_PATTERNS.items()}
    found = F.lit(False)
    for n in flags:
        found = found | F.col(n)
    return df.withColumns(flags).withColumn("suspicious", found)


def markup_report(df: DataFrame, column: str) -> DataFrame:
    """Rows with and without each script pattern."""
    return quality_report(
        df, {n: ~_passed(F.col(column).rlike(p)) for n, p in MARKUP_PATTERNS.items()}
    ).select(F.col("rule").alias("pattern"), F.col("failed").alias("hits"), F.col("passed").alias("clean"))


def check_schema(
    df: DataFrame, column: str, types: dict[str, str], required: Sequence[str] = ()
) -> DataFrame:
    """Adds ``schema_ok`` for a JSON text column: required keys exist, typed keys are non-null and of their type."""
    doc = F.try_parse_json(F.col(column))
    ok = doc.isNotNull()
    for key in required:
        ok = ok & F.try_variant_get(doc, _path(key), "variant").isNotNull()
    for key, kind in types.items():
        value = F.try_variant_get(doc, _path(key), "variant")
        ok = ok & F.coalesce(F.schema_of_variant(value).rlike(_JSON_TYPES[kind]), F.lit(False))
    return df.withColumn("schema_ok", ok)


def _path(key: str) -> str:
    return f"$['{key}']"


def has_filled(params: Column, keys: Sequence[str]) -> Column:
    """All keys of a parameter map are present and not empty."""
    ok = F.lit(True)
    for key in keys:
        ok = ok & F.coalesce(params[key] != "", F.lit(False))
    return ok
