"""Text cleaning and validation expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters stripped from both ends, and the control characters dropped.
TRIM_CHARS = " \t\n\r\0\x0b"
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ALL_CONTROL_CHARS = r"[\x00-\x1F\x7F]"
UNSAFE_FILE_CHARS = r'[<>:"|?*]'

# (?d) limits "end of input" to a trailing newline, as in PCRE.
PATTERNS = {
    "alphanumeric": r"(?d)^[a-zA-Z0-9]+$",
    "slug": r"(?d)^[a-z0-9_-]+$",
    "alpha": r"(?d)^[a-zA-Z]+$",
    "config_key": r"(?d)^[A-Z_][A-Z0-9_]*$",
    "integer": r"\A(?:0|-?[1-9][0-9]*)\z",
    "email": (
        r"\A(?=[^@]{1,64}@)[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
        r"@(?=.{1,253}\z)(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+"
        r"[A-Za-z](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\z"
    ),
}

# The script patterns a markup scan looks for. The lookahead is an ASCII word boundary.
MARKUP_PATTERNS = {
    "script_tag": r"(?i)<script(?![A-Za-z0-9_])",
    "javascript_url": r"(?i)javascript:",
    "event_handler": r"(?i)on[A-Za-z0-9_]+\s*=",
    "iframe_tag": r"(?i)<iframe(?![A-Za-z0-9_])",
    "object_tag": r"(?i)<object(?![A-Za-z0-9_])",
    "embed_tag": r"(?i)<embed(?![A-Za-z0-9_])",
    "vbscript_url": r"(?i)vbscript:",
    "data_html_url": r"(?i)data:text/html",
}


def trimmed(c: Column) -> Column:
    """Strip space, tab, newline, carriage return, NUL and vertical tab (SQL trim strips spaces only)."""
    return F.btrim(c, F.lit(TRIM_CHARS))


def cleaned(c: Column) -> Column:
    """Trim, drop control characters."""
    return F.regexp_replace(trimmed(c), CONTROL_CHARS, "")


def sanitize(c: Column, max_chars: int | None) -> Column:
    """Trim, drop control characters, keep the first ``max_chars`` characters (all for None)."""
    return cleaned(c) if max_chars is None else F.substring(cleaned(c), 1, max_chars)


def single_line(c: Column, max_chars: int = 255) -> Column:
    """Turn line breaks and tabs into spaces, then sanitize."""
    return sanitize(F.translate(c, "\r\n\t", "   "), max_chars)


def safe_file_name(c: Column, max_chars: int = 255) -> Column:
    """Delete path separators, ``..``, control and reserved characters."""
    parts = F.replace(F.translate(c, "/\\", ""), F.lit(".."), F.lit(""))
    clean = F.regexp_replace(F.regexp_replace(parts, ALL_CONTROL_CHARS, ""), UNSAFE_FILE_CHARS, "")
    return F.substring(trimmed(clean), 1, max_chars)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def keep_id_chars(c: Column) -> Column:
    """Identifier characters only: letters, digits, underscore, hyphen."""
    return F.regexp_replace(c, "[^a-zA-Z0-9_-]", "")


def keep_letters(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z]", "")


def first_bytes(c: Column, n: int | None) -> Column:
    """First ``n`` bytes of the UTF-8 text (all for None); a character cut in half becomes the replacement character."""
    if n is None:
        return c
    cut = F.substring(c.cast("binary"), 1, n).cast("string")
    return F.when(F.octet_length(c) <= n, c).otherwise(F.make_valid_utf8(cut))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_blank_or_zero(c: Column) -> Column:
    """True where the text counts as empty: missing, '' or '0'."""
    return c.isNull() | c.isin("", "0")


def matches(c: Column, pattern: str) -> Column:
    """Named pattern of ``PATTERNS``, or a regular expression of the caller's own."""
    return F.coalesce(c.rlike(PATTERNS.get(pattern, pattern)), F.lit(False))


def is_single_line(c: Column) -> Column:
    return ~c.rlike(r"[\r\n\t]")


def is_file_name(c: Column) -> Column:
    return ~(c.contains("..") | c.rlike(r'[/\\<>:"|?*\x00-\x1F\x7F]'))


def is_email(c: Column) -> Column:
    """Dot-atom local part of at most 64 characters at a dotted host name whose last label starts with a letter."""
    return matches(c, "email")


def clean_email(c: Column) -> Column:
    """Trim, delete characters no address can hold; null when the rest is not an address."""
    kept = F.regexp_replace(trimmed(c), r"[^A-Za-z0-9!#$%&'*+/=?^_`{|}~@.\[\]-]", "")
    return F.when(is_email(kept), kept)


def is_date(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """The text survives parsing and formatting unchanged."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit(pattern)), pattern) == c, F.lit(False))


def to_boolean(c: Column) -> Column:
    """Numbers: nonzero after dropping decimals. Text: true, yes, 1, on. Everything else is false."""
    from clickloom.functions.numbers import is_number, number_prefix

    word = ascii_lower(trimmed(c)).isin("true", "yes", "1", "on")
    return F.when(c.isNull(), False).when(is_number(c), F.abs(number_prefix(c)) >= 1).otherwise(word)
