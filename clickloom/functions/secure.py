"""Hashes and signatures, all JVM-side."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions.numbers import float_text
from clickloom.functions.web import form_encode

_BLOCK = 64


def hash_ip(ip: Column, salt: str, chars: int = 16) -> Column:
    """Pseudonym of an address: the first hex digits of SHA-256 over address and salt."""
    return F.substring(F.sha2(F.concat(ip, F.lit(salt)).cast("binary"), 256), 1, chars)


def _joined(*cols: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cols])


def request_fingerprint(ip: Column, ua: Column) -> Column:
    return F.md5(_joined(ip, ua).cast("binary"))


def session_fingerprint(ua: Column, language: Column, encoding: Column) -> Column:
    return F.sha2(_joined(ua, language, encoding).cast("binary"), 256)


def hmac_sha256(message: Column, secret: str) -> Column:
    """HMAC as two nested digests over the padded key, so no Python runs per row."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    key = key.ljust(_BLOCK, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in key))
    inner = F.unhex(F.sha2(F.concat(inner_pad, message.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def signature_payload(click_id: Column, country: Column, payout: Column, status: Column) -> Column:
    """Form-encoded fields in key order."""
    pairs = [("click_id", click_id), ("country", country), ("payout", float_text(payout)), ("status", status)]
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), form_encode(v)) for k, v in pairs])


def hmac_ok(
    signature: Column, click_id: Column, country: Column, payout: Column, status: Column, secret: str
) -> Column:
    """True when the signature fits, or when no secret is configured."""
    if not secret:
        return F.lit(True)
    expected = hmac_sha256(signature_payload(click_id, country, payout, status), secret)
    return F.coalesce(signature == expected, F.lit(False))
