"""Secrets in texts: patterns, and encoded keys and signed tokens that are reported only when their structure holds.

A candidate run of base64 or hex characters, or several on following lines, is decoded and parsed. A private key counts
when its tags and nested lengths fill the bytes exactly and its fields are those of a known key form; a token counts when
its header is a JSON object that names an algorithm. Long random strings and encoded pictures therefore stay unreported.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import math
import re
from collections.abc import Iterator
from itertools import zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import batches

BASE_KINDS = ("assign", "access", "hex")
METHOD_KINDS = ("pem", "key", "jwt")
KINDS = BASE_KINDS + METHOD_KINDS

# The base patterns.
_ASSIGN = re.compile(
    r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN_LENGTH = 6
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

# Candidates of the structural check. The shortest key form has a tag, a length, a version and 16 bytes: 23 bytes, so
# shorter runs hold none.
_LEAST_BASE64, _LEAST_HEX = 31, 46
_BASE64_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{_LEAST_BASE64},}}={{0,2}}")
_HEX_RUN = re.compile(rf"[0-9A-Fa-f]{{{_LEAST_HEX},}}")
_BASE64_TEXT = re.compile(rb"[A-Za-z0-9+/_-]{31,}={0,2}\s*")
# Runs on following lines, also where the break is written out; hex pairs also with colons or spaces between them.
_BREAK = r"(?:\r?\n[\x20\t]*+|(?:\\r)?\\n)"
_BASE64_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_BREAK}[A-Za-z0-9+/_-]++)++={{0,2}}")
_HEX_PAIRS = r"(?:[0-9A-Fa-f]{2})++(?![0-9A-Fa-f])"
_HEX_LINES = re.compile(rf"(?<![0-9A-Fa-f]){_HEX_PAIRS}(?:(?::?{_BREAK}|[:\x20]){_HEX_PAIRS})++")
_BASE64_GAP, _HEX_GAP = re.compile(_BREAK), re.compile(rf":?{_BREAK}|[:\x20]")
_BASE64_HEADS, _HEX_HEADS = ("M", "b3BlbnNzaC1rZXk", "LS0tLS1CRUdJTi"), ("30", "6f70656e7373682d", "2d2d2d2d2d424547")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+)++")
# Text that starts with an opening brace, whatever follows, or one glued to something in front.
_BRACE = re.compile(r"e[w-z0-9_-]")
_LEAST_HEADER = 14  # {"alg":"x"}, ten bytes and more
_GLUED_HEADER = re.compile(r"eyJ|eyAi|ewog|ew0K|ewki")
_HEADER = re.compile(r"(?<![A-Za-z0-9_-])e[w-z0-9_-][A-Za-z0-9_-]*+\.|eyJ|eyAi|ewog|ew0K|ewki")
_PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/=]+")

_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def _parts(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill ``data[start:end]`` exactly, or None. Lengths are the shortest form."""
    found = []
    while start < end:
        if end - start < 2:
            return None
        tag, length, start = data[start], data[start + 1], start + 2
        if length >= 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or end - start < size:
                return None
            length, start = int.from_bytes(data[start:start + size], "big"), start + size
            if length < 0x80 or length >> (8 * (size - 1)) == 0:
                return None
        if length > end - start:
            return None
        found.append((tag, start, start + length))
        start += length
    return found


def _small(data: bytes, part: tuple[int, int, int]) -> int:
    """Value of a one-byte integer, else -1."""
    return data[part[1]] if part[0] == _INTEGER and part[2] - part[1] == 1 else -1


def _der_key(data: bytes) -> bool:
    """A private key in one of the forms RSA (9 integers), DSA (6), elliptic curve, PKCS 8, encrypted PKCS 8."""
    outer = _parts(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    parts = _parts(data, outer[0][1], outer[0][2])
    if not parts or len(parts) < 2:
        return False
    tags, version = [p[0] for p in parts], _small(data, parts[0])
    if tags in ([_INTEGER] * 9, [_INTEGER] * 6):
        return version == 0 and all(p[2] > p[1] for p in parts)
    if version == 1 and tags[1] == _OCTETS and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return parts[1][2] - parts[1][1] >= 16
    if version in (0, 1) and tags[1:3] == [_SEQUENCE, _OCTETS]:
        algorithm = _parts(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == _OID and parts[2][2] - parts[2][1] >= 16
    if tags == [_SEQUENCE, _OCTETS]:
        algorithm = _parts(data, parts[0][1], parts[0][2])
        return bool(algorithm) and [p[0] for p in algorithm] == [_OID, _SEQUENCE] and parts[1][2] - parts[1][1] >= 16
    return False


def _ssh_size(data: bytes | memoryview) -> int:
    """Three length-prefixed names, a key count of at least one, then that many public keys and one private block.

    Their bytes, or 0 for something else.
    """
    magic = b"openssh-key-v1\0"
    if data[:len(magic)] != magic:
        return 0
    at, sizes = len(magic), []

    def skip() -> bool:
        nonlocal at
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        sizes.append(size)
        at += 4 + size
        return True

    if not all(skip() for _ in range(3)):
        return 0
    keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    return at if keys and all(skip() for _ in range(keys + 1)) and sizes[-1] >= 16 else 0


def _from_base64(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _holds_key(data: bytes | None, nested: bool = True) -> bool:
    if not data:
        return False
    if data[0] == _SEQUENCE and _der_key(data) or _ssh_size(data):
        return True
    if nested and b"PRIVATE KEY-----" in data:  # an armoured key that was encoded once more
        try:
            return any(True for _ in _armoured(data.decode("ascii")))
        except UnicodeDecodeError:
            return False
    if nested and _BASE64_TEXT.fullmatch(data):  # a bare one
        return _holds_key(_from_base64(data.decode("ascii").strip()), nested=False)
    return False


def _armoured(text: str):
    """Spans of armoured private keys: matching end line, a body that decodes to a key (or an encrypted body).

    A key ends before the next one begins, so every character is looked at once.
    """
    begins = list(_PEM_BEGIN.finditer(text))
    for begin, following in zip_longest(begins, begins[1:]):
        end_line = f"-----END {begin[1]}PRIVATE KEY-----"
        end = text.find(end_line, begin.end(), following.start() if following else len(text))
        if end < 0:
            continue
        body = text[begin.end():end].replace("\\n", "\n")
        locked = "ENCRYPTED" in begin[0] or "Proc-Type:" in body
        lines = [line for line in body.split("\n") if ":" not in line]
        data = _from_base64(_NOT_BASE64.sub("", "".join(lines)))
        if _holds_key(data, nested=False) or locked and data and len(data) >= 32:
            yield begin.start(), end + len(end_line)


class _Decoded:
    """A run of base64 or hex characters, decoded once for each place in a group where a key may start."""

    def __init__(self, text: str, hexadecimal: bool):
        self.text, self.step, self.lanes = text, 2 if hexadecimal else 4, {}

    def _lane(self, lane: int) -> bytes:
        if lane not in self.lanes:
            part = self.text[lane:]
            if self.step == 2:
                self.lanes[lane] = bytes.fromhex(part[:len(part) // 2 * 2])
            else:
                self.lanes[lane] = _from_base64(part[:-1] if len(part) % 4 == 1 else part) or b""
        return self.lanes[lane]

    def _first(self, start: int) -> int:
        return start // self.step * (1 if self.step == 2 else 3)

    def between(self, start: int, end: int) -> bytes:
        size = (end - start) // 2 if self.step == 2 else (end - start) * 6 // 8
        first = self._first(start)
        return self._lane(start % self.step)[first:first + size]

    def width(self, size: int) -> int:
        """Characters that hold so many bytes."""
        return size * 2 if self.step == 2 else (size * 8 + 5) // 6

    def key_size(self, start: int) -> int:
        """Bytes of the key that starts here by its head, 0 if none does."""
        data, at = self._lane(start % self.step), self._first(start)
        head = data[at:at + 12]
        if head[:1] == b"\x30" and len(head) > 5:
            size = head[1] & 0x7F if head[1] >= 0x80 else 0
            return 2 + size + (int.from_bytes(head[2:2 + size], "big") if size else head[1]) if size <= 4 else 0
        if head.startswith(b"open"):
            return _ssh_size(memoryview(data)[at:])
        if head.startswith(b"-----B"):
            following = data.find(b"-----BEGIN ", at + 1)
            body = data[at:following if following >= 0 else len(data)]
            span = next(_armoured(body.decode("latin-1")), None)
            return span[1] if span and span[0] == 0 else 0
        return 0


def _wrapped(text: str, chain: re.Match, gap: re.Pattern, hexadecimal: bool) -> Iterator[tuple[int, int]]:
    """Spans of keys from the start of one run to the end of a later one."""
    at, runs = chain.start(), []
    for g in gap.finditer(text, chain.start(), chain.end()):
        runs.append((at, g.start()))
        at = g.end()
    runs.append((at, chain.end()))
    joined = "".join(text[a:b] for a, b in runs).rstrip("=")
    starts, ends, size = [], {}, 0
    for k, (a, b) in enumerate(runs):
        starts.append(size)
        size = min(size + b - a, len(joined))
        ends[size] = k
    heads = _HEX_HEADS if hexadecimal else _BASE64_HEADS

    whole, done = _Decoded(joined, hexadecimal), 0
    for k, start in enumerate(starts):
        if start < done or not joined[start:start + 16].lower().startswith(heads) and not joined.startswith(heads, start):
            continue
        need = whole.key_size(start)
        end = start + whole.width(need)
        if need and end not in ends:  # the line break behind an armoured key
            end = next((e for e in (end + n for n in range(1, 5))
                        if e in ends and not whole.between(start, e)[need:].strip()), 0)
        if need and ends.get(end, -1) > k and _holds_key(whole.between(start, end)):
            done = end
            yield runs[k][0], runs[ends[end]][1]


def _glued(run: str) -> Iterator[tuple[int, int]]:
    """Spans of keys in a run of which a path before or behind is a part, as its slashes are base64 characters too."""
    text = run.rstrip("=")
    whole, done = _Decoded(text, False), 0
    for start in [0, *(m.end() for m in re.finditer("/", text))]:
        if start < done or not text.startswith(_BASE64_HEADS, start):
            continue
        need = whole.key_size(start)
        end = start + whole.width(need)
        if need and (end == len(text) or text[end:end + 1] == "/") and _holds_key(whole.between(start, end)):
            done = end
            yield start, len(run) if end == len(text) else end


def _json_object(segment: str) -> dict | None:
    data = _from_base64(segment)
    try:
        found = json.loads(data) if data and data[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _header(piece: str) -> tuple[int, dict | None]:
    """Where a header that names an algorithm starts in the segment, and the header."""
    if len(piece) < _LEAST_HEADER:
        return 0, None
    glued = _GLUED_HEADER.search(piece)
    for head in dict.fromkeys([0 if _BRACE.match(piece) else -1, glued.start() if glued else -1]):
        header = _json_object(piece[head:]) if head >= 0 else None
        if header and isinstance(header.get("alg"), str):
            return head, header
    return 0, None


def _tokens(text: str):
    """Spans of signed tokens (three segments) and encrypted ones (five), by their decoded headers."""
    for chain in _DOTTED.finditer(text):
        pieces, offsets, at = chain[0].split("."), [], chain.start()
        for piece in pieces:
            offsets.append(at)
            at += len(piece) + 1
        k = 0
        while k + 2 < len(pieces):
            head, header = _header(pieces[k])
            size = 0
            if header:
                if "enc" in header and k + 4 < len(pieces) and all(pieces[k + i] for i in (2, 3, 4)):
                    size = 5
                elif _json_object(pieces[k + 1]) is not None and (pieces[k + 2] or header["alg"] == "none"):
                    size = 3
            if size:
                yield offsets[k] + head, offsets[k + size - 1] + len(pieces[k + size - 1])
            k += size or 1


def _meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the sorted, separate spans overlaps."""
    k = bisect.bisect_right(spans, (start, math.inf))
    return k > 0 and spans[k - 1][1] > start or k < len(spans) and spans[k][0] < end


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans by start, then kind. Offsets count code points, ends are exclusive."""
    spans = []
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= _ASSIGN_LENGTH]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    armoured = list(_armoured(text)) if "PRIVATE KEY-----" in text else []
    spans += [("pem", *span) for span in armoured]
    for m in _BASE64_RUN.finditer(text):
        if _meets(armoured, *m.span()):
            continue
        if _holds_key(_from_base64(m[0])):
            spans.append(("key", *m.span()))
        elif "/" in m[0]:
            spans += [("key", m.start() + a, m.start() + b) for a, b in _glued(m[0])]
    for m in _HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and _holds_key(bytes.fromhex(m[0])):
            spans.append(("key", *m.span()))
    for pattern, gap, least in ((_BASE64_LINES, _BASE64_GAP, _LEAST_BASE64), (_HEX_LINES, _HEX_GAP, _LEAST_HEX)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least:
                spans += [("key", *span) for span in _wrapped(text, m, gap, pattern is _HEX_LINES)
                          if not _meets(armoured, *span)]
    if _HEADER.search(text):
        spans += [("jwt", *span) for span in _tokens(text)]
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _row(text: str) -> dict:
    return {"spans": [{"kind": k, "start": s, "end": e} for k, s, e in scan_text(text)]}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end) of every document, without a shuffle.

    One row per input row: repeated rows stay repeated, a null or empty text has no spans, a null id stays null. Spans
    of different kinds may overlap. Texts are read whole, in linear time.
    """
    return batches.texts(docs, id_col, text_col).mapInArrow(
        batches.per_text(_row, "spans spans"), f"doc_id bigint, spans {batches.SPANS}")


def _redacted(text: str) -> dict:
    out, at = [], 0
    for kind, start, end in scan_text(text):
        if end <= at:
            continue
        out += [text[at:max(start, at)], f"[{kind} removed]"] if start >= at else []
        at = end
    return {"clean": "".join([*out, text[at:]])}


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with each secret replaced by ``[kind removed]``; overlapping ones by one mark.

    A null text stays null. Only documents with a secret change.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def clean(column):
        return column.map(lambda text: text if text is None else _redacted(text)["clean"])

    return docs.withColumn(text_col, clean(F.col(text_col)))


def secrets_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    count = [batches.count_of("spans", k).alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *count, F.sha2(batches.spelled(base), 256).alias("base_sha256"),
                        batches.spelled(F.col("spans")).alias("spans"))
