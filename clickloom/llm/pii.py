"""Personal data in texts, also where it is disguised, with offsets into the source.

The plain patterns run on the source. Then transducers rewrite disguises: look-alike letters and digits, character
references, letters in the shape of digits, digits in words of four languages, and "at" and "dot" in words, brackets or
between spaces. Each keeps, for every character it writes, the source span that it
stands for. The same patterns run on the rewritten text, and what they find is mapped back to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The base patterns, cut so that each runs in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED_DIGITS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters of other scripts that look like ASCII ones, and signs that stand for ASCII ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "һ": "h", "ո": "n", "ց": "g", "ԛ": "q", "ԝ": "w", "ν": "v", "ο": "o", "α": "a", "ρ": "p", "ι": "i", "κ": "k",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Χ": "X", "ı": "i", "ɡ": "g", "ɑ": "a", "\u2024": ".", "\u3002": ".", "\uff61": ".", "\ufe52": ".",
    "\ufe6b": "@", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\ufe63": "-",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digits in English, German, Spanish and French.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8",
    "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
# Names of the two signs in these languages, and named character references.
_AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
_DOT_WORDS = ("dot", "punkt", "punto", "point")
_REFERENCES = {"commat": "@", "period": ".", "plus": "+", "hyphen": "-", "nbsp": " "}
# Signs that are written for digits.
_DIGIT_SHAPES = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1"}
# Last labels that are believed where "at" and "dot" are plain words.
TOP_LABELS = frozenset("com org net edu gov mil int info biz io ai app dev co me tv us uk de fr es it nl be ch at pl "
                       "se no dk fi ie pt br mx in cn jp kr ru au nz ca za eu".split())

# Last labels that are also common words; they are not believed after a dot between spaces.
_WORD_LABELS = frozenset("at be de es in it me no se us".split())
# Words that no address has before its first spelled dot.
_NO_LABEL = frozenset("the a an this that our your my his her their its".split())


def _any_of(words: dict[str, str]) -> str:
    """A pattern for any of the words, which looks at the first letter once."""
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items())


_ONE = _any_of(_DIGIT_WORDS)
_GAP = r"\s{0,3}"
_DOT_WORD = "|".join(_DOT_WORDS)
_DOT = rf"(?:\.|{_GAP}[\[({{<]{_GAP}(?:{_DOT_WORD}|\.){_GAP}[\])}}>]{_GAP}|\x20(?:{_DOT_WORD})\x20)"
_DIGIT_DOT = rf"{_GAP}[\[({{<]{_GAP}(?:{_DOT_WORD}|\.){_GAP}[\])}}>]{_GAP}|\x20(?:{_DOT_WORD})\x20"
# Digits in words and in signs, one after another: what is between them is a dot, or what numbers are grouped with.
_DIGIT = rf"(?:(?:{_ONE})(?![a-z])|[0-9]++)"
_DIGIT_CHAIN = re.compile(rf"(?ai)(?<![a-z0-9])(?:plus[\x20-])?{_DIGIT}(?:(?:{_DIGIT_DOT}|[\x20(),-]{{1,3}}|\.){_DIGIT})*+")
_CHAIN_PART = re.compile(rf"(?ai)(?P<plus>plus[\x20-])|(?P<word>(?:{_ONE})(?![a-z]))|(?P<number>[0-9]+)|(?P<dot>{_DIGIT_DOT})|"
                         r"(?P<gap>[\x20(),.-]{1,3})")
_AT_WORD = "|".join(_AT_WORDS)
_AT = re.compile(rf"(?ai){_GAP}[\[({{<]{_GAP}(?:{_AT_WORD}|@){_GAP}[\])}}>]{_GAP}|\x20(?:{_AT_WORD})\x20|\x20@\x20|@")
# A chain of labels ends before the next sign for "at", and so does a name: no place is read for two of them.
_LABELS = re.compile(rf"(?ai)([a-z0-9-]++)((?:{_DOT}[a-z0-9-]++)++)")
_SPACED_LABELS = re.compile(rf"(?ai)([a-z0-9-]++)((?:(?:{_DOT}|\x20\.\x20)[a-z0-9-]++)++)")
_ONE_DOT = re.compile(rf"(?ai){_DOT}|\x20\.\x20")
_DOT_BEFORE = re.compile(rf"(?ai){_DOT}\Z")
# Longest sign for a dot: a word in brackets with gaps.
_DOT_WIDTH = max(map(len, _DOT_WORDS)) + 2 + 4 * 3
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")


def _emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
        last = max(last, 0)
    return found


def _addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers at a time along each chain of dotted numbers."""
    found = []
    for chain in _DOTTED_DIGITS.finditer(text):
        parts, at = chain[0].split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) << (k & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(m.span())
    return found


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def plain_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start."""
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", *s) for s in _emails(text)]
    spans += [("ip", *s) for s in _addresses(text)]
    spans += [("card", *s) for s in _cards(text)]
    if "+" in text:
        spans += [("phone", *s) for s in _phones(text)]
    return spans


class Rewritten:
    """A text and the source span of each of its characters, as edits over unchanged stretches."""

    def __init__(self, text: str, edits: list[tuple[int, int, str, list[tuple[int, int]] | None]]):
        """``edits``: (start, end, replacement, source spans of its characters or None for the whole), in order."""
        out, size, at = [], 0, 0
        self.starts, self.kept, self.changed = [], [], []  # of stretches: offset here, source offset or spans
        for start, end, new, parts in edits:
            for piece, mapping in ((text[at:start], at), (new, parts or [(start, end)] * len(new))):
                if piece:
                    self.starts.append(size)
                    self.kept.append(mapping)
                    out.append(piece)
                    size += len(piece)
            self.changed.append((start, end))
            at = end
        if at < len(text):
            self.starts.append(size)
            self.kept.append(at)
            out.append(text[at:])
        self.text = "".join(out)

    def _of(self, k: int) -> tuple[int, int]:
        n = bisect_right(self.starts, k) - 1
        mapping, offset = self.kept[n], k - self.starts[n]
        return (mapping + offset, mapping + offset + 1) if isinstance(mapping, int) else mapping[offset]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self._of(start)[0], self._of(end - 1)[1]


def _look_alike(c: str) -> str | None:
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in _INVISIBLE:
        return ""
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.decimal(c))
    plain = unicodedata.normalize("NFKC", c) if 0xFF01 <= ord(c) <= 0xFF5E or 0x1D400 <= ord(c) <= 0x1D7FF else ""
    return plain if len(plain) == 1 and plain.isascii() else None


# Blocks above Latin-1 that hold look-alikes, invisible characters and digits; a cheap first test.
_ODD = re.compile("[\u00a0\u00ad\u0131\u0250-\u02ff\u0370-\u058f\u0600-\u1cff\u2000-\u206f\u2212\u3000-\u3002"
                  "\ua620-\uabff\ufe50-\ufeff\uff00-\uffef\U00010000-\U0001ffff]")


_REFERENCE = re.compile(rf"(?ai)&(?:#0{{0,5}}([0-9]{{2,3}})|#x0{{0,5}}([0-9a-f]{{2}})|({'|'.join(_REFERENCES)}));")


def look_alikes(text: str) -> Rewritten | None:
    """Look-alike letters, digits of other scripts, invisible characters, and character references to ASCII signs."""
    edits = []
    if "&" in text:
        for m in _REFERENCE.finditer(text):
            code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else ord(_REFERENCES[m[3].lower()])
            if 0x20 <= code < 0x7F:
                edits.append((m.start(), m.end(), chr(code), None))
    if not text.isascii():
        for m in _ODD.finditer(text):
            new = _look_alike(m[0])
            if new is not None:
                edits.append((m.start(), m.end(), new, None))
    return Rewritten(text, sorted(edits, key=lambda e: e[0])) if edits else None


_SHAPED = re.compile(r"[0-9][OoIl|]|[OoIl|][0-9]|[0-9]\.[OoIl|]|[OoIl|]\.[0-9]")
_SHAPE_GROUP = re.compile(r"(?<![A-Za-z0-9|])[0-9OoIl|]++(?![A-Za-z0-9])")


def digit_shapes(text: str) -> Rewritten | None:
    """O, o, I, l and | in groups that have digits, and alone at a dot between such groups. A | counts in groups of at
    most four signs only, as it also parts columns of numbers."""
    edits = []
    if _SHAPED.search(text):
        for m in _SHAPE_GROUP.finditer(text):
            group, (start, end) = m[0], m.span()
            if group.isdigit() or "|" in group and len(group) > 4:
                continue
            digits = any(c.isdigit() for c in group)
            at_dot = (text[start - 1:start] == "." and text[start - 2:start - 1] in {*"0123456789", *_DIGIT_SHAPES}
                      if start > 1 else False) or (
                text[end:end + 1] == "." and text[end + 1:end + 2] in {*"0123456789", *_DIGIT_SHAPES})
            if digits or len(group) == 1 and at_dot:
                edits += [(k, k + 1, _DIGIT_SHAPES[c], None) for k, c in enumerate(group, start) if c in _DIGIT_SHAPES]
    return Rewritten(text, edits) if edits else None


def spelled_digits(text: str) -> Rewritten | None:
    """Digits in words, four or more or beside other digits, with "plus" before, and dots in words or brackets between
    digits. Gaps between words go; others stay, as single ones where they have a comma or are long."""
    edits = []
    for m in _DIGIT_CHAIN.finditer(text):
        if m[0].isdigit():
            continue
        parts = [(p.lastgroup, *p.span()) for p in _CHAIN_PART.finditer(text, m.start(), m.end())]
        kinds = [p[0] for p in parts]
        spelled = kinds.count("word") > (0 if "number" in kinds else 3)
        for k, (kind, start, end) in enumerate(parts):
            if kind == "dot":
                edits.append((start, end, ".", None))
            elif spelled and kind == "word":
                edits.append((start, end, _DIGIT_WORDS[text[start:end].lower()], None))
            elif spelled and kind == "plus":
                edits.append((start, end, "+", None))
            elif spelled and kind == "gap":
                words = (kinds[k - 1] == "word") + (kinds[k + 1] == "word")
                gap = text[start:end]
                if words == 2 and end - start < 3 and not set(gap) & set("()."):
                    edits.append((start, end, "", None))
                elif words and ("," in gap or end - start > 1 and not set(gap) & set("()")):
                    edits.append((start, end, " ", None))
    return Rewritten(text, edits) if edits else None


def _name_start(text: str, low: int, end: int) -> int:
    """Start of the name that ends here: labels with dots between them, walked back; ``end`` where there is none."""
    start = end
    while True:
        at = start
        while at > low and text[at - 1] in _NAME:
            at -= 1
        if at == start:
            return first if start != end else end
        first = at
        dot = _DOT_BEFORE.search(text, max(low, at - _DOT_WIDTH), at)
        if not dot:
            return first
        start = dot.start()


def spelled_signs(text: str) -> Rewritten | None:
    """"at" and "dot" around the name and the labels of a mail address.

    Bracketed signs are believed as they stand. Plain words need each other, and a known last label or two spelled dots;
    signs between spaces need a known last label that is no word, and "point" needs an "at" that is not English.
    """
    edits, last = [], 0
    for at in _AT.finditer(text):
        sign = at[0].strip().lower()
        spaced = at[0] == " @ "
        labels = (_SPACED_LABELS if spaced else _LABELS).match(text, at.end())
        begin = _name_start(text, last, at.start()) if labels else at.start()
        if begin == at.start():
            continue
        dots = [(d.start(), d.end()) for d in _ONE_DOT.finditer(text, labels.start(2), labels.end())]
        before = [(d.start(), d.end()) for d in _ONE_DOT.finditer(text, begin, at.start())]
        starts = [begin, *(b for _, b in before)]
        for k in range(len(before) - 1, -1, -1):  # "connect the dot ann@..." has no name "the"
            if text[starts[k]:before[k][0]].lower() in _NO_LABEL and text[slice(*before[k])].strip().lower() in _DOT_WORDS:
                before = before[k + 1:]
                break
        signs = [text[a:b].strip().lower() for a, b in dots]
        plain_at = sign in _AT_WORDS
        spoken = [d for d in dots if text[d[0]:d[1]] != "."]
        words = [s for s in signs if s in _DOT_WORDS]
        if at[0] == "@" and not spoken and all(text[a:b] == "." for a, b in before):
            continue
        top = text[dots[-1][1]:labels.end()].lower()
        if (plain_at or spaced) and labels[1].lower() in _NO_LABEL or not re.search("(?a)[a-z]", top):
            continue
        if at[0] in (" at ", "@", " @ ") and "point" in [*words, *(text[a:b].strip().lower() for a, b in before)]:
            continue
        known = top in TOP_LABELS
        if spaced and (not known or top in _WORD_LABELS):
            continue
        spelled_out = plain_at and len(words) > 1 and len(words) == len(dots) and re.fullmatch("(?a)[a-z]{2,}", top) \
            and top not in _DOT_WORDS and top not in _AT_WORDS and top not in _NO_LABEL
        if plain_at and not spoken or (plain_at or words) and not known and not spelled_out:
            continue
        if at[0] == "@" and not spoken and not any(text[a:b].strip() != "." for a, b in before):
            continue
        found = [*[(a, b, ".", None) for a, b in before], (at.start(), at.end(), "@", None),
                 *[(a, b, ".", None) for a, b in dots]]
        edits += [e for e in found if text[e[0]:e[1]] != e[2]]
        last = labels.end()
    return Rewritten(text, edits) if edits else None


def scan_text(text: str) -> list[Span]:
    """All spans by kind, then start: the plain ones, and those that only the rewritten text shows.

    An added span covers at least one rewritten place; it may hold a plain span, which stays. Of added spans within one
    another the widest counts, and none lies within a plain one of its kind. Offsets count code points of the source, ends
    are exclusive.
    """
    base = plain_spans(text)
    layers: list[Rewritten] = []
    current = text
    added: set[Span] = set()
    for step in (look_alikes, digit_shapes, spelled_digits, spelled_signs):
        layer = step(current)
        if layer:
            layers.append(layer)
            current = layer.text
            added.update(_mapped_back(current, layers))
    return sorted({*base, *_widest(added, base)}, key=_by_kind)


def _by_kind(span: Span) -> tuple[int, int, int]:
    return KINDS.index(span[0]), span[1], span[2]


def _mapped_back(text: str, layers: list[Rewritten]) -> list[Span]:
    """Source spans of what the text of the last layer shows, where they cover a rewritten place."""
    changed, found = _changed(layers), []
    for kind, start, end in plain_spans(text):
        for layer in reversed(layers):
            start, end = layer.source(start, end)
        k = bisect_right(changed, (start, -1))
        if any(a < end and start < b for a, b in changed[max(0, k - 1):k + 1]):
            found.append((kind, start, end))
    return found


def _widest(added: set[Span], base: list[Span]) -> list[Span]:
    """Added spans that lie in no other span of their kind."""
    kept, last = [], ("", 0, 0)
    for span in sorted({*added, *base}, key=lambda s: (KINDS.index(s[0]), s[1], -s[2])):
        if span[0] != last[0] or span[2] > last[2]:
            last = span
            kept.append(span)
    return [span for span in kept if span in added]


def _changed(layers: list[Rewritten]) -> list[tuple[int, int]]:
    """Rewritten places of all layers as source spans, in order."""
    found = set()
    for n, layer in enumerate(layers):
        for start, end in layer.changed:
            for below in reversed(layers[:n]):
                start, end = below.source(start, end)
            found.add((start, end))
    return sorted(found)


def _row(text: str) -> dict:
    spans = [{"kind": k, "start": s, "end": e} for k, s, e in scan_text(text)]
    return {"spans": spans, "base": [{"kind": k, "start": s, "end": e} for k, s, e in plain_spans(text)]}


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``spans`` (all) and ``base`` (undisguised ones) of every document, without a shuffle.

    One row per input row: repeated rows stay repeated, a null or empty text has no spans, a null id stays null. Texts
    are read whole, in linear time.
    """
    return batches.texts(docs, id_col, text_col).mapInArrow(
        batches.per_text(_row, "spans spans,base spans"),
        f"doc_id bigint, spans {batches.SPANS}, base {batches.SPANS}")


def personal_data_digest(found: DataFrame) -> DataFrame:
    """Counts of undisguised spans per kind, their digest, and all spans as text."""
    count = [batches.count_of("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(batches.spelled(F.col("base")), 256).alias("base_sha256"),
                        batches.spelled(F.col("spans")).alias("spans"))
