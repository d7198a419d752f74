"""Elias-Fano codes of rising numbers, with select, and a flat file format for token ids that uses them.

``n`` numbers up to ``u`` take about ``2 + log2(u / n)`` bits each: the low bits side by side, the high bits in unary
as a bit vector. Select finds the k-th one of the bit vector from a sample every 256 ones and a count of the bytes from
there, so any boundary is read without a table of 64-bit offsets.

A file holds, all little-endian:

    magic "EFTK1\\0\\0\\0"; id bytes w (2 or 4), documents n, ids, documents without id      5 x 8 bytes
    code of the n + 1 document borders (counted in ids, from 0)
    code of the document ids less the smallest, after that smallest id (signed 64 bits)
    ids, w bytes each

and a code holds: numbers, largest, low-bit width, words of high bits (4 x 8 bytes), low-bit words, high-bit words,
positions of every 256th one (64 bits each).
"""

from __future__ import annotations

import numpy as np

MAGIC = b"EFTK1\0\0\0"
SAMPLE = 256
_BYTE_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


class EliasFano:
    """Read access to a code: ``select(k)`` is the k-th number, ``all()`` every one."""

    def __init__(self, n: int, largest: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.largest, self.width = n, largest, width
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        """Of numbers that never fall; none may be negative."""
        numbers = np.asarray(numbers, dtype=np.uint64)
        n = len(numbers)
        largest = int(numbers[-1]) if n else 0
        width = max(0, (largest // n).bit_length() - 1) if n else 0
        bits = np.zeros((n * width + 63) // 64 * 64, dtype=np.uint8)
        for k in range(width):
            bits[np.arange(n) * width + k] = (numbers >> np.uint64(k)) & np.uint64(1)
        ones = (numbers >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) // 64 + 1) * 64 if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(n, largest, width, np.packbits(bits, bitorder="little").view("<u8"),
                   np.packbits(high, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u8"))

    def _low_of(self, k: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(k), dtype=np.uint64)
        at = k.astype(np.uint64) * np.uint64(self.width)
        word, shift = at >> np.uint64(6), at & np.uint64(63)
        words = np.append(self.low, np.uint64(0))
        value = words[word] >> shift
        spill = shift + np.uint64(self.width) > np.uint64(64)
        value[spill] |= words[word[spill] + np.uint64(1)] << (np.uint64(64) - shift[spill])
        return value & np.uint64((1 << self.width) - 1)

    def select(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        at, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        data = self.high.view(np.uint8)
        byte = at // 8
        rest = int(data[byte]) >> at % 8  # the sampled one is its lowest bit
        base = at
        while (ones := rest.bit_count()) <= left:
            left -= ones
            byte += 1
            rest, base = int(data[byte]), byte * 8
        for _ in range(left):
            rest &= rest - 1
        position = base + (rest & -rest).bit_length() - 1
        return (position - k) << self.width | int(self._low_of(np.array([k]))[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        order = np.arange(self.n)
        return ((ones - order).astype(np.uint64) << np.uint64(self.width)) | self._low_of(order)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.largest, self.width, len(self.high)], dtype="<u8")
        return b"".join(x.tobytes() for x in (head, self.low, self.high, self.samples))

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The code at an offset, and the offset after it."""
        n, largest, width, words = (int(x) for x in np.frombuffer(data, "<u8", 4, at))
        at, found = at + 32, []
        for size in ((n * width + 63) // 64, words, -(-n // SAMPLE)):
            found.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        return cls(n, largest, width, *found), at


def pack_file(doc_ids: list[int | None], lengths: np.ndarray, ids: list[bytes], width: int) -> bytes:
    """One file of documents in order of their ids; those without an id come first."""
    missing = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[missing:], dtype=np.int64)
    smallest = int(known[0]) if len(known) else 0
    borders = np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)
    head = np.array([width, len(doc_ids), int(borders[-1]), missing], dtype="<u8").tobytes()
    above = (known.astype(np.uint64) - np.uint64(smallest % (1 << 64))) if len(known) else known
    return b"".join([MAGIC, head, EliasFano.of(borders).to_bytes(), np.int64(smallest).astype("<i8").tobytes(),
                     EliasFano.of(above).to_bytes(), *ids])


class TokenFile:
    """Documents of one file: their ids, borders and token ids."""

    def __init__(self, content: bytes):
        data = memoryview(content)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.width, self.n, self.size, self.missing = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
        self.borders, at = EliasFano.read(data, 40)
        self.smallest = int(np.frombuffer(data, "<i8", 1, at)[0])
        self._names, at = EliasFano.read(data, at + 8)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.size, at)

    def doc_ids(self) -> list[int | None]:
        known = self._names.all() + np.uint64(self.smallest % (1 << 64))
        return [None] * self.missing + known.astype(np.uint64).view(np.int64).tolist()

    def tokens(self, k: int) -> np.ndarray:
        """Ids of the k-th document, by two selects."""
        return self.ids[self.borders.select(k):self.borders.select(k + 1)]
