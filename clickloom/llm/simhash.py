"""Near-duplicates by SimHash: equal word sequences up to small changes have fingerprints that differ in few bits.

Fingerprints within the radius agree in at least two of four 16-bit segments when the radius is two, so each distinct
fingerprint is filed under the six pairs of segments. Fingerprints of one file are compared bit by bit in vertical
form: bit b of all members is one bit plane, a carry-save counter keeps the distances of all members at once, and the
comparison ends as soon as every member has passed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import batches
from clickloom.llm.components import components
from clickloom.plans.workspace import staged

BITS = 64
SEED = 42
# Members of one half of a cell: larger files are compared in pairs of blocks of about this size.
BLOCK = 2048


def fingerprint(text: str, shingle: int) -> int:
    """Majority bits over the hashes of all word shingles; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = min(shingle, len(words))
    pieces = map(b" ".join, zip(*[words[k:] for k in range(n)], strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(p, SEED) for p in pieces], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[start:start + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (64 bits as a signed long), one row per input row."""
    return batches.texts(docs, id_col, text_col).mapInArrow(
        batches.per_text(lambda text: {"fp": _signed(fingerprint(text, shingle))}, "fp bigint"),
        "doc_id bigint, fp bigint")


def _segments(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of ``radius + 2`` segments; two fingerprints within the radius agree in two of them."""
    count = radius + 2
    edges = [BITS * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _filed(nodes: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint under every pair of its segments."""
    def key(pair):
        parts = [F.shiftright(F.col("fp"), a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in pair]
        return F.struct(*[p.alias(f"part{i}") for i, p in enumerate(parts)])

    pairs = list(combinations(_segments(radius), 2))
    keys = F.array(*[F.struct(F.lit(k).alias("file"), *[key(pair)[f"part{i}"].alias(f"part{i}") for i in range(2)])
                     for k, pair in enumerate(pairs)])
    return nodes.select("fp", F.explode(keys).alias("key")).select("key.*", "fp")


def _cells(filed: DataFrame) -> DataFrame:
    """Files of two or more members, large ones as pairs of blocks: every two members meet in some cell."""
    file = ["file", "part0", "part1"]
    counts = filed.groupBy(*file).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = filed.join(counts, file).withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("fp", "file"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("block"))))
    return rows.withColumn("other", other).select(
        *file, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp")


def bit_planes(values: np.ndarray) -> list[int]:
    """Bit b of all values as one integer, value j at bit j."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def within(planes: list[int], everyone: int, query: int, radius: int) -> int:
    """Members at most ``radius`` bits from the query, as a bit set.

    The counter holds one lane per member, in bit-sliced form, and starts so high that the bit after the radius
    carries out of its top slice.
    """
    slices = (radius + 1).bit_length()
    start = (1 << slices) - 1 - radius
    counter = [everyone if start >> k & 1 else 0 for k in range(slices)]
    over = 0
    for b, plane in enumerate(planes):
        carry = plane ^ everyone if query >> b & 1 else plane
        for k in range(slices):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
            if not carry:
                break
        over |= carry
        if over == everyone:
            return 0
    return everyone & ~over


def linked_within(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member of its component) for all linked members that are not smallest themselves."""
    values = np.unique(values)
    found: list[tuple[int, int]] = []
    planes, everyone = bit_planes(values), (1 << len(values)) - 1
    numbers = [int(v) for v in values]
    unseen = everyone
    while unseen:
        first = (unseen & -unseen).bit_length() - 1
        unseen &= unseen - 1
        reached = [first]
        for j in reached:
            if not unseen:
                break
            near = within(planes, everyone, numbers[j], radius) & unseen
            unseen &= ~near
            while near:
                k = (near & -near).bit_length() - 1
                near &= near - 1
                reached.append(k)
        found += [(numbers[k], numbers[first]) for k in reached[1:]]
    return found


def _links(radius: int):
    """mapInArrow over rows sorted by cell: links of each cell, carried over batch borders."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "part0", "part1", "low", "high"]
        held_key, held = None, np.empty(0, dtype=np.int64)
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                out.extend(linked_within(held.astype("<i8").view("<u8"), radius))

        def batch_of(pairs):
            left = np.array([p[0] for p in pairs], dtype="<u8").view("<i8")
            right = np.array([p[1] for p in pairs], dtype="<u8").view("<i8")
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

        for batch in source:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names], axis=1)
            values = batch.column("fp").to_numpy()
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for start, end in zip([0, *edges], [*edges, len(values)], strict=True):
                key = tuple(keys[start])
                if key != held_key:
                    close()
                    held_key, held = key, np.empty(0, dtype=np.int64)
                held = np.concatenate([held, values[start:end]])
            if out:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)

    return run


def fingerprint_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links ``a``, ``b`` that connect exactly the distinct fingerprints ``fp`` at most ``radius`` bits apart."""
    cell = ["file", "part0", "part1", "low", "high"]
    cells = _cells(_filed(nodes, radius)).repartition(*cell).sortWithinPartitions(*cell)
    return cells.mapInArrow(_links(radius), "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (smallest id reachable over links) of every document.

    One row per input row. Texts of fewer words than a shingle count as one shingle; texts without words (null, empty,
    white space) have fingerprint 0 and link like any other. A component without any id has a null ``component_id``.
    Copies share a fingerprint and are compared once, however many there are.
    """
    prints = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(fingerprint_links(nodes, radius))
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = linked.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The documents whose id is the smallest of their group, with all their columns.

    Rows that share an id are one document and stay or go together; rows without an id cannot be told apart and stay.
    """
    groups = simhash_groups(docs, shingle, radius, id_col, text_col)
    dropped = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["_other"], "left_anti")


def groups_digest(groups: DataFrame) -> DataFrame:
    """The fingerprint as 16 lowercase hex digits."""
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
