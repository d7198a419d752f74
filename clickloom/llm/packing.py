"""Packing token pieces into sequences of a fixed length by the sum-of-squares rule.

Open sequences are counted by the gap they have left. A piece goes where the sum of the squared counts over all gaps
becomes smallest: into a gap of which there are many, towards a gap of which there are few, or into a new sequence.
The counts stay level, so that for whatever comes there is a fitting gap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import batches
from clickloom.llm.tokens import Vocabulary, encoder
from clickloom.plans.workspace import staged

# Pieces that one task packs. Each task leaves its last sequences partly filled, some tens among tens of thousands.
PIECES_PER_TASK = 50_000
# Sequence numbers of a task start at its number times this.
_NUMBERS = 1 << 40


class SumOfSquares:
    """Online packer: ``place(length)`` gives (sequence, offset). Holds one entry per open sequence."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}
        self.sequences = 0

    def place(self, length: int) -> tuple[int, int]:
        capacity, counts = self.capacity, self.counts
        gap = capacity
        if length < capacity:
            # Change of the sum for each gap that takes the piece; closed sequences count nothing.
            after = counts[:capacity - length]
            before = counts[length:capacity]
            change = np.where(before > 0, 2 * (after - before) + 2, np.iinfo(np.int64).max)
            if before[0]:
                change[0] = 1 - 2 * before[0]
            best = int(change.argmin()) if len(change) else 0
            if len(change) and change[best] <= 2 * counts[capacity - length] + 1:
                gap = best + length
        if gap == capacity:
            number = self.sequences
            self.sequences += 1
        else:
            number = self.open[gap].pop()
            counts[gap] -= 1
        left = gap - length
        if left:
            self.open.setdefault(left, []).append(number)
            counts[left] += 1
        return number, capacity - gap


def _cutter(vocabulary: Vocabulary, capacity: int, with_ids: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches.slices(source):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()),
                                   strict=True):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity].tobytes()
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part), turn,
                                 part if with_ids else None))
                    turn += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "turn", "ids"])

    return run


def pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = 4096, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, written: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``turn``, ``ids``.

    A document is cut only if it is longer than a sequence. A null or empty text has the end id alone. ``ids`` (bytes
    of unsigned 32-bit numbers) is filled on request. ``turn`` deals equal rows to different tasks.
    """
    cut = batches.texts(docs, id_col, text_col).mapInArrow(
        _cutter(vocabulary, capacity, with_ids),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, turn bigint, ids binary")
    return staged(cut, "pieces")


def _packer(capacity: int, names: list[str]):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = SumOfSquares(capacity), TaskContext.get().partitionId() * _NUMBERS
        for batch in source:
            placed = [packer.place(length) for length in batch.column("length").to_pylist()]
            numbers = pa.array([first + n for n, _ in placed], pa.int64())
            offsets = pa.array([offset for _, offset in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers, offsets], [*names, "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = 4096, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; pieces of a sequence follow each other without gaps.

    Pieces are dealt evenly to tasks, which pack them independently, longest first, in one pass with memory for the
    open sequences only. Equal rows stay separate pieces; no pieces give no rows.
    """
    tasks = -(-cut.count() // pieces_per_task) or 1
    dealt = cut.repartition(tasks, F.xxhash64("turn")).sortWithinPartitions(F.desc("length"), "turn")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return dealt.mapInArrow(_packer(capacity, cut.columns), f"{schema}, sequence_id bigint, offset bigint")


def packing_digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
