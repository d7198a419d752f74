"""Corpora as flat token files: written by tasks into a shared folder, read back by Spark."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm import batches
from clickloom.llm.elias_fano import TokenFile, pack_file
from clickloom.llm.tokens import Vocabulary, encoder, id_bytes
from clickloom.plans.workspace import staged, work_folder

# A file is closed once it holds so many ids, so memory and files stay bounded however large a partition is.
IDS_PER_FILE = 8 << 20
_MANIFEST = "file string, first_id bigint, first_tie bigint, n_docs bigint, n_ids bigint"


def _writer(folder: str, vocabulary: Vocabulary, ids_per_file: int):
    """mapInArrow over sorted rows: writes files, yields one manifest row for each.

    File names are new in every attempt of a task. Only files named by the manifest of the attempt that succeeded are
    read, so a repeated or speculative attempt leaves nothing but unused files.
    """
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
            fs.LocalFileSystem(), folder)
        encode = encoder(vocabulary)
        width = id_bytes(vocabulary)
        names: list[int | None] = []
        lengths: list[int] = []
        ids: list[bytes] = []
        total, tie = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal total
            name = f"{uuid.uuid4().hex}.eftk"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(pack_file(names, np.array(lengths, dtype=np.uint64), ids, width))
            row = pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([names[0]], pa.int64()), pa.array([tie], pa.int64()),
                 pa.array([len(names)], pa.int64()), pa.array([total], pa.int64())],
                ["file", "first_id", "first_tie", "n_docs", "n_ids"])
            names.clear(), lengths.clear(), ids.clear()
            total = 0
            return row

        for batch in batches.slices(source):
            ties = batch.column("tie").to_pylist()
            found = encode(batch.column("text").to_pylist())
            for doc_id, own_tie, own in zip(batch.column("doc_id").to_pylist(), ties, found, strict=True):
                if not names:
                    tie = own_tie
                names.append(doc_id)
                lengths.append(len(own))
                ids.append(own.astype(f"<u{width}").tobytes())
                total += len(own)
                if total >= ids_per_file:
                    yield close()
        if names:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
                 ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Write the ids of all texts, in ascending order of document id, and return the manifest.

    The manifest has one row per file: its name, the order of the files (``first_id``, ``first_tie``), documents and
    ids. Rows without an id come first; rows that share an id follow each other in the order of their texts' hashes.
    """
    rows = batches.texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return staged(sorted_rows.mapInArrow(_writer(folder, vocabulary, ids_per_file), _MANIFEST), "manifest")


def _reader(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            file = TokenFile(content.as_py())
            bounds = file.borders.all().astype(np.int64)
            if bounds[-1] != file.size or file.borders.select(file.n) != file.size:
                raise ValueError(f"broken borders in {path}")
            crcs = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes())
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            name = str(path).rpartition("/")[2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * file.n), pa.array(file.doc_ids(), pa.int64()), pa.array(bounds[:-1]),
                 pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())],
                ["file", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` from the files."""
    order = Window.orderBy("first_id", "first_tie").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("file_start"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eftk").load(folder).select("path", "content")
    rows = files.mapInArrow(
        _reader, "file string, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, "file").select(
        "doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files into a work folder and read them back. No documents give no files and no rows."""
    spark = docs.sparkSession
    folder = work_folder(spark, "tokens")
    manifest = write_tokens(docs, folder, vocabulary, id_col, text_col)
    return read_tokens(spark, folder, manifest)
