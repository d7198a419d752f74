"""Web pages as WARC archives, and a merged index of all captures.

Tasks write gzip-per-record archives. Reading one back gives its captures, sorted by URL key and time: a run. Runs are
merged by ranges of the key; the task of a range merges its share of every run with a loser tree, and the ranges follow
each other, so that the captures of one URL stand together in order of time, however many ranges they fill.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm import batches
from clickloom.plans.lookup import fits_broadcast
from clickloom.plans.workspace import staged, work_folder

# An archive is closed once it holds so many bytes, so that a task reads and sorts one bounded run at a time.
ARCHIVE_BYTES = 32 << 20
# Captures that one merging task holds.
ROWS_PER_RANGE = 200_000
_CHUNK = 1 << 16
_RECORD_ID = "urn:capture:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^#]*)")
_PORT = re.compile(r":[0-9]*$")
_DEFAULT_PORTS = {"http": ":80", "https": ":443"}
_MANIFEST = "file string, n_records bigint, n_bytes bigint"
_CAPTURE = ("url_key string, captured_at bigint, page_id bigint, payload_digest string, file string, at bigint, "
            "size bigint, payload_bytes bigint, record_type string, refers_to bigint")
_ORDER = ["url_key", "captured_at", "page_id", "payload_digest", "file", "at"]
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


class Record(NamedTuple):
    """One record as it is stored; ``payload`` is None for a revisit."""

    page_id: int | None
    url: str | None
    captured_at: int
    digest: str
    n_bytes: int
    payload: bytes | None
    refers_to: int | None = None


def url_key(url: str | None) -> str:
    """Host labels from right to left, then path and query: ``org,example)/a?b``. Scheme, user, default port and
    fragment do not count. What is no URL with a host is its own key; a missing URL has the empty key."""
    found = _URL.match(url or "")
    if not found:
        return url or ""
    scheme, host, rest = found.groups()
    name = _PORT.sub("", host.lower())
    port = host[len(name):]
    if port in ("", ":", _DEFAULT_PORTS.get(scheme.lower())):
        port = ""
    return ",".join(reversed(name.split("."))) + port + ")" + (rest if rest.startswith("/") else "/" + rest)


def _stamp(second: int) -> str:
    try:
        return (_EPOCH + timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return "1970-01-01T00:00:00Z"


def _id_of(page_id: int | None) -> str:
    return f"<{_RECORD_ID}{'none' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    text = record_id[1:-1].removeprefix(_RECORD_ID)
    return None if text == "none" else int(text)


def _lines(pairs: list[tuple[str, str | int]]) -> bytes:
    return "".join(f"{name}: {value}\r\n" for name, value in pairs).encode() + b"\r\n"


def pack_record(r: Record) -> bytes:
    """The record as one gzip member. Control characters of the URL are percent-encoded, so it stays in its line."""
    http = b"HTTP/1.1 200 OK\r\n" + _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", r.n_bytes)])
    block = http + (r.payload or b"")
    head: list[tuple[str, str | int]] = [
        ("WARC-Type", "response" if r.payload is not None else "revisit"), ("WARC-Record-ID", _id_of(r.page_id)),
        ("WARC-Date", _stamp(r.captured_at))]
    if r.url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f-\x9f]", lambda c: "".join(
            f"%{b:02X}" for b in c[0].encode()), r.url)))
    head.append(("WARC-Payload-Digest", f"sha1:{r.digest}"))
    if r.payload is None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _id_of(r.refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    deflate = zlib.compressobj(1, wbits=31)
    return deflate.compress(b"WARC/1.1\r\n" + _lines(head) + block + b"\r\n\r\n") + deflate.flush()


def _members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed size, content) of each gzip member, fed in pieces so that no rest is copied often."""
    view, start = memoryview(data), 0
    while start < len(view):
        inflate, at, parts = zlib.decompressobj(31), start, []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a record")
            piece = view[at:at + _CHUNK]
            parts.append(inflate.decompress(piece))
            at += len(piece)
        end = at - len(inflate.unused_data)
        yield start, end - start, b"".join(parts)
        start = end


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {name.lower(): value for name, _, value in pairs}


def unpack_record(data: bytes) -> Record | None:
    """The record of one member, None for the archive's own description. A payload must have the digest it names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.1\r\n"):
        raise ValueError("no WARC record")
    fields = _fields(head)
    if fields["warc-type"] == "warcinfo":
        return None
    size = int(fields["content-length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken length of {fields['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    n_bytes = int(_fields(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    refers_to = None
    if fields["warc-type"] == "revisit":
        payload, refers_to = None, _page_of(fields["warc-refers-to"])
    elif len(payload) != n_bytes or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"broken payload of {fields['warc-record-id']}")
    second = int((datetime.fromisoformat(fields["warc-date"]) - _EPOCH).total_seconds())
    return Record(_page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), second, digest, n_bytes, payload,
                  refers_to)


# --- writing -------------------------------------------------------------------------------------------------------


def _writer(folder: str, archive_bytes: int):
    """mapInArrow: writes archives and yields a manifest row for each. Names are new in every attempt of a task, and
    only files that the manifest names count, so repeated attempts do no harm."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if re.match(r"[a-z0-9+.-]+:", folder) else (
            fs.LocalFileSystem(), folder)
        name, out, records, size = "", None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())],
                ["file", "n_records", "n_bytes"])

        for batch in batches.slices(source):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "captured_at", "sha1", "n_bytes", "revisit",
                                                            "owner")]
            payloads = batch.column("payload")
            for k, (page_id, url, second, sha1, n_bytes, revisit, owner) in enumerate(zip(*columns, strict=True)):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    info = _lines([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                   ("WARC-Date", _stamp(0)), ("WARC-Filename", name),
                                   ("Content-Type", "application/warc-fields"), ("Content-Length", 0)])
                    deflate = zlib.compressobj(1, wbits=31)
                    size += out.write(deflate.compress(b"WARC/1.1\r\n" + info + b"\r\n\r\n") + deflate.flush())
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                payload = None if revisit else payloads[k].as_py()
                size += out.write(pack_record(Record(page_id, url, second, digest, n_bytes, payload, owner)))
                records += 1
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", time_col: str | None = None, least_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row and return the manifest: ``file``, ``n_records``, ``n_bytes`` of each archive.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the smallest id are responses and the
    others revisit them; all other rows are responses. A null payload is empty. A missing id is greater than any other:
    such rows revisit one with an id, and are responses where there is none. Rows that share the smallest id are all
    responses. ``time_col`` holds Unix seconds; missing ones, and years beyond 9999, count as 0.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    second = F.coalesce(F.col(time_col).cast("bigint"), F.lit(0)) if time_col else F.lit(0)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        second.cast("bigint").alias("captured_at"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("bigint")})
    shared = rows.where(F.col("n_bytes") >= least_bytes).groupBy("sha1", "n_bytes").agg(
        F.min("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    owners = staged(shared.select("sha1", "n_bytes", "owner"), "owners")
    # Few shared payloads are looked up where the pages lie. Many are met by a shuffle, which splits a hot payload.
    joined = rows.join(F.broadcast(owners) if fits_broadcast(owners) else owners, ["sha1", "n_bytes"], "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return staged(joined.withColumn("revisit", revisit).mapInArrow(_writer(folder, archive_bytes), _MANIFEST), "manifest")


# --- reading -------------------------------------------------------------------------------------------------------


def archive_run(name: str, data: bytes) -> list[tuple]:
    """The captures of one archive in order of URL key and time."""
    run = []
    for at, size, content in _members(data):
        r = unpack_record(content)
        if r is not None:
            run.append((url_key(r.url), r.captured_at, r.page_id, r.digest, name, at, size, r.n_bytes,
                        "revisit" if r.payload is None else "response", r.refers_to))
    run.sort(key=_key)
    return run


def _key(capture: tuple) -> tuple:
    """Order of captures; a missing id comes first."""
    key, second, page_id, *rest = capture[:len(_ORDER)]
    return (key, second, page_id is not None, page_id or 0, *rest)


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_names(ddl))
    kinds = [_ARROW[part.split()[1]] for part in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _names(ddl))


def _reader(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            yield _batch(archive_run(path.as_py().rpartition("/")[2], content.as_py()), _CAPTURE)


def read_runs(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Captures of all archives of the manifest, written; rows of one ``file`` are a sorted run."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    # Archives that a failed attempt left behind are no part of the manifest.
    return staged(found.mapInArrow(_reader, _CAPTURE).join(manifest.select("file"), "file", "left_semi"), "runs")


# --- merging -------------------------------------------------------------------------------------------------------


def merge(runs: list[Iterator]) -> Iterator:
    """All items of sorted runs in order, by a loser tree: one match per level for each item.

    Leaves ``n`` to ``2 n - 1`` are the runs; an inner node keeps the run that lost there. Equal items go by run.
    """
    n = len(runs)
    heads = [next(r, None) for r in runs]

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None
        return (heads[a], a) < (heads[b], b)

    winners, losers = [0] * n + list(range(n)), [0] * n
    for node in range(n - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if n > 1 else 0
    while n and heads[best] is not None:
        yield heads[best]
        heads[best] = next(runs[best], None)
        node = (n + best) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


_MERGED = f"{_CAPTURE}, range_no int, range_pos bigint, key_pos bigint"


def _merger(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over one range. A run may arrive in several pieces, each of them sorted; every piece is a leaf."""
    pieces: dict[str, list[list[tuple]]] = {}
    names = _names(_CAPTURE)
    for batch in source:
        for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            own = pieces.setdefault(row[4], [[]])
            entry = (_key(row), row)
            if own[-1] and entry[0] < own[-1][-1][0]:
                own.append([])
            own[-1].append(entry)
    number, key, key_pos, rows = TaskContext.get().partitionId(), None, 0, []
    for position, (_, row) in enumerate(merge([iter(p) for own in pieces.values() for p in own])):
        key_pos = key_pos + 1 if row[0] == key else 0
        key = row[0]
        rows.append((*row, number, position, key_pos))
        if len(rows) == 8192:
            yield _batch(rows, _MERGED)
            rows = []
    if rows:
        yield _batch(rows, _MERGED)


def merge_runs(runs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """All captures in one order: the columns of the runs, ``position`` among all and ``capture`` among those of the
    URL key, both from 0.

    The range key ends with file and offset, which are unique, so a URL that holds a third of all captures is spread
    over as many ranges as it fills. Numbers that run on over range borders come from one summary row per range.
    """
    spark = runs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // rows_per_range))
    merged = staged(runs.repartitionByRange(ranges, *_ORDER).mapInArrow(_merger, _MERGED), "merged")
    borders = merged.groupBy("range_no").agg(
        F.count("*").alias("n"), F.min_by("url_key", "range_pos").alias("first"), F.max_by("url_key", "range_pos").alias("last"),
        F.max_by("key_pos", "range_pos").alias("last_pos"))
    so_far = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    borders = staged(borders.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))), "borders")
    # A key that goes on in a range is the last key of all ranges before it that hold captures of it.
    ends = borders.select(F.col("last").alias("key"), "range_no", F.lit(1).alias("turn"), (F.col("last_pos") + 1).alias("n"))
    starts = borders.select(F.col("first").alias("key"), "range_no", F.lit(0).alias("turn"), F.lit(0).cast("bigint").alias("n"))
    along = Window.partitionBy("key").orderBy("range_no", "turn").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.union(starts).withColumn("carried", F.coalesce(F.sum("n").over(along), F.lit(0))).where("turn = 0")
    offsets = borders.join(carried.select("range_no", "carried"), "range_no").select("range_no", "before", "first", "carried")
    capture = F.col("key_pos") + F.when(F.col("url_key") == F.col("first"), F.col("carried")).otherwise(0)
    return merged.join(offsets, "range_no").select(
        *_names(_CAPTURE), (F.col("before") + F.col("range_pos")).alias("position"), capture.alias("capture"))


def capture_histories(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the archives (into a work folder by default), read them back and merge their runs.

    One row per page, see ``write_archives`` and ``merge_runs``. No pages give no archives and no rows.
    """
    folder = folder or work_folder(pages.sparkSession, "archives")
    manifest = write_archives(pages, folder, **options)
    return merge_runs(read_runs(pages.sparkSession, folder, manifest))


def captures_digest(captures: DataFrame) -> DataFrame:
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key",
                           "captured_at", "position", "capture")


def captures_sql(first_second: int) -> str:
    """The same rows as SQL for DuckDB: a window per payload and one per URL key. Page ids must be unique."""
    return rf"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url, sha1(coalesce(html, '')) AS hex,
    {first_second} + coalesce(page_id, 0) AS captured_at,
    regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^#]*)', ['scheme', 'host', 'rest']) AS u
  FROM pages),
k AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex, strlen(html)) AS owner,
    CASE WHEN u.scheme = '' THEN url ELSE
      array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), ':[0-9]*$', ''), '.')), ',')
      || regexp_replace(regexp_extract(u.host, ':[0-9]*$'),
        CASE lower(u.scheme) WHEN 'http' THEN '^:(80)?$' WHEN 'https' THEN '^:(443)?$' ELSE '^:$' END, '')
      || ')' || CASE WHEN u.rest LIKE '/%' THEN '' ELSE '/' END || u.rest END AS url_key,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS digest
  FROM p)
SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest,
  CASE WHEN owner IS NULL OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to, url_key, captured_at,
  row_number() OVER (ORDER BY url_key, captured_at, page_id NULLS FIRST) - 1 AS position,
  row_number() OVER (PARTITION BY url_key ORDER BY captured_at, page_id NULLS FIRST) - 1 AS capture
FROM k"""
