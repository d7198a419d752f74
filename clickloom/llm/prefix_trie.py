"""Prefix trie of conversations, by collapsing whole sequences before anything is expanded.

Identical conversations become one weighted sequence with a list of its ends. Sequences that are proper prefixes of
others fall out by an anti-join; what stays are the leaves. Only then the prefixes of the distinct sequences are
expanded and summed with their weights, so a conversation that was logged a million times is expanded once.

A prefix is known by its depth and 128 bits, the exclusive-or of a hash of position, role and text over its turns.
Nothing gathers a conversation, a prefix or a list of ends in memory: turns are numbered in sorted ranges, prefixes are
sums, and ends are hashed as a stream of chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.plans.workspace import staged

# Turns whose running sums one window task holds at a time, and ends in one chunk of a list.
_BLOCK = 1024
_ENDS_PER_CHUNK = 4096
# Leading characters of role and text that decide between turns of one number, before their hashes do.
_LEAD = 64
# Parents with more than one in so many of all children are looked up by a broadcast; there are fewer than this.
_BUSY = 1000
_KEY = ["depth", "x1", "x2"]


def _turn_hash(position: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), position, F.col("role_md5"), F.col("text_md5")).alias(x) for k, x in ((1, "x1"), (2, "x2"))]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 0), ``role_md5``, ``text_md5`` and ``n_bytes`` (of the text) of every turn, written.

    Turns go by number, missing ones first; equal numbers by the first characters of role and text, then by their MD5
    hashes. Repeated rows are separate turns. A missing role or text is empty. Rows without a conversation id belong to
    no conversation. Rows are dealt by ranges of this order, whose last part is the row's place in the input, so
    neither a conversation nor a row that holds a third of the table meets one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.left(role, F.lit(_LEAD)).alias("role_lead"), F.left(text, F.lit(_LEAD)).alias("text_lead"),
        F.md5(role.cast("binary")).alias("role_md5"), F.md5(text.cast("binary")).alias("text_md5"),
        F.octet_length(text).cast("bigint").alias("n_bytes"), F.monotonically_increasing_id().alias("place"))
    order = ["conv_id", "turn", "role_lead", "text_lead", "role_md5", "text_md5", "place"]
    # Row numbers of a partition start at its number times 2^33.
    ranged = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "role_md5", "text_md5", "n_bytes", F.monotonically_increasing_id().alias("row")), "turns")
    part = F.shiftright("row", 33).alias("part")
    spans = ranged.groupBy("conv_id", part).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    placed = ranged.withColumn("part", part).join(spans, ["conv_id", "part"])
    return staged(placed.select("conv_id", (F.col("row") + F.col("shift")).alias("pos"), "role_md5", "text_md5", "n_bytes"),
                  "numbered")


def _head_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos``, ``x1``, ``x2`` (hash of this turn at this place) and ``n_bytes`` of rebuilt conversations.

    Conversation c starts with the first h turns of conversation c - c % 5 and goes on with its own turns after its
    first h, where h is CRC-32 of c's decimal digits modulo 9. The remainder has the sign of c.
    """
    c = F.col("conv_id")
    base = c - c % 5
    own = turns.where((c == base) | (F.col("pos") >= _head_turns(c)))
    heads = turns.where((c == base) & (F.col("pos") < 8))
    # A conversation whose base has fewer than h turns closes up by the difference.
    lengths = heads.groupBy(c.alias("base")).agg(F.count("*").alias("n_base"))
    ids = turns.select("conv_id").distinct()
    gaps = ids.where(c != base).withColumn("base", base).join(lengths, "base", "left").select(
        "conv_id", (_head_turns(c) - F.least(_head_turns(c), F.coalesce("n_base", F.lit(0)))).alias("gap")).where("gap > 0")
    own = own.join(gaps, "conv_id", "left").withColumn("pos", F.col("pos") - F.coalesce("gap", F.lit(0)))
    child = F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("step")
    lent = heads.select("*", child).withColumn("child", c + F.col("step")).where(
        (F.col("step") != 0) & (F.col("child") - F.col("child") % 5 == c) & (F.col("pos") < _head_turns(F.col("child"))))
    lent = lent.drop("conv_id", "step").withColumnRenamed("child", "conv_id").join(ids, "conv_id", "left_semi")
    columns = ["conv_id", "pos", "role_md5", "text_md5", "n_bytes"]
    both = own.select(*columns).unionByName(lent.select(*columns))
    return both.select("conv_id", "pos", *_turn_hash(F.col("pos")), "n_bytes")


def whole_sequences(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``conv_id``, ``depth`` (turns), ``x1``, ``x2``, ``total`` (bytes) of every conversation of ``ids``, turnless too."""
    whole = turns.groupBy("conv_id").agg(
        F.count("*").alias("depth"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("n_bytes").alias("total"))
    zero = F.lit(0).cast("bigint")
    return ids.join(whole, "conv_id", "left").select("conv_id", *[
        F.coalesce(k, zero).alias(k) for k in ("depth", "x1", "x2", "total")])


def _prefixes(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every prefix of every distinct sequence: its key, the key's part before its last turn (``y1``, ``y2``), and
    ``before``, the bytes ahead of its last text. The empty prefix is one of them."""
    own = turns.join(sequences.select(F.col("first").alias("conv_id")), "conv_id", "left_semi")
    own = own.withColumn("block", F.floor(F.col("pos") / _BLOCK))
    sums = {"x1": F.bit_xor, "x2": F.bit_xor, "n_bytes": F.sum}
    totals = own.groupBy("conv_id", "block").agg(*[f(c).alias(c) for c, f in sums.items()])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outside = totals.select("conv_id", "block", *[
        F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"{c}_out") for c, f in sums.items()])
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = own.select("conv_id", "block", "pos", "n_bytes", *[F.col(x).alias(f"{x}_own") for x in ("x1", "x2")],
                        *[f(c).over(inside).alias(f"{c}_in") for c, f in sums.items()]).join(outside, ["conv_id", "block"])
    upto = {x: F.col(f"{x}_in").bitwiseXOR(F.col(f"{x}_out")) for x in ("x1", "x2")}
    deep = rolled.select(
        F.col("conv_id").alias("first"), (F.col("pos") + 1).alias("depth"), *[c.alias(x) for x, c in upto.items()],
        *[upto[x].bitwiseXOR(F.col(f"{x}_own")).alias(y) for x, y in (("x1", "y1"), ("x2", "y2"))],
        (F.col("n_bytes_in") + F.col("n_bytes_out") - F.col("n_bytes")).alias("before"))
    zero = F.lit(0).cast("bigint")
    return deep.unionByName(sequences.select("first", *[zero.alias(c) for c in (*_KEY, "y1", "y2", "before")]))


# --- lists of ends -------------------------------------------------------------------------------------------------

_CHUNK_SCHEMA = "depth bigint, x1 bigint, x2 bigint, start bigint, ends string"


def _by_key(source: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in source:
        yield from zip(*[batch.column(n).to_pylist() for n in (*_KEY, *names)], strict=True)


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    parts = [part.split() for part in ddl.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), parts, strict=True)],
        [name for name, _ in parts])


def _chunker(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) rows as pieces of comma-joined text."""
    key, ids, out = None, [], []
    for *now, conv_id in _by_key(source, "conv_id"):
        if now != key or len(ids) == _ENDS_PER_CHUNK:
            if ids:
                out.append((*key, ids[0], ",".join(map(str, ids))))
            key, ids = now, []
        ids.append(conv_id)
        if len(out) == 1024:
            yield _table(out, _CHUNK_SCHEMA)
            out = []
    if ids:
        out.append((*key, ids[0], ",".join(map(str, ids))))
    if out:
        yield _table(out, _CHUNK_SCHEMA)


_ENDS_SCHEMA = "depth bigint, x1 bigint, x2 bigint, ends_sha256 string"


def _hasher(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks: the digest of each key's whole list, fed chunk by chunk."""
    key, digest, out = None, None, []
    for *now, text in _by_key(source, "ends"):
        if now != key:
            if digest:
                out.append((*key, digest.hexdigest()))
            key, digest = now, hashlib.sha256(text.encode())
        else:
            digest.update(b"," + text.encode())
        if len(out) == 4096:
            yield _table(out, _ENDS_SCHEMA)
            out = []
    if digest:
        out.append((*key, digest.hexdigest()))
    if out:
        yield _table(out, _ENDS_SCHEMA)


def ends_digests(whole: DataFrame) -> DataFrame:
    """The key of each distinct sequence and SHA-256 of its conversation ids, ascending and comma-joined.

    Ids are put into order by ranges of (key, id), which cut a list that many conversations share. The digest itself is
    a chain, and is fed with one row for some thousand ids.
    """
    chunks = whole.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(
        *_KEY, "conv_id").mapInArrow(_chunker, _CHUNK_SCHEMA)
    return chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "start").mapInArrow(_hasher, _ENDS_SCHEMA)


# --- the trie ------------------------------------------------------------------------------------------------------


def _parents(nodes: DataFrame) -> DataFrame:
    """``up_conv_id``, the smallest member of the parent, of the nodes where the path of their own smallest member begins.

    Along that path a node's parent has the same smallest member, so nothing else is looked up. Children counts add up
    to the number of nodes, so at most ``_BUSY`` parents have a share of 1 / ``_BUSY`` of them; those are broadcast, and
    each of the others meets one task with few rows.
    """
    branches = nodes.where("depth > 0 and depth = own_depth").select(*_KEY, (F.col("depth") - 1).alias("up"), "y1", "y2")
    above = nodes.where("n_children > 0").select(
        F.col("depth").alias("up"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("conv_id").alias("up_conv_id"),
        "n_children")
    many = F.col("n_children") * _BUSY >= nodes.count()
    busy = F.broadcast(above.where(many).drop("n_children"))
    met = branches.join(busy, ["up", "y1", "y2"], "left")
    rest = met.where("up_conv_id is null").drop("up_conv_id").join(above.where(~many), ["up", "y1", "y2"])
    return met.where("up_conv_id is not null").select(*_KEY, "up_conv_id").unionByName(rest.select(*_KEY, "up_conv_id"))


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    ``turns`` have ``conv_id``, ``pos`` without gaps, ``x1``, ``x2`` and ``n_bytes``; ``ids`` names all conversations.
    ``saved_tokens`` is the sum over the subtree of (members - 1) times the bytes of the last text. The first factor's
    members give, for each distinct sequence below, its weight times its bytes from here on. The bytes of the distinct
    nodes below are shared out: a node belongs to the sequence of its smallest member, which owns the end of its own
    path from some depth on, so each sequence adds its owned bytes once and no node meets its ancestors.
    """
    turns = staged(turns, "rebuilt")
    whole = staged(whole_sequences(turns, ids), "whole")
    sequences = staged(whole.groupBy(*_KEY).agg(
        F.min("conv_id").alias("first"), F.count("*").alias("weight"), F.first("total").alias("total")), "sequences")
    prefixes = staged(_prefixes(turns, sequences), "prefixes")
    inner = prefixes.join(sequences.select("first", F.col("depth").alias("length")), "first").where("depth < length")
    leaves = sequences.join(inner.select(*_KEY).distinct(), _KEY, "left_anti").select("first", F.lit(1).alias("leaf"))
    owners = prefixes.groupBy(*_KEY).agg(F.min("first").alias("owner"), F.first("before").alias("before"))
    owned = owners.groupBy(F.col("owner").alias("first")).agg(
        F.min("depth").alias("own_depth"), F.min_by("before", "depth").alias("own_before"))
    facts = staged(sequences.select("first", "weight", "total").join(leaves, "first", "left").join(owned, "first", "left"), "facts")
    rest = F.col("total") - F.col("before")
    apart = F.when(F.col("depth") >= F.col("own_depth"), rest).otherwise(
        F.coalesce(F.col("total") - F.col("own_before"), F.lit(0)))
    nodes = staged(prefixes.join(facts, "first").groupBy(*_KEY).agg(
        F.min("first").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.coalesce(F.sum("leaf"), F.lit(0)).cast("bigint").alias("n_leaves"),
        F.sum(F.col("weight") * rest - apart).alias("saved_tokens"),
        F.first("y1").alias("y1"), F.first("y2").alias("y2"),
        F.min_by("own_depth", "first").alias("own_depth")), "nodes")
    below = nodes.where("depth > 0")
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("y1").alias("x1"), F.col("y2").alias("x2")).agg(
        F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, _KEY, "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")), "nodes_children")
    parents = _parents(nodes)
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("own_depth"), F.col("up_conv_id")).otherwise(
        F.col("conv_id"))
    found = nodes.join(parents, _KEY, "left").join(ends_digests(whole), _KEY, "left")
    return found.select(
        "conv_id", "depth", parent.cast("bigint").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations. No conversations give no rows, not even a root."""
    turns = numbered_turns(conversations)
    return trie(rebuilt_turns(turns), turns.select("conv_id").distinct())


def trie_sql() -> str:
    """The same rows as SQL for DuckDB: whole prefixes as keys, and every node joined to all nodes below it."""
    return rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(coalesce(role, ''), {_LEAD}),
      left(coalesce(text, ''), {_LEAD}), md5(coalesce(role, '')), md5(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM t),
crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, 8 AS b, CAST(4294967295 AS BIGINT) AS c FROM ids
  UNION ALL
  SELECT conv_id, s, CASE WHEN b = 8 THEN k + 1 ELSE k END, CASE WHEN b = 8 THEN 1 ELSE b + 1 END,
    CASE WHEN (CASE WHEN b = 8 THEN xor(c, CAST(ascii(s[k + 1]) AS BIGINT)) ELSE c END) & 1 = 1
      THEN xor((CASE WHEN b = 8 THEN xor(c, CAST(ascii(s[k + 1]) AS BIGINT)) ELSE c END) >> 1, 3988292384)
      ELSE (CASE WHEN b = 8 THEN xor(c, CAST(ascii(s[k + 1]) AS BIGINT)) ELSE c END) >> 1 END
  FROM crc WHERE b < 8 OR k < length(s)),
h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS base FROM crc WHERE b = 8 AND k = length(s)),
r AS (
  SELECT h.conv_id, 0 AS part, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.pos < h.h
  UNION ALL
  SELECT h.conv_id, 1, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos >= h.h),
w AS (
  SELECT ids.conv_id, coalesce(turns, []) AS turns FROM ids LEFT JOIN (
    SELECT conv_id, list({{'r': role, 't': text}} ORDER BY part, pos) AS turns FROM r GROUP BY conv_id) USING (conv_id)),
m AS (SELECT conv_id, len(turns) AS total, unnest(range(0, len(turns) + 1)) AS depth, turns FROM w),
n AS (
  SELECT depth, turns[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
    CAST((count(*) - 1) * coalesce(strlen(any_value(turns[depth].t)), 0) AS BIGINT) AS saved,
    sha256(coalesce(string_agg(CASE WHEN total = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM m GROUP BY depth, turns[1:depth]),
u AS (SELECT n.*, parent.conv_id AS parent_conv_id FROM n LEFT JOIN n AS parent
  ON parent.depth = n.depth - 1 AND parent.p = n.p[1:n.depth - 1]),
kids AS (SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN kids USING (depth, p)),
up AS (SELECT unnest(range(0, depth + 1)) AS depth, p, saved, n_children FROM v),
below AS (SELECT depth, p[1:depth] AS p, CAST(sum(saved) AS BIGINT) AS saved_tokens, count_if(n_children = 0) AS n_leaves
  FROM up GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, saved_tokens, ends_sha256
FROM v JOIN below USING (depth, p)"""
