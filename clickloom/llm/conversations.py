"""Logged conversations rendered as chat text, without the snapshots that longer ones contain.

A log that writes the whole conversation after each turn holds many prefixes of one conversation. Each turn gets a hash
of its position, role and text; the exclusive-or over the first turns is the hash of that prefix and rolls on turn by
turn. A conversation whose hash is a proper prefix's hash of another one is dropped by an anti-join; equal
conversations leave the one with the smallest id. Only column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.plans.workspace import staged

# Turns of one text row; a longer conversation has several, so no row gathers an unbounded conversation.
CHUNK = 256
# Turns whose order one task finds at a time.
_BLOCK = 256
_HASH = ["x1", "x2"]


def _positions(turns: DataFrame) -> DataFrame:
    """Turns with ``pos`` (from 0) in their conversation, counted block by block."""
    order = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    counts = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    here = (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("b"))
    ranked = turns.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.join(offsets, here).select("conv_id", "block", (F.col("first") + F.col("rank")).alias("pos"), "role", "text")


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos``, ``role``, ``text`` and the 128-bit hash ``x1``, ``x2`` of the prefix that ends there.

    Turns are ordered by number (missing ones first), then role and text. Equal rows are one turn. Rows without a
    conversation id belong to no conversation. A missing role means user, a missing text is empty.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    turns = turns.withColumn("block", F.floor(F.col("turn") / _BLOCK))
    placed = _positions(turns)
    for k, name in enumerate(_HASH):
        placed = placed.withColumn(name, F.xxhash64(F.lit(k + 1), "pos", "role", "text"))
    placed = placed.withColumn("block", F.floor(F.col("pos") / _BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("conv_id", "block").agg(*[F.bit_xor(x).alias(x) for x in _HASH])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outside = totals.select("conv_id", "block", *[
        F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"{x}_before") for x in _HASH])
    rolled = placed.select("conv_id", "block", "pos", "role", "text", *[F.bit_xor(x).over(inside).alias(x) for x in _HASH])
    return rolled.join(outside, ["conv_id", "block"]).select(
        "conv_id", "pos", "role", "text", *[F.col(x).bitwiseXOR(F.col(f"{x}_before")).alias(x) for x in _HASH])


def maximal(hashed: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``copies`` of the conversations that are no proper prefix of another one.

    ``copies`` counts equal conversations, of which the smallest id stays.
    """
    last = F.max_by(F.struct(*_HASH), "pos").alias("whole")
    whole = hashed.groupBy("conv_id").agg(F.count("*").alias("n_turns"), last).select("conv_id", "n_turns", "whole.*")
    one = whole.groupBy("n_turns", *_HASH).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = hashed.select("conv_id", "pos", *_HASH).join(one.select("conv_id", "n_turns"), "conv_id").where(
        F.col("pos") + 1 < F.col("n_turns"))
    prefixes = inner.select((F.col("pos") + 1).alias("n_turns"), *_HASH).distinct()
    return one.join(prefixes, ["n_turns", *_HASH], "left_anti").select("conv_id", "n_turns", "copies")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn between start and end marks; marks inside the text are opened up, so that none can be forged."""
    safe = F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<| $1 |>")
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), safe, F.lit("<|im_end|>\n"))


def render_maximal(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id``, ``chunk``, ``n_turns``, ``copies`` and ``text`` of every conversation that is kept.

    A conversation of up to ``chunk`` turns is one row, a longer one several, numbered from 0, whose texts follow each
    other. ``n_turns`` counts the whole conversation. No conversations give no rows.
    """
    hashed = staged(prefix_hashes(conversations), "prefixes")
    kept = maximal(hashed)
    rows = hashed.select("conv_id", "pos", rendered_turn(F.col("role"), F.col("text")).alias("turn")).join(kept, "conv_id")
    grouped = rows.groupBy("conv_id", F.floor(F.col("pos") / chunk).alias("chunk"), "n_turns", "copies").agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn"))).alias("turns"))
    return grouped.select("conv_id", "chunk", "n_turns", "copies",
                          F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("text"))


def rendering_sql() -> str:
    """The same rows as SQL for DuckDB, for conversations of up to one chunk, by comparing the turns themselves."""
    return r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS turns,
    string_agg('<|im_start|>' || role || chr(10) || regexp_replace(text, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g')
      || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text
  FROM t GROUP BY conv_id),
one AS (SELECT turns, min(conv_id) AS conv_id, any_value(text) AS text, count(*) AS copies FROM c GROUP BY turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM one))
SELECT conv_id, CAST(0 AS BIGINT) AS chunk, CAST(len(turns) AS BIGINT) AS n_turns, copies, text
FROM one WHERE turns NOT IN (SELECT turns FROM p)"""
