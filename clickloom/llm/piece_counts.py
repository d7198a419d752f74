"""Token counts from pre-token frequencies: no text is ever turned into ids.

No piece of the model has a space sign after another character, so no merge crosses a place where a space follows
another character, and the tokens of a text are those of its pre-tokens (a word with the spaces before it). Each
distinct pre-token of the corpus is counted once; a text's count is the sum over its pre-tokens. The most frequent
pre-tokens, bounded in number and length, reach the tasks as a dictionary; all others are joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import batches
from clickloom.plans.workspace import staged

# The dictionary holds at most so many pre-tokens of at most so many bytes each; the join has the rest.
FREQUENT = 400_000
FREQUENT_BYTES = 64
# Distinct pre-tokens that a task counts before it hands them on.
_FLUSH = 400_000
_RUNS = re.compile(r" *[^ ]+| +")
_SIGN = "▁"


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first space; every text starts with one space of the tokenizer's own.

    The space sign itself means a space. A text that ends in spaces ends with a pre-token of spaces, of which the
    first is left out, so a single one gives an empty string.
    """
    if not text:
        return []
    if _SIGN in text:
        text = text.replace(_SIGN, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [run[1:] for run in _RUNS.findall(" " + text)]
    return text.split(" ")


def _frequencies(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pre_token", "n"])
        seen.clear()
        return batch

    for batch in batches.slices(source):
        for text in batch.column("text").to_pylist():
            seen.update(pre_tokens(text))
        if len(seen) > _FLUSH:
            yield flush()
    if seen:
        yield flush()


def _counter(model_path: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches.slices(source, 8192):
            words = batch.column("pre_token").to_pylist()
            sizes = [len(ids) if word else 1 for word, ids in zip(words, model.encode(words, num_threads=1), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("pre_token"), batch.column("n"), pa.array(sizes, pa.int64())],
                ["pre_token", "n", "pieces"])

    return run


def _crossing(model_path: str) -> bool:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return any(re.search(f"[^{_SIGN}]{_SIGN}", model.id_to_piece(k)) for k in range(model.get_piece_size()))


def piece_table(rows: DataFrame, model_path: str) -> DataFrame:
    """``pre_token``, its number ``n`` in the corpus and its ``pieces``, written, one row per distinct pre-token."""
    counts = rows.select("text").mapInArrow(_frequencies, "pre_token string, n bigint").groupBy("pre_token").agg(
        F.sum("n").alias("n"))
    return staged(counts.mapInArrow(_counter(model_path), "pre_token string, n bigint, pieces bigint"), "pieces")


def _least_frequency(table: DataFrame, limit: int) -> float:
    """Smallest frequency such that at most ``limit`` short pre-tokens have it or more; from a histogram."""
    step = F.floor(F.log2("n") * 8)
    histogram = table.where(F.octet_length("pre_token") <= FREQUENT_BYTES).groupBy(step.alias("step")).agg(
        F.count("*").alias("words"), F.min("n").alias("least"))
    total, least = 0, float("inf")
    for row in sorted(histogram.collect(), key=lambda r: -r["step"]):  # a few hundred rows at most
        total += row["words"]
        if total > limit:
            break
        least = row["least"]
    return least


def _texts_in_parts(frequent):
    """Rows of a text: one with the sum over dictionary pre-tokens, and one for each other pre-token."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = frequent.value.get
        row = TaskContext.get().partitionId() << 40
        kinds = {"row": pa.int64(), "doc_id": pa.int64(), "n_bytes": pa.int64(), "base": pa.int64(),
                 "pre_token": pa.string(), "times": pa.int64()}
        for batch in batches.slices(source):
            out: list[list] = [[] for _ in kinds]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, rest = 0, []
                for word, times in Counter(pre_tokens(text)).items():
                    size = pieces_of(word)
                    if size is None:
                        rest.append((word, times))
                    else:
                        base += size * times
                # A text of dictionary words alone has one row that meets no partner, under a key of its own.
                rest = rest or [(f"{row}", 0)]
                size = len(text.encode())
                for k, (word, times) in enumerate(rest):
                    for column, value in zip(out, (row, doc_id, 0 if k else size, 0 if k else base, word, times),
                                             strict=True):
                        column.append(value)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds.values(), strict=True)], list(kinds))

    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
                 frequent: int = FREQUENT) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every document.

    One row per input row, repeated rows included. A null or empty text has no bytes and no tokens. ``model_path`` is a
    sentencepiece BPE model; one whose pieces hold a space inside is refused, since its texts cannot be taken apart.
    """
    if _crossing(model_path):
        raise ValueError("the model has pieces that reach over a space")
    spark = docs.sparkSession
    rows = batches.texts(docs, id_col, text_col)
    table = piece_table(rows, model_path)
    least = _least_frequency(table, frequent)
    common = (F.col("n") >= F.lit(least)) & (F.octet_length("pre_token") <= FREQUENT_BYTES)
    dictionary = spark.sparkContext.broadcast({r["pre_token"]: r["pieces"] for r in table.where(common).collect()})
    parts = rows.mapInArrow(_texts_in_parts(dictionary), "row bigint, doc_id bigint, n_bytes bigint, base bigint, "
                            "pre_token string, times bigint")
    joined = parts.join(table.where(~common).select("pre_token", "pieces"), "pre_token", "left")
    tokens = F.col("base") + F.col("times") * F.coalesce(F.col("pieces"), F.lit(0))
    counted = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
