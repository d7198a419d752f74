"""Ranked lexical search over posting lists that are cut into blocks of similar documents.

The index is partitioned by documents: a shard is some hundred documents of one task. In a shard, every term's posting
list is clustered by document similarity, and each block keeps the coordinatewise maximum of its documents' impacts. An
item's terms are taken from rare to frequent; a block is skipped only when its summary proves that no document in it
reaches the item's k-th best score so far, so the result is that of scoring everything.

Scores are integers: an impact is (10^9 tf) div (1000 tf + 12 m), and a term's weight multiplies it on the query's side.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm import batches
from clickloom.plans.workspace import staged

SHARD = 1024
# Documents of one block, about.
BLOCK = 64
_SKETCH = 16
# Items and bytes of item texts that are searched in one pass; more items take more passes over the corpus.
ITEMS_PER_PASS = 4096
ITEM_BYTES_PER_PASS = 4 << 20
# An item's rows from all tasks are ranked in so many groups before they meet.
_GROUPS = 64
# Letters and digits stay, A-Z become small, all other ASCII becomes a blank; bytes of longer characters stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in their order."""
    return text.translate(_FOLD).split()


class Query(NamedTuple):
    """An item with its terms as numbers of the vocabulary, and how often it has each."""

    number: int
    item_id: int | None
    terms: np.ndarray
    counts: np.ndarray


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# --- one shard -----------------------------------------------------------------------------------------------------


class Best:
    """The k best (score, id): higher scores first, then smaller ids; a missing id comes last among equals."""

    def __init__(self, k: int):
        self.k = k
        self.heap: list[tuple[int, int, int]] = []

    def bar(self) -> int:
        """Scores below this change nothing."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def rows(self) -> list[tuple[int, int | None]]:
        return [(score, -minus if known else None) for score, known, minus in self.heap]


class Shard:
    """Impacts of some documents, and blocked posting lists with summaries.

    ``partners[t]`` are the vocabulary terms that some item has together with term t: a summary of a block of t's list
    needs no other coordinates.
    """

    def __init__(self, ids: list, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, partners: dict[int, np.ndarray],
                 block: int = BLOCK):
        self.ids, self.block, self.partners = ids, block, partners
        self.terms, columns = np.unique(terms, return_inverse=True)
        self.column = {int(t): k for k, t in enumerate(self.terms)}
        self.impacts = np.zeros((len(ids), len(self.terms)), dtype=np.int32)
        self.impacts[rows, columns] = impacts
        # Signs by term number: equal terms have equal directions in every shard.
        signs = ((self.terms[:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.arange(
            32, 32 + _SKETCH, dtype=np.uint64)) & np.uint64(1)
        sketch = np.sqrt(self.impacts, dtype=np.float32) @ (2 * signs.astype(np.float32) - 1)
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        self.lists: dict[int, tuple] = {}
        self.scored = 0

    def _list(self, term: int) -> tuple:
        """Documents of a term, its blocks, the coordinates of their summaries, and the summaries."""
        if term not in self.lists:
            docs = np.flatnonzero(self.impacts[:, self.column[term]])
            wanted = np.array([c for c in map(self.column.get, self.partners[term].tolist()) if c is not None])
            blocks = [docs]
            if len(docs) > self.block:
                centres = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // self.block)).astype(int)]
                nearest = (self.sketch[docs] @ self.sketch[centres].T).argmax(axis=1)
                order = np.argsort(nearest, kind="stable")
                blocks = np.split(docs[order], np.flatnonzero(np.diff(nearest[order])) + 1)
            summaries = np.stack([self.impacts[b][:, wanted].max(axis=0) for b in blocks])
            self.lists[term] = docs, blocks, {int(c): k for k, c in enumerate(wanted)}, summaries
        return self.lists[term]

    def search(self, query: Query, weights: np.ndarray, best: Best) -> None:
        """Offer every document of the shard that can be among the best."""
        found = [(int(weights[t]), int(t), int(n)) for t, n in zip(query.terms, query.counts, strict=True)
                 if int(t) in self.column and weights[t] > 0]
        found.sort(key=lambda f: (-f[0], f[1]))
        columns = np.array([self.column[t] for _, t, _ in found], dtype=int)
        factors = np.array([w * n for w, _, n in found], dtype=np.int64)
        if not found:
            return
        most = self.impacts[:, columns].max(axis=0).astype(np.int64) * factors
        # The most that a document can have whose first term is this one or a later one.
        left = np.cumsum(most[::-1])[::-1]
        met = np.zeros(len(self.ids), dtype=bool)
        for k, (_, term, _) in enumerate(found):
            if left[k] < best.bar():
                return
            docs, blocks, place, summaries = self._list(term)
            # Documents with an earlier term have been dealt with, so only this and later terms count.
            coordinates = [place[c] for c in columns[k:].tolist()]
            bounds = summaries[:, coordinates].astype(np.int64) @ factors[k:]
            for b in np.argsort(-bounds, kind="stable").tolist():
                if bounds[b] < best.bar():
                    break
                new = blocks[b][~met[blocks[b]]]
                scores = self.impacts[new][:, columns[k:]].astype(np.int64) @ factors[k:]
                self.scored += len(new)
                bar = best.bar()
                for d in np.flatnonzero(scores >= bar).tolist():
                    best.add(int(scores[d]), self.ids[new[d]])
            met[docs] = True


# --- the corpus ----------------------------------------------------------------------------------------------------

_FORWARD = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"


def _counter(vocabulary: dict[bytes, int]):
    """mapInArrow: length and counts of the asked terms of every text."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.slices(source):
            lengths, terms, tfs = [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                own = [(vocabulary[t], c) for t, c in Counter(words).items() if t in vocabulary]
                lengths.append(len(words))
                terms.append([t for t, _ in own])
                tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return run


def _partners(queries: list[Query]) -> dict[int, np.ndarray]:
    found: dict[int, set[int]] = {}
    for q in queries:
        own = q.terms.tolist()
        for t in own:
            found.setdefault(t, set()).update(own)
    return {t: np.array(sorted(p)) for t, p in found.items()}


def shard_of(batch: pa.RecordBatch, n_docs: int, n_terms: int, partners: dict[int, np.ndarray], block: int = BLOCK) -> Shard:
    """The shard of some forward rows. Impacts are computed as 64-bit integers and fit into 32."""
    lengths = batch.column("n").to_pylist()
    m = np.array([75 + 25 * n * n_docs // n_terms for n in lengths], dtype=np.int64)
    lists = batch.column("terms")
    sizes = np.array([len(x) for x in lists], dtype=int)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    impacts = 1_000_000_000 * tf // (1000 * tf + 12 * m[rows])
    return Shard(batch.column("doc_id").to_pylist(), rows, terms, impacts.astype(np.int32), partners, block)


_FOUND = "number int, item_id bigint, doc_id bigint, score bigint"


def _searcher(shared, k: int, shard: int, block: int):
    """mapInArrow over forward rows: the k best documents of this task for every item."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n_docs, n_terms, partners = shared.value
        best = [Best(k) for _ in queries]
        for batch in batches.slices(source, shard):
            here = shard_of(batch, n_docs, n_terms, partners, block)
            for q, own in zip(queries, best, strict=True):
                here.search(q, weights, own)
        rows = [(q.number, q.item_id, doc_id, score) for q, own in zip(queries, best, strict=True)
                for score, doc_id in own.rows()]
        if rows:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["number", "item_id", "doc_id", "score"])

    return run


def _pass(docs: DataFrame, items: list, k: int, shard: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    counts = [Counter(terms_of(bytes(r.text))) for r in items]
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*counts)))}
    queries = [Query(n, r.item_id, np.array([vocabulary[t] for t in c], dtype=np.int64),
                     np.array(list(c.values()), dtype=np.int64)) for n, (r, c) in enumerate(zip(items, counts, strict=True))]
    forward = staged(docs.mapInArrow(_counter(vocabulary), _FORWARD), "forward")
    n_docs, n_terms = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for term, df in asked.collect():  # one row per term of this pass's items
        weights[term] = weight(n_docs, df)
    shared = spark.sparkContext.broadcast((queries, weights, n_docs, n_terms, _partners(queries)))
    matching = forward.where(F.size("terms") > 0)
    return matching.mapInArrow(_searcher(shared, k, shard, block), _FOUND)


def _ranked(rows: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", shard: int = SHARD, block: int = BLOCK,
                  items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of each item's ``k`` best documents with a score above 0.

    All documents are ranked for all items. A null or empty text, of a document or an item, has no terms. Every row is
    a document of its own, also where ids or texts repeat; a missing document id ranks last among equal scores. Equal
    rows of the items count once; rows that share an item id only are ranked apart. Items are searched in passes of
    bounded size, so what the driver and the tasks hold of them does not grow with their number.
    """
    asked = staged(items.select(
        F.col(item_col).cast("bigint").alias("item_id"),
        F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("text")).distinct(), "items")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(-(-n // items_per_pass), -(-size // ITEM_BYTES_PER_PASS), 1)
    texts = batches.texts(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    found = None
    for p in range(passes):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()
        rows = _pass(texts, own, k, shard, block)
        grouped = _ranked(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_GROUPS))), k, "number", "part")
        top = _ranked(grouped.drop("rank", "part"), k, "number").select("item_id", "rank", "doc_id", "score")
        found = top if found is None else found.unionByName(top)
    return found


def search_sql(k: int = 20) -> str:
    """The same rows as SQL for DuckDB, by scoring every pair of an item and a document that share a term."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def split(column: str) -> str:
        return f"regexp_extract_all(translate(coalesce({column}, ''), '{upper}', '{lower}'), '{pattern}')"

    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {split('text')} AS terms FROM documents),
s AS (SELECT count_if(len(terms) > 0) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d),
i AS (SELECT row_number() OVER () AS number, item_id, unnest({split('text')}) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT number, item_id, term, count(*) AS times FROM i GROUP BY ALL),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
m AS (SELECT row, doc_id, 75 + ((25 * len(terms) * n) // l) AS m FROM d, s WHERE len(terms) > 0),
r AS (
  SELECT number, item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
  doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= {k}"""
