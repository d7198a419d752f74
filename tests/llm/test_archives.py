"""WARC archives, their merged index, the prefix trie and ranked search."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import pytest
from pyspark.sql import functions as F

from clickloom.llm import prefix_trie, ranked_search, warc

PAGES = [
    (1, "http://a.example.org/x?b=1#top", "<p>one</p>"), (2, "https://A.example.org:443/x", "<p>two</p>"),
    (3, "http://a.example.org/x?b=1", "<p>one</p>"), (4, None, None), (5, "", ""), (6, "no url\r\nX-Forged: 1", "é" * 70_000),
    (7, "http://a.example.org", "<p>one</p>"), (None, "http://b.example.org/", "<p>one</p>"),
    (None, "http://b.example.org/", "alone"), (None, "http://b.example.org/", "alone"), (9, "http://c.example.org/", "twin"),
    (9, "http://c.example.org/", "twin"), (10, "http://c.example.org/", "twin"),
]
_NAMES = "page_id bigint, url string, html string, owner int, n int, file string, sha1 string, revisit int"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "f", "s", 0) for r in rows], _NAMES)


def _expected(rows):
    least = {}
    for page_id, _, html in rows:
        text = html or ""
        known = [i for i in (least.get(text), page_id) if i is not None]
        least[text] = min(known, default=None)
    out = []
    for page_id, _, html in rows:
        data, owner = (html or "").encode(), least[html or ""]
        first = page_id == owner
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if first else "revisit", None if first else owner))
    return Counter(out)


def test_archives_of_odd_pages(spark):
    for rows, size in ((PAGES, warc.ARCHIVE_BYTES), (PAGES, 1), (PAGES * 3, 700), ([], 1)):
        found = warc.capture_histories(_pages(spark, rows), archive_bytes=size).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == _expected(rows)
        assert sorted(r.position for r in found) == list(range(len(rows)))
        by_key = defaultdict(list)
        for r in sorted(found, key=lambda r: r.position):
            by_key[r.url_key].append(r.capture)
        assert list(by_key) == sorted(by_key) and all(v == list(range(len(v))) for v in by_key.values())


def test_small_payloads_are_never_revisits(spark):
    found = warc.capture_histories(_pages(spark, PAGES), least_bytes=5).collect()
    assert {r.record_type for r in found if r.payload_bytes < 5} == {"response"}
    assert {r.page_id for r in found if r.record_type == "revisit"} == {3, 7, None}


def test_histories_in_small_ranges(spark, setting):
    """One URL with a third of all captures goes over many ranges, and its numbers go on."""
    setting("spark.sql.shuffle.partitions", "23")
    rows = [(i, "http://hot.example.org/" if i % 3 == 0 else f"http://h{i % 40}.example.org/p", f"v{i % 50}") for i in range(900)]
    pages = _pages(spark, rows).withColumn("seen", (F.col("page_id") * 7919) % 601)
    found = warc.capture_histories(pages, time_col="seen", archive_bytes=2000).orderBy("position").collect()
    order = [(r.url_key, r.captured_at, r.page_id) for r in found]
    assert order == sorted((warc.url_key(u), i * 7919 % 601, i) for i, u, _ in rows)
    assert [r.capture for r in found if r.url_key == "org,example,hot)/"] == list(range(300))


def test_records_round_trip():
    long = warc.Record(7, "http://x.org/ä b", 1_700_000_000, base64.b32encode(hashlib.sha1(b"q" * 300_000).digest()).decode(),
                       300_000, b"q" * 300_000)
    again = warc.Record(None, None, 0, "A" * 32, 5, None, 7)
    data = warc.pack_record(long) + warc.pack_record(again)
    (a, n, first), (b, _, second) = warc._members(data)
    assert (a, b) == (0, n) and warc.unpack_record(first) == long._replace(url="http://x.org/ä%20b")
    assert warc.unpack_record(second) == again
    with pytest.raises(ValueError):
        warc.unpack_record(first.replace(b"qqq\r\n\r\n", b"qqr\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc._members(data[:-9]))


def test_loser_tree_and_url_keys():
    rng = random.Random(3)
    for n in range(9):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 12))) for _ in range(n)]
        assert list(warc.merge([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    for url, key in (("HTTP://user@M.Example.org:80/A?b#c", "org,example,m)/A?b"), ("https://e.org:80", "org,e:80)/"),
                     ("http://e.org?q", "org,e)/?q"), ("mailto:x", "mailto:x"), (None, "")):
        assert warc.url_key(url) == key


# --- trie ----------------------------------------------------------------------------------------------------------


def _trie(rows):
    """Every prefix of every rebuilt conversation, plainly."""
    logged = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            logged[c].append((turn is not None, turn or 0, role or "", text or ""))
    logged = {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in logged.items()}
    rebuilt = {}
    for c, own in logged.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(logged.get(c - c % 5, [])[:h] + own[h:])
    # nodes by number: (parent, turn) -> node, made parents first
    number, members, ends, depth, up, size = {}, defaultdict(list), defaultdict(list), {0: 0}, {}, {0: 0}
    for c in sorted(rebuilt):
        node = 0
        members[0].append(c)
        for turn in rebuilt[c]:
            parent, node = node, number.setdefault((node, turn), len(number) + 1)
            depth[node], up[node], size[node] = depth[parent] + 1, parent, len(turn[1].encode())
            members[node].append(c)
        ends[node].append(c)
    children = Counter(up.values())
    leaves, saved = Counter(), Counter()
    for node in sorted(members, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * size[node]
        if node:
            leaves[up[node]] += leaves[node]
            saved[up[node]] += saved[node]
    return Counter((
        m[0], depth[n], members[up[n]][0] if n else None, len(m), children[n], leaves[n], saved[n],
        hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items())


def _conversations(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "x") for r in rows],
                                 "conv_id bigint, turn bigint, role string, text string, pos int, depth int, first string")


def _fuzzed(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(40)]), rng.choice([None, *range(7)]), rng.choice(["user", "a", None]),
             rng.choice(["x", "yy", "é", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("rows", [
    [], [(3, 1, "user", "a")], [(None, 1, "user", "a")], _fuzzed(1, 300), _fuzzed(2, 60) * 3,
    # one conversation with half of the rows, over several blocks, and one that extends it
    [(5, k, "user", f"t{k % 7}") for k in range(2500)] + [(6, k, "user", f"t{k % 7}") for k in range(2600)] + _fuzzed(3, 50),
    # equal conversations, whose list of ends takes several chunks
    [(k, t, "user", f"{t}") for k in range(0, 50_000, 5) for t in range(1)] + [(0, 1, None, "x" * 200_000)],
], ids=["none", "one", "no id", "fuzzed", "repeated", "long", "copies"])
def test_trie(spark, rows):
    found = prefix_trie.rebuilt_trie(_conversations(spark, rows)).collect()
    assert Counter(tuple(r) for r in found) == _trie(rows)


def test_trie_in_many_partitions(spark, setting):
    setting("spark.sql.shuffle.partitions", "37")
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = _fuzzed(4, 400)
    assert Counter(map(tuple, prefix_trie.rebuilt_trie(_conversations(spark, rows)).collect())) == _trie(rows)


# --- search --------------------------------------------------------------------------------------------------------


def _best(docs, items, k):
    """All documents scored one by one."""
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(
            c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    held = [(i, Counter(split(t))) for i, t in docs]
    n, total = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df, out = Counter(t for _, c in held for t in c), Counter()
    for item_id, text in set(items):
        scored = []
        for doc_id, c in held:
            if c:
                m = 75 + 25 * c.total() * n // total
                score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                            for t in split(text) if c[t])
                if score > 0:
                    scored.append((-score, doc_id is None, doc_id or 0))
        out.update((item_id, rank, None if missing else doc_id, -minus)
                   for rank, (minus, missing, doc_id) in enumerate(sorted(scored)[:k], 1))
    return out


def _words(rng, n, size=60):
    return " ".join(f"{rng.choice(['w', 'W', 'ü', 'É'])}{int(size * rng.random() ** 2)}" for _ in range(n))


ITEMS = [(1, "w1 w2 W3 ü4"), (1, "w1 w2 W3 ü4"), (1, "w5"), (2, None), (None, "w7 w8 w7"), (3, ""), (4, "nowhere"), (5, "w0 " * 5)]


def _check(spark, docs, items, **options):
    frame = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id bigint, text string, n int, terms int")
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, number int")
    found = ranked_search.top_documents(frame, asked, **options).collect()
    assert Counter(tuple(r) for r in found) == _best(docs, items, options.get("k", 20))


def test_search_of_odd_rows(spark, odd_docs):
    rng = random.Random(1)
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    docs += [(100 + i, _words(rng, rng.randint(0, 30))) for i in range(80)] + [(None, "w1 w2"), (200, "w1 w2"), (200, "w1 w2")]
    _check(spark, docs, [*ITEMS, (6, "word x quick fox")])
    _check(spark, docs, [], k=3)
    _check(spark, [], ITEMS)
    _check(spark, docs, [(9, _words(rng, 5000))], k=5)


@pytest.mark.parametrize("options", [{"shard": 16, "block": 2}, {"shard": 64, "block": 4, "k": 3}, {"items_per_pass": 3}])
def test_search_in_small_shards_blocks_and_passes(spark, options):
    """A third of the documents are copies of one, so most scores are equal."""
    rng = random.Random(2)
    copies = _words(rng, 25)
    docs = [(i, copies if i % 3 == 0 else _words(rng, rng.randint(1, 40))) for i in rng.sample(range(10_000), 300)]
    _check(spark, docs, [(i, _words(rng, rng.randint(1, 12))) for i in range(12)] + ITEMS, **options)


def test_blocks_are_skipped():
    """Documents with their own words each: an item's search scores its few documents only."""
    import numpy as np
    import pyarrow as pa

    rng, partners = np.random.default_rng(0), {t: np.arange(200) for t in range(200)}
    terms = [np.unique(np.concatenate([[0], 1 + (d % 20) * 9 + rng.integers(0, 9, 6)])) for d in range(1000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(1000)), pa.array([100] * 1000), pa.array([t.tolist() for t in terms], pa.list_(pa.int32())),
         pa.array([[1] * len(t) for t in terms], pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])
    shard = ranked_search.shard_of(batch, 1000, 100_000, partners, block=16)
    weights = np.array([1, *[100] * 199], dtype=np.int64)
    best = ranked_search.Best(5)
    shard.search(ranked_search.Query(0, 0, np.array([0, 1, 2, 3, 4]), np.ones(5, dtype=np.int64)), weights, best)
    impact = 1_000_000_000 // 2200
    full = sorted(((sum(int(weights[t]) * impact for t in (0, 1, 2, 3, 4) if t in set(own.tolist())), -d)
                   for d, own in enumerate(terms)), reverse=True)[:5]
    assert sorted(((s, -d) for s, d in best.rows()), reverse=True) == full
    assert shard.scored <= 60
