from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from clickloom.llm import queries, simhash
from clickloom.llm.components import components


def naive_print(text: str) -> int:
    words = text.encode().lower().split()
    n = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_groups(prints: dict, radius: int = 2) -> dict:
    """doc id -> smallest id reachable."""
    ids, group = sorted(prints), {}
    for first in ids:
        if first in group:
            continue
        todo = [first]
        group[first] = first
        while todo:
            d = todo.pop()
            for e in ids:
                if e not in group and (prints[d] ^ prints[e]).bit_count() <= radius:
                    group[e] = first
                    todo.append(e)
    return group


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = random.Random(radius)
    for _ in range(30):
        near = [rng.getrandbits(64) for _ in range(3)]
        values = np.unique(np.array([b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6)))
                                     for b in near for _ in range(20)], dtype="<u8"))
        planes, numbers = simhash.bit_planes(values), [int(v) for v in values]
        for q in numbers:
            expected = sum(1 << j for j, x in enumerate(numbers) if (x ^ q).bit_count() <= radius)
            assert simhash.within(planes, (1 << len(numbers)) - 1, q, radius) == expected


def test_query_equals_brute_force(spark, sf_dir, texts):
    prints = {d: naive_print(t) for d, t in texts.items()}
    groups = naive_groups(prints)
    rows = queries.queries()["op3_simhash"](spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {
        (d, f"{prints[d]:016x}", groups[d]) for d in texts}


def test_links_in_blocks(spark, monkeypatch):
    """Dense groups that share files of several blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = {i: rng.choice(base) ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for i in range(400)}
    nodes = spark.createDataFrame([(simhash._signed(p),) for p in set(prints.values())], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(nodes, 2)).collect()}
    found = defaultdict(set)
    for i, p in prints.items():
        found[roots.get(simhash._signed(p), simhash._signed(p))].add(i)
    expected = defaultdict(set)
    for i, first in naive_groups(prints).items():
        expected[first].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_components(spark):
    rng = random.Random(1)
    links = [(a, a + 1) for a in range(0, 200)] + [(1000, b) for b in range(1001, 1200)] + [(5000, 5000), (7, 3)]
    rng.shuffle(links)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1200)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.simhash_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    blank = {(r.doc_id, r.component_id) for r in rows if r.fp == 0}
    assert blank == {(3, 3), (4, 3), (5, 3), (None, 3)}
    assert [r.component_id for r in rows if r.doc_id == 2] == [1, 1]
    assert simhash.simhash_groups(no_docs).count() == 0
    kept = sorted(r.doc_id for r in simhash.keep_one(odd_docs).collect() if r.doc_id is not None)
    assert kept == [1, 3, 6, 7, 8, 9]
    assert simhash.keep_one(odd_docs).columns == odd_docs.columns
