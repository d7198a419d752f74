"""Token files, token counts and packing against the tokenizer libraries on whole texts."""

from __future__ import annotations

import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clickloom.llm import elias_fano, packing, piece_counts, queries, token_files, tokens

BYTES = tokens.public_vocabulary("byte_bpe_50k.json", 0, True)
WORDS = tokens.public_vocabulary("word_bpe_49k.json", 1, False)
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a  b", "a\n b", "\n  x", "a \n b  ", "don't we 'll go", "<|endoftext|> a<|endoftext|>b,", " a  b",
       "x\x1c y\x85 z", "İ ß ﬁ é é ́a ÀÉ", "12 345 a1", "\t\t a\r\n b", "Σας ΣΑΣ", "word, word. word.,", "▁", "a ▁", "<s>"]


@functools.cache
def tokenizer_of(path):
    return Tokenizer.from_file(path)


def whole(vocabulary, text):
    return tokenizer_of(vocabulary.path).encode(text, add_special_tokens=False).ids + [vocabulary.end_id]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("vocabulary", [BYTES, WORDS])
def test_pieces_give_the_ids_of_whole_texts(vocabulary, texts):
    rng = random.Random(1)
    odd = ODD + ["".join(rng.choice("ab '\n\t.,1é́s <|>") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    tokenizer = Tokenizer.from_file(vocabulary.path)
    for some in (odd, list(texts.values())[:100]):
        for text, ids in zip(some, tokens.encoder(vocabulary)(some), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [vocabulary.end_id], text[:80]


def test_small_memory(monkeypatch, texts):
    monkeypatch.setattr(tokens, "MEMORY", 10)
    encode, some = tokens.encoder(BYTES), list(texts.values())[:20]
    for text in some:
        assert encode([text])[0].tolist() == whole(BYTES, text)


def test_elias_fano():
    rng = random.Random(5)
    for _ in range(200):
        n, u = rng.randint(0, 900), rng.choice([0, 3, 100, 10**5, 2**40, 2**63])
        numbers = np.array(sorted(rng.randint(0, u) for _ in range(n)), dtype=np.uint64)
        data = elias_fano.EliasFano.of(numbers).to_bytes()
        code, end = elias_fano.EliasFano.read(memoryview(data), 0)
        assert end == len(data) and (code.all() == numbers).all()
        assert all(code.select(k) == int(numbers[k]) for k in rng.sample(range(n), min(n, 20)))
    many = np.cumsum(np.full(10_000, 500)).astype(np.uint64)
    assert len(elias_fano.EliasFano.of(many).to_bytes()) * 8 / len(many) < 12  # 64 in a table


def test_token_file():
    ids, lengths = [None, None, -2**63, -5, -5, 0, 7, 2**63 - 1], [3, 0, 1, 2, 0, 5, 1, 1]
    content = elias_fano.pack_file(ids, np.array(lengths), [np.arange(n, dtype="<u2").tobytes() for n in lengths], 2)
    file = elias_fano.TokenFile(content)
    assert file.doc_ids() == ids
    assert [file.tokens(k).tolist() for k in range(8)] == [list(range(n)) for n in lengths]
    with pytest.raises(ValueError):
        elias_fano.TokenFile(b"something else")


def test_files_of_the_query(spark, sf_dir, texts):
    expected, at = {}, 0
    for d in sorted(texts):
        ids = whole(BYTES, texts[d])
        expected[d] = (at, len(ids), crc(ids))
        at += len(ids)
    rows = queries.queries()["op4_token_files"](spark, sf_dir).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == expected


def test_many_small_files_and_odd_rows(spark, odd_docs, no_docs, tmp_path):
    manifest = token_files.write_tokens(odd_docs, str(tmp_path), BYTES, ids_per_file=10)
    rows = sorted(token_files.read_tokens(spark, str(tmp_path), manifest).collect(), key=lambda r: r.start)
    assert manifest.count() > 5
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r.start for r in rows[1:]] == list(np.cumsum([r.n_tokens for r in rows])[:-1])
    assert [r.n_tokens for r in rows if r.doc_id in (3, 4)] == [1, 1]
    assert token_files.round_trip(no_docs, BYTES).count() == 0


@pytest.mark.parametrize("frequent", [piece_counts.FREQUENT, 50, 0])
def test_token_counts(spark, sf_dir, texts, frequent):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = piece_counts.count_tokens(docs, PIECES, frequent=frequent).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        (d, len(t.encode()), n := len(model.encode(t)), n > 4096) for d, t in texts.items()}


def test_pre_tokens():
    model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(2)
    for text in ODD + ["".join(rng.choice("ab \n▁é1.<s>") for _ in range(rng.randint(0, 20))) for _ in range(2000)]:
        assert sum(len(model.encode(w)) if w else 1 for w in piece_counts.pre_tokens(text)) == len(model.encode(text)), text


def test_token_counts_of_odd_rows(odd_docs, no_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = sorted((r.doc_id or 0, len(model.encode(r.text or ""))) for r in odd_docs.collect())
    for frequent in (100, 0):
        rows = piece_counts.count_tokens(odd_docs, PIECES, frequent=frequent).collect()
        assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == expected
    assert piece_counts.count_tokens(no_docs, PIECES).count() == 0


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark, sf_dir, texts):
    expected = set()
    for d, t in texts.items():
        ids = whole(WORDS, t)
        expected |= {(d, s // 4096, s, len(ids[s:s + 4096]), crc(ids[s:s + 4096])) for s in range(0, len(ids), 4096)}
    rows = queries.queries()["op9_packing"](spark, sf_dir).collect()
    assert len(rows) == len(expected)
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected
    least = -(-sum(r.length for r in rows) // 4096)
    assert check_packing(rows, 4096) <= least * 1.03 + 2


def test_sum_of_squares_takes_the_least_change():
    rng, capacity = random.Random(4), 40
    packer, gaps = packing.SumOfSquares(capacity), defaultdict(int)
    for _ in range(500):
        length = rng.randint(1, capacity)
        if length < capacity:
            def total(gap, length=length):
                after = dict(gaps)
                if gap != capacity:
                    after[gap] -= 1
                after[gap - length] = after.get(gap - length, 0) + 1
                return sum(n * n for g, n in after.items() if g)
            options = {g: total(g) for g in [*[g for g, n in gaps.items() if n and g >= length], capacity]}
        number, offset = packer.place(length)
        gap = capacity - offset
        if length < capacity:
            assert options[gap] == min(options.values())
        if gap != capacity:
            gaps[gap] -= 1
        if gap > length:
            gaps[gap - length] += 1


def test_packing_odd_rows(odd_docs, no_docs):
    cut = packing.pieces(odd_docs, WORDS, 64, with_ids=True)
    rows = packing.pack(cut, 64, pieces_per_task=50).collect()
    assert len(rows) == cut.count() and all(len(r.ids) == 4 * r.length for r in rows)
    check_packing(rows, 64)
    assert sorted(r.length for r in rows if r.doc_id in (3, 4)) == [1, 1]
    assert packing.pack(packing.pieces(no_docs, WORDS)).count() == 0
