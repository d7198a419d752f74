from __future__ import annotations

import pytest

# Nulls in each column, empty and blank texts, repeated rows, equal ids, equal texts, and a long text.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (3, None, None), (4, "", "en"), (5, " \n\t ", "en"), (None, "no id here", None), (None, None, None),
    (6, "word " * 20_000, "en"), (7, "x" * 100_000, "en"), (8, "a  b\n\n c", "de"), (9, "Ünïcödé ß é́ 😀 end", "de"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd rows with extra columns that are named like results and helpers."""
    names = "doc_id bigint, text string, lang string, spans int, n_tokens int, fp int, kept int, shard int, block int"
    return spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0) for r in ROWS], names)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    """doc_id -> text of the small test table."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
