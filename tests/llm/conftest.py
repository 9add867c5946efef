import os

import numpy as np
import pytest

from quillspark.llm import _common


os.environ.setdefault("QUILLSPARK_SURROGATE_KEY", "a key of the tests")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} tail{i % 31}." for i in range(30000))
    base = "The quick brown fox jumps over the lazy dog while many other animals watch from the old barn near the river bank"
    rows = [
        (1, base, "en", "s", 1, 5, 0, "x"),
        (2, base, "en", None, 1, 5, 0, "x"),
        (2, base, "en", None, 1, 5, 0, "x"),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "s", 0, 1, 1, ""),
        (5, " \n\t ", "de", "s", 3, 2, 2, "k"),
        (None, "a text without a number of its own", "en", "s", 9, 2, 2, "k"),
        (6, long, "en", "s", len(long), 2, 2, "k"),
        (7, "one", "fr", "s", 3, 2, 2, "k"),
        (8, "One", "fr", "s", 3, 2, 2, "k"),
        (9, "é ü ▁ 😀 \u0000 <|endoftext|> 123-45-6789 a@b.example.com", "fr", "s", 3, 2, 2, "k"),
        (10, base + " today", "en", "s", 3, 2, 2, "k"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, band int, node int, kind string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(autouse=True)
def seeded():
    np.random.seed(0)
    assert _common.ARROW_ROWS > 0
