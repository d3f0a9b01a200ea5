from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs; two partitions, so that nothing leans on one."""

    def make(pairs, lang="en"):
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(2, "doc_id", "text") if rows else spark.createDataFrame([], DOCS)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, repeated rows, ties, long and non-Latin texts."""
    long = " ".join(f"word{i % 977} and{i % 31}." for i in range(30_000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "a"), (6, "one two three"), (6, "one two three"), (7, long), (8, long + " tail"), (None, "no id here at all"), (9, "日本語 текст \U0001f600 ünï"), (10, "-- !! ##")]


@pytest.fixture(scope="session")
def clashing(spark):
    """Documents with columns named as operators' own."""
    names = "doc_id long, text string, lang string, source string, n_chars long, class long, key long, score double, spans string, h long, k0 string, component string, label int, _text string"
    return spark.createDataFrame([(1, "some text here now and more", "en", "s", 27, 5, 6, 0.5, "x", 7, "y", "z", 1, "w"), (2, "other text there then", "de", "s", 21, 5, 6, 0.5, "x", 7, "y", "z", 1, "w")], names)
