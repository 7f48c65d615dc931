"""Small tables of documents for the tests."""

from __future__ import annotations

DOCS = "/root/testdata/sf0.001/documents.parquet"


def real_docs(spark, rows):
    return spark.read.parquet(DOCS).orderBy("doc_id").limit(rows)


def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    long_text = " ".join(f"Word{i % 977} and" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat, and the dog sat too.", "en", "a", 44, 0.5, True),
        (1, "The cat sat on the mat, and the dog sat too.", "en", "a", 44, 0.5, True),
        (2, "the CAT sat on the mat, and the dog sat too.", "en", None, 44, None, None),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 0.1, False),
        (5, " \t\n ", "de", "b", 4, 0.1, False),
        (None, "A text without an id, on its own.", "en", "a", 33, 1.0, True),
        (None, None, "fr", None, None, None, None),
        (6, long_text, "en", "c", len(long_text), 2.0, True),
        (7, long_text, "en", "c", len(long_text), 2.0, True),
        (8, "Ünïcode wörds: 😀 日本語 x", "de", "😀", 24, 2.0, True),
        (9, "one", "en", "c", 3, 2.0, True),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean"
    return spark.createDataFrame(rows, schema)
