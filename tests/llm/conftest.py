"""Shared inputs: documents with every awkward case, and builders for small tables."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, band bigint"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, lang, source]) rows, with further columns of clashing names."""

    def build(rows):
        full = []
        for r in rows:
            i, text, lang, source = (*r, "en", "src0")[:4] if len(r) < 4 else r
            full.append((i, text, lang, source, len(text or ""), 0.5, "x", 7))
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, LABELS)


LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
AWKWARD = [
    (1, None, None, None),
    (2, "", "en", ""),
    (3, " \t\n ", "en", "src0"),
    (4, "one", "en", "src0"),
    (5, "one", "en", "src1"),
    (6, "same words here and there " * 30, "de", "src0"),
    (6, "same words here and there " * 30, "de", "src0"),
    (7, "same words here and there " * 30, "de", None),
    (8, LONG, "en", "src0"),
    (9, "Éa K İ \U0001f600 ▁ mit license\r\nx", "fr", "src2"),
]


@pytest.fixture(scope="session")
def awkward(docs_of):
    return docs_of(AWKWARD)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])
