import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """``documents`` rows from ``(doc_id, text)`` or ``(doc_id, text, source)`` tuples."""

    def build(rows, partitions=3):
        full = [
            (row[0], row[1], "en", row[2] if len(row) > 2 else "s", len(row[1] or "")) for row in rows
        ]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return build


@pytest.fixture
def odd_docs(docs_of):
    """Nulls, empty and blank texts, equal rows, equal keys, a long text."""
    return docs_of(
        [
            (None, None, None),
            (None, "some words here", None),
            (1, None),
            (2, ""),
            (3, " \n\t "),
            (4, "one"),
            (5, "a text that stands twice " * 30),
            (5, "a text that stands twice " * 30),
            (6, "a text that stands twice " * 30),
            (7, "first"),
            (7, "second text of one key"),
            (8, "long " * 200_000),
            (9, "x" * 300_000),
        ]
    )


@pytest.fixture
def labels_of(spark):
    def build(rows):
        return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")

    return build
