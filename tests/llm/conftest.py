import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def documents(spark):
    """A table of ``(doc_id, text)`` pairs with columns whose names clash with results."""

    def make(rows, **more):
        extra = {"fp": "x", "h1": "y", "keep": "z", "score": "s", "lang": "en", **more}
        full = [(d, t, *extra.values()) for d, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra))

    return make


ODD = [(None, None), (None, ""), (1, None), (2, ""), (3, " \n\t\n "), (4, "a"), (5, "Ünïcödé ß"), (6, "word " * 60_000), (7, "same text here"), (7, "same text here"), (8, "x" * 50_000)]


@pytest.fixture(scope="session")
def odd(documents):
    """Null ids and texts, empty, blank, short and long texts, and a repeated row."""
    return documents(ODD)


@pytest.fixture(scope="session")
def empty(documents):
    return documents(ODD).where("false")
