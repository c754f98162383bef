import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table of documents from texts or (doc_id, text[, lang]) rows; extra columns carry names used inside."""

    def make(rows, extra=False):
        full = []
        for k, r in enumerate(rows):
            r = (k, r) if r is None or isinstance(r, str) else r
            full.append((r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1] or "")))
        frame = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            names = ("id", "n", "key", "h", "a", "b", "root", "row", "turn", "tree", "edits", "ids", "language", "score", "set_key")
            for name in names:
                frame = frame.selectExpr("*", f"1 AS `{name}`")
        return frame

    return make
