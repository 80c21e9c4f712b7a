from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Make a documents table of (doc_id, text) rows."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], DOC)

    return make
