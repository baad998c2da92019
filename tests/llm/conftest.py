"""Small tables for the operators on documents."""

from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text[, lang[, source]]) rows, in two partitions."""

    def make(rows, extra: str = ""):
        full = [(*row, *[None] * (4 - len(row)), None) for row in rows]
        frame = spark.createDataFrame(full, DOCUMENTS).repartition(2)
        return frame.selectExpr("*", extra) if extra else frame

    return make
