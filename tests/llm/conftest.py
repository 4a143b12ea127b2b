import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def docs_of(spark):
    """A documents table of a dict or list of (id, text), with columns whose names may clash."""

    def make(rows):
        pairs = list(rows.items()) if isinstance(rows, dict) else list(rows)
        return spark.createDataFrame(
            [(i, t, "x", 1, 2, "y") for i, t in pairs],
            "doc_id long, text string, name string, band int, doc long, key string",
        )

    return make
