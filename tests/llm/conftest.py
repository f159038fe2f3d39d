import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hearthspark.llm.common import ship  # noqa: E402
from odd_rows import ODD  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs."""
    ship(spark)

    def make(rows, lang="en"):
        return spark.createDataFrame(
            [(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], SCHEMA
        ).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)
