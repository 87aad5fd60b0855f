import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents of texts; ids count from 0 unless given as pairs."""
    def make(texts, schema=DOC, partitions=3):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"src{n % 3}", None if t is None else len(t))
                for n, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make
