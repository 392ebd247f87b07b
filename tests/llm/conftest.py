import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session
    s = local_session("*", shuffle_partitions=4, extra={
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="quarry-llm-test-")})
    yield s


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_lines string"


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty and long texts, repeated rows, and columns named like results."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, words, "en", "a", 5, 0.5, "x"), (1, words, "en", "a", 5, 0.5, "x"), (2, words + " thirteen", "en", None, 5, 0.1, "x"),
            (3, "", "en", "", 0, None, None), (4, None, None, None, None, None, None), (None, words, "en", "a", 5, 0.5, "x"),
            (5, long, "en", "b", len(long), 0.5, "x"), (6, " \n\t ", "de", "b", 4, 0.5, "x"), (7, long, "en", "b", 1, 0.5, "x"),
            (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
