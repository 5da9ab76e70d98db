import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
for path in (os.path.dirname(os.path.dirname(HERE)), HERE):
    if path not in sys.path:
        sys.path.insert(0, path)


from corpus_docs import SCHEMA  # noqa: E402


@pytest.fixture
def odd_docs(spark):
    """Null and empty texts, a null id, rows repeated in full, an id with two texts, a very long text, ties."""
    long = "one two three four five six seven eight nine ten " * 6000
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "Alpha beta gamma. Under the MIT License"), (4, "Alpha beta gamma. Under the MIT License"),
            (5, "alpha BETA gamma. under the mit license"), (6, long), (7, long), (None, "no id here, under the mit license"),
            (8, "same id"), (8, "other text, same id"), (9, "$$$ ### 123"), (10, "é"), (11, "token = abcdefgh12345678")]
    return spark.createDataFrame([(i, t, None if i == 9 else "en", None, None, "x", "y", 3, "z") for i, t in rows], SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
