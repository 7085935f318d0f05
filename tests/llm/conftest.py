import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty texts, ties, a long text, an extra column, a name that operators use for their own."""
    long = "a long text of many words " * 40_000
    rows = [
        (1, "", "en", 0), (2, None, "en", 0), (3, "\n \t\n", None, 1), (4, "one two three", "en", 1), (5, "one two three", "en", 1),
        (6, long, "en", 2), (7, long + "!", None, 2), (8, "ÄÖ ünï 漢字   x", "de", 3), (9, "12 34 -- 56", "de", 3), (10, "word", "de", 4),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "other") for r in rows], "doc_id long, text string, lang string, source int, n_chars long, part string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
