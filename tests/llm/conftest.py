import pytest
from pyspark.sql import functions as F

#: Edge cases that every operator over texts must take: null, empty, blank, long, repeated, odd characters.
LONG = "lorem ipsum dolor sit amet consetetur " * 4000
TEXTS = [None, "", "   \n\t ", "a", "One two", LONG, LONG, "tabs\tand\nlines ▁ <|im_end|> \\c 日本語 😀", "x" * 5000]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge-case documents with repeated ids, a null id, and extra columns whose names clash with results."""
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(TEXTS)] + [(3, "a", "en"), (None, "no id at all", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {c: F.lit("clash") for c in ("score", "spans", "n_tokens", "ids", "component_id", "rejected", "n_bytes", "key", "sig", "cls", "cell", "bucket")})


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
