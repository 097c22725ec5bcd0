from __future__ import annotations

import pytest

LONG = "the and of to " * 30_000

#: Null, empty and blank texts, a very long one, copies, a repeated row, a null id.
ODD_ROWS = [
    (0, None, "en"),
    (1, "", None),
    (2, " \n\t ", "en"),
    (3, LONG, "en"),
    (4, "Mail ann@example.com or ann@example.com at 10.0.0.1, please. Thanks for all of it.", "en"),
    (4, "Mail ann@example.com or ann@example.com at 10.0.0.1, please. Thanks for all of it.", "en"),
    (5, "Mail ann@example.com or ann@example.com at 10.0.0.1, please. Thanks for all of it.", "de"),
    (6, "x" * 200_000, "fr"),
    (7, "1234 !!! ???", "es"),
    (None, "A text without an id is a text all the same, with words in it.", "fr"),
]
#: Names that operators use for columns of their own.
CLASHING = [
    "score", "fingerprint", "component_id", "lang_pred", "block", "piece", "n_words", "spans", "label", "stratum", "train",
    "sequence_id", "length", "word", "redacted_text", "kept_text", "any", "level", "row", "count",
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names clash."""
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *("?" for _ in CLASHING)) for r in ODD_ROWS], schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    """A table without rows."""
    return odd.where("false")


@pytest.fixture(scope="session")
def real(spark, sf):
    """The smallest given documents, on the driver too."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df, {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
