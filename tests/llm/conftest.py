from __future__ import annotations

import pytest

#: Texts with nulls, blanks, copies, and characters of all lengths.
ODD = [None, "", " \n\t", "a b c", "A  b\nc", "Ünï çödé 中文 😀", "x" * 300, "word " * 3000, "the end"]


def frame(spark, texts, **columns):
    """A table of texts whose other columns clash with the names of results."""
    rows = [(i, t, *(c[i] for c in columns.values())) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{n} string" for n in columns)]))
    return df.selectExpr("*", "'clash' AS score", "1 AS n_tokens", "'x' AS rep", "0 AS batch", "'y' AS key", "2 AS kept")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def texts_of(df) -> dict[int, str]:
    return {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
