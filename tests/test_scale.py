"""Shared steps in their cheaper form: the same results, and no text read twice."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans import structure_queries as S
from lectern.sources import adapters as A


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    parts = ["a", "Word", "x-1.", "+", "é", "中文", " ", " ", "  ", "\t", "\n", "\n\n\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "\x01", "𝒳",
             "DO NOT write in this margin.", "candidate Number 12", "© ucles 2020", "........", ".....", "This Document consists of 3", "ſ", "K", "İ"]
    return [None, "", " ", " \t ", *["".join(rng.choices(parts, k=rng.randint(1, 120))) for _ in range(400)]]


def test_patterns_equal_their_plain_forms(spark):
    rows = spark.createDataFrame([(t,) for t in odd_texts()], "t string")
    plain = F.col("t")
    for pattern in T.BOILERPLATE:
        plain = F.regexp_replace(plain, f"(?iu){pattern}", "")
    plain = T.strip(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    flat = F.trim(F.regexp_replace("t", f"{T.WS}+", " "))
    split = F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))
    pairs = [(T.clean_text("t"), plain), (T.collapse("t"), flat), (T.words("t"), split)]
    pairs += [(T.has_tokens("t", n), T.token_count("t") >= n) for n in (1, 2, 7, 25)]
    for got, want in pairs:
        bad = rows.select("t", got.alias("got"), want.alias("want")).filter(~F.col("got").eqNullSafe(F.col("want"))).collect()
        assert bad == []


def test_page_pieces_equal_word_windows(spark):
    rng = random.Random(6)
    texts = [*odd_texts(), *[" ".join(rng.choices(["one", "two,", "+", "é1", "x"], k=k)) for k in (20, 24, 119, 120, 121, 220, 221, 400)]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    cut = F.pandas_udf(T.page_pieces(12, 2, 6, 4), "array<string>")
    windows = F.filter(T.word_windows(T.strip("t"), 12, 2), lambda w: T.token_count(w) >= 4)
    want = F.when(T.token_count("t") >= 6, F.concat(F.array(T.strip("t")), windows)).otherwise(F.array().cast("array<string>"))
    for r in rows.select("t", cut("t").alias("got"), want.alias("want")).collect():
        assert r.got == r.want, r.t


def test_chunks_clean_a_text_once(spark, sf):
    assert "UCLES" not in plan(A.chunks(spark, sf))
    assert plan(A.pages(spark, sf).select("clean_text")).count("UCLES") > 0
    flagged = A.chunks(spark, sf, flags=True).join(A.pages(spark, sf).select("document_id", F.col("page_number").alias("page_start"), F.struct(
        "contains_code", "contains_table").alias("page")), ["document_id", "page_start"])
    assert flagged.filter("contains_code <> page.contains_code OR contains_table <> page.contains_table").count() == 0 < flagged.count()


@pytest.mark.parametrize("query", [S.paper_parse, S.scheme_parse])
def test_papers_are_cleaned_and_cut_once(spark, sf, query):
    assert "UCLES" not in plan(query(spark, sf))
