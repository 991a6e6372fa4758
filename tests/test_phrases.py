from __future__ import annotations

import random

from lectern.operators import phrases


def test_occurrences_against_counting(spark):
    rng = random.Random(3)
    words = ["ab", "abab", "b", "c++", "x_y", "été", "sql", "a-b", "12", "(", "中文", "B"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))).lower() for _ in range(60)] + ["", "\n", "ab\nab", "c ++"]
    asked = ["ab", "b", "ab ab", "b a", "c++", "++", "+ x", "x_y", "t", "été sql", "é", "(", "a-b", "-", "nothing here", "zz", "中", "2 (", "ab  ab", "\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("*", "id % 2 AS side")
    wanted = spark.createDataFrame([(s, p) for s in (0, 1) for p in asked], "side int, phrase string")
    index = phrases.postings(rows, "text", "side", "id")
    got = {(r.phrase, r.id): r.n for r in phrases.occurrences(wanted, index, rows, ["side"], "id", "text").collect()}
    assert got == {(p, i): t.count(p) for p in asked if p.strip() for i, t in enumerate(texts) if t.count(p)}


def test_counted_and_grams(spark):
    table = spark.sql("SELECT array('b', 'a', 'b', 'c', 'b') AS v, array() AS e, 'abca' AS w")
    row = table.select(
        phrases.counted("v").alias("v"), phrases.counted("e").alias("e")
    ).first()
    assert [tuple(x) for x in row.v] == [("a", 1), ("b", 3), ("c", 1)] and row.e == []
    got = [r.gram for r in phrases.grams(table, "w").collect()]
    assert sorted(got) == ["a", "a", "ab", "abc", "b", "bc", "bca", "c", "ca"]


def test_phrases_of_no_rows(spark):
    rows = spark.createDataFrame([], "id int, text string, side int")
    wanted = spark.createDataFrame([(0, "ab")], "side int, phrase string")
    assert phrases.occurrences(wanted, phrases.postings(rows, "text", "side", "id"), rows, ["side"], "id", "text").collect() == []
