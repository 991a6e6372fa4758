"""Steps that keep texts out of shuffles and tables: the same rows, and less on disk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as K

from lectern.operators import benchmark, chunking, context, evidence, index, skew
from lectern.plans import evidence_queries as E
from lectern.plans import records_queries as R
from lectern.plans import retrieval
from lectern.plans import retrieval_queries as Q
from lectern.session import settled


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def joins(df) -> list[str]:
    return [x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in x]


def same(left, right) -> bool:
    rows = lambda df: sorted(map(str, df.select(*left.columns).collect()))
    return rows(left) == rows(right)


def test_tables_are_compressed(spark):
    text = spark.range(20_000).select(F.sha2(F.floor(F.col("id") / 7).cast("string"), 256).alias("t"))
    sizes = spark.read.format("binaryFile").load
    table = settled(text, "test")
    files = table.inputFiles()
    assert files and all(".zstd." in f for f in files)
    assert same(table, text) and sizes(files).count() == len(files)


def odd_pages(spark):
    rng = random.Random(7)
    rows = [(d, p, rng.randint(0, 4)) for d in ("a", "b", "hot") for p in range(1, 60 if d == "hot" else 6)]
    return spark.createDataFrame([*rows, (None, 1, 2), ("b", None, 3)], "d string, p int, n int")


def test_offsets_travel_to_the_rows(spark, monkeypatch):
    pages = odd_pages(spark).withColumn("text", F.lit("x"))
    here = skew.running_offset(pages, "d", "p", F.col("n"))
    assert all("BroadcastHashJoin" in x for x in joins(here)) and joins(here)
    monkeypatch.setattr(skew, "OFFSET_ROWS", 3)
    assert same(here, skew.running_offset(pages, "d", "p", F.col("n")))
    twice = pages.unionByName(pages).filter("n = 2 OR p < 0")  # equal counts, so the order of copies doesn't matter
    few = skew.running_offset(twice, "d", "p", F.col("n"))
    monkeypatch.setattr(skew, "OFFSET_ROWS", 10_000)
    assert same(few, skew.running_offset(twice, "d", "p", F.col("n")))


@pytest.mark.parametrize("held", [0, 1, 40, 3000])
def test_narrowed_keeps_what_a_join_meets(spark, held):
    big = spark.range(3000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("k"), "id").unionByName(
        spark.createDataFrame([(None, 1), ("c7", 2)], "k string, id long"))
    small = big.filter((F.col("id") * 7) % 3000 < held).select("k").unionByName(spark.createDataFrame([("other",), (None,)], "k string"))
    left = skew.narrowed(big, small, "k")
    assert left.columns == big.columns
    assert same(left.join(small, "k"), big.join(small, "k"))
    assert left.count() <= held + 1 + 3000 * 0.2


def test_index_holds_texts_once(spark, sf, monkeypatch):
    wrote = []
    monkeypatch.setattr(retrieval, "settle", lambda df: wrote.append(df.columns) or settled(df, "retrieval"))
    chunks = Q.settled_index(spark, sf, vectors=False).chunks
    assert [c for c in wrote if "retrieval_text" in c] == []
    whole = Q.A.chunks(spark, sf)
    assert same(chunks.select("chunk_id", "retrieval_text"), whole.select("chunk_id", "retrieval_text"))


def test_retrieval_text_follows_from_the_other_columns(spark):
    kinds = {f.name: f for f in K.StructType.fromDDL(
        "document_id string, document_type string, level string, subject_code string, year int, session string, component string, "
        "authority_level int, ord bigint, page_number int, content_type string, sequence int, text string")}
    one = dict.fromkeys(kinds) | {"document_id": "d", "document_type": "TEXTBOOK", "ord": 1, "content_type": "EXPLANATION", "sequence": 1, "text": " a b "}
    rows = [one, one | {"level": "", "subject_code": "9618", "page_number": 3}, one | {"document_type": None, "level": "A_LEVEL", "text": ""}]
    built = chunking.assemble(spark.createDataFrame([tuple(r.values()) for r in rows], K.StructType(list(kinds.values()))))
    assert same(built, chunking.with_retrieval_text(built.drop("retrieval_text")).select(*built.columns))


def test_chosen_chunks_leave_the_others_out_of_the_join(spark, sf):
    built = Q.settled_index(spark, sf, vectors=False)
    light = built.chunks.select("chunk_id", F.lit("q").alias("query_id"), F.lit(1).alias("position"), F.lit("R").alias("relationship"), "parent_chunk_id", "text")
    some = settled(light.filter("parent_chunk_id IS NOT NULL").orderBy("chunk_id").limit(5), "test")
    assert "getbit" in plan(context.expand_parents(some, built.chunks)).lower()
    found = settled(some.select("query_id", "chunk_id"), "test")
    assert "getbit" in plan(benchmark.with_all_terms(
        found.withColumnRenamed("query_id", "case_id"), spark.createDataFrame([("q", "the")], "case_id string, term string"), built)).lower()


def test_policy_packs_postings_without_grouping_them(spark, sf, monkeypatch):
    monkeypatch.setattr(R.search, "_packed", lambda postings: pytest.fail("postings are grouped again"))
    assert R.retrieval_by_policy(spark, sf).count() > 0


def test_policy_counts_copies_of_a_chunk_as_one(spark, sf, monkeypatch):
    """Copies have their terms put together, as when postings were grouped."""
    real = Q.settled_index(spark, sf, vectors=False)
    packed = settled(real.packed.unionByName(real.packed), "test")
    copies = index.of_packed(real.chunks.unionByName(real.chunks), packed, real.stats)
    grouped = []
    monkeypatch.setattr(R, "settled_index", lambda *a, **b: copies)
    monkeypatch.setattr(R.search, "_packed", lambda postings, f=R.search._packed: grouped.append(1) or f(postings))
    assert R.retrieval_by_policy(spark, sf).count() > 0 and grouped


def test_passages_of_few_words_are_still_found(spark):
    corpus = spark.createDataFrame([("d1", "one two three four"), ("d2", "onetwo x"), ("d3", None)], "chunk_id string, text string")
    items = spark.createDataFrame([("a", "two three four"), ("b", "two"), ("c", ""), ("d", None), ("e", "none of these")], "query_id string, query string")
    found = {(r.query_id, r.chunk_id) for r in R._containing(items, corpus, None).collect()}
    assert found == {("a", "d1"), ("b", "d1"), ("b", "d2")}


def test_marking_evidence_joins_few_chunks(spark, sf, monkeypatch):
    """Texts of chunks, ranked ones and parents, are joined only after the others are left out."""
    met = []
    monkeypatch.setattr(skew, "narrowed", lambda big, small, key, f=skew.narrowed: met.append(big.columns) or f(big, small, key))
    assert Q.grading_evidence(spark, sf).count() > 0
    assert sum("text" in c for c in met) == 3  # both passes and the parents


def topics_and_chunks(spark):
    """Topics and chunks with every kind of gap: no level, page, range or phrase, and phrases of several pieces."""
    rng = random.Random(11)
    words = ["array", "arrays", "sub-array", "c++", "loop", "while loop", "sql", "(sql)", "été", "a", "explain", "中文", "stack"]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    chunks = [(
        f"c{i}", f"d{i % 9}", rng.choice(["TEXTBOOK", "QUESTION_PAPER", "MARK_SCHEME", None]), rng.choice(["O", "A", None]), rng.choice([None, 3, 11, 12, 13, 20, 40]),
        rng.choice(["EXPLANATION", "PARENT_CONTEXT", None]), " \n".join(pick(rng.choice([1, 8, 200]))).title(),
    ) for i in range(300)]
    topics = [(
        f"t{i}" if i else None, rng.choice(["O", "A", None]), rng.choice([None, pick(4), [*pick(2), None, "array", "array"]]), rng.choice([None, [], pick(3), ["While  Loop", "c++ loop"]]),
        rng.choice([True, False, None]), *rng.choice([(None, None), (12, 13), (11, None), (20, 12), (3, 40)]),
    ) for i in range(40)]
    return (
        spark.createDataFrame(topics, "topic_id string, level string, content_phrases array<string>, paper_phrases array<string>, strict_phrases boolean, "
                              "pdf_page_start int, pdf_page_end int"),
        spark.createDataFrame(chunks, "chunk_id string, document_id string, document_type string, level string, page_start int, content_type string, text string"),
    )


def test_topics_score_chunks_where_they_are(spark, monkeypatch):
    topics, chunks = topics_and_chunks(spark)
    found = evidence.topic_index(chunks)
    here = evidence.topic_scores(topics, found)
    assert "MapInArrow" in plan(here) and not joins(here)
    monkeypatch.setattr(evidence, "SCORED_ROWS", 7)
    monkeypatch.setattr(skew, "fits", lambda *a: False)
    joined = evidence.topic_scores(topics, found)
    assert joins(joined) and joined.count() > 200
    assert same(here, joined) and here.schema["score"].dataType == joined.schema["score"].dataType


def test_copies_of_a_chunk_or_topic_take_the_joins(spark):
    topics, chunks = topics_and_chunks(spark)
    one = topics.filter("topic_id = 't3'")
    assert joins(evidence.topic_scores(topics.unionByName(one), evidence.topic_index(chunks)))
    assert joins(evidence.topic_scores(topics, evidence.topic_index(chunks.unionByName(chunks.filter("document_type = 'TEXTBOOK'").limit(1)))))


def test_topics_of_no_rows(spark):
    topics, chunks = topics_and_chunks(spark)
    assert evidence.topic_scores(topics.filter("false"), evidence.topic_index(chunks)).collect() == []
    assert evidence.topic_scores(topics, evidence.topic_index(chunks.filter("false"))).collect() == []


@pytest.mark.parametrize("query", ["catalog_readiness", "slot_assignment", "evidence_merge", "missing_topics", "evidence_lanes"])
def test_evidence_takes_no_join_of_all_words(spark, sf, monkeypatch, query):
    monkeypatch.setattr(evidence.phrases, "occurrences", lambda *a, **b: pytest.fail("the words of all chunks are joined"))
    getattr(E, query)(spark, sf).collect()


def test_copies_of_a_pair_keep_their_order(spark):
    """Of two pairs at one place the later number comes first, however the chunk table lies."""
    rows = spark.createDataFrame([("THEORY", 5, 1), ("THEORY", 5, 2), ("THEORY", 4, 3)], "category string, place long, n long")
    for table in (rows, rows.orderBy(F.desc("n")).coalesce(1)):
        turns = benchmark.round_robin(table, "category", "place", 3, F.desc("n")).collect()
        assert [(r.turn, r.n) for r in turns] == [(1, 3), (2, 2), (3, 1)]
