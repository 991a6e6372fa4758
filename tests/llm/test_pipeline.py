from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import common, decontaminate, packing, queries, secrets, toxicity
from tests.llm.conftest import ODD, frame, texts_of
from tests.llm.test_duplicates import brute_near
from tests.llm.test_secrets_and_benchmark import brute


def test_stages_against_brute_force(spark, sf):
    docs = common.read(spark, sf, "documents")
    labels, bench = common.read(spark, sf, "labels"), common.read(spark, sf, "benchmark")
    stage = dict(corpus_pipeline.STAGES)
    toxic = {r.doc_id for r in toxicity.classify(docs, labels, toxicity.label_categories(), ["toxic"]).where("toxic").collect()}
    kept = {i: t for i, t in texts_of(docs).items() if i not in toxic}
    docs = common.settle(stage["toxicity"](spark, docs, sf), "t")
    assert texts_of(docs) == kept
    kept = {i: t for i, t in kept.items() if brute_near(kept)[i][2]}
    docs = common.settle(stage["near_copies"](spark, docs, sf), "t")
    assert texts_of(docs) == kept
    found = {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()}
    kept = {i: t for i, t in kept.items() if i not in found}
    docs = common.settle(stage["benchmark"](spark, docs, sf), "t")
    assert texts_of(docs) == kept
    docs = common.settle(stage["secrets"](spark, docs, sf), "t")
    masked = texts_of(docs)
    assert set(masked) == set(kept)
    for i, t in kept.items():
        assert masked[i] == t if not brute(t) else brute(masked[i]) == ""
    assert docs.where("n_chars <> length(text)").count() == 0
    want = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    got = stage["packing"](spark, docs, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(got) == sorted(want) and len(got) == len(kept)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, sf, name):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "no id here at all", "en", "s", 3), (None, None, None, None, None), (3, ODD[3], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.selectExpr("*", "1 AS toxic", "'x' AS component_id", "2 AS batch", "'y' AS _before", "'z' AS key")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, wide, sf)
    if name == "packing":
        assert out.count() >= len(rows)
    else:
        assert out.columns == corpus_pipeline.COLUMNS
        assert out.count() == {"near_copies": 10}.get(name, len(rows))
    assert stage(spark, wide.limit(0), sf).count() == 0


def test_stage_functions_drop_rows_without_an_id(spark):
    docs = frame(spark, ["alpha beta gamma delta epsilon zeta"] * 2).withColumn("doc_id", F.lit(None).cast("long"))
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    assert decontaminate.remove(docs, bench).count() == 0
    clean = secrets.redact(docs)
    assert clean.count() == 2


def test_every_query_is_named_for_its_operator():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    assert set(queries.SQL) <= set(queries.QUERIES)
