from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import language_id, toxicity
from tests.llm.conftest import ODD, frame


def chain():
    return toxicity.label_categories()


def test_toxicity_on_the_tables(spark, sf, documents):
    big = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    judged = toxicity.classify(docs, labels, chain(), ["toxic"]).join(labels.withColumnRenamed("toxic", "label"), "doc_id")
    counts = {(r.label, r.toxic): r["count"] for r in judged.groupBy("label", "toxic").count().collect()}
    # some labels of these tables are noise
    assert counts[1, True] >= 0.8 * (counts[1, True] + counts.get((1, False), 0))
    assert counts.get((0, True), 0) <= 0.02 * counts[0, False]


def test_toxicity_odd_cases(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(odd.union(odd), empty, chain(), ["toxic"]).collect()
    assert len(rows) == 2 * len(ODD) and not any(r.toxic for r in rows)
    one_sided = spark.createDataFrame([(i, 1, 1) for i in range(9)] + [(None, 1, 0), (3, None, 1), (77, 0, 0)], empty.schema)
    rows = {r.doc_id: r for r in toxicity.classify(odd, one_sided, chain(), ["toxic"]).collect()}
    assert not rows[0].toxic and not rows[2].toxic and rows[3].toxic and rows[3].p_toxic == 1.0
    assert toxicity.classify(none, one_sided, chain(), ["toxic"]).count() == 0


def test_out_of_fold_probabilities_feed_the_chain(spark):
    texts = [f"w{i % 7} {'bad' if i % 2 else 'good'} filler{i % 5}" for i in range(200)]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(frame(spark, texts), labels, chain(), ["toxic"]).collect()
    assert all(r.toxic == bool(r.doc_id % 2) for r in rows)
    assert all((r.p_low_quality > 0.5) == bool(r.doc_id % 2) for r in rows)


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    out = language_id.identify(docs, language_id.training_rows(docs)).join(docs.select("doc_id", "lang", language_id.held_out().alias("h")), "doc_id")
    right, n = out.where("h").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * n
    assert out.where("score < 0 OR score > 1").count() == 0


def test_held_out_is_crc32(spark):
    for df in (spark.range(300).selectExpr("id AS doc_id"),):
        rows = df.select("doc_id", language_id.held_out().alias("h")).collect()
        assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_odd_cases(spark, odd, none):
    train = spark.createDataFrame([("the and of", "en"), ("der die das", "de"), (None, "en"), ("x", None)], "text string, lang string")
    rows = {r.doc_id: r for r in language_id.identify(odd, train).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[0].score == 0 and rows[0].ambiguous
    assert rows[8].lang_pred == "en" and rows[5].lang_pred in ("en", "de")
    assert {r.lang_pred for r in language_id.identify(odd, train.limit(0)).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify(odd, train.limit(1)).collect()} == {"und", "en"}
    assert language_id.identify(none, train).count() == 0


def test_codewords_differ():
    for n in (2, 3, 4, 5, 6, 40):
        code = language_id.codewords(n)
        assert len(np.unique(code, axis=0)) == n and set(np.unique(code)) <= {-1.0, 1.0}
        assert all(len(set(bit)) == 2 for bit in code.T)
