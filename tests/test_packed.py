"""Packed postings in place of texts."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, index, search
from lectern.plans import retrieval
from lectern.plans.retrieval_queries import settled_index
from lectern.sources import adapters as A
from tests.test_scale import plan


def test_packed_postings_stand_for_texts(spark, sf):
    """Vectors and statistics follow from the packed postings, and BM25 finds the same with and without them."""
    built = settled_index(spark, sf)
    assert built.packed.inputFiles() and "regexp" not in plan(built.postings) + plan(built.vectors)
    assert built.vectors.exceptAll(index.hash_vectors(built.chunks)).count() == 0 == index.hash_vectors(built.chunks).exceptAll(built.vectors).count()
    for chunks in (built.chunks, built.chunks.limit(0)):
        assert index.packed_stats(chunks, index.packed_postings(chunks)).first() == index.corpus_stats(chunks).first()
    tokens = chunking.indexable(built.chunks).select("chunk_id", F.explode(T.tokens(F.coalesce("retrieval_text", "text"))).alias("term"))
    counts = tokens.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    assert built.postings.select("chunk_id", "term", "tf").exceptAll(counts).count() == 0 and built.postings.count() == counts.count()
    asked = retrieval.variants(retrieval.understand(A.questions(spark, sf)))
    found = [
        {(r.query_id, r.variant, r.chunk_id, r["rank"], r.score) for r in search.bm25(asked, one).collect()}
        for one in (built, dataclasses.replace(built, packed=None))
    ]
    assert found[0] == found[1] and len(found[0]) > 1000
