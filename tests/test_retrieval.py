from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import hashing as H
from lectern.operators import context, evaluate, index, search, skew
from lectern.plans import retrieval

CHUNK = ("chunk_id string, ord bigint, document_type string, level string, content_type string, text string, retrieval_text string, "
         "document_id string, page_start int, authority_level int, parent_chunk_id string, subject_code string, year int, session string, "
         "component string, question_number string")


def chunks(spark, rows):
    base = dict(document_type="TEXTBOOK", level="O_LEVEL", content_type="EXPLANATION", document_id="d", page_start=1, authority_level=4,
                parent_chunk_id=None, subject_code=None, year=None, session=None, component=None, question_number=None)
    data = []
    for i, row in enumerate(rows):
        r = {**base, "ord": i, **row}
        r["retrieval_text"] = r.get("retrieval_text", r["text"])
        data.append(tuple(r[f.split()[0]] for f in CHUNK.split(", ")))
    return spark.createDataFrame(data, CHUNK)


def asked(spark, *texts, level=None, document_type=None):
    rows = [(f"q{i}", t, level, None, document_type) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id string, query string, level string, exam_year int, document_type string")


def with_index(table):
    lex = index.lexical(table)
    return index.Index(table, lex.postings, lex.terms, lex.stats, index.hash_vectors(table), H.HASH_MODEL)


def test_rrf_prefers_items_in_both_lists(spark):
    rows = [("q", "sparse", 1, "a", "T", 1), ("q", "sparse", 1, "b", "T", 2), ("q", "dense", 1, "b", "T", 1), ("q", "dense", 1, "c", "T", 2)]
    df = spark.createDataFrame(rows, "query_id string, lane string, variant int, chunk_id string, document_type string, rank int")
    assert search.rrf(df).orderBy(F.desc("rrf_score")).first().chunk_id == "b"


def test_both_filters_apply(spark):
    table = chunks(spark, [{"chunk_id": "a", "text": "binary search list"},
                           {"chunk_id": "b", "text": "binary search list", "document_type": "QUESTION_PAPER"},
                           {"chunk_id": "c", "text": "binary search list", "document_type": "QUESTION_PAPER", "level": "A_LEVEL"}])
    built = with_index(table)
    q = asked(spark, "binary search", level="O_LEVEL", document_type="QUESTION_PAPER")
    assert [r.chunk_id for r in search.bm25(q, built).collect()] == ["b"]
    vectors = retrieval.hash_queries(q.withColumn("variant", F.lit(1)))
    assert [r.chunk_id for r in search.dense(vectors, built.vectors).collect()] == ["b"]


def test_matrix_broadcast_and_salted_bm25_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    table = chunks(spark, [{"chunk_id": f"c{i}", "text": "hot " + " ".join(rng.choice(words, 12))} for i in range(60)])
    built, q = with_index(table), asked(spark, "hot w1 w2 w2", "w3 hot")
    want = [tuple(r) for r in search.bm25(q, built, 7).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(search, "MATRIX_CELLS", 0)
    assert [tuple(r) for r in search.bm25(q, built, 7).orderBy("query_id", "rank").collect()] == want
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    assert [tuple(r) for r in search.bm25(q, built, 7).orderBy("query_id", "rank").collect()] == want


def test_blocked_dense_search_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vec = spark.createDataFrame(
        [(f"c{i}", i, "O" if i % 2 else "A", "T", rng.normal(size=8).tolist()) for i in range(200)],
        "chunk_id string, ord bigint, level string, document_type string, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", 1, "O" if i == 0 else None, None, rng.normal(size=8).tolist()) for i in range(9)],
                              "query_id string, variant int, level string, document_type string, embedding array<double>")
    want = [tuple(r) for r in search.dense(q, vec, 5).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 4)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 64)
    assert [tuple(r) for r in search.dense(q, vec, 5).orderBy("query_id", "rank").collect()] == want
    near = search.approximate_dense(q, vec, 5, bucket_length=4.0).filter("rank = 1").count()
    assert near == 9


def test_user_scorer_decides_the_order(spark):
    rows = spark.createDataFrame([("q", 1, "short", "x", 0), ("q", 2, "a longer passage", "x", 0)],
                                 "query_id string, place int, passage string, rerank_query string, authority_level int")
    out = search.rerank(rows, 2, lambda q, p: p.str.len().astype(float)).orderBy("rerank_rank").collect()
    assert [r.place for r in out] == [2, 1]


def naive_compress(query, text, limit):
    import re

    from lectern.functions.text import TOKEN
    tok = lambda x: {t.lower() for t in re.findall(TOKEN, x)}
    terms = {t for t in tok(query) if len(t) > 2 and t not in context.COMPRESSION_STOP}
    segs = []
    for b in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if b:
            segs += [b] if "\n" in b or len(b) <= 420 else [s.strip() for s in re.split(r"(?<=[.!?])\s+", b) if s.strip()]
    scored = []
    for i, s in enumerate(segs):
        found = tok(s)
        hit = len(terms & found)
        scored.append((-round(hit / max(1, len(terms)) * 4 + hit / max(1, len(found)) * 2 + (.2 if i == 0 or len(s) < 120 else 0), 9), i, s))
    out, used = [], 0
    for _, i, s in sorted(scored):
        if out and used + len(s) + 2 > limit:
            continue
        s = s if out else s[:limit]
        used += len(s) + (2 if out else 0)
        out.append((i, s))
        if used >= limit * .85:
            break
    return "\n\n".join(s for _, s in sorted(out))


def test_compressed_context_equals_a_plain_fold(spark):
    rng = np.random.default_rng(11)
    words = ["binary", "search", "list", "middle", "cat", "dog", "tree", "the", "value", "Sorted"]
    rows, plain = [], {}
    for q in range(6):
        budget, limit = 3000 + 400 * q, 5
        used, kept = 0, []
        for n in range(1, 8):
            text = "\n\n".join(" ".join(rng.choice(words, rng.integers(20, 160))) + ". " + " ".join(rng.choice(words, 40)) + "." for _ in range(rng.integers(1, 6)))
            kind = "QUESTION_PAPER" if n == 3 else "TEXTBOOK"
            rows.append((f"q{q}", "binary search of a sorted list", n, 0, f"c{n}", kind, text, limit, budget))
            if len(kept) < limit and used < budget:
                cap = min(2400, budget - used)
                got = text[:cap] if len(text) <= cap or kind == "QUESTION_PAPER" else naive_compress("binary search of a sorted list", text, cap)
                kept.append((f"c{n}", got))
                used += len(got)
        plain[f"q{q}"] = kept
    df = spark.createDataFrame(rows, "query_id string, query string, position int, step int, chunk_id string, chunk_type string, text string, context_chunks int, context_chars int")
    out = {}
    for r in context.assemble(df).orderBy("query_id", "context_position").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.text))
    assert out == plain


def test_relevant_middle_survives(spark):
    text = "\n\n".join(["intro " * 60, "Binary search halves the sorted list at the middle item.", "outro " * 60])
    row = [("q", "binary search middle", 1, 0, "c", "TEXTBOOK", text * 4, 1, 400)]
    df = spark.createDataFrame(row, "query_id string, query string, position int, step int, chunk_id string, chunk_type string, text string, context_chunks int, context_chars int")
    got = context.assemble(df).first().text
    assert "Binary search" in got and len(got) <= 400


def test_one_corrective_pass(spark):
    table = chunks(spark, [{"chunk_id": "a", "text": "polymorphism means many forms in objects"},
                           {"chunk_id": "b", "text": "a definition explanation of zebra crossing"}])
    rows, report = retrieval.retrieve(asked(spark, "polymorphism objects", "please describe quux"), with_index(table))
    got = {r.query_id: r for r in report.collect()}
    assert got["q0"].retry_count == 0 and got["q0"].sufficient
    assert got["q1"].retry_count == 1 and got["q1"].query == "quux definition explanation"
    assert {r.query_id for r in rows.collect()} >= {"q0"}


def test_exact_scheme_is_complete(spark):
    paper = dict(subject_code="9618", year=2021, session="MJ", component="12", question_number="3(b)", level="A_LEVEL")
    long = "mark point " * 2000
    table = chunks(spark, [{"chunk_id": "m", "text": long, "document_type": "MARK_SCHEME", **paper},
                           {"chunk_id": "p", "text": "Describe arrays", "document_type": "QUESTION_PAPER", **paper},
                           {"chunk_id": "t", "text": "arrays are lists", "level": "A_LEVEL"}])
    rows, report = retrieval.retrieve(asked(spark, "Answer 9618/12/M/J/21 Question 3(b)"), with_index(table))
    got = rows.orderBy("context_position").collect()
    assert [r.chunk_id for r in got] == ["m", "p"] and len(got[0].text) == len(long)
    assert report.first().exact_scheme


def test_metrics_credit_each_gold_once(spark):
    hits = spark.createDataFrame([("q", r, "d", 1, f"c{r}") for r in range(1, 6)], "query_id string, rank int, document_id string, page_start int, chunk_id string")
    gold = spark.createDataFrame([("q", 0, "d", 1, 1, "c9", None, "PAGE"), ("q", 1, "x", 1, 1, "c8", None, "PAGE")],
                                 "query_id string, ordinal int, document_id string, page int, page_end int, chunk_id string, parent_chunk_id string, policy string")
    r = evaluate.retrieval(hits, gold).first()
    assert (r.precision_at_5, r.recall_at_10, r.reciprocal_rank) == (0.2, 0.5, 1.0)
    assert 0 < r.ndcg_at_10 < 1


def test_gates(spark):
    values = spark.createDataFrame([("recall_at_5", 0.95), ("median_latency_ms", 10.0)], "metric string, value double")
    rows = evaluate.gates(values)
    verdict = evaluate.gate_verdict(rows).first()
    assert (verdict.measured_gate_count, verdict.total_gate_count) == (2, 23)
    assert verdict.all_measured_gates_passed and not verdict.all_required_gates_passed


def test_repeated_texts_are_embedded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return np.ones((len(texts), 2))

    cache = spark.createDataFrame([], "cache_key string, model string, embedding array<float>")
    texts = spark.createDataFrame([(1, "same"), (2, "same")], "id int, text string")
    rows, _ = index.fill_cache(texts, cache, "m", embed)
    assert len(rows.collect()) == 2 and calls.value == 1
    usage = index.cache_usage(texts, cache, "m").first()
    assert (usage.cache_hits, usage.cache_misses) == (0, 1)


def test_mixed_models_are_refused(spark):
    with pytest.raises(ValueError):
        index.check_model(index.Index(None, None, None, None, None, "a"), "b")


def test_dense_index_matches_row_number(spark):
    rows = [("hot", i * 3) for i in range(500)] + [("cold", 5)]
    df = spark.createDataFrame(rows, "k string, p bigint")
    out = skew.dense_index(df, "k", "p", 64).collect()
    assert sorted((r.k, r.p, r.n) for r in out) == sorted([("hot", i * 3, i + 1) for i in range(500)] + [("cold", 5, 1)])


def test_sparse_and_dense_hash_vectors_agree(spark):
    df = spark.createDataFrame([("a", "one two three two")], "k string, t string")
    sparse = H.hash_embedding(df, "k", "t")
    dense = np.array(H.dense_embedding(sparse, "k").first().embedding)
    assert dense.shape == (384,) and abs(np.linalg.norm(dense) - 1) < 1e-9
    unit = search._unit(pd.DataFrame([sparse.first().asDict()]))
    assert np.allclose(unit[0], dense)


def test_curriculum_source_has_every_term(spark):
    """Words before tokens before the syllabus; a term that nothing has leaves a case without a source."""
    from lectern.operators import benchmark, index

    rows = [("w", "TEXTBOOK", "stack and queue here here here"), ("t", "TEXTBOOK", "the stack, and the queue."), ("s", "SYLLABUS", "stack queue heap"),
            ("x", "TEXTBOOK", "stack only"), ("o", "TEXTBOOK", "heap alone")]
    chunks = spark.createDataFrame(
        [(c, "d", kind, "O_LEVEL", 1, text, text, "EXPLANATION", i) for i, (c, kind, text) in enumerate(rows)],
        "chunk_id string, document_id string, document_type string, level string, page_start int, text string, retrieval_text string, content_type string, ord long")
    built = index.lexical(chunks)
    cases = spark.createDataFrame(
        [(1, "stack queue", "O_LEVEL", ["stack", "queue"]), (2, "stack queue", "O_LEVEL", ["stack,", "the"]), (3, "heap stack", "O_LEVEL", ["stack", "heap"]),
         (4, "stack", "O_LEVEL", ["stack", "nowhere"]), (5, "stack", "A_LEVEL", ["stack"])],
        "case_id long, query string, level string, terms array<string>")
    got = {r.case_id: (r.chunk_id, r.kind) for r in benchmark.curriculum_sources(cases, built).collect()}
    assert got == {"1": ("w", 1), "2": ("t", 1), "3": ("s", 3)}
    counts = {(r.chunk_id, r.term): (r.tf, r.dl) for r in built.postings.collect()}
    assert counts[("w", "here")] == (3, 6) and counts[("x", "only")] == (1, 2)


def test_running_winners_keep_ties_by_order_and_skip_nothing():
    import pyarrow as pa

    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"query_id": ["a", "b", "c"], "variant": [1, 1, 1], "level": [None, "O", None], "document_type": [None, None, "T"]})
    rows = pd.DataFrame({"chunk_id": [f"c{i}" for i in range(300)], "ord": rng.permutation(300), "level": rng.choice(["O", "A"], 300),
                         "document_type": rng.choice(["T", "S"], 300)})
    scores = rng.integers(0, 6, (300, 3)).astype(float)
    best = search.Winners(frame, 7)
    for start in range(0, 300, 40):
        best.add(scores[start:start + 40], pa.RecordBatch.from_pandas(rows.iloc[start:start + 40], preserve_index=False))
    got = best.batch().to_pandas()
    for i, (allowed, name) in enumerate([(rows["ord"] >= 0, "a"), (rows["level"] == "O", "b"), (rows["document_type"] == "T", "c")]):
        want = rows.assign(score=scores[:, i])[allowed].sort_values(["score", "ord"], ascending=[False, True]).head(7)
        assert got[got["query_id"] == name]["chunk_id"].tolist() == want["chunk_id"].tolist()
    assert search.Winners(frame, 7).batch().num_rows == 0


def test_hash_vectors_count_signs_per_slot(spark):
    texts = ["", None, "one", "one one one two", " ".join(f"w{i % 700}" for i in range(5000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = {r.k: dict(zip(r.slots, r.weights)) for r in H.hash_embedding(df, "k", "t").collect()}
    import hashlib

    for i, text in enumerate(texts):
        cells: dict[int, float] = {}
        for token in (text or "").split():
            value = int(hashlib.sha256(token.encode()).hexdigest()[:8], 16)
            cells[value % 384] = cells.get(value % 384, 0.0) + (1.0 if value % 2 else -1.0)
        cells = {slot: w for slot, w in cells.items() if w}
        norm = sum(w * w for w in cells.values()) ** 0.5
        want = {slot: w / norm for slot, w in cells.items()}
        assert got.get(i, {}) == pytest.approx(want)


def test_gold_matches_equal_every_pair(spark):
    rng = np.random.default_rng(17)
    hits = [(f"q{q}", r, f"d{rng.integers(3)}", None if r == 9 else int(rng.integers(0, 70)), f"c{rng.integers(12)}") for q in range(6) for r in range(1, 13)]
    gold = []
    for q in range(6):
        for i in range(25):
            first = None if i == 3 else int(rng.integers(0, 60))
            last = None if i % 4 == 0 or first is None else first + int(rng.choice([-1, 0, 3, 17, 2_000_000_000]))
            chunk = rng.choice([None, "", *[f"c{k}" for k in range(12)]])
            parent = rng.choice([None, *[f"c{k}" for k in range(12)]])
            gold.append((f"q{q}", i, f"d{rng.integers(3)}", first, last, chunk, parent, rng.choice(["PAGE", "CHUNK", None])))
    hit_rows = spark.createDataFrame(hits, "query_id string, rank int, document_id string, page_start int, chunk_id string")
    gold_rows = spark.createDataFrame(
        gold, "query_id string, ordinal int, document_id string, page int, page_end int, chunk_id string, parent_chunk_id string, policy string")

    def fits(h, g):
        if h[0] != g[0] or h[2] != g[2]:
            return False
        if g[7] == "PAGE" or not g[5]:
            end = g[3] if g[4] is None else g[4]
            return g[3] is not None and h[3] is not None and g[3] <= h[3] <= end
        return h[4] in (g[5], g[6])

    want = {}
    for h in hits:
        found = [g[1] for g in gold if fits(h, g)][:10]
        if h[1] <= 10 and found:
            want[h[0], h[1]] = found
    got = {(r.query_id, r["rank"]): r.ordinals for r in evaluate.gold_matches(hit_rows, gold_rows).collect()}
    assert got == want and len(want) > 20
    assert evaluate.gold_matches(hit_rows.limit(0), gold_rows).count() == 0


def test_exact_scheme_rows(spark):
    records = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", None), ("e", False)], "query_id string, exact_mark_scheme_available boolean")
    found = spark.createDataFrame([("a", "MARK_SCHEME"), ("a", "QUESTION_PAPER"), ("b", "QUESTION_PAPER"), ("c", "MARK_SCHEME")], "query_id string, document_type string")
    rows = {r.query_id: r.exact_scheme_correct for r in evaluate.exact_scheme_rows(records, found).collect()}
    assert rows == {"a": True, "b": False, "c": False, "d": True, "e": True}


def test_index_tables_are_read_by_column(spark, sf):
    """Tables with several readers lie in columns, so a reader of terms doesn't read texts; counts take one pass."""
    from lectern.operators import index as indexing
    from lectern.plans.retrieval_queries import settled_index

    built = settled_index(spark, sf)
    for table in (built.chunks, built.postings, built.stats, built.vectors):
        assert all(f.endswith(".parquet") for f in table.inputFiles()) and table.inputFiles()
    words = indexing.vocabulary(built.chunks)
    assert words.filter("term IS NOT NULL").select("term", "df").exceptAll(built.terms.select("term", "df")).count() == 0
    assert words.filter("term IS NOT NULL").count() == built.terms.count()
    assert indexing.summary(words).first() == built.stats.select("n", "average_length").first()
    assert tuple(indexing.summary(indexing.vocabulary(built.chunks.limit(0))).first()) == (0, 0.0)
