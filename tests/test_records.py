from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lectern.functions import udtf
from lectern.operators import answers, benchmark, contracts, evidence, grading, ingest, memory
from lectern.sources import io, snapshot
from lectern.sources.schemas import BENCHMARK, QUESTION


def naive_memory(pairs):
    messages, summary, topic, out = [], "", None, []
    for q, a in pairs:
        messages += [("user", q), ("assistant", a[:1600])]
        if len(messages) > 10:
            gone, messages = messages[:-8], messages[-8:]
            compact = " | ".join(f"{r}: {' '.join(t.split())[:240]}" for r, t in gone)
            summary = " | ".join(x for x in (summary, compact) if x)[-2400:]
        topic = q if len(q.split()) >= 3 else topic
        out.append((list(messages), summary, topic))
    return out


def test_memory_equals_a_plain_fold_in_any_block_size(spark):
    pairs = [(f"question number {i}" if i % 3 else "ok", ("answer " * (i % 9)) + str(i)) for i in range(300)]
    df = spark.createDataFrame([("c", i, q, a) for i, (q, a) in enumerate(pairs)], "conversation_id string, position bigint, query string, answer string")
    want = naive_memory(pairs)
    for block in (128, 4096):
        got = memory.states(df, block).orderBy("n").collect()
        assert [([(m.role, m.content) for m in r.recent_messages], r.summary, r.active_topic) for r in got] == want


def test_new_question_is_not_rewritten(spark):
    rows = [("c", 1, "Write an SQL query for names", "x"), ("c", 2, "Explain binary search", "y"), ("c", 3, "Can you explain that more simply?", "z")]
    df = spark.createDataFrame(rows, "conversation_id string, position bigint, query string, answer string")
    got = [r.standalone_query for r in memory.rewritten(df).orderBy("n").collect()]
    assert got[1] == "Explain binary search"
    assert got[2] == "Previous topic: Explain binary search\nCurrent request: Can you explain that more simply?"


def test_extract_answers(spark):
    df = spark.createDataFrame([("Q1: first\nQuestion 2) second\nAnswer 9 none", [1, 2]), ("no labels", [4, 5])], "t string, n array<int>")
    got = [r.m for r in df.select(grading.extract_answers(F.col("t"), F.col("n")).alias("m")).collect()]
    assert got == [{1: "first", 2: "second"}, {4: "no labels"}]


def test_agreement(spark):
    df = spark.createDataFrame([(3.0, 4.0), (5.0, 5.0), (1.0, None)], "ai_score double, human_score double")
    r = grading.agreement(df).first()
    assert (r["count"], r.mae, r.pearson_correlation) == (2, 0.5, 1.0)
    flat = spark.createDataFrame([(3.0, 4.0), (3.0, 5.0)], "ai_score double, human_score double")
    assert grading.agreement(flat).first().pearson_correlation is None


def test_reviews_keep_the_machine_score(spark):
    grades = spark.createDataFrame([(1, 7, 3.0, 4.0, "old")], "grade_id int, submission_id int, ai_score double, max_score double, comments string")
    subs = spark.createDataFrame([(7, 9)], "submission_id int, assessment_id int")
    owners = spark.createDataFrame([(9, 5)], "assessment_id int, owner_id int")
    reviews = spark.createDataFrame([(1, 5, 5.0, None), (1, 5, 4.0, None), (1, 6, 4.0, "x")], "grade_id int, reviewer_id int, human_score double, comments string")
    out = {(r.reviewer_id, r.human_score, r.accepted, r.ai_score, r.comments) for r in grading.apply_reviews(grades, reviews, subs, owners).collect()}
    assert out == {(5, None, False, 3.0, "old"), (5, 4.0, True, 3.0, "old"), (6, None, False, 3.0, "old")}


def record(**changes):
    ref = [("d", 1, "c")]
    row = dict(id="1", question="q", category="SQL", difficulty="BEGINNER", expected_intent="X", gold_answer="a", ground_truth_references=ref,
               expected_pages=[1], expected_topics=["t"], expected_citations=ref, review_status="AUTO_VALIDATED_EXACT",
               generation_provenance="exact_question_mark_scheme_pair", question_chunk_id="q", answer_chunk_id="a", source_validation_terms=None,
               gold_match_policy=None, exact_mark_scheme_available=True, level="O_LEVEL", line_no=1)
    return tuple({**row, **changes}.values())


def test_benchmark_records(spark):
    rows = [record(), record(id="2", gold_answer=" "), record(id="3", question="bad Ã© text"), record(id="4", ground_truth_references=[]),
            record(id="1", line_no=9), record(id="5", answer_chunk_id=None), record(id="6", category=None)]
    df = contracts.benchmark_records(spark.createDataFrame(rows, BENCHMARK + ", line_no int"))
    got = {(r.id, r.line_no): r.outcome.reason for r in df.collect()}
    assert got == {("1", 1): None, ("2", 1): "EMPTY_QUESTION_OR_ANSWER", ("3", 1): "CORRUPTED_TEXT", ("4", 1): "NO_GROUND_TRUTH",
                   ("1", 9): "DUPLICATE_ID", ("5", 1): "EXACT_PAIR_CHUNKS", ("6", 1): "MISSING_REQUIRED_FIELDS"}
    assert contracts.measurable(df).count() == 1


def test_model_output(spark):
    rows = [(json.dumps({"answer_markdown": "fine", "source_keys": ["S1"]}),), (json.dumps({"answer_markdown": "see [S1]", "source_keys": ["S1"]}),),
            (json.dumps({"answer_markdown": "fine", "source_keys": ["S9"]}),), ("[]",), (json.dumps({"answer_markdown": "x", "source_keys": "S1"}),)]
    df = spark.createDataFrame(rows, "p string").select(contracts.model_output(F.col("p"), F.array(F.lit("S1"), F.lit("S2"))).alias("o"))
    assert [r.o.reason for r in df.collect()] == [None, "INLINE_SOURCE_LABEL", "UNKNOWN_SOURCE_KEY", "NOT_THE_ANSWER_CONTRACT", "EMPTY_ANSWER_OR_INVALID_KEYS"]


def question(number, marks, kind="SHORT_ANSWER", topic="t0", text="Explain it", source=None, rubric=None, coding=False):
    source = source or ("TEXTBOOK" if number % 2 else "PAST_PAPER")
    roles = ["TEXTBOOK_CONTENT"] if source == "TEXTBOOK" else ["TEXTBOOK_CONTENT", "PAST_PAPER_STYLE"]
    mcq = kind == "MCQ"
    return (number, text, kind, ["a", "b", "c", "d"] if mcq else [], "a" if mcq else "", marks, "model",
            rubric or [f"point {i} logic condition loop output" for i in range(marks)], source, [topic], coding,
            [("d", "c", 1, r) for r in roles])


def paper(**changes):
    marks, kinds = evidence.SLOT_MARKS, evidence.SLOT_TYPES
    topics = ["t0", "t1", "t1", "t0", "t0", "t1", "t1", "t0"]
    out = [question(i + 1, m, k, t, coding=i == 7) for i, (m, k, t) in enumerate(zip(marks, kinds, topics))]
    for number, value in changes.items():
        out[int(number[1:]) - 1] = value
    return out


def judge(spark, questions, contract):
    df = spark.createDataFrame([(questions,)], f"questions array<{QUESTION}>")
    return df.select(contract.alias("o")).first().o


def test_mock_paper_contracts(spark):
    q, topics = F.col("questions"), F.array(F.lit("t0"), F.lit("t1"))
    scope = contracts.mock_scope(q, F.lit("mock_test"), topics, F.lit(25), F.lit(True))
    theory = contracts.mock_scope(q, F.lit("mock_test"), topics, F.lit(25), F.lit(False))
    lanes = contracts.source_distribution(q, F.lit(4), F.lit(4), topics, F.lit(8))
    marking = contracts.marking_quality(q, F.lit("mock_test"), F.lit(True), F.lit("PROGRAMMING"), F.lit(8))
    complete = contracts.completeness(q, F.lit(8), F.lit("MIXED"))
    for contract in (scope, lanes, marking, complete):
        assert judge(spark, paper(), contract).passed
    assert judge(spark, paper(), theory).reason == "THEORY_ONLY_MOCK_TEST_CONTAINS_CODING"
    assert judge(spark, paper(q2=question(2, 2, topic="t9")), scope).reason == "MOCK_TEST_SCOPE_DEVIATION"
    assert judge(spark, paper(q3=question(3, 3, topic="t0")), lanes).reason == "SOURCE_TOPIC_ASSIGNMENT_DRIFT"
    assert judge(spark, paper(q4=question(4, 3, rubric=["one"], topic="t0")), marking).item == 4
    assert judge(spark, paper(q8=question(8, 4, "LONG_ANSWER", rubric=["a", "b", "c", "d"])), marking).reason == "PROGRAMMING_RUBRIC_LACKS_LOGIC_CRITERIA"
    assert not judge(spark, paper()[:7], complete).passed
    assert judge(spark, paper(q1=question(1, 1)), scope).reason == "MOCK_TEST_REQUIRES_A_ONE_MARK_MCQ"
    both = contracts.combined(lanes, marking, scope, complete)
    assert judge(spark, paper(), both).passed


def test_slots_alternate_lanes_and_topics(spark):
    catalog = [("S1", "TEXTBOOK_CONTENT", ["a"]), ("S2", "TEXTBOOK_CONTENT", ["b"]), ("S3", "PAST_PAPER_STYLE", ["a"]), ("S4", "PAST_PAPER_STYLE", [])]
    df = spark.createDataFrame([(catalog, ["a", "b"]), (catalog[1:], ["a", "b"])], "c array<struct<source_key: string, role: string, topic_ids: array<string>>>, t array<string>")
    first, second = [r.s for r in df.select(evidence.slots(F.lit(4), F.col("t"), F.col("c")).alias("s")).collect()]
    assert [(s.content_source, s.topic_ids) for s in first] == [("TEXTBOOK", ["a"]), ("PAST_PAPER", ["b"]), ("TEXTBOOK", ["b"]), ("PAST_PAPER", ["a"])]
    assert first[1].source_keys == ["S4", "S2"] and first[3].source_keys == ["S3", "S1"]
    assert second == []


def test_structure_sums_to_25(spark):
    s = spark.range(1).select(evidence.structure_slots(F.lit(True), F.lit("SQL")).alias("s")).first().s
    assert sum(x.marks for x in s) == 25 and s[0].question_type == "MCQ" and s[7].requires_coding


def test_topic_scores(spark):
    topics = spark.createDataFrame([("t", "O_LEVEL", ["binary search"], ["binary search"], False, 20, 30)],
                                   "topic_id string, level string, content_phrases array<string>, paper_phrases array<string>, strict_phrases boolean, pdf_page_start int, pdf_page_end int")
    rows = [("in", "d", "TEXTBOOK", "O_LEVEL", 25, "EXPLANATION", "Binary search halves a list", None), ("out", "d", "TEXTBOOK", "O_LEVEL", 31, "EXPLANATION", "Binary search", None),
            ("toc", "d", "TEXTBOOK", "O_LEVEL", 25, "EXPLANATION", "Table of contents binary search", None),
            ("paper", "p", "QUESTION_PAPER", "O_LEVEL", 7, "QUESTION", "Describe a binary search", 4), ("other", "p", "QUESTION_PAPER", "O_LEVEL", 7, "QUESTION", "Describe binary numbers", 4)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, document_type string, level string, page_start int, content_type string, text string, marks int")
    book = evidence.topic_candidates(topics, chunks, "TEXTBOOK").collect()
    past = evidence.topic_candidates(topics, chunks, "QUESTION_PAPER").collect()
    assert [(r.chunk_id, r.score) for r in book] == [("in", 8.0 + 2 + 5 + 2)]
    assert [r.chunk_id for r in past] == ["paper"]


def test_scope_resolution(spark):
    topics = spark.createDataFrame([("a", "c1", "O_LEVEL", 1, 3), ("b", "c2", "O_LEVEL", 4, 9)], "topic_id string, chapter_id string, level string, book_page_start int, book_page_end int")
    asked = spark.createDataFrame([("ok", "O_LEVEL", ["c1"], ["a"]), ("wrong", "O_LEVEL", ["c1"], ["b"]), ("none", "O_LEVEL", ["c9"], ["a"])],
                                  "request_id string, level string, chapter_ids array<string>, topic_ids array<string>")
    good, bad = evidence.resolve_scope(asked, topics)
    assert [(r.request_id, r.pdf_page_start) for r in good.collect()] == [("ok", 13)]
    assert {(r.request_id, r.reason) for r in bad.collect()} == {("wrong", "INVALID_TOPIC"), ("none", "INVALID_CHAPTER")}


def test_pairs_and_sampling(spark):
    rows = [("q1", "QUESTION_PAPER", None, "1", 1, "Explain arrays"), ("s1", "MARK_SCHEME", None, "1", 2, "old scheme text here now"), ("s2", "MARK_SCHEME", None, "1", 3, "the last scheme wins here"),
            ("q2", "QUESTION_PAPER", "12", "2", 4, "Explain lists"), ("s3", "MARK_SCHEME", "12", "2", 5, "too short")]
    df = spark.createDataFrame([(c, t, "9618", 2020, "MJ", comp, n, "d", 1, text, "A_LEVEL", o) for c, t, comp, n, o, text in rows],
                               "chunk_id string, document_type string, subject_code string, year int, session string, component string, question_number string, document_id string, page_start int, text string, level string, ord bigint")
    assert [(r.chunk_id, r.scheme.chunk_id) for r in benchmark.exact_pairs(df).collect()] == [("q1", "s2")]


def test_page_text_choice(spark):
    good, poor = "readable text " * 40, "~" * 50
    rows = [("d", 1, "native", good, None, True), ("d", 2, "native", poor, None, True), ("d", 2, "secondary", good, None, True),
            ("d", 3, "native", poor, None, True), ("d", 3, "paddle", "", None, True), ("d", 3, "tesseract", good, .8, True), ("d", 4, "native", poor, None, False), ("d", 4, "paddle", good, .9, False)]
    out = {r.page_number: r for r in ingest.select_page_text(spark.createDataFrame(rows, "document_id string, page_number int, engine string, text string, confidence double, has_images boolean")).collect()}
    assert not out[1].ocr_attempted and out[2].secondary_parser_used and not out[2].ocr_attempted
    assert out[3].ocr_engine == "tesseract" and out[3].ocr_used and out[3].ocr_confidence == .8
    assert not out[4].ocr_attempted and out[4].quality_score < .75


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int").count() == 2
    assert io.read_jsonl(spark, str(tmp_path / "none.jsonl"), "id int").count() == 0
    (tmp_path / "s.csv").write_text("ai_score,human_score\n3,4\nx,5\n")
    df = io.read_csv(spark, str(tmp_path / "s.csv"), "ai_score double, human_score double", ["ai_score"])
    assert [r.ai_score for r in df.collect()] == [3.0, None]
    with pytest.raises(ValueError):
        io.read_csv(spark, str(tmp_path / "s.csv"), "x int", ["missing"])
    pdfs = tmp_path / "raw"
    (pdfs / "sub").mkdir(parents=True)
    (pdfs / "sub" / "x.pdf").write_bytes(b"abc")
    (pdfs / "y.txt").write_bytes(b"no")
    rows = io.inventory(spark, str(pdfs))
    assert [(r.path, r.bytes) for r in rows.collect()] == [("sub/x.pdf", 3)]
    assert len(io.fingerprint(rows, "2.0").first().fingerprint) == 20


def test_routing_files_prune_by_type(spark, tmp_path):
    rows = spark.createDataFrame([("a", "TEXTBOOK", "O_LEVEL"), ("b", "SYLLABUS", "A_LEVEL")], "chunk_id string, document_type string, level string")
    io.write_chunks(rows, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.filter("document_type = 'SYLLABUS'").first().chunk_id == "b"
    io.write_postings(spark.createDataFrame([("t", "a", 1)], "term string, chunk_id string, tf int"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_review_and_answers(spark):
    asked = spark.createDataFrame([(True, False, True, "X"), (False, True, True, "X"), (True, True, False, "X"), (True, False, False, "EXAM_ANSWER")],
                                  "s boolean, e boolean, g boolean, i string")
    got = [r.d.execution_status for r in asked.select(answers.disposition(F.col("s"), F.col("e"), F.col("g"), F.col("i")).alias("d")).collect()]
    assert got == ["TO_GENERATE", "COMPLETED_ABSTENTION", "COMPLETED", "SKIPPED_MISSING_API_KEY"]
    rows = spark.createDataFrame([("q", 1, "d", "MARK_SCHEME", 3, "c1", " one "), ("q", 2, "d", "MARK_SCHEME", 3, "c2", "two"), ("q", 3, "d", "TEXTBOOK", 3, "c1", "x")],
                                 "query_id string, context_position int, document_id string, document_type string, page_start int, chunk_id string, text string")
    assert answers.official_answers(rows).first().answer == "one\n\ntwo"
    details = answers.source_details(rows.withColumnRenamed("context_position", "position")).collect()
    assert [(r.chunk_id, r.book_name) for r in sorted(details, key=lambda r: r.position)] == [("c1", "d"), ("c2", "d")]
    cited = spark.createDataFrame([("q", "d", 3, "c2"), ("q", "d", 4, "c2")], "query_id string, document_id string, page int, chunk_id string")
    assert [r.page for r in answers.invalid_citations(cited, rows).collect()] == [4]


def test_align_fills_missing_answers(spark):
    subs = spark.createDataFrame([(1, 9, "Q2: two")], "submission_id int, assessment_id int, answer_text string")
    df = spark.createDataFrame([(9, [question(1, 2), question(2, 3)])], f"assessment_id int, questions array<{QUESTION}>")
    assert [(r.number, r.student_answer) for r in grading.align(subs, df).orderBy("number").collect()] == [(1, ""), (2, "two")]


def test_topic_phrases_fall_back_to_the_heading(spark):
    topics = spark.createDataFrame([("a", "Query language (SQL)", "Databases"), ("b", "Arrays", "Data")], "topic_id string, name string, chapter_name string")
    profiles = spark.createDataFrame([("b", ["array"], None, True)], "topic_id string, content array<string>, past_paper array<string>, strict boolean")
    got = {r.topic_id: r for r in evidence.with_phrases(topics, profiles).collect()}
    assert got["a"].content_phrases == ["Query language (SQL)", "SQL"] and got["a"].paper_phrases[-1] == "Databases"
    assert got["b"].content_phrases == ["array"] and got["b"].strict_phrases


def test_topic_alignment(spark):
    topics = F.array(F.struct(F.lit("t").alias("topic_id"), F.array(F.lit("binary search")).alias("phrases")))
    check = lambda text, ids, source: spark.range(1).select(
        contracts.topic_alignment(F.lit(text), F.array(*[F.lit(i) for i in ids]), F.lit(source), topics).alias("o")).first().o.reason
    assert check("How does a search work", ["t"], "") is None
    assert check("What is a stack", ["t"], "") == "TOPIC_DRIFT"
    assert check("What is a stack", ["t"], "some evidence") is None
    assert check("What is a stack", ["zz"], "some evidence") == "UNKNOWN_TOPIC"


def test_active_build_is_never_overwritten(spark, tmp_path):
    root, table = str(tmp_path / "builds"), spark.range(3)
    settings = {"source": "x"}
    with pytest.raises(RuntimeError):
        snapshot.read(spark, root, "chunks")
    build = snapshot.stage(spark, root, {"chunks": table}, settings)
    snapshot.stage(spark, root, {"chunks": table}, settings)
    snapshot.publish(spark, root, build, {"terms": table}, {"sparse": "bm25"})
    assert snapshot.read(spark, root, "terms").count() == 3
    with pytest.raises(RuntimeError):
        snapshot.stage(spark, root, {"chunks": table}, settings)


def test_table_functions(spark):
    udtf.register(spark)
    assert spark.sql("SELECT * FROM word_windows('a b c d e', 3, 1)").count() == 2
    assert [tuple(r) for r in spark.sql("SELECT * FROM extract_answers('Q1 x\nQ2 y', array(1, 2))").collect()] == [(1, "x"), (2, "y")]


def test_request_domains(spark):
    ok = contracts.assessment_request(F.lit("arrays"), F.lit("easy"), F.lit("quiz"), F.lit(5), F.lit("mixed"))
    bad = contracts.assessment_request(F.lit("arrays"), F.lit("easy"), F.lit("exam"), F.lit(5), F.lit("mixed"))
    r = spark.range(1).select(ok.alias("a"), bad.alias("b")).first()
    assert r.a.passed and r.b.reason == "ASSESSMENT_TYPE"


def test_answer_log_stream_appends(spark, tmp_path):
    from lectern.operators.answers import ANSWER_LOG
    from lectern.streaming import telemetry as live

    schema = ("timestamp timestamp, question string, answer string, answer_type string, profile struct<category: string, difficulty: string>, "
              "execution_status string, retrieved array<struct<document_id: string, page_start: int>>, "
              "citations array<struct<document_id: string, page: int>>, citation_valid boolean, confidence double, latency_ms double, "
              "input_tokens int, output_tokens int, estimated_cost double, trace_id string")
    row = (None, "q", "a", "X", ("SQL", "BEGINNER"), "COMPLETED", [("d2", 4), ("d1", 2), ("d2", 4)], [("d2", 4)], True, None, 1.0, 2, 3, 0.1, "t")
    inbox = str(tmp_path / "in")
    for _ in range(2):
        spark.createDataFrame([row], schema).write.mode("append").parquet(inbox)
        rows = spark.readStream.schema(schema).parquet(inbox)
        live.append_answers(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 and tuple(out.columns) == ANSWER_LOG
    assert (out.first().retrieved_documents, out.first().retrieved_pages, out.first().citations) == ("d1, d2", "2, 4", "d2 p.4")


def test_streamed_memory_takes_turns_in_any_order(spark, tmp_path):
    from lectern.streaming import memory as live

    schema = "conversation_id string, position bigint, role string, content string"
    pairs = [(f"a question number {i}", f"answer {i}") for i in range(14)]
    turns = [("c", 2 * i + k, role, text) for i, p in enumerate(pairs) for k, (role, text) in enumerate(zip(("user", "assistant"), p))]
    inbox, root = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (turns[9:] + [("d", 0, "user", "alone")], turns[1:9] + turns[12:15], turns[:2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        live.write_states(spark.readStream.schema(schema).parquet(inbox), root, str(tmp_path / "state")).awaitTermination()
    got = live.read_states(spark, root).orderBy("n").collect()
    want = naive_memory(pairs)
    assert [(len(r.recent_messages), r.summary, r.active_topic) for r in got] == [(len(m), s, t) for m, s, t in want]


def test_streamed_traces_keep_the_last_version(spark, tmp_path):
    from lectern.streaming import telemetry as live

    schema = "trace_id string, version int, created_at timestamp, category string, success boolean, latency_ms double, total_cost double"
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = datetime(2024, 1, 1)
    for part in ([("a", 3, day, "X", True, 3.0, 1.0), ("a", 2, day, "Y", False, 9.0, 9.0)], [("a", 1, day, "Z", False, 9.0, 9.0), ("b", 1, day, None, False, 5.0, 2.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        live.write_traces(spark.readStream.schema(schema).parquet(inbox), out, str(tmp_path / "state")).awaitTermination()
    rows = live.daily(live.read_traces(spark, out)).orderBy("category").collect()
    assert [(r.category, r.requests, r.failures, r.average_latency_ms) for r in rows] == [("UNKNOWN", 1, 1, 5.0), ("X", 1, 0, 3.0)]


def test_memory_refuses_blocks_below_the_halo(spark):
    from lectern.operators import memory

    rows = spark.createDataFrame([("c", 0, "q", "a")], "conversation_id string, position bigint, query string, answer string")
    with pytest.raises(ValueError):
        memory.states(rows, block=memory.HALO - 1)


def test_latency_is_not_rounded(spark):
    from lectern.operators import evaluate

    rows = spark.createDataFrame([(0.001, False, 0.0), (0.002, False, 0.0), (0.0035, True, 0.0)], "latency_ms double, technical_failure boolean, estimated_cost double")
    r = evaluate.latency(rows).first()
    assert (r.median_latency_ms, r.p95_latency_ms, r.minimum_latency_ms) == (0.002, 0.0035, 0.001)


def test_gold_of_short_passages(spark):
    from lectern.plans.records_queries import _containing

    corpus = spark.createDataFrame([("d1", "one cat sat"), ("d2", "concatenate it all"), ("d3", "nothing here")], "chunk_id string, text string")
    items = spark.createDataFrame([("a", "cat"), ("b", "nate it"), ("c", ""), ("e", "one cat sat")], "query_id string, query string")
    found = {(r.query_id, r.chunk_id) for r in _containing(items, corpus, None).collect()}
    assert found == {("a", "d1"), ("a", "d2"), ("b", "d2"), ("e", "d1")}


def test_streamed_totals_take_old_versions_back(spark, tmp_path, monkeypatch):
    """Late, repeated and equal versions, missing values, and a snapshot after every second batch."""
    from lectern.streaming import folders
    from lectern.streaming import telemetry as live

    save = folders.save
    monkeypatch.setattr(folders, "save", lambda batch, i, root, resolve: save(batch, i, root, resolve, 2))
    schema = "trace_id string, version int, created_at timestamp, category string, success boolean, latency_ms double, total_cost double"
    day, next_day = datetime(2024, 1, 1, 5), datetime(2024, 1, 2, 5)
    batches = [
        [("a", 2, day, "X", True, 4.0, 1.0), ("b", 1, day, None, False, None, None), ("c", 1, day, "X", True, 2.0, 1.0)],
        [("a", 1, day, "Y", False, 9.0, 9.0), ("c", 2, next_day, "X", False, 8.0, 2.0)],
        [("c", 2, next_day, "X", False, 8.0, 2.0), ("d", 1, next_day, "X", None, 4.0, 2.0)],
        [("b", 3, next_day, "X", True, 3.0, 0.5)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        live.write_daily(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(str(r.day), r.category): (r.requests, r.failures, r.average_latency_ms, r.total_cost) for r in live.read_daily(spark, f"{tmp_path}/out").collect()}
    assert got == {("2024-01-01", "X"): (1, 0, 4.0, 1.0), ("2024-01-02", "X"): (3, 1, 5.0, 4.5)}


def test_streamed_totals_call_their_state_once_a_bucket(spark, tmp_path):
    """Some thousand traces, one without an id, share a few state entries; equal versions keep the greatest row."""
    from lectern.streaming import telemetry as live

    schema = "trace_id string, version int, created_at timestamp, category string, success boolean, latency_ms double, total_cost double"
    day = datetime(2024, 1, 1, 5)
    first = [(str(i), 1, day, "X", True, 1.0, 1.0) for i in range(5000)] + [(None, 1, day, "X", False, None, 1.0)]
    second = [(str(i), 1 + i % 2, day, "Y", None, 3.0, 1.0) for i in range(0, 5000, 5)] + [(None, 2, day, "Y", False, 5.0, None)]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = live.write_daily(stream, f"{tmp_path}/out", f"{tmp_path}/state", buckets=4)
        query.awaitTermination()
        assert sum(operator["numRowsTotal"] for operator in query.lastProgress["stateOperators"]) == 4
    got = {r.category: (r.requests, r.failures, r.average_latency_ms, r.total_cost) for r in live.read_daily(spark, f"{tmp_path}/out").collect()}
    assert got == {"X": (4000, 0, 1.0, 4000.0), "Y": (1001, 1, 3005.0 / 1001, 1000.0)}


def test_order_statistics(spark):
    import random
    import statistics

    from lectern.operators import evaluate, quantiles

    rng = random.Random(2)
    for n in (0, 1, 2, 3, 20, 21, 340, 1001):
        values = [rng.choice([0.5, 1.0, 1.0, 2.25, rng.random()]) for _ in range(n)]
        rows = spark.createDataFrame([(v, False, 0.0) for v in [*values, None]], "latency_ms double, technical_failure boolean, estimated_cost double")
        r = evaluate.latency(rows).first()
        assert r["count"] == n
        if n:
            assert r.median_latency_ms == statistics.median(values) and r.p95_latency_ms == sorted(values)[-(-95 * n // 100) - 1]
            ranked = quantiles.at_ranks(rows, "latency_ms", lambda k: {"first": k * 0 + 1, "last": k, "beyond": k + 1}).first()
            assert tuple(ranked) == (min(values), max(values), None)
        else:
            assert r.median_latency_ms is None and r.p95_latency_ms is None


def test_missing_topics_asks_with_every_phrase(spark, sf, monkeypatch):
    """The query looks for gaps with the whole catalogue of topics; gaps are found per topic and role."""
    from lectern.plans import evidence_queries as E
    from lectern.plans import registry

    asked = {}
    build = evidence.build
    monkeypatch.setattr(evidence, "build", lambda requests, topics, *rest: asked.update(topics=topics) or build(requests, topics, *rest))
    E.missing_topics(spark, sf)
    columns = ["topic_id", "level", "content_phrases", "paper_phrases", "strict_phrases", "pdf_page_start", "pdf_page_end"]
    assert asked["topics"].select(columns).exceptAll(E.topics(spark, sf).select(columns)).count() == 0
    assert E.LONG_WORDS in registry.SQL["missing_topics"]
    requests = spark.createDataFrame([("r", "O_LEVEL", ["a", "b"])], "request_id string, level string, topic_ids array<string>")
    found = spark.createDataFrame([("r", "TEXTBOOK_CONTENT", ["a"]), ("r", "PAST_PAPER_STYLE", ["a", "b"])], "request_id string, role string, topic_ids array<string>")
    assert [tuple(r) for r in evidence.missing_topics(requests, found).select("request_id", "topic_id", "missing").collect()] == [("r", "b", "TEXTBOOK_CONTENT")]
