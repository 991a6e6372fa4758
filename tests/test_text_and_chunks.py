from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import markdown, rubric
from lectern.functions import text as T
from lectern.functions import understanding as U
from lectern.operators import chunking

DOCUMENT = dict(document_type="QUESTION_PAPER", level="O_LEVEL", subject_code="2210", year=2024, session="MJ", component="12",
                authority_level=3)
PAGE_SCHEMA = ("document_id string, document_type string, level string, subject_code string, year int, session string, "
               "component string, authority_level int, ord bigint, page_number int, clean_text string")


def pages(spark, rows, **changes):
    d = {**DOCUMENT, **changes}
    return spark.createDataFrame(
        [(doc, d["document_type"], d["level"], d["subject_code"], d["year"], d["session"], d["component"], d["authority_level"],
          i // 100, n, text) for i, (doc, n, text) in enumerate(rows)], PAGE_SCHEMA)


def labels(df):
    return [r.question_number for r in df.orderBy("ord").collect()]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


def test_subparts_and_page(spark):
    text = "1 A computer stores data\n(a) State what is meant by RAM. [1]\nmore text here\n2 Describe how the compiler works [3]"
    out = chunking.assessment_entries(pages(spark, [("p", 3, text)]), False)
    assert labels(out) == ["1", "1(a)", "2"]
    assert {r.page_start for r in out.collect()} == {3}
    assert [r.marks for r in out.orderBy("ord").collect()] == [None, 1, 3]


def test_printed_page_number_is_not_a_question(spark):
    text = "14\nUCLES\n1 Explain how data is stored in memory\nwith an example"
    assert labels(chunking.assessment_entries(pages(spark, [("p", 1, text)]), False)) == ["1"]


def test_question_runs_over_pages(spark):
    rows = [("p", 1, "1 Explain the use of arrays\nfirst line"), ("p", 2, ""), ("p", 3, "second line of it\n2 Describe the stack and heap")]
    out = chunking.assessment_entries(pages(spark, rows), False).orderBy("ord").collect()
    assert [r.question_number for r in out] == ["1", "2"]
    assert out[0].text.endswith("first line\nsecond line of it") and out[0].page_start == 1


def naive_labels(texts, scheme):
    """A plain line scan written for this test."""
    lines = [x.rstrip() for t in texts for x in t.splitlines()]
    out, high, letter, is_open = [], 0, None, False
    for i, line in enumerate(lines):
        if not scheme and is_open:
            roman = re.match(r"^\s*\(([ivx]+)\)\s*(.*)$", line, re.I)
            sub = re.match(r"^\s*\(([a-z])\)(?:\s*\(([ivx]+)\))?\s*(.*)$", line, re.I)
            if roman and letter:
                out.append((i, f"{high}({letter})({roman[1].lower()})"))
                continue
            if sub:
                letter = sub[1].lower()
                out.append((i, f"{high}({letter})" + (f"({sub[2].lower()})" if sub[2] else "")))
                continue
        tail = r"\s*$" if scheme else r"(?:\s+|\s*$)(.*)$"
        m = re.match(r"^\s*(\d{1,2})(?:\s*\(([a-z])\))?(?:\s*\(([ivx]+)\))?" + tail, line, re.I)
        if not m:
            continue
        after = next((x.strip() for x in lines[i + 1:i + 4] if x.strip()), "")
        own = "" if scheme else m[4].strip()
        count = lambda x: len(re.findall("[A-Za-z]+", x))
        useful = scheme or m[2] or m[3] or count(own) >= 3 or re.match(r"^\s*\([a-z]\)", after, re.I) or (not own and count(after) >= 3)
        if 1 <= int(m[1]) <= 20 and int(m[1]) in (high, high + 1) and useful:
            high = max(high, int(m[1]))
            letter = m[2].lower() if m[2] else None
            out.append((i, m[1] + (f"({letter})" if letter else "") + (f"({m[3].lower()})" if m[3] else "")))
            is_open = True
    ends = [i for i, _ in out[1:]] + [len(lines)]
    texts = [("\n".join(lines[s:e]).strip(), label) for (s, label), e in zip(out, ends)]
    return [(label, t) for t, label in texts if len(re.findall(T.TOKEN, t)) >= 3]


@pytest.mark.parametrize(("run", "fan"), [(64, 64), (1, 2), (3, 3)])
def test_papers_equal_a_plain_scan(spark, monkeypatch, run, fan):
    """Short runs and small blocks make several levels of composed tables."""
    monkeypatch.setattr(chunking, "RUN_LINES", run)
    monkeypatch.setattr(chunking, "FAN", fan)
    rng = random.Random(7)
    bits = ["1", "2 ", "3 (a)", "2(b)(ii) ", "(a) ", "(i) ", "(ii)", "(v) text", "", "Explain the idea of arrays", "no", "4 x", "21 many words in here",
            "17", "3", "words and more words", "(c)(iv) state", "5 Describe the use of it"]
    docs, expected = [], {}
    for d in range(25):
        texts = ["\n".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4)]
        docs += [(f"d{d}", n, t) for n, t in enumerate(texts, 1)]
        expected[f"d{d}"] = [x for x in texts if x]
    for scheme in (False, True):
        out = chunking.assessment_entries(pages(spark, docs), scheme).orderBy("document_id", "page_start", "ord").collect()
        got = {}
        for r in sorted(out, key=lambda r: (r.document_id, r.ord)):
            got.setdefault(r.document_id, []).append((r.question_number, r.text))
        for doc, texts in expected.items():
            assert got.get(doc, []) == naive_labels(texts, scheme), doc


@pytest.mark.parametrize("run", [512, 3])
def test_entry_over_many_pages(spark, monkeypatch, run):
    """Pages without labels, without lines and with missing numbers; a label that later pages decide on."""
    monkeypatch.setattr(chunking, "RUN_LINES", run)
    texts = {1: "before any label\n", 2: "1 Explain the use of arrays\n(a) one more line here\nend of a", 4: "goes on", 5: "", 9: "and on\n2\n", 10: "",
             11: "\n", 12: "(a) words of the second one", 13: "3", 20: "no", 21: "", 22: "tail of it", 30: "3 Describe the stack and heap\n" + "x y z\n" * 9}
    out = chunking.assessment_entries(pages(spark, [("p", n, t) for n, t in texts.items()]), False).orderBy("ord").collect()
    assert [(r.question_number, r.text) for r in out] == naive_labels([t for t in texts.values() if t], False)
    assert [(r.page_start, r.ord % chunking.ORD_STRIDE) for r in out] == [(2, 1), (2, 2), (12, 3), (30, 4)]  # "2" alone is too short


def test_short_documents_need_no_state_tables(spark, monkeypatch):
    def refuse(events):
        raise AssertionError("a table for a document of one run")

    monkeypatch.setattr(chunking, "_table", refuse)
    text = "\n".join(f"({'abc'[i % 3]}) State what is meant by it" if i % 3 else f"{i // 3 + 1} Explain the use of arrays" for i in range(60))
    out = chunking.assessment_entries(pages(spark, [("p", 1, text), ("p", 2, "(a) More about the last one"), ("q", 1, text)]), False)
    assert out.count() == 121


def test_textbook_children_stay_on_their_page(spark):
    rows = [("b", 10, " ".join(["alpha"] * 500)), ("b", 11, " ".join(["beta"] * 500))]
    out = chunking.textbook(pages(spark, rows, document_type="TEXTBOOK")).collect()
    children = [r for r in out if r.content_type == "EXPLANATION"]
    assert all(r.parent_chunk_id == f"b_page_{r.page_start:04d}_parent" for r in children)
    assert all(len(set(r.text.split())) == 1 for r in children)
    assert len({r.chunk_id for r in out}) == len(out) == 6


def test_syllabus_and_examiner_sections(spark):
    words = " ".join(["objective"] * 20)
    out = chunking.syllabus(pages(spark, [("s", 1, f"intro\n1.1 {words}\n1.2 {words}")], document_type="SYLLABUS"))
    assert [r.text.split()[0] for r in out.orderBy("ord").collect()] == ["1.1", "1.2"]
    words = " ".join(["comment"] * 30)
    out = chunking.examiner_report(pages(spark, [("e", 1, f"Question 1 {words}\nQuestion 12 {words}")], document_type="EXAMINER_REPORT"))
    assert labels(out) == ["1", "12"]


def test_examiner_sections_from_question_100_on(spark):
    words = " ".join(["comment"] * 30)
    text = "\n".join(f"Question {n} {words}" for n in (99, 100, 101))
    out = chunking.examiner_report(pages(spark, [("e", 1, text)], document_type="EXAMINER_REPORT")).orderBy("ord").collect()
    assert [r.text for r in out] == [f"Question {n} {words}" for n in (99, 100, 101)]
    assert [r.question_number for r in out] == ["99", "10", "10"]


def test_tokens_keep_trailing_punctuation(spark):
    assert one(spark, T.tokens("t"), t="Binary search. C++ a/b") == ["binary", "search.", "c++", "a/b"]


def test_window_count(spark):
    for n in (0, 1, 5, 6, 7, 13, 50):
        text = " ".join(f"w{i}" for i in range(n))
        want, start = [], 0
        while start < n:
            want.append(" ".join(text.split()[start:start + 6]))
            if start + 6 >= n:
                break
            start += 4
        assert one(spark, T.word_windows("t", 6, 2), t=text) == want


def test_quality_and_blocks(spark):
    assert one(spark, T.quality_score("t"), t="a" * 300) == 1.0
    assert one(spark, T.quality_score("t"), t="   ") == 0.0
    kinds = [b.block_type for b in one(spark, T.line_blocks("t"), t="WHILE x\nDATA STORAGE\n1.2 Title\nplain words")]
    assert kinds == ["CODE", "HEADING", "HEADING", "PARAGRAPH"]


def test_question_categories(spark):
    rows = [("Explain how bubble sort works", None, None), ("Write an SQL query with a JOIN", None, None),
            ("Compare RAM and ROM", None, None), ("Answer 9618/12/M/J/21 Question 3(b)", None, None)]
    df = U.with_profile(spark.createDataFrame(rows, "query string, level string, exam_year int"))
    got = {r.query: r.profile for r in df.collect()}
    assert [got[q].category for q, _, _ in rows] == ["PROGRAMMING", "SQL", "COMPARISON", "EXAM_QUESTION"]
    exam = got[rows[3][0]]
    assert (exam.subject_code, exam.component, exam.session, exam.year, exam.question_number) == ("9618", "12", "MJ", 2021, "3(b)")
    assert exam.level == "A_LEVEL" and exam.intent == "EXAM_ANSWER"


def test_truth_table_and_lists(spark):
    text = "A B C | X\n0 0 0 | 0\n0 0 1 | 1"
    assert markdown.text_blocks(text) == [{"type": "table", "rows": [["A", "B", "C", "X"], ["0", "0", "0", "0"], ["0", "0", "1", "1"]]}]
    lists = "Remember:\n\n- Validate input\n- Store the result\n\n1. Read\n2. Process"
    df = spark.createDataFrame([(1, lists), (2, text), (3, "")], "id int, t string")
    out = {r.id: r.markdown for r in markdown.markdown(markdown.blocks(df, "id", "t"), "id").collect()}
    assert out[1] == lists
    assert out[2].startswith("| A | B | C | X |\n| --- | --- | --- | --- |\n| 0 |")


def test_fence_and_ruled_table():
    blocks = markdown.text_blocks("```sql\nSELECT 1\n```\n| a | b |\n|---|---|\n| 1 | 2 |\ntext more")
    assert [b["type"] for b in blocks] == ["code", "table", "paragraph"]
    assert blocks[0] == {"type": "code", "language": "sql", "text": "SELECT 1"}


def test_rubric_has_one_criterion_per_mark(spark):
    column = rubric.atomic_rubric(F.lit("SHORT_ANSWER"), F.lit(4), F.array(F.lit("Uses a loop correctly; 1 mark for the output value")), F.lit(""),
                                  F.lit("The loop adds numbers. The total is printed."))
    out = one(spark, column, t="x")
    assert len(out) == 4 and len(set(out)) == 4 and all(c.startswith("1 mark for ") for c in out)
    assert out[:2] == ["1 mark for Uses a loop correctly.", "1 mark for the output value."]


def test_coding_rubric_dimensions(spark):
    out = one(spark, rubric.coding_rubric(F.array(F.lit("1 mark for the WHERE filter."), F.lit("x")), F.lit("SQL")), t="x")
    assert len(out) == 4 and out[2] == "1 mark for the WHERE filter."
    assert out[0] == "1 mark for selecting the correct field(s)."


def test_coding_detector(spark):
    assert one(spark, rubric.requires_coding(F.col("t")), t="Write an SQL query to list names")
    assert not one(spark, rubric.requires_coding(F.col("t")), t="Which SQL query lists the names?")
