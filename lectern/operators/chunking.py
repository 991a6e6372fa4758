"""Chunkers: page rows in, chunk rows out.

Input pages carry their document's columns (``document_id, document_type, level, subject_code, year,
session, component, authority_level, ord``) plus ``page_number, clean_text`` and the page flags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import hashing as H
from lectern.functions import text as T
from lectern.operators import skew
from lectern.session import settled

# Window sizes, minimum token counts and heading patterns of the five chunkers.
TEXTBOOK_WINDOW = (360, 55)
SYLLABUS_WINDOW = (320, 40)
MIN_TOKENS = {"PARENT_CONTEXT": 20, "EXPLANATION": 25, "LEARNING_OBJECTIVE": 18, "ENTRY": 3, "EXAMINER_COMMENT": 25}
SECTION_HEAD = r"(?mdU)^\s*\d+(?:\.\d+)+\s+"
SECTION_SPLIT = r"(?mdU)(?=^\s*\d+(?:\.\d+)+\s+)"
EXAMINER_SPLIT = r"(?imdU)(?=^\s*Question\s+\d+\b)"
EXAMINER_NUMBER = r"(?iU)Question\s+(\d{1,2})"
QUESTION_LABEL = r"(?iU)^\s*(\d{1,2})(?:\s*\(([a-z])\))?(?:\s*\(([ivx]+)\))?(?:\s+|\s*$)(.*)$"
SCHEME_LABEL = r"(?iU)^\s*(\d{1,2})(?:\s*\(([a-z])\))?(?:\s*\(([ivx]+)\))?\s*$"
SUBPART_LABEL = r"(?iU)^\s*\(([a-z])\)(?:\s*\(([ivx]+)\))?\s*(.*)$"
ROMAN_LABEL = r"(?iU)^\s*\(([ivx]+)\)\s*(.*)$"
# A line holds no line break, so the rest of it needn't be read to tell that a label is there.
QUESTION_START, SUBPART_START, ROMAN_START = (x.removesuffix("(.*)$") for x in (QUESTION_LABEL, SUBPART_LABEL, ROMAN_LABEL))
THREE_WORDS = r"\A(?:[^A-Za-z]*+[A-Za-z]++){3}"
ENTRY_MARK = "\x1e"  # a line break, so no line holds it
HIGHEST_QUESTION = 20
ORD_STRIDE = 10_000_000

DOCUMENT_COLUMNS = (
    "document_id", "document_type", "level", "subject_code", "year", "session", "component", "authority_level", "ord",
)
PAGE_FLAGS = ("contains_code", "contains_table", "contains_diagram", "figure_path")


def chunk_header(page: str = "page_number") -> Column:
    """The metadata line put in front of the text for retrieval."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.concat_ws(
        " | ", part("Qualification", "level"), part("Source", "document_type"),
        part("Subject", "subject_code"), part("Page", page),
    )


def with_retrieval_text(chunks: DataFrame) -> DataFrame:
    """Chunk rows with the ``retrieval_text`` that follows from their other columns, so a table need not hold texts twice."""
    return chunks.withColumn("retrieval_text", F.concat(chunk_header("page_start"), F.lit("\n"), "text"))


def assemble(rows: DataFrame) -> DataFrame:
    """Chunk rows from ``(document columns, page columns, content_type, sequence, text)`` plus the
    optional ``chunk_id, parent_chunk_id, question_number, marks, maximum_marks, relationship``."""
    body = T.strip("text")
    identity = H.stable_hash(
        {
            "document_id": F.col("document_id"),
            "page": F.col("page_number").cast("int"),
            "type": F.col("content_type"),
            "sequence": F.col("sequence").cast("int"),
            "text": F.col("text"),
        },
        8,
    )
    generated = F.concat_ws(
        "_", "document_id", F.lower("content_type"), F.format_string("%04d", F.col("sequence").cast("int")), identity
    )
    have = set(rows.columns)
    optional = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
    flag = lambda name: F.coalesce(F.col(name) if name in have else F.lit(None), F.lit(False)).cast("boolean").alias(name)
    chunk_id = F.coalesce(F.col("chunk_id"), generated) if "chunk_id" in have else generated
    return rows.select(
        chunk_id.alias("chunk_id"),
        "document_id",
        "document_type",
        T.non_blank("level").alias("level"),
        T.non_blank("subject_code").alias("subject_code"),
        F.col("year").cast("int").alias("year"),
        T.non_blank("session").alias("session"),
        T.non_blank("component").alias("component"),
        F.col("page_number").cast("int").alias("page_start"),
        F.col("page_number").cast("int").alias("page_end"),
        body.alias("text"),
        F.concat(chunk_header(), F.lit("\n"), body).alias("retrieval_text"),
        H.content_hash("text").alias("content_hash"),
        T.token_count("text").alias("token_count"),
        F.coalesce(F.col("authority_level"), F.lit(0)).cast("int").alias("authority_level"),
        "content_type",
        flag("contains_code"),
        flag("contains_table"),
        flag("contains_diagram"),
        optional("figure_path", "string"),
        optional("parent_chunk_id", "string"),
        optional("question_number", "string"),
        optional("marks", "int"),
        optional("maximum_marks", "int"),
        optional("relationship", "string"),
        (F.col("ord") * ORD_STRIDE + F.col("sequence")).cast("bigint").alias("ord"),
    )


def _numbered_pieces(pages: DataFrame, pieces: Callable[[Column], Column]) -> DataFrame:
    """One row per entry of ``pieces`` of ``clean_text`` with its 1-based sequence inside the document.

    Pages are written once with their cleaned text and their count.  The counts go through the window and the offsets
    are joined to whole pages; a page is split after that, so what may cross a shuffle is its text once, not its
    overlapping pieces.  The outer explode keeps the optimizer from deriving a size filter that would evaluate
    ``pieces`` again below the join.
    """
    kept = [c for c in (*DOCUMENT_COLUMNS, "page_number", *PAGE_FLAGS) if c in pages.columns]
    counted = settled(pages.select(*kept, "clean_text", F.size(pieces(F.col("clean_text"))).alias("_count")), "pages")
    placed = skew.running_offset(counted, "document_id", "page_number", F.col("_count"))
    return (
        placed.select(*kept, "offset", F.posexplode_outer(pieces(F.col("clean_text"))).alias("_pos", "_piece"))
        .filter(F.col("_pos").isNotNull())
        .withColumn("sequence", (F.col("offset") + F.col("_pos") + 1).cast("int"))
        .drop("offset")
    )


def textbook(pages: DataFrame, window: tuple[int, int] = TEXTBOOK_WINDOW) -> DataFrame:
    """A page parent plus overlapping word-window children that never cross the page."""
    cut = F.pandas_udf(T.page_pieces(*window, MIN_TOKENS["PARENT_CONTEXT"], MIN_TOKENS["EXPLANATION"]), "array<string>")
    rows = _numbered_pieces(pages, cut).withColumnRenamed("_piece", "text")
    parent_id = F.concat(
        F.col("document_id"), F.lit("_page_"), F.format_string("%04d", F.col("page_number").cast("int")), F.lit("_parent")
    )
    is_parent = F.col("_pos") == 0
    return assemble(
        rows.withColumns({
            "content_type": F.when(is_parent, "PARENT_CONTEXT").otherwise("EXPLANATION"),
            "chunk_id": F.when(is_parent, parent_id),
            "parent_chunk_id": F.when(~is_parent, parent_id),
        })
    )


def _sections(pages: DataFrame, sections: Callable[[Column], Column], content_type: str) -> DataFrame:
    useful = lambda text: F.filter(sections(text), lambda s: T.has_tokens(s, MIN_TOKENS[content_type]))
    rows = _numbered_pieces(pages, useful).withColumnRenamed("_piece", "text")
    return rows.withColumn("content_type", F.lit(content_type))


def syllabus(pages: DataFrame) -> DataFrame:
    """Numbered sections of a page, or word windows when it has none."""
    sections = lambda text: F.when(text.rlike(SECTION_HEAD), F.split(text, SECTION_SPLIT)).otherwise(
        T.word_windows(text, *SYLLABUS_WINDOW)
    )
    return assemble(_sections(pages, sections, "LEARNING_OBJECTIVE"))


def examiner_report(pages: DataFrame) -> DataFrame:
    """``Question n`` sections, whatever ``n``, with the first two digits of their number."""
    rows = _sections(pages, lambda text: F.split(text, EXAMINER_SPLIT), "EXAMINER_COMMENT")
    number = T.non_blank(F.regexp_extract("text", EXAMINER_NUMBER, 1))
    return assemble(rows.withColumn("question_number", number))


# --- question papers and mark schemes -------------------------------------------------------------

def _events(lines: Column, mark_scheme: bool) -> Column:
    """Lines of a page that may start an entry, in their order.

    A numeric label needs a sub-part, three words of its own, or useful text within the next three lines of the
    document.  Where the page ends before that is known, ``wait`` is the number of lines of later pages to look at, and
    ``bare`` says that words there are enough.
    """
    label = SCHEME_LABEL if mark_scheme else QUESTION_START

    def event(text: Column, i: Column) -> Column:
        part = lambda pattern, g: F.regexp_extract(text, pattern, g)
        lower = lambda pattern, g: T.non_blank(F.lower(part(pattern, g)))
        tail = T.strip(part(QUESTION_LABEL, 4))
        missing = i + 4 - F.size(lines)
        shown = F.filter(F.array(*[T.strip(F.get(lines, i + k)) for k in (1, 2, 3)]), lambda x: x != "")
        looked = T.let(F.get(shown, F.lit(0)), lambda after: (
            F.when(after.rlike(SUBPART_START) | ((tail == "") & after.rlike(THREE_WORDS)), 0).when(after.isNull() & (missing > 0), missing)
        ))
        useful = (part(label, 2) != "") | (part(label, 3) != "") | tail.rlike(THREE_WORDS)
        nothing = F.lit("")
        read = F.struct(
            part(label, 1).alias("number"), (nothing if mark_scheme else part(SUBPART_START, 1)).alias("sub"),
            (nothing if mark_scheme else part(ROMAN_START, 1)).alias("roman"),
        )

        def described(m: Column, wait: Column) -> Column:
            sub, roman = m["sub"] != "", m["roman"] != ""
            kind = F.when(sub & roman, "B").when(roman, "R").when(sub, "S").when(wait.isNotNull(), "N")
            numbered = wait.isNotNull()
            return F.when(kind.isNotNull(), F.struct(
                i.alias("line"), kind.alias("kind"),
                F.when(numbered, m["number"].try_cast("int")).alias("main"), F.when(numbered, m["number"]).alias("number"),
                F.when(numbered, lower(label, 2)).otherwise(lower(SUBPART_START, 1)).alias("letter"),
                F.when(numbered, lower(label, 3)).otherwise(lower(SUBPART_START, 2)).alias("sub_roman"),
                F.when(roman, F.lower(m["roman"])).alias("roman"),
                F.coalesce(wait, F.lit(0)).alias("wait"), F.when(wait > 0, tail == "").otherwise(False).alias("bare"),
            ))

        def numeric(m: Column) -> Column:
            plain = (m["sub"] == "") & (m["roman"] == "") & m["number"].try_cast("int").between(1, HIGHEST_QUESTION)
            return F.when(plain, F.lit(0) if mark_scheme else F.when(useful, 0).otherwise(looked))

        return T.let(read, lambda m: T.let(numeric(m), lambda wait: described(m, wait)))

    return F.filter(F.transform(lines, event), lambda e: e.isNotNull())


def page_lines(pages: DataFrame, mark_scheme: bool) -> DataFrame:
    """Pages with at least one line, as ``lines array<string>`` (right-stripped), with their possible ``events`` and
    what later lines of the document see of the first three (``head``).

    They are written once, as texts are cleaned and cut in their making, and each reader takes its columns; the outer
    explode keeps the lines from being made again for every column that follows from them.
    """
    kept = [c for c in (*DOCUMENT_COLUMNS, "page_number", *PAGE_FLAGS) if c in pages.columns]
    cut = T.let(F.split("clean_text", T.LINE_BREAK), lambda raw: (
        F.when(F.element_at(raw, -1) == "", F.slice(raw, 1, F.greatest(F.size(raw) - 1, F.lit(0)))).otherwise(raw)
    ))
    right = F.transform(cut, lambda x: F.rtrim(x, F.lit(T.WS_CHARACTERS)))
    lines = F.col("lines")
    head = F.transform(F.slice(lines, 1, 3), lambda x: T.let(T.strip(x), lambda t: F.when(t != "", F.struct(
        t.rlike(SUBPART_START).alias("sub"), t.rlike(THREE_WORDS).alias("words")))))
    rows = pages.select(*kept, F.explode_outer(F.array(right)).alias("lines")).select(
        *kept, "lines", F.size(lines).alias("n_lines"), head.alias("head"),
        F.explode_outer(F.array(_events(lines, mark_scheme))).alias("events")).withColumn("n_events", F.size("events").cast("bigint"))
    return settled(rows, "paper_pages").filter(F.col("n_lines") > 0)


def _label_runs(pages: DataFrame) -> DataFrame:
    """``(document_id, n, parts)``: the label events of a document in runs, by page.

    A run takes the pages, or parts of a page, that begin within ``RUN_LINES`` events, so it has fewer than twice as
    many.  Only counts and heads go through the window; the first lines of later pages settle the labels that wait.
    """
    order = Window.partitionBy("document_id").orderBy("page_number")
    light = pages.select("document_id", "page_number", "head", F.col("n_events").alias("_n"))
    empty = F.array().cast(light.schema["head"].dataType)
    ahead = F.concat(*[F.coalesce(F.lead("head", k).over(order), empty) for k in (1, 2, 3)])
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    looked = light.select("document_id", "page_number", F.slice(ahead, 1, 3).alias("_ahead"), before.alias("_before"), "_n").filter("_n > 0")

    def stays(e: Column) -> Column:
        after = F.get(F.filter(F.slice("_ahead", 1, e["wait"]), lambda x: x.isNotNull()), F.lit(0))
        return (e["wait"] == 0) | F.coalesce(after["sub"] | (e["bare"] & after["words"]), F.lit(False))

    fields = ("line", "kind", "main", "number", "letter", "sub_roman", "roman")
    found = pages.filter("n_events > 0").select("document_id", "page_number", "events")
    parts = found.join(looked.drop("_n"), ["document_id", "page_number"]).select(
        "document_id", "page_number", "_ahead", "_before", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.size("events") - 1) / RUN_LINES).cast("int")), lambda i: F.slice("events", i * RUN_LINES + 1, RUN_LINES)
        )).alias("part", "events"),
    ).select(
        "document_id", "page_number", "part", F.floor((F.col("_before") + F.col("part") * RUN_LINES) / RUN_LINES).alias("n"),
        F.transform(F.filter("events", stays), lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias("events"),
    )
    return skew.spread(parts, "document_id", "n").groupBy("document_id", "n").agg(
        F.array_sort(F.collect_list(F.struct("page_number", "part", "events"))).alias("parts"))


# Labels are accepted in document order: a state (highest question so far, current letter) is read and changed by
# every event.  An entry is open as soon as the highest question is above zero.  What a run of events does to any
# state is a table with one row per possible state, and such tables compose; so runs of lines are summarised apart,
# the summaries are composed in blocks, and each run is read again from the state it starts in.  A document of one run
# needs no table.

STATE = "struct<highest: int, letter: string>"
SAME = "="  # in a table: the letter that was there before
STATES = 2 * (HIGHEST_QUESTION + 1)
RUN_LINES, FAN = 512, 64


def _state(highest: Column, letter: Column) -> Column:
    return F.struct(highest.cast("int").alias("highest"), letter.cast("string").alias("letter"))


def _accepted(state: Column, event: Column) -> tuple[Column, Column, Column]:
    """Whether a state accepts an event as a numbered question, as a roman part and as a lettered part."""
    kind, highest = event["kind"], state["highest"]
    numbered = (kind == "N") & ((event["main"] == highest) | (event["main"] == highest + 1))
    roman = (highest > 0) & state["letter"].isNotNull() & kind.isin("B", "R")
    return numbered, roman, (highest > 0) & kind.isin("B", "S") & ~roman


def _after(state: Column, event: Column) -> Column:
    numbered, _, lettered = _accepted(state, event)
    return _state(
        F.when(numbered, F.greatest(state["highest"], event["main"])).otherwise(state["highest"]),
        F.when(numbered | lettered, event["letter"]).otherwise(state["letter"]),
    )


def _label(state: Column, event: Column) -> Column:
    """The label an event gets in a state, null if it isn't accepted."""
    numbered, roman, lettered = _accepted(state, event)
    part = lambda c: F.coalesce(F.concat(F.lit("("), c, F.lit(")")), F.lit(""))
    highest = state["highest"].cast("string")
    return (
        F.when(numbered, F.concat(event["number"], part(event["letter"]), part(event["sub_roman"])))
        .when(roman, F.concat(highest, part(state["letter"]), part(event["roman"])))
        .when(lettered, F.concat(highest, part(event["letter"]), part(event["sub_roman"])))
    )


def _table(events: Column) -> Column:
    """State after ``events`` for every state before them."""
    start = lambda i: _state(F.floor(i / 2), F.when(i % 2 == 1, SAME))
    return F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda i: F.aggregate(events, start(i), _after))


def _looked_up(table: Column, state: Column) -> Column:
    def entry(found: Column) -> Column:
        return _state(found["highest"], F.when(found["letter"] == SAME, state["letter"]).otherwise(found["letter"]))

    return T.let(F.get(table, state["highest"] * 2 + state["letter"].isNotNull().cast("int")), entry)


def _start_states(tables: DataFrame, last: int) -> DataFrame:
    """``(document_id, n, state)``: the state before each table, for tables ``n`` = 0 to ``last`` of a document.

    Blocks of ``FAN`` tables are composed to one table each, the starts of the blocks are found in the same way, and
    a block gives its tables their starts; no group has more than ``FAN`` tables, whatever the document's length.
    """
    member = F.struct("n", "table")
    blocks = tables.groupBy("document_id", F.floor(F.col("n") / FAN).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    nothing = _state(F.lit(0), F.lit(None))
    if last < FAN:
        begun = blocks.withColumn("state", nothing)
    else:
        blocks = settled(blocks, "label_blocks")
        composed = F.aggregate(
            F.slice("members", 2, FAN), F.get("members", F.lit(0))["table"],
            lambda whole, m: F.transform(whole, lambda s: _looked_up(m["table"], s)),
        )
        upper = _start_states(blocks.select("document_id", F.col("block").alias("n"), composed.alias("table")), last // FAN)
        begun = blocks.join(upper.withColumnRenamed("n", "block"), ["document_id", "block"])
    empty = F.array().cast(f"array<struct<n: bigint, state: {STATE}>>")
    walked = F.aggregate(
        "members", F.struct(F.col("state").alias("now"), empty.alias("seen")),
        lambda acc, m: F.struct(
            _looked_up(m["table"], acc["now"]).alias("now"),
            F.concat(acc["seen"], F.array(F.struct(m["n"].alias("n"), acc["now"].alias("state")))).alias("seen"),
        ),
        lambda acc: acc["seen"],
    )
    return begun.select("document_id", F.explode(walked).alias("_s")).select("document_id", "_s.n", "_s.state")


def entry_starts(pages: DataFrame) -> DataFrame:
    """``(document_id, page_number, starts)``: the accepted labels of a page with their lines, in order."""
    runs = settled(_label_runs(pages), "label_runs")
    last = runs.agg(F.max("n")).first()[0] or 0
    nothing = _state(F.lit(0), F.lit(None))
    if last == 0:
        begun = runs.withColumn("state", nothing)
    else:
        long = runs.join(runs.filter("n = 1").select("document_id"), "document_id", "left_semi")
        states = _start_states(long.select("document_id", "n", _table(F.flatten("parts.events")).alias("table")), last)
        begun = runs.join(states, ["document_id", "n"], "left").withColumn("state", F.coalesce("state", nothing))
    none = F.array().cast("array<struct<line: int, label: string>>")

    def read(acc: Column, e: Column) -> Column:
        label = T.let(_label(acc["now"], e), lambda x: F.when(x.isNull(), none).otherwise(
            F.array(F.struct(e["line"].alias("line"), x.alias("label")))))
        return F.struct(_after(acc["now"], e).alias("now"), F.concat(acc["starts"], label).alias("starts"))

    pages_none = F.array().cast("array<struct<page_number: int, starts: array<struct<line: int, label: string>>>>")
    walked = F.aggregate(
        "parts", F.struct(F.col("state").alias("now"), pages_none.alias("pages")),
        lambda acc, p: T.let(F.aggregate(p["events"], F.struct(acc["now"].alias("now"), none.alias("starts")), read), lambda x: F.struct(
            x["now"].alias("now"),
            F.concat(acc["pages"], F.array(F.struct(p["page_number"].alias("page_number"), x["starts"].alias("starts")))).alias("pages"),
        )),
        lambda acc: acc["pages"],
    )
    found = begun.select("document_id", F.explode(walked).alias("_p")).select("document_id", "_p.page_number", "_p.starts")
    return found.groupBy("document_id", "page_number").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts")).filter(
        F.size("starts") > 0)


def _continued(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """``(document_id, page_number, more)``: text on later pages of the last entry that starts on a page."""
    order = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    firsts = starts.select("document_id", "page_number", F.get("starts", F.lit(0))["line"].alias("_first"))
    light = pages.select("document_id", "page_number").join(firsts, ["document_id", "page_number"], "left")
    owner = F.last(F.when(F.col("_first").isNotNull(), F.col("page_number")), ignorenulls=True).over(order)
    owned = light.withColumn("_owner", owner).filter("_owner IS NOT NULL AND coalesce(_first, 1) > 0")
    text = F.array_join(F.slice("lines", 1, F.coalesce("_first", F.size("lines"))), "\n")
    return pages.select("document_id", "page_number", "lines").join(owned, ["document_id", "page_number"]).groupBy(
        "document_id", F.col("_owner").alias("page_number")
    ).agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_number", text.alias("text"))))["text"], "\n").alias("more"))


def assessment_entries(pages: DataFrame, mark_scheme: bool) -> DataFrame:
    """One chunk per accepted question or scheme entry; text may run over several pages.

    Label decisions use only label lines.  A page is cut once at the lines where its entries start; what its last
    entry has on later pages is joined to it, so a long document is never one group.
    """
    pages = page_lines(pages, mark_scheme)
    starts = settled(entry_starts(pages), "entry_starts")
    kept = [c for c in (*DOCUMENT_COLUMNS, "page_number", *PAGE_FLAGS) if c in pages.columns]
    cut = pages.select(*kept, "lines").join(starts, ["document_id", "page_number"]).join(
        _continued(pages, starts), ["document_id", "page_number"], "left")
    # a mark before each line that starts an entry and a line feed before the others
    feeds = lambda n: F.array_repeat(F.lit("\n"), n)
    line = lambda i: F.get("starts", i)["line"]
    marks = F.concat(feeds(line(F.lit(0))), F.flatten(F.transform("starts", lambda s, i: F.concat(
        F.array(F.lit(ENTRY_MARK)), feeds(F.coalesce(line(i + 1), F.size("lines")) - s["line"] - 1)))))
    marked = F.array_join(F.zip_with(marks, "lines", lambda mark, text: F.concat(mark, text)), "")
    whole = F.concat(marked, F.coalesce(F.concat(F.lit("\n"), "more"), F.lit("")))
    entries = F.zip_with("starts", F.slice("_texts", 2, F.size("starts")), lambda s, text: F.struct(
        s["label"].alias("question_number"), T.strip(text).alias("text")))
    read = cut.select(*kept, "starts", F.explode_outer(F.array(F.split(whole, ENTRY_MARK))).alias("_texts")).select(
        *kept, F.filter(entries, lambda e: T.has_tokens(e["text"], MIN_TOKENS["ENTRY"])).alias("entries"))
    read = settled(read, "entries")
    placed = skew.running_offset(read, "document_id", "page_number", F.size("entries"))
    rows = placed.select(*kept, "offset", F.posexplode("entries").alias("_pos", "_entry")).select(
        *kept, (F.col("offset") + F.col("_pos") + 1).cast("int").alias("sequence"), "_entry.question_number", "_entry.text")
    return assemble(rows.withColumns({
        "content_type": F.lit("MARK_SCHEME_ENTRY" if mark_scheme else "QUESTION"),
        "maximum_marks" if mark_scheme else "marks": T.last_marks("text"),
        "relationship": F.lit("EXACT_MARK_SCHEME" if mark_scheme else "QUESTION_IDENTITY"),
    }))


# --- whole corpus -----------------------------------------------------------------------------------


def build(pages: DataFrame, textbook_window: tuple[int, int] = TEXTBOOK_WINDOW) -> DataFrame:
    """All chunks of a page table; a page of unknown type yields none."""
    of = lambda kind: pages.filter(F.col("document_type") == kind)
    return (
        textbook(of("TEXTBOOK"), textbook_window)
        .unionByName(syllabus(of("SYLLABUS")))
        .unionByName(assessment_entries(of("QUESTION_PAPER"), mark_scheme=False))
        .unionByName(assessment_entries(of("MARK_SCHEME"), mark_scheme=True))
        .unionByName(examiner_report(of("EXAMINER_REPORT")))
    )


def duplicates(chunks: DataFrame) -> DataFrame:
    """Chunks whose content hash occurred earlier in corpus order, with the first chunk's id.

    The first id of each hash comes from a map-side combined aggregate; the join back meets one row
    per hash, so adaptive skew handling can split a hash that holds a large share of the corpus.
    """
    keyed = chunks.select("chunk_id", "content_hash", "ord")
    firsts = (
        keyed.groupBy("content_hash")
        .agg(F.min(F.struct("ord", "chunk_id")).alias("_first"), F.count("*").alias("_n"))
        .filter(F.col("_n") > 1)
    )
    return (
        keyed.join(firsts, "content_hash")
        .filter(F.col("ord") > F.col("_first.ord"))
        .select("chunk_id", F.col("_first.chunk_id").alias("duplicate_of"))
    )


def totals(chunks: DataFrame) -> DataFrame:
    """One row: chunks, dense chunks and duplicate chunks."""
    per_hash = chunks.groupBy("content_hash").agg(
        F.count("*").alias("_n"), F.count_if(F.col("content_type") != "PARENT_CONTEXT").alias("_dense")
    )
    return per_hash.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("_dense"), F.lit(0)).alias("dense_chunks"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_chunks"),
    )


def counts_by_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_type").agg(F.count("*").alias("chunk_count"))


def indexable(chunks: DataFrame) -> DataFrame:
    """Chunks that enter the lexical and vector indexes: everything but page parents."""
    return chunks.filter(F.col("content_type") != "PARENT_CONTEXT")
