"""Topic dimension, topic-scoped evidence lanes, evidence merge and question slots."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lectern.functions import text as T
from lectern.operators import phrases, skew
from lectern.session import settled

# Markers, command words, weights and limits.
NAVIGATION_MARKERS = (
    "contents", "table of contents", "index", "isbn", "acknowledgements", "endorsed for", "back to contents page",
)
COMMANDS = ("state", "identify", "describe", "explain", "complete", "write", "calculate", "draw", "suggest")
TASK_WORDS = ("describe", "explain", "identify", "write", "state", "complete")
DIFFICULTY = {
    "easy": "BEGINNER", "medium": "INTERMEDIATE", "hard": "ADVANCED",
    "beginner": "BEGINNER", "intermediate": "INTERMEDIATE", "advanced": "ADVANCED",
}
PAGE_BUCKET = 16
#: Chunks that are scored at once, and words whose phrases a task keeps.
SCORED_ROWS, KNOWN_WORDS = 4096, 500_000
PAPER_LIMIT, STYLE_LIMIT, MARKING_LIMIT = 2, 6, 4
SLOT_MARKS = (1, 2, 3, 3, 4, 4, 4, 4)
SLOT_TYPES = ("MCQ", "SHORT_ANSWER", "SHORT_ANSWER", "SHORT_ANSWER", "LONG_ANSWER", "LONG_ANSWER", "LONG_ANSWER", "LONG_ANSWER")
PDF_OFFSET = {"O_LEVEL": 12, "A_LEVEL": 8}
SCOPED_QUERY = (". Chapter: ", ". Topic: ", ". Required concepts: ", ".")
STYLE_PATTERN = "Cambridge question-style pattern. Command words: "
STYLE_NO_COMMAND = "structured response"
STYLE_MARKS = ". Displayed marks: "
STYLE_NO_MARKS = "not parsed"
STYLE_END = ". Use only its command-word and response-shape pattern; its original subject matter is intentionally omitted."


# --- topic dimension -----------------------------------------------------------------------------------


def section_ranges(sections: DataFrame) -> DataFrame:
    """Page range of each section: up to the page before the next section of its chapter."""
    order = Window.partitionBy("chapter_id").orderBy("place")
    following = F.coalesce(F.lead("page_start").over(order), F.col("chapter_end") + 1)
    return sections.withColumn("page_end", F.greatest(F.col("page_start"), following - 1))


def with_phrases(topics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Retrieval phrases per topic: configured ones, else the full heading plus any acronym in it."""
    acronyms = F.regexp_extract_all("name", F.lit(r"\(([A-Z][A-Z0-9]{1,8})\)"), F.lit(1))
    generic = F.array_distinct(F.concat(F.array("name"), acronyms))
    joined = topics.join(profiles.select("topic_id", "content", "past_paper", "strict"), "topic_id", "left")
    content = F.coalesce("content", generic)
    paper = F.coalesce("past_paper", F.concat(content, F.array(F.coalesce("chapter_name", F.lit("")))))
    keep = lambda c: F.filter(c, lambda p: p != "")
    return joined.withColumns({
        "content_phrases": keep(content),
        "paper_phrases": keep(paper),
        "strict_phrases": F.coalesce("strict", F.lit(False)),
    }).drop("content", "past_paper", "strict")


def available_catalog(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chapters with their topics, only for levels that have syllabus documents."""
    levels = chunks.filter(F.col("document_type") == "SYLLABUS").select("level").distinct()
    item = F.struct("topic_id", "name", T.page_label(F.col("book_page_start"), F.col("book_page_end")).alias("label"))
    return topics.join(levels, "level", "left_semi").groupBy("level", "chapter_id", "chapter_name").agg(
        F.array_sort(F.collect_list(item)).alias("topics")
    )


def resolve_scope(requests: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(resolved rows, rejected requests)`` for ``(request_id, level, chapter_ids, topic_ids)``.

    A request is rejected when a chapter is unknown at its level or a topic lies outside the chosen
    chapters; the first problem is reported.
    """
    chapters = topics.select("level", "chapter_id").distinct()
    wanted_chapters = requests.select("request_id", "level", F.explode_outer(F.array_distinct("chapter_ids")).alias("chapter_id"))
    wanted_topics = requests.select(
        "request_id", "level", "chapter_ids", F.posexplode_outer(F.array_distinct("topic_ids")).alias("topic_pos", "topic_id")
    )
    bad_chapter = wanted_chapters.join(chapters, ["level", "chapter_id"], "left_anti").select("request_id").distinct().withColumn(
        "reason", F.lit("INVALID_CHAPTER"))
    placed = wanted_topics.join(topics, ["level", "topic_id"], "left")
    inside = F.coalesce(F.array_contains("chapter_ids", F.col("chapter_id")), F.lit(False))
    bad_topic = placed.filter(~inside).select("request_id").distinct().withColumn("reason", F.lit("INVALID_TOPIC"))
    rejected = bad_chapter.unionByName(bad_topic).groupBy("request_id").agg(F.min("reason").alias("reason"))
    offset = F.when(F.col("level") == "O_LEVEL", PDF_OFFSET["O_LEVEL"]).otherwise(PDF_OFFSET["A_LEVEL"])
    resolved = placed.filter(inside).join(rejected, "request_id", "left_anti").drop("chapter_ids").withColumns({
        "pdf_page_start": F.col("book_page_start") + offset, "pdf_page_end": F.col("book_page_end") + offset,
    })
    return resolved, rejected


def syllabus_evidence(topics: DataFrame, chunks: DataFrame, limit: int = 3) -> DataFrame:
    """Best syllabus excerpts per topic: five points per shared topic term, one per chapter term.

    Candidates share at least one heading term, so they come from an equi-join on (level, term).
    """
    rows = chunks.filter(F.col("document_type") == "SYLLABUS").select(
        "level", "chunk_id", "document_id", "page_start", "text", T.heading_terms("text").alias("row_terms")
    )
    asked = topics.select(
        "topic_id", "level", T.heading_terms("name").alias("topic_terms"), T.heading_terms("chapter_name").alias("chapter_terms")
    )
    by_term = rows.select("level", "chunk_id", F.explode_outer("row_terms").alias("term")).filter(F.col("term").isNotNull())
    wanted = asked.select("topic_id", "level", F.explode_outer("topic_terms").alias("term")).filter(F.col("term").isNotNull())
    shared = skew.salted_join(by_term, wanted, ["level", "term"], "chunk_id").groupBy("topic_id", "chunk_id").agg(
        F.count("*").alias("topic_overlap")
    )
    scored = shared.join(asked.select("topic_id", "topic_terms", "chapter_terms"), "topic_id").join(rows.drop("level"), "chunk_id")
    score = F.col("topic_overlap") * 5 + T.overlap(F.col("chapter_terms"), F.col("row_terms"))
    order = Window.partitionBy("topic_id").orderBy(F.desc("score"), "chunk_id")
    best = scored.withColumn("score", score).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return best.select(
        "topic_id", "place", "chunk_id", "document_id", F.col("page_start").alias("page"), "score",
        T.excerpt(F.col("text"), F.col("topic_terms")).alias("excerpt"),
    )


def scoped_query(purpose: Column, chapter: Column, topic: Column, terms: Column) -> Column:
    before_chapter, before_topic, before_terms, end = map(F.lit, SCOPED_QUERY)
    return T.strip(F.concat(purpose, before_chapter, chapter, before_topic, topic, before_terms, F.array_join(terms, ", "), end))


# --- scoring -----------------------------------------------------------------------------------------------


def _squeezed(text: Column, size: int) -> Column:
    return F.lower(F.regexp_replace(F.substring(text, 1, size), rf"{T.WS}+", " "))


def is_navigation(document_type: Column, page: Column, text: Column) -> Column:
    """Covers, contents pages, indexes and short front matter."""
    number = F.coalesce(page, F.lit(0))
    opening = _squeezed(text, 220)
    marked = F.exists(F.array(*[F.lit(m) for m in NAVIGATION_MARKERS]), lambda m: F.contains(opening, m))
    front = (document_type == "TEXTBOOK") & number.between(1, 10)
    return marked | front | ((number <= 5) & (T.token_count(text) < 180))


CHUNK_FIELDS = ("chunk_id", "document_id", "document_type", "page_start", "content_type", "text", "marks")
TOPICAL = ("TEXTBOOK", "QUESTION_PAPER")


class TopicIndex(NamedTuple):
    """Chunks that may be evidence, read and checked once, and the pieces of the topical ones.

    ``rows``: ``CHUNK_FIELDS``, ``level``, ``opening`` (lower-cased, 240 characters), ``has_task``, ``pieces`` (of topical
    chunks, each with its number).  ``words``: the pieces as ``level, document_type, chunk_id, page_start, word, n``;
    ``vocabulary``: each ``word`` once.
    """

    rows: DataFrame
    words: DataFrame
    vocabulary: DataFrame


def topic_index(chunks: DataFrame) -> TopicIndex:
    """The index tables of a chunk table, written to the shared folder."""
    fields = [c if c in chunks.columns else F.lit(None).cast("int").alias(c) for c in CHUNK_FIELDS]
    low = F.lower("text")
    task = F.lit(False)
    for word in TASK_WORDS:
        task = task | F.contains(low, F.lit(word))
    navigation = is_navigation(F.col("document_type"), F.col("page_start"), F.col("text"))
    topical = F.col("document_type").isin(*TOPICAL)
    kept = (topical & ~navigation) | F.col("document_type").isin("MARK_SCHEME", "EXAMINER_REPORT")
    rows = settled(chunks.filter(kept).select(
        "level", *fields, F.regexp_replace(F.substring(low, 1, 240), rf"{T.WS}+", " ").alias("opening"), task.alias("has_task"),
        F.when(topical, phrases.counted(phrases.pieces(low))).alias("pieces"),
    ), "topic_rows")
    words = rows.select("level", "document_type", "chunk_id", "page_start", F.explode("pieces").alias("_p")).select(
        "level", "document_type", "chunk_id", "page_start", F.col("_p.value").alias("word"), F.col("_p.n").alias("n"))
    return TopicIndex(rows, words, words.select("word").distinct())


def topic_scores(topics: DataFrame, index: TopicIndex, document_types: tuple[str, ...] = TOPICAL) -> DataFrame:
    """Scored ``(topic_id, document_type, chunk_id, document_id, page_start, score)`` of topics and chunks of their level.

    Phrases come from the index of pieces, shared terms from an equi-join on the term, and textbook topics with a
    page range meet all their pages through (level, page bucket); the three are added up by pair.  Papers need a
    phrase; textbook chunks of a topic without a range need a phrase, or a shared term unless the topic is strict.

    Topics that fit a task travel to the chunks, which are scored where they are (``_scored_in_place``).  More topics, a
    topic or a chunk id that comes twice take the joins, which shuffle the words of all chunks.
    """
    by_type = {"TEXTBOOK": ("content_phrases", "pdf_page_start", "pdf_page_end"), "QUESTION_PAPER": ("paper_phrases", None, None)}
    asked = None
    for kind in document_types:
        source, start, end = by_type[kind]
        page = lambda c: (F.col(c) if c else F.lit(None)).cast("int")
        one = topics.select(
            "topic_id", "level", F.lit(kind).alias("document_type"), F.transform(source, F.lower).alias("phrases"),
            "strict_phrases", page(start).alias("_from"), page(end).alias("_to"),
        )
        asked = one if asked is None else asked.unionByName(one)
    rows = index.rows.filter(F.col("document_type").isin(*document_types))
    pair, scope = ["topic_id", "document_type", "chunk_id"], ["topic_id", "level", "document_type", "_from", "_to"]
    in_range = F.col("_from").isNull() | F.col("page_start").between(F.col("_from"), F.col("_to"))

    once = lambda ids: ids.distinct().count() == ids.count()
    if skew.fits(asked) and once(asked.select("topic_id", "document_type")) and once(rows.select(F.xxhash64("chunk_id"))):
        return _scored_in_place(asked, rows)

    listed = asked.select(*scope, F.explode("phrases").alias("phrase")).groupBy(*scope, "phrase").agg(F.count("*").alias("listed"))
    words = index.words.filter(F.col("document_type").isin(*document_types))
    found = phrases.occurrences(listed, words, rows.withColumn("_low", F.lower("text")), ["level", "document_type"], "chunk_id", "_low", in_range, settled(index.vocabulary, "topic_vocabulary"))
    exact = found.select(*pair, (F.col("listed") * F.least("n", F.lit(5))).alias("exact"), F.lit(0).alias("shared"))

    wanted = asked.select(*scope, F.explode(F.array_distinct(F.filter(
        F.flatten(F.transform("phrases", T.tokens)), lambda t: F.length(t) > 2))).alias("token"))
    tokens = rows.select("level", "document_type", "chunk_id", "page_start", F.explode(T.token_set(F.lower("text"))).alias("token"))
    shared = tokens.join(wanted, ["level", "document_type", "token"]).filter(in_range).select(
        *pair, F.lit(0).alias("exact"), F.lit(1).alias("shared"))

    bucket = lambda c: F.floor(F.col(c) / PAGE_BUCKET).cast("int")
    ranged = asked.filter(F.col("_from").isNotNull()).withColumn("_bucket", F.explode(F.sequence(bucket("_from"), bucket("_to"))))
    paged = rows.select("level", "document_type", "chunk_id", "page_start", bucket("page_start").alias("_bucket"))
    placed = paged.join(ranged, ["level", "document_type", "_bucket"]).filter(in_range).select(
        *pair, F.lit(0).alias("exact"), F.lit(0).alias("shared"))

    pairs = exact.unionByName(shared).unionByName(placed).groupBy(*pair).agg(F.sum("exact").alias("exact"), F.sum("shared").alias("shared"))
    known = pairs.join(skew.maybe_broadcast(asked.drop("level")), ["topic_id", "document_type"])
    enough = (F.col("exact") > 0) | F.col("_from").isNotNull() | ((F.col("document_type") == "TEXTBOOK") & ~F.col("strict_phrases"))
    light = rows.select("chunk_id", "document_id", "page_start", "content_type", "opening", "has_task")
    heading = F.exists("phrases", lambda p: (F.length(p) > 3) & F.contains(F.col("opening"), p))
    score = (
        F.col("exact") * 8.0 + F.col("shared") + F.when(heading, 5.0).otherwise(0.0)
        + F.when(F.col("content_type") == "PARENT_CONTEXT", 0.5).otherwise(2.0)
        + F.when((F.col("document_type") == "QUESTION_PAPER") & F.col("has_task"), 2.0).otherwise(0.0)
    )
    return skew.spread(known.filter(enough), "chunk_id").join(light, "chunk_id").select(*pair, "document_id", "page_start", score.alias("score"))


class _Lists(NamedTuple):
    """Lists of whole numbers in one array: list ``i`` is ``values[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(lists: list, *width: int) -> _Lists:
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return _Lists(starts, np.array([y for x in lists for y in x], np.int64).reshape(-1, *width))

    def met(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every list that is looked up, once for each of its values: the place in ``at``, and the value."""
        sizes = self.starts[at + 1] - self.starts[at]
        place = np.repeat(np.arange(len(at)), sizes)
        inside = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return place, self.values[self.starts[at][place] + inside]


class _Asked:
    """Topics as a task looks them up; topics have numbers, and so have phrases and tokens."""

    def __init__(self, topics: list[Row]) -> None:
        number = lambda values: {v: i for i, v in enumerate(dict.fromkeys(values))}
        self.topic_ids = [t.topic_id for t in topics]
        self.groups = number((t.level, t.document_type) for t in topics)
        self.group = np.array([self.groups[t.level, t.document_type] for t in topics], np.int64)
        bound = lambda name: np.array([np.nan if t[name] is None else t[name] for t in topics], np.float64)
        self.first, self.last = bound("_from"), bound("_to")
        self.ranged = ~np.isnan(self.first)
        self.ranges = [np.flatnonzero(self.ranged & (self.group == g)) for g in range(len(self.groups))]
        self.lenient = np.array([t.document_type == "TEXTBOOK" and t.strict_phrases is False for t in topics], bool)
        said = [[p for p in t.phrases or () if p is not None] for t in topics]
        self.headings = [tuple(p for p in dict.fromkeys(x) if len(p) > 3) for x in said]
        numbers = number(p for x in said for p in x)
        self.phrases = list(numbers)
        askers = [[] for _ in numbers]  # topic, and how often it lists the phrase
        for topic, x in enumerate(said):
            for phrase, listed in Counter(x).items():
                askers[numbers[phrase]].append((topic, listed))
        # a phrase of one piece is looked for in the pieces of a text; one of several, where its longest piece is met
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        for t in topics:
            for phrase, parts in zip(t.phrases or (), t.parts or (), strict=True):
                use = (numbers[phrase], int(len(parts) == 1)) if parts else None
                if use and use not in (uses := self.pieces.setdefault(max(parts, key=len), [])):
                    uses.append(use)
        self.sizes = sorted({len(x) for x in self.pieces})
        tokens = number(k for t in topics for k in t.tokens or ())
        wanted = [[] for _ in tokens]
        for topic, t in enumerate(topics):
            for k in t.tokens or ():
                wanted[tokens[k]].append(topic)
        self.askers, self.tokens, self.wanted = _Lists.of(askers, 2), list(tokens), _Lists.of(wanted)

    def uses(self, word: str) -> tuple[tuple[int, int, int], ...]:
        """``(phrase, whether it is whole, how often)`` of the pieces of phrases inside a word."""
        found = {x for n in self.sizes if n <= len(word) for i in range(len(word) - n + 1) if (x := word[i:i + n]) in self.pieces}
        return tuple((*use, word.count(x)) for x in found for use in self.pieces[x])

    def scores(self, rows: pa.RecordBatch, known: dict[str, tuple], tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, topic, score)`` of the pairs of a batch of chunks; ``known`` are the uses of words seen before."""
        column = lambda name: rows.column(name).to_pylist()
        kinds = column("document_type")
        group = np.array([self.groups.get(x, -1) for x in zip(column("level"), kinds, strict=True)], np.int64)
        page = np.array([np.nan if p is None else p for p in column("page_start")], np.float64)

        def in_scope(row: np.ndarray, topic: np.ndarray) -> np.ndarray:
            inside = (page[row] >= self.first[topic]) & (page[row] <= self.last[topic])
            return (self.group[topic] == group[row]) & (~self.ranged[topic] | inside)

        def found(name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
            listed = rows.column(name)
            owner = np.repeat(np.arange(rows.num_rows), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            met = listed.flatten().dictionary_encode()
            return owner, met.indices.to_numpy(zero_copy_only=False), met.dictionary

        nobody = np.zeros(0, np.int64)
        exact = shared = (nobody, nobody, nobody)
        if self.pieces:
            owner, slot, words = found("_words")
            names = words.to_pylist()
            if len(known) > KNOWN_WORDS:
                known.clear()
            for word in names:
                if word not in known:
                    known[word] = self.uses(word)
            place, use = _Lists.of([known[word] for word in names], 3).met(slot)
            n = rows.column("_counts").flatten().to_numpy(zero_copy_only=False)
            key, whole = owner[place] * len(self.phrases) + use[:, 0], use[:, 1] == 1
            here, back = np.unique(key, return_inverse=True)
            times = np.bincount(back, weights=np.where(whole, n[place] * use[:, 2], 0), minlength=len(here)).astype(np.int64)
            verified = np.zeros(len(here), bool)
            verified[back[~whole]] = True
            row, phrase = here // len(self.phrases), here % len(self.phrases)
            place, asker = self.askers.met(phrase)
            met = in_scope(row[place], asker[:, 0])
            place, asker = place[met], asker[met]
            texts, open_ = rows.column("_low"), np.unique(place)
            for i in open_[verified[open_]]:  # phrases of several pieces are counted in the text itself
                times[i] = (texts[int(row[i])].as_py() or "").count(self.phrases[phrase[i]])
            there = times[place] > 0
            place, asker = place[there], asker[there]
            exact = (row[place], asker[:, 0], asker[:, 1] * np.minimum(times[place], 5))
        if self.tokens:
            owner, slot, words = found("_tokens")
            slot = pc.index_in(words, tokens).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[slot]
            there = slot >= 0
            place, topic = self.wanted.met(slot[there])
            row = owner[there][place]
            met = in_scope(row, topic)
            shared = (row[met], topic[met], np.ones(int(met.sum()), np.int64))
        placed = []
        for g, topics in enumerate(self.ranges):
            members = np.flatnonzero(group == g)
            at, topic = np.nonzero(in_scope(members[:, None], topics[None, :]))
            placed.append((members[at], topics[topic]))
        row = np.concatenate([exact[0], shared[0], *[p[0] for p in placed]])
        topic = np.concatenate([exact[1], shared[1], *[p[1] for p in placed]])
        pairs, back = np.unique(row * len(self.topic_ids) + topic, return_inverse=True)
        total = lambda start, values: np.bincount(back[start:start + len(values)], weights=values, minlength=len(pairs))
        hits, terms = total(0, exact[2]), total(len(exact[2]), shared[2])
        row, topic = pairs // len(self.topic_ids), pairs % len(self.topic_ids)
        enough = (hits > 0) | self.ranged[topic] | self.lenient[topic]
        row, topic, hits, terms = row[enough], topic[enough], hits[enough], terms[enough]
        openings, contents, tasks = column("opening"), column("content_type"), column("has_task")
        own = np.array([
            (0.5 if c == "PARENT_CONTEXT" else 2.0) + (2.0 if k == "QUESTION_PAPER" and t else 0.0)
            for c, k, t in zip(contents, kinds, tasks, strict=True)
        ])
        heading = np.array([
            any(p in openings[r] for p in self.headings[t]) if openings[r] else False for r, t in zip(row.tolist(), topic.tolist(), strict=True)
        ], bool)
        return row, topic, hits * 8.0 + terms + np.where(heading, 5.0, 0.0) + own[row]


def _scored_in_place(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """``topic_scores`` of few topics, each once by type, and chunks with an id of their own: nothing is shuffled.

    A task has all topics, and sees a chunk's pieces and tokens together; a word is searched for phrases once.
    """
    terms = F.array_distinct(F.filter(F.flatten(F.transform("phrases", T.tokens)), lambda t: F.length(t) > 2))
    topics = asked.dropna(subset=["topic_id", "level", "document_type"]).withColumns(
        {"tokens": terms, "parts": F.transform("phrases", phrases.pieces)}).collect()
    shared = rows.sparkSession.sparkContext.broadcast(_Asked(topics))
    kept = ["document_type", "chunk_id", "document_id", "page_start"]
    schema = StructType([asked.schema["topic_id"], *[rows.schema[c] for c in kept], StructField("score", DoubleType())])
    ids = pa.array([t.topic_id for t in topics]) if topics else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        known: dict[str, tuple] = {}
        tokens = pa.array(state.tokens, pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows if state.topic_ids else 0, SCORED_ROWS):
                part = batch.slice(start, SCORED_ROWS)
                row, topic, score = state.scores(part, known, tokens)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(topic)), *[part.column(c).take(at) for c in kept], pa.array(score)], names=schema.names)

    low = F.lower("text")
    seen = rows.filter("chunk_id IS NOT NULL").select(
        *kept, "level", "content_type", "opening", "has_task", low.alias("_low"), F.col("pieces.value").alias("_words"),
        F.col("pieces.n").alias("_counts"), T.token_set(low).alias("_tokens"))
    return seen.mapInArrow(run, schema).select("topic_id", *kept, "score")


def topic_candidates(topics: DataFrame, chunks: DataFrame, document_type: str) -> DataFrame:
    """Scored ``(topic_id, chunk)`` pairs of one document type, with the chunk's fields."""
    index = topic_index(chunks.filter(F.col("document_type") == document_type))
    scored = topic_scores(topics, index, (document_type,)).select("topic_id", "chunk_id", "score")
    return scored.join(index.rows, "chunk_id").select("topic_id", *CHUNK_FIELDS, "score")


def diverse_top(scored: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Best chunk of every (document, page) first, then the rest by score; ``limit`` per key.

    A smaller limit is a prefix of a larger one.
    """
    page = F.coalesce("page_start", F.lit(0))
    here = Window.partitionBy(*keys, "document_id", page).orderBy(F.desc("score"), "chunk_id")
    flagged = scored.withColumn("_first", F.row_number().over(here) == 1)
    order = Window.partitionBy(*keys).orderBy(F.desc("_first"), F.desc("score"), "chunk_id")
    return flagged.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("_first")


def merge_scoped(local: DataFrame, retrieved: DataFrame, limit: int = 6) -> DataFrame:
    """Local and retrieved candidates of a topic: highest score per chunk, best ``limit``."""
    best = local.unionByName(retrieved).filter(F.col("score") >= 0).groupBy("topic_id", "chunk_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("topic_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def commands_in(text: Column) -> Column:
    lowered = F.lower(text)
    return F.filter(F.array(*[F.lit(c) for c in COMMANDS]), lambda c: F.regexp_like(lowered, F.concat(F.lit(r"(?U)\b"), c, F.lit(r"\b"))))


def style_candidates(chunks: DataFrame, limit: int = STYLE_LIMIT) -> DataFrame:
    """Question-paper chunks with clear task structure, the most diverse ones per level."""
    size = T.token_count("text")
    rows = chunks.filter((F.col("document_type") == "QUESTION_PAPER") & ~is_navigation(
        F.col("document_type"), F.col("page_start"), F.col("text")))
    found = rows.withColumns({"_n": F.size(commands_in(F.lower("text"))), "_size": size}).filter((F.col("_n") > 0) & (F.col("_size") >= 12))
    score = F.col("_n") * 4.0 + F.least(F.coalesce("marks", F.lit(0)), F.lit(6)) + F.least(F.col("_size"), F.lit(180)) / 180.0
    return diverse_top(found.select("chunk_id", "document_id", "page_start", "level", score.alias("score")), ["level"], limit)


def marking_candidates(chunks: DataFrame, limit: int = MARKING_LIMIT) -> DataFrame:
    """Scheme and examiner-report chunks that show how marks are given, per level."""
    size = T.token_count("text")
    rows = chunks.filter(F.col("document_type").isin("MARK_SCHEME", "EXAMINER_REPORT")).withColumn("_size", size).filter(F.col("_size") >= 8)
    score = F.when(F.col("document_type") == "MARK_SCHEME", 3.0).otherwise(2.0) + F.least(F.col("_size"), F.lit(180)) / 180.0
    return diverse_top(rows.select("chunk_id", "document_id", "page_start", "level", score.alias("score")), ["level"], limit)


def style_projection(text: Column, marks: Column) -> Column:
    """Command words and marks of a task, without its subject matter."""
    found = F.array_join(commands_in(text), ", ")
    shown = F.when(F.coalesce(marks, F.lit(0)) > 0, marks.cast("string")).otherwise(STYLE_NO_MARKS)
    return F.concat(
        F.lit(STYLE_PATTERN), F.coalesce(T.non_blank(found), F.lit(STYLE_NO_COMMAND)), F.lit(STYLE_MARKS), shown, F.lit(STYLE_END)
    )


# --- evidence sets -----------------------------------------------------------------------------------------


def topic_limit(n_topics: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(6), F.floor(F.lit(18) / F.greatest(F.lit(1), n_topics)).cast("int")))


def build(requests: DataFrame, topics: DataFrame, chunks: DataFrame | TopicIndex, syllabus: DataFrame | None = None) -> DataFrame:
    """Merged evidence rows per request: ``(request_id, position, chunk_id, role, topic_ids, …)``.

    ``requests``: request_id, level, topic_ids.  Topic scores are computed once per topic, however many
    requests select it, over an index that reads the chunks once.  Texts join the winners at the end.
    """
    index = chunks if isinstance(chunks, TopicIndex) else topic_index(chunks)
    selected = requests.select(
        "request_id", topic_limit(F.size("topic_ids")).alias("_limit"), F.posexplode("topic_ids").alias("topic_pos", "topic_id")
    )
    scored = diverse_top(topic_scores(topics, index), ["topic_id", "document_type"], 6)
    if syllabus is None:
        evidence = topics.select("topic_id", F.array().cast("array<string>").alias("syllabus_ids"))
    else:
        evidence = syllabus.groupBy("topic_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("syllabus_ids"))
    empty = F.array().cast("array<string>")
    book = F.col("document_type") == "TEXTBOOK"
    scoped = scored.join(selected, "topic_id").join(evidence, "topic_id", "left").filter(
        F.col("place") <= F.when(book, F.col("_limit")).otherwise(PAPER_LIMIT)
    ).select(
        "request_id", F.struct(F.lit(0).alias("lane"), "topic_pos", F.when(book, 0).otherwise(1).alias("step"), "place").alias("pos"), "chunk_id",
        F.when(book, "TEXTBOOK_CONTENT").otherwise("PAST_PAPER_STYLE").alias("role"), F.array("topic_id").alias("topic_ids"),
        F.coalesce("syllabus_ids", empty).alias("syllabus_ids"),
    )

    def general(rows: DataFrame, role: str, lane: int) -> DataFrame:
        return rows.join(requests.select("request_id", "level"), "level").select(
            "request_id", F.struct(F.lit(lane).alias("lane"), F.lit(0).alias("topic_pos"), F.lit(0).alias("step"), "place").alias("pos"), "chunk_id",
            F.lit(role).alias("role"), empty.alias("topic_ids"), empty.alias("syllabus_ids"),
        )

    merged = settled(merge(
        scoped.unionByName(general(style_candidates(index.rows), "PAST_PAPER_STYLE", 1))
        .unionByName(general(marking_candidates(index.rows), "MARKING_PATTERN", 2))
    ), "merged")
    shown = F.when(F.col("role") == "PAST_PAPER_STYLE", style_projection(F.col("text"), F.col("marks"))).otherwise(F.col("text"))
    texts = index.rows.select("chunk_id", "document_id", "document_type", "page_start", "text", "marks")
    return merged.join(skew.narrowed(texts, merged, "chunk_id"), "chunk_id").withColumn("text", shown)


def merge(rows: DataFrame) -> DataFrame:
    """One row per (request, chunk): the role of the first occurrence, the union of topic and syllabus ids, its position."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = rows.groupBy("request_id", "chunk_id").agg(
        F.min("pos").alias("pos"), F.min_by("role", "pos").alias("role"), union("topic_ids").alias("topic_ids"), union("syllabus_ids").alias("syllabus_ids"),
    )
    order = Window.partitionBy("request_id").orderBy("pos")
    return merged.withColumn("position", F.row_number().over(order)).drop("pos")


def lane_counts(evidence: DataFrame) -> DataFrame:
    count = lambda role: F.count_if(F.col("role") == role)
    return evidence.groupBy("request_id").agg(
        count("TEXTBOOK_CONTENT").alias("textbook_chunks"), count("PAST_PAPER_STYLE").alias("past_paper_chunks"),
        count("MARKING_PATTERN").alias("marking_chunks"), F.count("*").alias("context_chunks"),
    )


def missing_topics(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """Selected topics without textbook or without past-paper evidence."""
    selected = requests.select("request_id", F.explode("topic_ids").alias("topic_id"))
    covered = evidence.select("request_id", "role", F.explode("topic_ids").alias("topic_id"))
    gap = lambda role: selected.join(
        covered.filter(F.col("role") == role), ["request_id", "topic_id"], "left_anti"
    ).withColumn("missing", F.lit(role))
    return gap("TEXTBOOK_CONTENT").unionByName(gap("PAST_PAPER_STYLE"))


def catalog_readiness(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per level: topics checked, largest context, topics without paper and without textbook evidence."""
    gaps = missing_topics(requests, evidence).groupBy("request_id").agg(
        F.count_if(F.col("missing") == "TEXTBOOK_CONTENT").alias("_book"), F.count_if(F.col("missing") == "PAST_PAPER_STYLE").alias("_paper")
    )
    joined = requests.join(lane_counts(evidence), "request_id", "left").join(gaps, "request_id", "left")
    return joined.groupBy("level").agg(
        F.count("*").alias("topics_checked"), F.coalesce(F.max("context_chunks"), F.lit(0)).alias("maximum_context_chunks"),
        F.count_if(F.col("_paper") > 0).alias("topics_without_topical_paper"), F.count_if(F.col("_book") > 0).alias("failing_topics"),
    )


# --- plans and slots -----------------------------------------------------------------------------------------


def plan_columns(requests: DataFrame) -> DataFrame:
    """Normalised difficulty, bounded question count and the half/half lane targets."""
    mapping = F.create_map(*[F.lit(v) for pair in DIFFICULTY.items() for v in pair])
    count = F.greatest(F.lit(1), F.least(F.col("question_count"), F.lit(20)))
    return requests.withColumns({
        "difficulty": F.coalesce(F.try_element_at(mapping, F.lower("difficulty")), F.upper("difficulty")),
        "question_count": count,
        "question_format": F.upper("question_format"),
        "textbook_questions": F.floor((count + 1) / 2).cast("int"),
        "past_paper_questions": F.floor(count / 2).cast("int"),
    })


def slots(count: Column, topic_ids: Column, catalog: Column) -> Column:
    """``array<struct<number, content_source, topic_ids, source_keys>>``; empty when a lane is missing.

    ``catalog`` is the bounded source list ``array<struct<source_key, role, topic_ids>>``.  Odd numbers
    use the textbook lane, even ones the paper lane; the topic index advances per pair and is shifted
    by one in the paper lane.
    """
    keys = lambda rows: F.transform(rows, lambda r: r["source_key"])
    of_role = lambda role: F.filter(catalog, lambda r: r["role"] == role)

    def fill(lanes: Column) -> Column:
        n_topics = F.size(topic_ids)

        def one(i: Column) -> Column:
            paper = i % 2 == 0
            index = (F.floor((i - 1) / 2) + F.when(paper, 1).otherwise(0)) % F.greatest(F.lit(1), n_topics)
            topic = F.get(topic_ids, index.cast("int"))
            scoped = lambda rows: F.filter(rows, lambda r: topic.isNull() | F.array_contains(r["topic_ids"], topic))
            book_keys = keys(scoped(lanes["book"]))
            own_paper = keys(scoped(lanes["paper"]))
            paper_keys = F.when(F.size(own_paper) > 0, own_paper).otherwise(keys(lanes["paper"]))
            pick = lambda options: F.get(options, ((i - 1) % F.greatest(F.lit(1), F.size(options))).cast("int"))
            book_key, paper_key = pick(book_keys), pick(paper_keys)
            return F.struct(
                i.alias("number"),
                F.when(paper, "PAST_PAPER").otherwise("TEXTBOOK").alias("content_source"),
                F.array_compact(F.array(topic)).alias("topic_ids"),
                F.when(paper, F.array(paper_key, book_key)).otherwise(F.array(book_key)).alias("source_keys"),
            )

        made = F.transform(F.sequence(F.lit(1), count), one)
        broken = F.exists(made, lambda s: F.exists(s["source_keys"], lambda k: k.isNull()))
        usable = (F.size(lanes["book"]) > 0) & (F.size(lanes["paper"]) > 0) & ~broken
        return F.filter(made, lambda s: usable)

    return T.let(F.struct(of_role("TEXTBOOK_CONTENT").alias("book"), of_role("PAST_PAPER_STYLE").alias("paper")), fill)


def structure_slots(allows_code: Column, code_kind: Column) -> Column:
    """The fixed eight questions and 25 marks of a mock test."""
    rows = []
    for number, (marks, kind) in enumerate(zip(SLOT_MARKS, SLOT_TYPES, strict=True), 1):
        coding = allows_code if number == 8 else F.lit(False)
        rows.append(F.struct(
            F.lit(number).alias("number"), F.lit(marks).alias("marks"), F.lit(kind).alias("question_type"),
            coding.alias("requires_coding"), F.when(coding, code_kind).alias("coding_kind"),
        ))
    return F.array(*rows)


def readiness(textbook_chunks: Column, paper_chunks: Column, missing: Column, slot_count: Column) -> Column:
    """Why an assessment cannot be generated, or null when it can."""
    return (
        F.when((textbook_chunks == 0), "NO_TEXTBOOK_EVIDENCE")
        .when(paper_chunks == 0, "NO_PAST_PAPER_EVIDENCE")
        .when(missing > 0, "SELECTED_TOPIC_WITHOUT_TEXTBOOK")
        .when(slot_count == 0, "UNALLOCATABLE_SLOTS")
    )
