"""SQL building blocks shared by the check statements: the adapters and text functions as SQL."""

from __future__ import annotations

import re

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_+/#.-]*"
EDGE = r"[^\p{L}\p{M}\p{N}_]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def words(x: str) -> str:
    return f"(CASE WHEN {collapse(x)} = '' THEN []::VARCHAR[] ELSE string_split({collapse(x)}, ' ') END)"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '{TOKEN}'), lambda t: lower(t))"


def token_count(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '{TOKEN}'))"


def clean(x: str) -> str:
    out = x
    for pattern in (
        r"Do not write in this margin\.?", r"Candidate (?:name|number)[^\n]*", r"© UCLES[^\n]*",
        r"\.{8,}", r"This document consists of[^\n]*",
    ):
        out = f"regexp_replace({out}, '(?i){pattern}', '', 'g')"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', E'\\n\\n', 'g')"
    return strip(out)


def word_test(x: str, body: str) -> str:
    """Case-insensitive whole-word test that treats accented letters as word characters."""
    return f"regexp_matches({x}, '(?i)(?:^|{EDGE})(?:{body})(?:{EDGE}|$)')"


def windows(parts: str, size: int, overlap: int) -> str:
    step = max(1, size - overlap)
    return (
        f"list_transform(range(0, CASE WHEN len({parts}) = 0 THEN 0 ELSE "
        f"CAST(ceil(greatest(len({parts}) - {size}, 0) / {step}.0) AS BIGINT) + 1 END), "
        f"lambda i: array_to_string({parts}[i * {step} + 1 : i * {step} + {size}], ' '))"
    )


def content_hash(x: str) -> str:
    return f"left(sha256(CAST(to_json({collapse(f'lower({x})')}) AS VARCHAR)), 24)"


PAGES = f"""
page_base AS (
  SELECT doc_id, text AS raw_text, lang, doc_id % 5 AS kind, doc_id // 25 AS shelf,
         CAST((doc_id % 25) // 5 + 1 AS INTEGER) AS page_number, {clean('text')} AS clean_text
  FROM documents),
pages_t AS (
  SELECT ['tb','sy','qp','ms','er'][kind + 1] || '_' || shelf AS document_id, page_number,
         ['TEXTBOOK','SYLLABUS','QUESTION_PAPER','MARK_SCHEME','EXAMINER_REPORT'][kind + 1] AS document_type,
         CASE WHEN shelf % 2 = 0 THEN 'O_LEVEL' ELSE 'A_LEVEL' END AS level,
         CASE WHEN shelf % 2 = 0 THEN '2210' ELSE '9618' END AS subject_code,
         CAST(2015 + shelf % 10 AS INTEGER) AS year, ['MJ','FM','ON'][shelf % 3 + 1] AS session,
         CAST(11 + shelf % 3 AS VARCHAR) AS component, [4,5,3,6,4][kind + 1] AS authority_level,
         shelf * 5 + kind AS ord, raw_text, clean_text, doc_id, lang
  FROM page_base)
"""


def chunks(size: int = 120, overlap: int = 20) -> str:
    """Parents and children of every page, as the chunk adapter builds them."""
    return f"""{PAGES},
c_words AS (
  SELECT *, {words('clean_text')} AS ws FROM pages_t WHERE {token_count('clean_text')} >= 20),
c_pieces AS (
  SELECT *, list_concat([{{'ct': 'PARENT_CONTEXT', 'tx': clean_text}}],
     list_transform(list_filter({windows('ws', size, overlap)}, lambda w: {token_count('w')} >= 25),
                    lambda w: {{'ct': 'EXPLANATION', 'tx': w}})) AS pieces
  FROM c_words),
c_off AS (
  SELECT *, coalesce(sum(len(pieces)) OVER (PARTITION BY document_id ORDER BY page_number
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c_pieces),
c_rows AS (
  SELECT * EXCLUDE (pieces, ws, off), unnest(pieces) AS piece,
         CAST(off + unnest(range(1, len(pieces) + 1)) AS INTEGER) AS seq FROM c_off),
c_ids AS (
  SELECT *, piece.ct AS content_type, piece.tx AS text,
         document_id || '_page_' || printf('%04d', page_number) || '_parent' AS page_parent,
         left(sha256(CAST(to_json({{'document_id': document_id, 'page': page_number, 'sequence': seq,
              'text': piece.tx, 'type': piece.ct}}) AS VARCHAR)), 8) AS h FROM c_rows),
chunks_t AS (
  SELECT CASE WHEN content_type = 'PARENT_CONTEXT' THEN page_parent
              ELSE document_id || '_explanation_' || printf('%04d', seq) || '_' || h END AS chunk_id,
         document_id, document_type, level, subject_code, year, session, component, page_number AS page_start,
         text, 'Qualification: ' || level || ' | Source: ' || document_type || ' | Subject: ' || subject_code
           || ' | Page: ' || page_number || chr(10) || text AS retrieval_text,
         {content_hash('text')} AS content_hash, {token_count('text')} AS token_count, authority_level, content_type,
         CASE WHEN content_type <> 'PARENT_CONTEXT' THEN page_parent END AS parent_chunk_id,
         ord * 10000000 + seq AS ord,
         CASE WHEN content_type <> 'PARENT_CONTEXT' AND document_type IN ('QUESTION_PAPER','MARK_SCHEME')
              THEN page_number || '(' || chr(CAST(97 + (ord * 10000000 + seq) % 3 AS INTEGER)) || ')' END
           AS question_number
  FROM c_ids)
"""


CHUNKS = chunks()

QUESTIONS = f"""
q_words AS (SELECT item_id, text AS passage, {words('text')} AS ws FROM benchmark),
q_half AS (SELECT *, greatest(1, len(ws) // 2) AS half FROM q_words),
q_parts AS (SELECT *, array_to_string(ws[1:half], ' ') AS a, array_to_string(ws[half + 1:], ' ') AS b FROM q_half),
questions_t AS (
  SELECT 'q' || item_id AS query_id, item_id, passage,
         ['Compare ' || a || ' and ' || b, 'What is ' || a || ' ' || b, 'Explain the algorithm ' || a || ' ' || b,
          'Write an SQL query for ' || a || ' ' || b, 'Answer ' || CASE WHEN item_id % 2 = 0 THEN '2210' ELSE '9618' END || '/' || (11 + item_id % 3) || '/'
            || ['M/J','F/M','O/N'][item_id % 3 + 1] || '/' || (15 + item_id % 10) || ' Question ' || (1 + item_id % 5)
            || ' ' || a || ' ' || b,
          a || ' ' || b][item_id % 6 + 1] AS query,
         CASE WHEN item_id % 3 = 0 THEN 'O_LEVEL' END AS level
  FROM q_parts)
"""

EXCHANGES = """
ex_pairs AS (
  SELECT u.conv_id, u.turn, u.text AS query, r.text AS answer
  FROM conversations u JOIN conversations r
    ON r.conv_id = u.conv_id AND r.turn = u.turn + 1 AND u.role = 'user' AND r.role = 'assistant')
"""

TRACES = """
traces_t AS (
  SELECT CAST(event_id AS VARCHAR) AS trace_id, CAST(user_id AS VARCHAR) AS session_id, ts AS created_at,
         event_type AS category, event_type <> 'error' AS success,
         CASE WHEN event_type = 'error' THEN ['MISSING_CONTEXT','INVALID_CITATION_IDENTITY','EMPTY_ANSWER'][event_id % 3 + 1] END
           AS failure_category,
         value AS latency_ms, CAST(json_extract(props, '$.k') AS INTEGER) AS input_tokens,
         CAST(json_extract(props, '$.k') AS INTEGER) * 2 AS output_tokens, value / 1000.0 AS total_cost,
         event_id % 4 = 0 AS cache_hit, CASE WHEN event_id % 5 <> 0 THEN 'm' || event_id % 3 END AS model
  FROM events)
"""

GRADES = """
grades_t AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS grade_id, l_orderkey AS submission_id,
         l_quantity AS ai_score,
         CASE WHEN l_returnflag <> 'N' THEN least(50.0, greatest(0.0, l_quantity + l_linenumber - 4)) END AS human_score,
         50.0 AS max_score, l_linestatus AS comments, l_discount AS confidence_score
  FROM lineitem)
"""

INDEX = f"""
idx AS (SELECT chunk_id, ord, document_type, level, {tokens('retrieval_text')} AS toks
        FROM chunks_t WHERE content_type <> 'PARENT_CONTEXT'),
post AS (SELECT chunk_id, ord, document_type, level, dl, term, count(*) AS tf
         FROM (SELECT chunk_id, ord, document_type, level, len(toks) AS dl, unnest(toks) AS term FROM idx) GROUP BY ALL),
tdf AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len(toks)) AS average_length FROM idx)
"""


def _rule(name: str, test: str) -> str:
    return f"WHEN {test} THEN '{name}'"


_W = lambda body: word_test("query", body)
CATEGORY = "CASE " + " ".join([
    _rule("ASSESSMENT_GENERATION",
          _W(f"(?:generate|create|make){EDGE}(?:[^\\n]*{EDGE})?(?:quiz|mock paper|assessment|assignment)")),
    _rule("MCQ", r"regexp_matches(query, '(?i)(?:^|\n)\s*(?:[A-D][.)]|\([A-D]\))\s+')"),
    _rule("FILL_IN_THE_BLANK", f"(regexp_matches(query, '_{{3,}}') OR {_W('fill (?:in )?the blank')})"),
    _rule("SQL", _W("SQL|SELECT|INSERT|UPDATE|DELETE FROM|CREATE TABLE|JOIN|primary key|foreign key")),
    _rule("DEBUGGING", _W(f"(?:debug|fix|correct)[^\\n]*{EDGE}(?:code|program|algorithm)|(?:syntax|logic|runtime) error")),
    _rule("TRACE_TABLE", _W("trace table|dry[ -]?run|trace the algorithm|variable values")),
    _rule("PROGRAMMING", _W("pseudocode|algorithm|procedure|function|recursion|binary search|linear search|bubble sort"
                            "|insertion sort|write (?:a )?program|Python")),
    _rule("CALCULATION", _W("calculate|convert|show your working|binary addition|hexadecimal conversion|floating[ -]?point")),
    _rule("COMPARISON", _W("compare|contrast|difference between|similarities and differences")),
    _rule("DEFINITION", f"regexp_matches(query, '(?i)^\\s*(?:define|what is|what does [^\\n]+ mean)(?:{EDGE}|$)')"),
    _rule("EXAMINER_FEEDBACK", _W("examiner report|candidate mistake|common mistake")),
    _rule("SYLLABUS", _W("syllabus|learning objective|assessment objective")),
]) + " ELSE 'THEORY' END"

_HEADER = r"(?i)\b(2210|9618)\s*/?\s*(\d{2})?\s*/?\s*(M/J|MJ|F/M|FM|O/N|ON)?\s*/?\s*(20\d{2}|\d{2})?"
PROFILE = f"""
ref_t AS (
  SELECT *, nullif(regexp_extract(query, '{_HEADER}', 1), '') AS subject_code,
    coalesce(nullif(regexp_extract(query, '(?i)\\bpaper\\s*(\\d)', 1), ''), nullif(regexp_extract(query, '{_HEADER}', 2), '')) AS component,
    nullif(upper(replace(regexp_extract(query, '{_HEADER}', 3), '/', '')), '') AS session,
    TRY_CAST(coalesce(nullif(regexp_extract(query, '\\b(20\\d{{2}})\\b', 1), ''),
      CASE WHEN length(regexp_extract(query, '{_HEADER}', 4)) = 2 THEN '20' || regexp_extract(query, '{_HEADER}', 4)
           ELSE nullif(regexp_extract(query, '{_HEADER}', 4), '') END) AS INTEGER) AS year,
    nullif(regexp_replace(regexp_extract(query, '(?i)(?:question|q\\.)\\s*(\\d+(?:\\s*\\([a-z0-9]+\\))*)', 1), '\\s+', '', 'g'), '') AS question_number,
    {CATEGORY} AS rule_category
  FROM questions_t),
profile_t AS (
  SELECT query_id, item_id, passage, query, subject_code, component, session, year, question_number,
    CASE WHEN question_number IS NOT NULL AND component IS NOT NULL THEN 'EXAM_QUESTION' ELSE rule_category END AS category,
    coalesce(level, CASE subject_code WHEN '9618' THEN 'A_LEVEL' WHEN '2210' THEN 'O_LEVEL' END) AS level
  FROM ref_t),
plan_t AS (
  SELECT *, category IN ('ASSESSMENT_GENERATION','COMPARISON','PROGRAMMING','SQL','DEBUGGING','TRACE_TABLE','MCQ') AS multi_query,
    CASE category
      WHEN 'ASSESSMENT_GENERATION' THEN ['TEXTBOOK','SYLLABUS','QUESTION_PAPER','MARK_SCHEME','EXAMINER_REPORT']
      WHEN 'PROGRAMMING' THEN ['TEXTBOOK','SYLLABUS','QUESTION_PAPER'] WHEN 'SQL' THEN ['TEXTBOOK','SYLLABUS','QUESTION_PAPER']
      WHEN 'DEBUGGING' THEN ['TEXTBOOK','QUESTION_PAPER','SYLLABUS'] WHEN 'TRACE_TABLE' THEN ['QUESTION_PAPER','TEXTBOOK','MARK_SCHEME']
      WHEN 'CALCULATION' THEN ['TEXTBOOK','QUESTION_PAPER','MARK_SCHEME'] WHEN 'MCQ' THEN ['QUESTION_PAPER','MARK_SCHEME','TEXTBOOK','SYLLABUS']
      WHEN 'FILL_IN_THE_BLANK' THEN ['QUESTION_PAPER','MARK_SCHEME','TEXTBOOK']
      WHEN 'EXAM_QUESTION' THEN ['QUESTION_PAPER','MARK_SCHEME','TEXTBOOK','SYLLABUS','MARKING_PATTERN']
      ELSE ['TEXTBOOK','SYLLABUS'] END AS preferred_types,
    CASE category WHEN 'ASSESSMENT_GENERATION' THEN 12 WHEN 'DEFINITION' THEN 5 WHEN 'COMPARISON' THEN 8 WHEN 'PROGRAMMING' THEN 8
      WHEN 'SQL' THEN 8 WHEN 'DEBUGGING' THEN 8 WHEN 'TRACE_TABLE' THEN 8 WHEN 'CALCULATION' THEN 7 WHEN 'MCQ' THEN 5
      WHEN 'FILL_IN_THE_BLANK' THEN 5 WHEN 'EXAM_QUESTION' THEN 8 ELSE 6 END AS context_chunks,
    CASE category WHEN 'ASSESSMENT_GENERATION' THEN 20000 WHEN 'DEFINITION' THEN 9000 WHEN 'COMPARISON' THEN 15000 WHEN 'PROGRAMMING' THEN 16000
      WHEN 'SQL' THEN 16000 WHEN 'DEBUGGING' THEN 16000 WHEN 'TRACE_TABLE' THEN 16000 WHEN 'CALCULATION' THEN 13000 WHEN 'MCQ' THEN 9000
      WHEN 'FILL_IN_THE_BLANK' THEN 9000 WHEN 'EXAM_QUESTION' THEN 15000 ELSE 12000 END AS context_chars
  FROM profile_t)
"""


def _bare(pattern: str) -> str:
    spaced = f"regexp_replace(query, '(?i)\\b(?:{pattern})\\b', ' ', 'g')"
    single = f"regexp_replace({spaced}, '{WS}+', ' ', 'g')"
    return f"regexp_replace({single}, '^[ .:\\-]+|[ .:\\-]+$', '', 'g')"


VARIANTS = f"""
bare_t AS (SELECT *, {strip('query')} AS q1, {_bare('answer|question|marks?|explain|state|give|write|show your working')} AS bare,
   CASE category WHEN 'SQL' THEN 'SQL syntax example database' WHEN 'PROGRAMMING' THEN 'algorithm pseudocode worked example'
     WHEN 'DEBUGGING' THEN 'program error correction explanation' WHEN 'TRACE_TABLE' THEN 'algorithm trace variable values'
     WHEN 'MCQ' THEN 'definition concept evidence' WHEN 'COMPARISON' THEN 'similarities differences advantages disadvantages' END AS suffix
   FROM plan_t),
both_t AS (SELECT *, CASE WHEN NOT multi_query THEN NULL WHEN bare <> '' AND lower(bare) <> lower(q1) THEN bare
   WHEN suffix IS NOT NULL THEN (CASE WHEN bare = '' THEN query ELSE bare END) || ' ' || suffix END AS q2 FROM bare_t),
variants_t AS (
  SELECT query_id, CAST(1 AS INTEGER) AS variant, q1 AS vquery, level FROM both_t
  UNION ALL SELECT query_id, CAST(2 AS INTEGER), q2, level FROM both_t WHERE q2 IS NOT NULL AND q2 <> q1)
"""

SPARSE = f"""
vt AS (SELECT query_id, variant, level AS want, term, count(*) AS qtf
       FROM (SELECT query_id, variant, level, unnest({tokens('vquery')}) AS term FROM variants_t) GROUP BY ALL),
sparse_s AS (
  SELECT query_id, variant, chunk_id, ord, document_type,
     round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
        / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(1.0, average_length)))), 9) AS score
  FROM vt JOIN post USING (term) JOIN tdf USING (term), st
  WHERE want IS NULL OR want = level GROUP BY ALL),
sparse_r AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, ord) AS rank
             FROM sparse_s WHERE score <> 0 QUALIFY rank <= 80)
"""


def slots(rows: str, key: str) -> str:
    """Hash-embedding cells of ``rows(key, term)``: slot, weight, norm."""
    return f"""
  SELECT {key}, slot, w, sqrt(sum(w * w) OVER (PARTITION BY {key})) AS norm FROM (
    SELECT {key}, v % 384 AS slot, sum(CASE WHEN v % 2 = 1 THEN 1.0 ELSE -1.0 END) AS w
    FROM (SELECT {key}, CAST('0x' || left(sha256(term), 8) AS BIGINT) AS v FROM {rows}) GROUP BY ALL) WHERE w <> 0"""


DENSE = f"""
chunk_cells AS ({slots("(SELECT chunk_id, unnest(toks) AS term FROM idx)", "chunk_id")}),
query_cells AS ({slots("(SELECT query_id || '#' || variant AS qv, unnest(" + tokens('vquery') + ") AS term FROM variants_t)", "qv")}),
dense_pairs AS (
  SELECT qv, chunk_id, sum(q.w * c.w / q.norm / c.norm) AS s
  FROM query_cells q JOIN chunk_cells c USING (slot) GROUP BY ALL),
dense_s AS (
  SELECT v.query_id, v.variant, i.chunk_id, i.ord, i.document_type, round(coalesce(s, 0.0), 9) + 0.0 AS score
  FROM variants_t v CROSS JOIN idx i LEFT JOIN dense_pairs p ON p.qv = v.query_id || '#' || v.variant AND p.chunk_id = i.chunk_id
  WHERE (v.level IS NULL OR v.level = i.level) AND len(i.toks) > 0),
dense_r AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, ord) AS rank
            FROM dense_s QUALIFY rank <= 80)
"""

EXACT = """
exact_t AS (
  SELECT p.query_id, c.chunk_id, c.document_type, c.page_start, c.ord,
    row_number() OVER (PARTITION BY p.query_id ORDER BY c.document_type <> 'MARK_SCHEME', c.page_start, c.ord) AS place
  FROM plan_t p JOIN chunks_t c ON c.subject_code = p.subject_code AND c.year = p.year AND c.session = p.session
    AND c.component = p.component
    AND (p.question_number IS NULL OR c.question_number = p.question_number
         OR starts_with(c.question_number, p.question_number || '(')))
"""

FUSED = """
both_r AS (SELECT query_id, variant, chunk_id, document_type, rank, 0 AS lane FROM sparse_r
           UNION ALL SELECT query_id, variant, chunk_id, document_type, rank, 1 FROM dense_r),
rrf_t AS (SELECT query_id, chunk_id, document_type, round(sum(1.0 / (60 + rank)), 12) AS rrf_score,
            min({'l': lane, 'v': variant, 'r': rank}) AS first_seen FROM both_r GROUP BY ALL),
fused_t AS (
  SELECT r.query_id, r.chunk_id, r.document_type, r.rrf_score,
    row_number() OVER (PARTITION BY r.query_id ORDER BY round(r.rrf_score + CASE WHEN list_position(preferred_types, r.document_type) > 0
       THEN (len(preferred_types) + 1 - list_position(preferred_types, r.document_type)) * 1e-6 ELSE 0 END, 12) DESC, first_seen) AS rn
  FROM rrf_t r JOIN plan_t p USING (query_id)
  WHERE list_contains(preferred_types, r.document_type)
    AND NOT EXISTS (SELECT 1 FROM exact_t e WHERE e.query_id = r.query_id AND e.chunk_id = r.chunk_id)),
exact_n AS (SELECT query_id, count(*) AS n_exact FROM exact_t GROUP BY 1),
cand_t AS (
  SELECT query_id, chunk_id, document_type, 1.0 AS rrf_score, 'exact_metadata' AS route, place FROM exact_t
  UNION ALL
  SELECT f.query_id, f.chunk_id, f.document_type, f.rrf_score, 'hybrid_rrf', coalesce(n_exact, 0) + rn
  FROM fused_t f LEFT JOIN exact_n USING (query_id) WHERE rn <= greatest(1, 24 - coalesce(n_exact, 0)))
"""

RETRIEVAL = ",".join([CHUNKS, INDEX, QUESTIONS, PROFILE, VARIANTS, SPARSE, DENSE, EXACT, FUSED])

COVERAGE_STOP = ("['what','when','where','which','that','this','with','from','into','about','explain','define','answer',"
                 "'question','using','write','show']")
RANKED = f"""
question_w AS (SELECT query_id, arg_min(c.text, place) AS wording FROM exact_t JOIN chunks_t c USING (chunk_id)
               WHERE c.document_type = 'QUESTION_PAPER' GROUP BY 1),
rerank_in AS (
  SELECT d.query_id, d.chunk_id, d.place, list_distinct({tokens("coalesce(nullif(wording, ''), p.query)")}) AS qt,
         list_distinct({tokens('c.retrieval_text')}) AS ct, c.authority_level, greatest(p.context_chunks, 8) AS k
  FROM cand_t d JOIN plan_t p USING (query_id) JOIN chunks_t c USING (chunk_id) LEFT JOIN question_w w USING (query_id)
  WHERE route = 'hybrid_rrf'),
rerank_t AS (
  SELECT query_id, chunk_id, round(len(list_intersect(qt, ct)) / CAST(greatest(1, len(qt)) AS DOUBLE) + 0.01 * authority_level, 9) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rn, k FROM rerank_in QUALIFY rn <= k),
ranked_t AS (
  SELECT query_id, chunk_id, CAST(NULL AS DOUBLE) AS score, place AS position, route FROM cand_t WHERE route = 'exact_metadata'
  UNION ALL SELECT r.query_id, r.chunk_id, r.score, coalesce(n_exact, 0) + rn, 'hybrid_rrf' FROM rerank_t r LEFT JOIN exact_n USING (query_id)),
cover_t AS (
  SELECT r.query_id, max(CASE WHEN c.document_type IN ('TEXTBOOK','SYLLABUS','EXAMINER_REPORT') AND len(terms) > 0
      THEN len(list_intersect(terms, list_distinct({tokens('c.text')}))) / CAST(len(terms) AS DOUBLE) ELSE 0.0 END) AS coverage,
    bool_or(route = 'exact_metadata' AND c.document_type = 'MARK_SCHEME') AS scheme, count(*) AS n_rows
  FROM ranked_t r JOIN chunks_t c USING (chunk_id)
  JOIN (SELECT query_id, list_filter(list_distinct({tokens('query')}), lambda t: length(t) > 2 AND NOT list_contains({COVERAGE_STOP}, t)) AS terms
        FROM plan_t) q USING (query_id) GROUP BY 1)
"""


# --- the whole path: a second pass for weak questions, parents, compression, budget ---------------------

CORRECTED = (
    f"trim({_bare('please|could you|explain|describe|write|answer|question')} || ' ' || CASE category "
    "WHEN 'PROGRAMMING' THEN 'algorithm prerequisite steps pseudocode' WHEN 'SQL' THEN 'SQL syntax SELECT FROM WHERE example' "
    "WHEN 'COMPARISON' THEN 'definition differences advantages disadvantages' WHEN 'CALCULATION' THEN 'method formula worked example' "
    "ELSE 'definition explanation' END)"
)
_PASS = (
    "questions_t", "ref_t", "profile_t", "plan_t", "bare_t", "both_t", "variants_t", "vt", "sparse_s", "sparse_r", "query_cells", "dense_pairs",
    "dense_s", "dense_r", "exact_t", "both_r", "rrf_t", "fused_t", "exact_n", "cand_t", "question_w", "rerank_in", "rerank_t", "ranked_t", "cover_t",
)


def second_pass() -> str:
    """The retrieval statements again, over ``questions_t2``."""
    again = ",".join([PROFILE, VARIANTS, SPARSE, DENSE[DENSE.index("query_cells AS"):], EXACT, FUSED, RANKED])
    return re.sub(rf"\b({'|'.join(_PASS)})\b", r"\g<1>2", again)


def _report(n: str) -> str:
    return f"""SELECT p.query_id, p.query, p.context_chunks, p.context_chars, coalesce(scheme, false) AS scheme,
    coalesce(n_rows, 0) > 0 AND (coalesce(scheme, false) OR coalesce(coverage, 0.0) >= 0.2) AS sufficient FROM plan_t{n} p LEFT JOIN cover_t{n} USING (query_id)"""


COMPRESSION_STOP = "['what','when','where','which','that','this','with','from','into','about','explain','define','answer','question','state','give','describe','identify']"
_STATE = "{{'used': {used}, 'full': {full}, 'chosen': {chosen}}}"
_FIRST = "len(a.chosen) = 0"
_PIECE = f"CASE WHEN {_FIRST} THEN left(x.chosen[1].segment, CAST(lim AS BIGINT)) ELSE x.chosen[1].segment END"
_ADDED = f"length({_PIECE}) + CASE WHEN {_FIRST} THEN 0 ELSE 2 END"
_CHOSEN = _STATE.format(
    used=f"a.used + {_ADDED}", full=f"a.used + {_ADDED} >= lim * 0.85",
    chosen=f"list_concat(a.chosen, [{{'pos': x.chosen[1].pos, 'segment': {_PIECE}}}])",
)
_EMPTY = "{'used': 0::BIGINT, 'full': false, 'chosen': []::STRUCT(pos BIGINT, segment VARCHAR)[]}"
_GREEDY = f"""array_to_string(list_transform(list_sort(list_reduce(list_concat([{_EMPTY}], i.segments),
    lambda a, x: CASE WHEN a.full OR (NOT ({_FIRST}) AND a.used + {_ADDED} > lim) THEN a ELSE {_CHOSEN} END).chosen), lambda c: c.segment), chr(10) || chr(10))"""
#: Read more than once: computed once.
_SHARED = (
    "chunks_t|idx|post|tdf|st|chunk_cells|(?:plan_t|variants_t|sparse_r|dense_r|exact_t|cand_t|ranked_t|cover_t|report)[12]?|kept|grown|typed|head|items"
)


def grounded(questions: str = QUESTIONS, maximum: int | None = None) -> str:
    """Everything up to ``context_t`` for the rows of ``questions_t``; ``maximum`` takes the place of the plan's chunk count."""
    first = ",".join([CHUNKS, INDEX, questions, PROFILE, VARIANTS, SPARSE, DENSE, EXACT, FUSED])
    statements = f"""{first}, {RANKED},
report1 AS ({_report("")}),
questions_t2 AS (SELECT q.query_id, q.item_id, q.passage, {CORRECTED.replace("query", "p.query", 1).replace("category", "p.category")} AS query, q.level
  FROM questions_t q JOIN plan_t p USING (query_id) JOIN report1 r USING (query_id) WHERE NOT r.sufficient),
{second_pass()},
report2 AS ({_report("2")}),
kept AS (SELECT r.query_id, r.chunk_id, r.position, r.route, f.* EXCLUDE (query_id) FROM ranked_t r JOIN report1 f USING (query_id) WHERE f.sufficient
  UNION ALL SELECT r.query_id, r.chunk_id, r.position, r.route, f.* EXCLUDE (query_id) FROM ranked_t2 r JOIN report2 f USING (query_id)),
steps AS (SELECT query_id, chunk_id, position, 0 AS step FROM kept WHERE NOT scheme AND sufficient
  UNION ALL SELECT k.query_id, c.parent_chunk_id, k.position, 1 FROM kept k JOIN chunks_t c USING (chunk_id)
    JOIN chunks_t p ON p.chunk_id = c.parent_chunk_id AND p.content_type = 'PARENT_CONTEXT' WHERE NOT k.scheme AND k.sufficient),
grown AS (SELECT * FROM steps QUALIFY step = 0 OR row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY position, step) = 1),
typed AS (SELECT g.*, c.text, k.query, k.context_chunks, k.context_chars, h.document_type IN ('MARK_SCHEME','QUESTION_PAPER','MARKING_PATTERN') AS whole
  FROM grown g JOIN chunks_t c USING (chunk_id) JOIN kept k ON k.query_id = g.query_id AND k.position = g.position JOIN chunks_t h ON h.chunk_id = k.chunk_id),
head AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position, step) AS rn FROM typed WHERE length(text) > 0 QUALIFY rn <= context_chunks),
blocks AS (SELECT query_id, rn, list_filter(list_transform(regexp_split_to_array(text, '\n{WS}*\n'), lambda b: {strip('b')}), lambda b: b <> '') AS bs FROM head),
cut AS (SELECT query_id, rn, flatten(list_transform(bs, lambda b: CASE WHEN contains(b, chr(10)) OR length(b) <= 420 THEN [b] ELSE
    list_filter(list_transform(string_split(regexp_replace(b, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '') END)) AS ss FROM blocks),
asked AS (SELECT DISTINCT query_id, list_filter(list_distinct({tokens('query')}), lambda t: length(t) > 2 AND NOT list_contains({COMPRESSION_STOP}, t)) AS terms FROM kept),
seg AS (SELECT query_id, rn, unnest(ss) AS segment, unnest(range(0, len(ss))) AS pos FROM cut),
weighed AS (SELECT query_id, rn, segment, pos, length(segment) AS len, terms, list_distinct({tokens('segment')}) AS found FROM seg JOIN asked USING (query_id)),
listed AS (SELECT query_id, rn, list({_STATE.format(used="0::BIGINT", full="false", chosen="[{'pos': pos, 'segment': segment}]")} ORDER BY
    -round(len(list_intersect(terms, found)) / CAST(greatest(1, len(terms)) AS DOUBLE) * 4 + len(list_intersect(terms, found)) / CAST(greatest(1, len(found)) AS DOUBLE) * 2
      + CASE WHEN pos = 0 OR len < 120 THEN 0.2 ELSE 0.0 END, 9), pos) AS segments FROM weighed GROUP BY ALL),
items AS (SELECT h.*, coalesce(l.segments, []) AS segments FROM head h LEFT JOIN listed l USING (query_id, rn)),
filled(query_id, rn, used, chunk_id, selected, original) AS (
  SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT FROM items
  UNION ALL
  SELECT query_id, rn, used + length(sel), chunk_id, sel, length(text) FROM (
    SELECT i.query_id, i.rn, i.used, i.chunk_id, i.text, CASE WHEN length(i.text) <= lim OR i.whole THEN left(i.text, CAST(lim AS BIGINT)) ELSE {_GREEDY} END AS sel
    FROM (SELECT i.*, f.used, least(i.context_chars - f.used, 2400) AS lim FROM filled f JOIN items i ON i.query_id = f.query_id AND i.rn = f.rn + 1 WHERE f.used < i.context_chars) i)),
context_t AS (
  SELECT query_id, position AS context_position, chunk_id, false AS compressed, text, length(text) AS original FROM kept JOIN chunks_t USING (chunk_id) WHERE scheme AND route = 'exact_metadata'
  UNION ALL SELECT query_id, rn, chunk_id, length(selected) < original, selected, original FROM filled WHERE rn > 0)"""
    if maximum:
        statements = statements.replace("greatest(p.context_chunks, 8)", str(max(maximum, 8))).replace("p.query, p.context_chunks,", f"p.query, {maximum} AS context_chunks,")
    return re.sub(rf"\b({_SHARED}) AS \(", r"\g<1> AS MATERIALIZED (", statements)


def typed(statements: str) -> str:
    """``grounded`` statements whose ``questions_t`` also carry ``wanted``, the one document type they ask for (or null)."""
    fits = lambda value: f"(wanted IS NULL OR wanted = {value})"
    for old, new in (
        ("SELECT query_id, item_id, passage, query, subject_code", "SELECT query_id, item_id, passage, wanted, query, subject_code"),
        ("AS vquery, level FROM", "AS vquery, level, wanted FROM"),
        ("q2, level FROM", "q2, level, wanted FROM"),
        ("level AS want, term", "level AS want, wanted, term"),
        ("(SELECT query_id, variant, level, unnest(", "(SELECT query_id, variant, level, wanted, unnest("),
        ("WHERE want IS NULL OR want = level", f"WHERE (want IS NULL OR want = level) AND {fits('document_type')}"),
        ("(v.level IS NULL OR v.level = i.level)", f"(v.level IS NULL OR v.level = i.level) AND {fits('i.document_type')}"),
        ("AND c.component = p.component", f"AND c.component = p.component AND {fits('c.document_type')}"),
        ("list_contains(preferred_types, r.document_type)", "(CASE WHEN wanted IS NULL THEN list_contains(preferred_types, r.document_type) ELSE r.document_type = wanted END)"),
        ("coalesce(coverage, 0.0) >= 0.2)", "coalesce(coverage, 0.0) >= 0.2 OR coalesce(wanted = 'QUESTION_PAPER', false))"),
        ("q.level\n  FROM questions_t q", "q.level, q.wanted\n  FROM questions_t q"),
    ):
        if old not in statements:
            raise ValueError(f"the retrieval statements have no {old!r}")
        statements = statements.replace(old, new)
    return statements
