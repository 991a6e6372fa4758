"""Text column expressions.

Every function takes and returns a ``Column`` and stays inside built-in expressions, so the work runs
in the JVM next to the scan.  Whitespace means Unicode whitespace throughout.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns that decide token and quality results.
WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
WS_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same characters, told apart from printable ASCII by one comparison, and those of them that are no blank.
QUICK_WS = rf"[[^!-~]&&{WS}]"
OTHER_WS = rf"[[^ -~]&&{WS}]"
WORD = rf"[!-~[^{WS[1:-1]}]]+"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_+/#.-]*"
UNREADABLE = (
    r"[^\p{L}\p{N}\s\x0B\x1C-\x1F\x{85}\p{Z}"
    r".,:;()\[\]{}+\-*/=<>\"'?!%&£#_]"
)
BOILERPLATE = (
    r"Do not write in this margin\.?",
    r"Candidate (?:name|number)[^\n]*",
    r"© UCLES[^\n]*",
    r"\.{8,}",
    r"This document consists of[^\n]*",
)
# Every boilerplate begins with one of these characters.
ANY_BOILERPLATE = rf"(?=[CcDdTt©.])(?iu:{'|'.join(BOILERPLATE)})"
CODE_LINE = r"(?iU)\b(DECLARE|FOR|WHILE|IF|PROCEDURE|FUNCTION)\b"
CODE_PAGE = r"(?iU)\b(DECLARE|PROCEDURE|FUNCTION|WHILE|FOR|SELECT|FROM)\b"
TABLE_PAGE = r"(?U)(?:\S+\s{3,}){2,}|\bTable\s+\d+"
NUMBERED_HEADING = r"(?U)^\d+(\.\d+)*\s"
MARKS = r"(?iU)\[\s*\d+\s*\]|\b\d+\s+marks?\b"
MOJIBAKE = r"Ã[^\n]|â€|ï¬|\x{FFFD}"
HEADING_STOP = ("and", "the", "for", "with", "its", "use", "uses", "level", "concept", "concepts")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Remove leading and trailing whitespace."""
    return F.btrim(_col(text), F.lit(WS_CHARACTERS))


def collapse(text: Column | str) -> Column:
    """Single spaces between words, none at the ends; runs that are one blank already are left alone."""
    return F.trim(F.regexp_replace(_col(text), rf"(?:{OTHER_WS}| (?={QUICK_WS})){QUICK_WS}*+", " "))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0))


def non_blank(text: Column | str) -> Column:
    """The value, or null when it is empty."""
    return F.nullif(_col(text), F.lit(""))


def tokens(text: Column | str) -> Column:
    """Lower-cased lexical tokens; ``_ + / # . -`` may follow the first letter or digit."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, F.lower)


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def token_count(text: Column | str) -> Column:
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN))


def has_tokens(text: Column | str, least: int) -> Column:
    """Whether the text has at least ``least`` tokens; reading ends at the last one that is needed."""
    return F.coalesce(_col(text), F.lit("")).rlike(rf"\A(?:[^A-Za-z0-9]*+{TOKEN}+){{{least}}}")


def slug(value: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(value)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean_text(text: Column | str) -> Column:
    """Drop exam boilerplate, squeeze blanks, keep at most one empty line between paragraphs."""
    out = _col(text)
    for pattern in BOILERPLATE:
        out = F.regexp_replace(out, f"(?iu){pattern}", "")
    # a text without any of them is read once, and blanks that stand alone are not replaced by themselves
    out = F.when(_col(text).rlike(ANY_BOILERPLATE), out).otherwise(_col(text))
    out = F.regexp_replace(out, r"\t[ \t]*+| [ \t]++", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def line_blocks(text: Column | str) -> Column:
    """``array<struct<block_type, text>>``, one entry per non-empty line."""
    lines = F.filter(F.transform(F.split(_col(text), "\n"), strip), lambda x: x != "")

    def block(line: Column) -> Column:
        heading = (F.length(line) < 120) & (is_upper(line) | line.rlike(NUMBERED_HEADING))
        kind = F.when(line.rlike(CODE_LINE), "CODE").when(heading, "HEADING").otherwise("PARAGRAPH")
        return F.struct(kind.alias("block_type"), line.alias("text"))

    return F.transform(lines, block)


def quality_score(text: Column | str) -> Column:
    """Share of readable characters, scaled down for texts shorter than 300 characters."""
    clean = strip(text)
    size = F.length(clean)
    readable = F.length(F.regexp_replace(clean, UNREADABLE, ""))
    density = F.least(size / F.lit(300.0), F.lit(1.0))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.bround((readable / size) * density, 3))


def needs_ocr(text: Column | str, min_characters: int = 100) -> Column:
    return (F.length(strip(text)) < min_characters) | (quality_score(text) < 0.75)


def contains_table(text: Column | str) -> Column:
    return _col(text).rlike(TABLE_PAGE)


def contains_code(text: Column | str) -> Column:
    return _col(text).rlike(CODE_PAGE)


def last_marks(text: Column | str) -> Column:
    """The last displayed mark value (``[n]`` or ``n marks``) as INT, null if none."""
    last = F.try_element_at(F.regexp_extract_all(_col(text), F.lit(MARKS), F.lit(0)), F.lit(-1))
    return F.regexp_extract(last, r"(\d+)", 1).try_cast("int")


def has_mojibake(text: Column | str) -> Column:
    return _col(text).rlike(MOJIBAKE)


def overlap(left: Column, right: Column) -> Column:
    """Number of distinct values two arrays share."""
    return F.size(F.array_intersect(left, right))


def coverage(wanted: Column, found: Column) -> Column:
    """Share of the distinct ``wanted`` terms that occur in ``found``."""
    return overlap(wanted, found) / F.greatest(F.lit(1), F.size(F.array_distinct(wanted)))


def long_terms(text: Column | str, stop: Sequence[str] = ()) -> Column:
    """Distinct tokens longer than two characters, without the stop list."""
    kept = F.filter(token_set(text), lambda t: F.length(t) > 2)
    return F.array_except(kept, F.array(*[F.lit(s) for s in stop])) if stop else kept


def heading_terms(text: Column | str) -> Column:
    """Alphabetic terms of three letters or more, lower-cased, minus the heading stop list."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit("[A-Za-z]{3,}"), F.lit(0))
    lowered = F.transform(found, F.lower)
    return F.array_except(lowered, F.array(*[F.lit(s) for s in HEADING_STOP]))


def lexical_score(query: Column, passage: Column, authority: Column) -> Column:
    """Share of query terms present in the passage plus a hundredth per authority level."""
    return coverage(token_set(query), token_set(passage)) + F.coalesce(authority, F.lit(0)) * F.lit(0.01)


def word_windows(text: Column | str, size: int, overlap_words: int) -> Column:
    """Sliding word windows; the last one ends at the last word."""
    step = max(1, size - overlap_words)

    def cut(parts: Column) -> Column:
        count = F.size(parts)
        last = F.ceil(F.greatest(count - size, F.lit(0)) / F.lit(step)).cast("int")
        pieces = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(parts, i * step + 1, F.lit(size)), " ")
        )
        return F.when(count == 0, F.array().cast("array<string>")).otherwise(pieces)

    return let(words(text), cut)


def page_pieces(size: int, overlap_words: int, least_page: int, least_window: int) -> Callable[[pd.Series], pd.Series]:
    """Helper of a user function: a page of ``least_page`` tokens or more, without blanks at its ends, followed by its
    ``word_windows`` of ``least_window`` tokens or more; Python splits at the same whitespace, and faster than a pattern."""
    step = max(1, size - overlap_words)
    enough = {n: re.compile(rf"(?:[^A-Za-z0-9]*+{TOKEN}+){{{n}}}") for n in (least_page, least_window)}

    def cut(text: str | None) -> list[str]:
        page = (text or "").strip()
        if not enough[least_page].match(page):
            return []
        parts = page.split()
        last = -(-max(0, len(parts) - size) // step)
        windows = (" ".join(parts[i * step:i * step + size]) for i in range(last + 1 if parts else 0))
        return [page, *(w for w in windows if enough[least_window].match(w))]

    return lambda texts: texts.map(cut)


def segments(text: Column | str) -> Column:
    """Blank-line blocks; single-line blocks over 420 characters are split at sentence ends."""
    body = _col(text)
    blocks = F.filter(F.transform(F.split(body, rf"\n{WS}*\n"), strip), lambda b: b != "")

    def expand(block: Column) -> Column:
        sentences = F.filter(F.transform(F.split(block, rf"(?<=[.!?]){WS}+"), strip), lambda s: s != "")
        keep_whole = F.contains(block, F.lit("\n")) | (F.length(block) <= 420)
        return F.when(keep_whole, F.array(block)).otherwise(sentences)

    return F.flatten(F.transform(blocks, expand))


def excerpt(text: Column, terms: Column, before: int = 140, size: int = 700) -> Column:
    """``size`` characters starting ``before`` characters ahead of the earliest term hit."""
    def cut(lowered: Column) -> Column:
        hits = F.filter(F.transform(terms, lambda t: F.position(t, lowered)), lambda p: p > 0)
        first = F.coalesce(F.array_min(hits), F.lit(1))
        return F.substring(text, F.greatest(F.lit(1), first - before), F.lit(size))

    return let(F.lower(text), cut)


def page_label(start: Column, end: Column) -> Column:
    """Printed page label: one page or a range."""
    single = F.concat(F.lit("Book p. "), start.cast("string"))
    span = F.concat(F.lit("Book pp. "), start.cast("string"), F.lit("–"), end.cast("string"))
    return F.when(start == end, single).otherwise(span)


def count_occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of a literal phrase."""
    removed = F.length(text) - F.length(F.replace(text, phrase, F.lit("")))
    return F.when(F.length(phrase) > 0, (removed / F.length(phrase)).cast("int")).otherwise(F.lit(0))


def json_field(document: Column | str, path: str) -> Column:
    return F.get_json_object(_col(document), path)
