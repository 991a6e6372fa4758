"""Secret scans with multipart credential linking, in DataFrame expressions only.

Base kinds are reported as they match.  Weak parts (named identifiers, loosely named or bare secrets, and
endpoints) say little alone: they are joined by interval with the other parts of the same document and
reported only when complementary parts lie within ``SCOPE`` characters: a weak secret next to an identifier
or endpoint, a weak identifier next to a secret, an endpoint next to both.

Places of matches come from cutting the text at the pattern: a match begins where the pieces and matches
before it end.  Every costly pattern is guarded by a cheaper condition that it implies.  Only documents with
weak parts take part in the join, on (document, block of ``SCOPE`` characters): a part's ends stand in at most
two blocks and reach into at most four, whatever its length, so no key holds more parts than have an end near
a block.

Cases: null texts are empty; a text without matches has empty spans; rows with one id and text are linked
alike and all stay; null ids are an id of their own; places count code points, ends are exclusive; other
columns stay in ``redact`` and are ignored in ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

#: Characters between the parts of one credential, at most.
SCOPE = 400
MASK = "[SECRET]"

_VALUE = r"[A-Za-z0-9+/_.=-]"
_SET = r"""["']?\x20*[:=]\x20*["']?"""
#: Base kinds in the order in which they are listed; assign has its value in group 2, with a least length.
ASSIGN = rf"((?i:password|passwd|secret|token|api_?key)){_SET}({_VALUE}+)"
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts.
LOGIN = rf"(?i:\b(?:user(?:name|_?id)?|login|account|client_?id|key_?id))\b{_SET}([A-Za-z0-9._@-]{{3,}})"
LOOSE = rf"(?i:\b(?:pass|pwd|auth|credentials?|private_?key|access_?key))\b{_SET}({_VALUE}{{6,}})"
BARE = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+"""

KINDS = ("assign", "access", "hex", "login", "loose", "bare", "endpoint")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "login": "id", "loose": "secret", "bare": "secret", "endpoint": "endpoint"}
_SPAN = "array<struct<start: int, kind: int, end: int>>"


def _spans(text: Column, pattern: str, kind: str, guard: Column, group: int = 0, least: int = 0) -> Column:
    """Spans of all leftmost matches; those whose ``group`` is shorter than ``least`` are dropped."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"))), values, lambda s, v: F.struct(s.gap.alias("gap"), s.size.alias("size"), (F.length(v) >= least).alias("ok")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(state: Column, x: Column) -> Column:
        begin = state.at + x.gap
        end = begin + F.coalesce(x.size, F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x.ok, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"))

    found = F.aggregate(sizes, start, add, lambda s: s.spans)
    return F.when(guard & text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, base, weak``: span arrays of every row, in one pass over the texts."""
    keyed = common.keyed_texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    set_sign = text.contains(":") | text.contains("=")
    digit = text.rlike("[0-9]")
    base = F.concat(
        _spans(text, ASSIGN, "assign", set_sign, 2, ASSIGN_LEAST),
        _spans(text, ACCESS, "access", text.contains("AKIA")),
        _spans(text, HEX, "hex", F.lit(True)),
    )
    weak = F.concat(
        _spans(text, LOGIN, "login", set_sign),
        _spans(text, LOOSE, "loose", set_sign),
        _spans(text, BARE, "bare", digit),
        _spans(text, ENDPOINT, "endpoint", text.contains("://")),
    )
    return keyed.select("doc_id", F.xxhash64("text").alias("text_key"), F.array_sort(base).alias("base"), weak.alias("weak"))


def _has(kinds: list[str]) -> Column:
    return F.col("kind").isin([KINDS.index(k) for k in kinds])


def _with_role(role: str) -> list[str]:
    return [k for k in KINDS if ROLE[k] == role]


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, text_key, linked``: weak spans with complementary parts within ``scope`` characters."""
    several = found.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).dropDuplicates(["doc_id", "text_key"])
    spans = several.select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("s")).select("doc_id", "text_key", "s.*")

    def block(at: Column) -> Column:
        return F.floor(at / F.lit(scope))

    # a partner before a part is near its start, one after it near its end
    stands = F.array_distinct(F.array(block(F.col("start")), block(F.col("end"))))
    before, after = (F.sequence(block(F.col(a) - x), block(F.col(a) + y)) for a, x, y in (("start", scope, 0), ("end", 0, scope)))
    reach = spans.withColumn("block", F.explode(F.array_distinct(F.concat(before, after))))

    def near(candidates: DataFrame, role: list[str]) -> DataFrame:
        c, p = candidates.withColumn("block", F.explode(stands)).alias("c"), reach.where(_has(role)).alias("p")
        meets = F.col("c.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("c.text_key") == F.col("p.text_key")) & (F.col("c.block") == F.col("p.block"))
        # parts of one place are one thing read twice
        apart = (F.col("c.end") <= F.col("p.start")) | (F.col("p.end") <= F.col("c.start"))
        gap = F.greatest(F.col("c.start") - F.col("p.end"), F.col("p.start") - F.col("c.end"))
        return c.join(p, meets & apart & (gap <= scope), "left_semi").drop("block").distinct()

    ids, secrets, ends = _with_role("id"), _with_role("secret"), _with_role("endpoint")
    chosen = near(spans.where(_has(["loose", "bare"])), ids + ends).unionByName(near(spans.where(_has(["login"])), secrets))
    chosen = chosen.unionByName(near(near(spans.where(_has(ends)), ids), secrets))
    return chosen.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``doc_id, text_key, base, linked`` of every row: arrays of (start, kind number, end) by start, then kind."""
    found = common.settle(parts(docs, id_col, text_col), "parts")
    more = linked(found, scope).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    joined = found.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select("doc_id", "text_key", "base", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"))


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, by start and then kind."""
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string")))
    return F.array_join(each, ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; texts without spans, and nulls, stay as they are."""
    found = scan(docs, id_col, text_col, scope).withColumn("_secret_spans", F.array_sort(F.concat("base", "linked"))).where(F.size("_secret_spans") > 0)
    found = found.select(F.col("doc_id").alias("_secret_id"), F.col("text_key").alias("_secret_key"), "_secret_spans").dropDuplicates(["_secret_id", "_secret_key"])
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_secret_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_secret_key"))
    joined = docs.join(found, same, "left")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        fresh = s.start >= state.at
        out = F.when(fresh, F.concat(state.out, text.substr(state.at + 1, s.start - state.at), F.lit(mask))).otherwise(state.out)
        return F.struct(F.greatest(state.at, s.end).alias("at"), out.alias("out"))

    rest = F.aggregate("_secret_spans", start, add, lambda s: F.concat(s.out, text.substr(s.at + 1, F.length(text))))
    return joined.withColumn(text_col, F.when(F.col("_secret_spans").isNull(), text).otherwise(rest)).select(*docs.columns)
