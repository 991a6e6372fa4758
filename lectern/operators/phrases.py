"""Inverted index of the pieces of texts, and phrases found through it.

A text is cut into pieces: runs of letters and digits, and runs of other visible characters.  Where a phrase
occurs inside a text, its inner pieces are whole pieces of the text, its first one ends a piece and its last one
begins a piece; a phrase of one piece lies inside a piece.  So a phrase meets the vocabulary through its rarest
character gram, the vocabulary meets the texts by equality, and only phrases of several pieces are verified in the
text itself.  Nothing is joined on less than a gram or a word.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import skew
from lectern.session import settled

PIECE = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]+"
GRAM = 3


def pieces(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def counted(values: Column) -> Column:
    """``array<struct<value, n>>``: each distinct value with its number, from one sort inside the row."""

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

        def numbered(at: Column) -> Column:
            ends = F.concat(F.slice(at, 2, F.size(at)), F.array(size))
            return F.zip_with(at, ends, lambda a, b: F.struct(F.get(ordered, a).alias("value"), (b - a).alias("n")))

        return F.when(size > 0, T.let(starts, numbered)).otherwise(F.array().cast("array<struct<value: string, n: int>>"))

    return T.let(F.sort_array(values), runs)


def grams(rows: DataFrame, piece: str, sizes: Iterable[int] = range(1, GRAM + 1)) -> DataFrame:
    """``rows`` once per place and size of a character gram of ``piece``, with the ``gram``."""
    out = None
    for n in sizes:
        at = F.explode(F.sequence(F.lit(1), F.length(piece) - (n - 1)))
        one = rows.filter(F.length(piece) >= n).withColumn("_i", at).withColumn("gram", F.expr(f"substring({piece}, _i, {n})")).drop("_i")
        out = one if out is None else out.unionByName(one)
    return out


def postings(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """``(keep…, word, n)``: the pieces of each row's text, counted inside the row."""
    return rows.select(*keep, F.explode_outer(counted(pieces(text))).alias("_p")).filter(F.col("_p").isNotNull()).select(
        *keep, F.col("_p.value").alias("word"), F.col("_p.n").alias("n")
    )


def words_of(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(phrase, word, whole, times)`` for phrases met by a word through their rarest gram.

    ``whole`` phrases have one piece and occur ``times`` times in the word; for the others the word is where one
    of the pieces may stand.  Phrases without a visible character are met by nothing.
    """
    asked = phrases.select("phrase").distinct().select("phrase", pieces("phrase").alias("_all")).select(
        "phrase", F.size("_all").alias("_size"), F.posexplode("_all").alias("_at", "piece")
    )
    wanted = grams(asked, "piece").filter(F.length("gram") == F.least(F.length("piece"), F.lit(GRAM))).distinct()
    wanted = settled(wanted, "wanted_grams")
    sizes = [r[0] for r in wanted.select(F.length("gram")).distinct().collect()]  # up to GRAM numbers
    by_gram = grams(skew.spread(vocabulary, "word"), "word", sizes or [GRAM])
    frequency = by_gram.join(skew.maybe_broadcast(wanted.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("_n"))
    rarest = wanted.join(frequency, "gram", "left").groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_at", "piece", "gram", "_size")).alias("_r")
    ).select("phrase", "_r.gram", "_r.piece", "_r._at", "_r._size")
    rarest = settled(rarest, "rarest_grams")
    whole = F.col("_size") == 1
    first, last = F.col("_at") == 0, F.col("_at") == F.col("_size") - 1
    stands = (
        F.when(whole, F.contains("word", "piece")).when(first, F.endswith("word", "piece"))
        .when(last, F.startswith("word", "piece")).otherwise(F.col("word") == F.col("piece"))
    )
    return by_gram.join(skew.maybe_broadcast(rarest), "gram").filter(stands).select(
        "phrase", "word", whole.alias("whole"), F.when(whole, T.count_occurrences(F.col("word"), F.col("piece"))).otherwise(1).alias("times")
    ).distinct()


def occurrences(
    asked: DataFrame, words: DataFrame, texts: DataFrame, on: list[str], key: str, text: str,
    where: Column | None = None, vocabulary: DataFrame | None = None,
) -> DataFrame:
    """``asked`` rows met by a text, with ``key`` and ``n``, how often the phrase occurs in it.

    ``asked`` has a ``phrase`` and the columns ``on``; ``words`` has ``on``, ``key``, ``word`` and ``n``; ``texts`` has
    ``key`` and ``text``.  ``where`` may compare columns of ``asked`` and ``words``; ``vocabulary`` are the distinct words.
    """
    met = words_of(asked, words.select("word").distinct() if vocabulary is None else vocabulary)
    names = [c for c in asked.columns if c not in on]
    found = words.join(asked.join(met, "phrase"), [*on, "word"])
    if where is not None:
        found = found.filter(where)
    kept = [*on, *names, key]
    of_words = found.filter("whole").groupBy(*kept).agg(F.sum(F.col("n") * F.col("times")).cast("int").alias("n"))
    maybe = found.filter("NOT whole").select(*kept).distinct()
    verified = maybe.join(texts.select(key, F.col(text).alias("_text")), key).select(
        *kept, T.count_occurrences(F.col("_text"), F.col("phrase")).alias("n")
    )
    return of_words.unionByName(verified.filter("n > 0"))
