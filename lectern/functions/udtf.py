"""SQL table functions over the splitters.

    SELECT * FROM documents, LATERAL word_windows(text, 360, 55)
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

LABEL = re.compile(r"(?:^|\n)\s*(?:q(?:uestion)?|answer)\s*(\d+)\s*[:.)-]?", re.IGNORECASE)


@udtf(returnType="position int, window string")
class WordWindows:
    """Sliding word windows of a text."""

    def eval(self, text: str, size: int, overlap: int):  # noqa: A003
        words = (text or "").split()
        step = max(1, size - overlap)
        count = 0 if not words else -(-max(0, len(words) - size) // step) + 1
        for i in range(count):
            yield i + 1, " ".join(words[i * step:i * step + size])


@udtf(returnType="number int, answer string")
class ExtractAnswers:
    """Labelled answers of a submission; the last label of a number wins."""

    def eval(self, text: str, numbers: list):  # noqa: A003
        pieces = LABEL.split(text or "")
        if len(pieces) == 1:
            if numbers:
                yield int(numbers[0]), pieces[0].strip()
            return
        found = {int(n): answer.strip() for n, answer in zip(pieces[1::2], pieces[2::2], strict=True)}
        for number in numbers:
            if number in found:
                yield int(number), found[number]


def register(spark: SparkSession) -> None:
    spark.udtf.register("word_windows", WordWindows)
    spark.udtf.register("extract_answers", ExtractAnswers)
