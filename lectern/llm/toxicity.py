"""Toxicity by a classifier chain.

Categories are predicted one after the other: the linear model of a category sees the hashed words of the
text and the probabilities of all earlier categories.  For training, those probabilities are out-of-fold
predictions, so that a later model learns from the same kind of guess as it gets afterwards.

The models are fitted on at most ``SAMPLE`` labelled documents, the first by a hash of their id; every whole
text is then scored in one pass without a shuffle.  A document is ``toxic`` if any of the categories in
``toxic_if`` reaches the threshold.

Cases: labels without a document, documents without labels and null labels don't train; a category whose
training labels are all equal (also if only so without one fold), or absent, always gets their mean (0 without
labels); null and empty texts have
no words, so they get the bias and are never called toxic; repeated rows give repeated rows; other columns,
also with the names of the result's, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import common, linear

#: Most labelled documents that models are fitted on.
SAMPLE = 16_000
FOLDS = 3
THRESHOLD = 0.5


def _sampled_features(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch, t in common.chunks(batches):
        index, first = linear.features(t)
        rows = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(index))
        yield pa.record_batch([batch.column("doc_id"), *(batch.column(n) for n in names), rows], ["doc_id", *names, "words"])


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], sample: int = SAMPLE, folds: int = FOLDS) -> list[linear.Model | float]:
    """One model a category (or a constant), in chain order.

    ``categories``: name and a 0/1 column over ``labels``; ``labels`` has ``doc_id``.
    """
    names = [name for name, _ in categories]
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.cast("int").alias(n) for n, c in categories))
    picked = picked.dropna().groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows are broadcast
    texts = docs.join(F.broadcast(picked), "doc_id").select("doc_id", *names, "text")
    schema = "doc_id long, " + ", ".join(f"{n} int" for n in names) + ", words array<int>"
    rows = texts.mapInArrow(lambda b: _sampled_features(b, names), schema).toArrow().sort_by("doc_id")
    if not len(rows):
        return [0.0] * len(names)
    labelled = {n: rows[n].to_numpy() for n in names}
    words = rows["words"].combine_chunks()
    first = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    index = words.flatten().to_numpy()
    del rows, words
    fold = np.arange(len(first) - 1) % folds
    earlier = np.zeros((len(fold), 0))
    models: list[linear.Model | float] = []
    for name in names:
        y = labelled[name]
        if min(np.bincount(y[fold != k], minlength=2).min() for k in range(folds)) == 0:
            models.append(float(y.mean()))
            earlier = np.column_stack([earlier, np.full(len(y), y.mean())])
            continue
        models.append(linear.fit(index, first, earlier, y))
        if name != names[-1]:
            guess = np.zeros(len(y))
            for k in range(folds):
                part, rest = _subset(index, first, fold == k), _subset(index, first, fold != k)
                guess[fold == k] = linear.fit(*rest, earlier[fold != k], y[fold != k])(*part, earlier[fold == k])
            earlier = np.column_stack([earlier, guess])
    return models


def _subset(index: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.diff(first)
    return index[np.repeat(rows, length)], np.concatenate([[0], np.cumsum(length[rows])])


def _chain(t: common.Texts, models: list[linear.Model | float]) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities in chain order, and whether the text has words."""
    index, first = linear.features(t)
    chain = np.zeros((len(t), 0))
    for model in models:
        p = np.full(len(t), model) if isinstance(model, float) else model(index, first, chain)
        chain = np.column_stack([chain, p])
    return chain, np.diff(first) > 0


def _scored(batches: Iterator[pa.RecordBatch], models: list[linear.Model | float]) -> Iterator[pa.RecordBatch]:
    for batch, t in common.chunks(batches):
        chain, has_words = _chain(t, models)
        yield pa.record_batch([batch.column("doc_id"), pa.array(has_words), *(pa.array(chain[:, i]) for i in range(chain.shape[1]))], ["doc_id", "has_words", *(f"p{i}" for i in range(chain.shape[1]))])


def classify(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], toxic_if: Sequence[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``p_<category>`` in chain order, and ``toxic``, for every row."""
    keyed = common.keyed_texts(docs, id_col, text_col)
    models = train(keyed, labels, categories, sample)
    schema = "doc_id long, has_words boolean, " + ", ".join(f"p{i} double" for i in range(len(models)))
    scored = keyed.mapInArrow(lambda b: _scored(b, models), schema)
    names = [n for n, _ in categories]
    hit = F.lit(False)
    for i, n in enumerate(names):
        hit = hit | (F.col(f"p{i}") >= threshold) if n in toxic_if else hit
    return scored.select("doc_id", *(F.col(f"p{i}").alias(f"p_{n}") for i, n in enumerate(names)), (hit & F.col("has_words")).alias("toxic"))


def _clean(batches: Iterator[pa.RecordBatch], models: list[linear.Model | float], decisive: list[int], text: str, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch, t in common.chunks(batches, text):
        chain, has_words = _chain(t, models)
        toxic = has_words & (chain[:, decisive] >= threshold).any(axis=1)
        yield batch.filter(pa.array(~toxic))


def remove(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], toxic_if: Sequence[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, decided row by row, without a join."""
    models = train(common.keyed_texts(docs, id_col, text_col), labels, categories, sample)
    decisive = [i for i, (n, _) in enumerate(categories) if n in toxic_if]
    return docs.mapInArrow(lambda b: _clean(b, models, decisive, text_col, threshold), docs.schema)


def label_categories() -> list[tuple[str, Column]]:
    """The chain over the ``labels`` table: low quality first, then toxic."""
    return [("low_quality", 1 - F.col("quality")), ("toxic", F.col("toxic"))]
