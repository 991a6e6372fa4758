"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; each bit splits the languages in two, and a linear classifier over hashed
byte n-grams predicts it.  The classifiers are multinomial: a bit's weight of an n-gram is the log ratio of
its smoothed shares on the two sides, so training is one pass of n-gram counts by language over all training
texts, added up in tables whose size depends on the number of languages alone.  Decoding takes, for every
language, the logistic losses of the bits' margins against its codeword, weighted by how well each bit
separates, and picks the least; a small lead over the next language is flagged as ambiguous.

Cases: texts without a letter, and null ones, are ``und`` with score 0; training rows with null text or lang
don't train; with one language everything with letters gets it; without any, everything is ``und``; equal
losses go to the language first by name; every input row gives one row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

#: Hashed n-grams per length.
WIDTH = 1 << 14
LENGTHS = (1, 2, 3, 4)
#: Bits of a codeword where there are too many languages for all splits.
MOST_BITS = 31
#: Margins are limited to this, so that one odd text can't outweigh the other bits.
MARGIN = 30.0
AMBIGUOUS = 0.6


def codewords(languages: int, seed: int = 20) -> np.ndarray:
    """One row of -1/+1 per language: all different splits for few languages, else random distinct ones."""
    if languages < 2:
        return np.ones((languages, 1))
    if 2 ** (languages - 1) - 1 <= MOST_BITS:
        splits = np.arange(1, 2 ** (languages - 1))
        return np.array([np.where((splits >> i) & 1, 1.0, -1.0) for i in range(languages)])
    bits = max(MOST_BITS, int(10 * np.ceil(np.log2(languages))))
    draw = np.random.default_rng(seed)
    while True:
        code = draw.permuted(np.where(np.arange(languages)[:, None] % 2 == np.zeros(bits), 1.0, -1.0), axis=0)
        if len(np.unique(code, axis=0)) == languages:
            return code


def grams(t: common.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: hashed n-gram per place (with its length's offset), and the place of its first byte.

    N-grams don't cross documents.
    """
    data = common.LOWER[t.data].astype(np.uint32)
    n = len(data)
    owner_end = np.repeat(t.offsets[1:], t.lengths())
    value = np.zeros(n, np.uint32)
    for i, length in enumerate(range(1, max(LENGTHS) + 1)):
        at = np.arange(max(0, n - length + 1))
        value = value[: len(at)] * np.uint32(257) + data[length - 1 :] + np.uint32(1)
        if length in LENGTHS:
            at = at[at + length <= owner_end[: len(at)]]
            hashed = (value[at] * np.uint32(2654435761)) >> np.uint32(18)
            yield hashed.astype(np.int64) + i * WIDTH, at


def _counted(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(names), len(LENGTHS) * WIDTH), np.int64)
    index = {x: i for i, x in enumerate(names)}
    for batch, t in common.chunks(batches, size=1 << 20):
        owner = np.repeat([index[x] for x in batch.column("lang").to_pylist()], t.lengths())
        for gram, at in grams(t):
            code, n = np.unique(owner[at] * total.shape[1] + gram, return_counts=True)
            total.reshape(-1)[code] += n
    for i in range(len(names)):
        if total[i].any():
            used = np.flatnonzero(total[i])
            yield pa.record_batch([pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array(total[i][used])], ["lang_no", "gram", "n"])


class Decoder:
    """Languages, their codewords, n-gram weights by bit, and the weight of each bit."""

    def __init__(self, names: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.names, self.code = names, codewords(len(names))
        share = np.zeros((counts.shape[1], self.code.shape[1]))
        apart = []
        for b, side in enumerate(self.code.T):
            plus, minus = (self._shares(counts[side == s], smoothing) for s in (1, -1))
            share[:, b] = np.log(plus) - np.log(minus)
            # how far apart the two sides are (symmetric divergence), as the bit's weight
            apart.append(float(((plus - minus) * share[:, b]).sum()))
        self.weights = share.astype(np.float32)
        self.bit_weight = np.array(apart) / max(sum(apart), 1e-12) if sum(apart) > 0 else np.full(len(apart), 1 / len(apart))

    @staticmethod
    def _shares(counts: np.ndarray, smoothing: float) -> np.ndarray:
        """Mean over a side's languages of their n-gram shares per length, so that a large language doesn't drown others."""
        if not len(counts):
            return np.full(counts.shape[1], 1 / WIDTH)
        by_length = counts.reshape(len(counts), len(LENGTHS), WIDTH) + smoothing
        return (by_length / by_length.sum(axis=2, keepdims=True)).mean(axis=0).reshape(-1)

    def margins(self, t: common.Texts) -> np.ndarray:
        out = np.zeros((len(t), self.weights.shape[1]))
        for gram, at in grams(t):
            first = np.searchsorted(at, t.offsets)
            for b in range(out.shape[1]):
                out[:, b] += common.sums(self.weights[:, b][gram].astype(np.float64), first)
        return np.clip(out / len(LENGTHS), -MARGIN, MARGIN)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its share of exp(-loss)."""
        loss = np.stack([(np.logaddexp(0, -margins * word) * self.bit_weight).sum(axis=1) for word in self.code], axis=1)
        best = loss.argmin(axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return best, 1 / share.sum(axis=1)


def train(texts: DataFrame) -> Decoder | None:
    """From columns ``text`` and ``lang``; None without training rows."""
    texts = texts.where("text is not null and lang is not null").select("text", "lang")
    names = sorted(r[0] for r in texts.select("lang").distinct().collect())  # label values, not rows
    if not names:
        return None
    counted = texts.mapInArrow(lambda b: _counted(b, names), "lang_no int, gram int, n long").groupBy("lang_no", "gram").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # at most languages x lengths x WIDTH rows
    counts = np.zeros((len(names), len(LENGTHS) * WIDTH))
    counts[rows["lang_no"].to_numpy(), rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return Decoder(names, counts)


def _predicted(batches: Iterator[pa.RecordBatch], decoder: Decoder) -> Iterator[pa.RecordBatch]:
    names = np.array(decoder.names, object)
    for batch, t in common.chunks(batches, size=1 << 20):
        best, share = decoder.decode(decoder.margins(t))
        yield pa.record_batch([batch.column("doc_id"), batch.column("letters"), pa.array(names[best], pa.string()), pa.array(share)], ["doc_id", "letters", "lang_pred", "score"])


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` of every row of ``docs``; ``training`` has ``text`` and ``lang``."""
    decoder = train(training)
    keyed = common.keyed_texts(docs, id_col, text_col).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if decoder is None:
        return keyed.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    out = keyed.mapInArrow(lambda b: _predicted(b, decoder), "doc_id long, letters boolean, lang_pred string, score double")
    return out.select(
        "doc_id",
        F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
        (~F.col("letters") | (F.col("score") < ambiguous)).alias("ambiguous"),
    )


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``documents`` that may train: ``crc32(doc_id as text) mod 4`` is not 2."""
    return docs.where(~held_out()).select("text", "lang")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
