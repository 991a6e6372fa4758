"""Hashed word and prefix features and a small logistic regression over them."""

from __future__ import annotations

import numpy as np

from lectern.llm import common

#: Number of hashed features.
BITS = 20
WIDTH = 1 << BITS
#: Lengths in bytes of word beginnings that are features too.
PREFIXES = (4, 5)


def features(t: common.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and word beginnings of each document, and where each document's begin.

    Words are runs of letters and digits, A-Z as a-z; the beginnings make inflected forms of a word alike.
    """
    w = common.words(t, common.NOT_ALNUM)
    doc = w.doc().astype(np.uint64) << np.uint64(BITS)
    found = [doc | (common.hash_words(t.data, w) >> np.uint64(64 - BITS))]
    for size in PREFIXES:
        long = w.end - w.start > size
        cut = common.Words(w.start[long], w.start[long] + size, w.first)
        found.append(doc[long] | (common.mix(common.hash_words(t.data, cut) + np.uint64(size)) >> np.uint64(64 - BITS)))
    pairs = np.unique(np.concatenate(found))
    return (pairs & np.uint64(WIDTH - 1)).astype(np.int32), np.searchsorted(pairs >> np.uint64(BITS), np.arange(len(t) + 1, dtype=np.uint64))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Logistic regression: weights of hashed words that enough documents have, of extra columns, and a bias."""

    def __init__(self, weights: np.ndarray, extra: np.ndarray, bias: float):
        self.weights, self.extra, self.bias = weights, extra, bias

    def __call__(self, index: np.ndarray, first: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return sigmoid(common.sums(self.weights[index], first) + extra @ self.extra + self.bias)


def _document_counts(index: np.ndarray, first: np.ndarray, rows: np.ndarray, block: int = 512) -> np.ndarray:
    """Number of the chosen documents that have each feature; a few documents at a time, to hold little."""
    total = np.zeros(WIDTH, np.int64)
    for lo in range(0, len(rows), block):
        hi = min(lo + block, len(rows))
        part = index[first[lo] : first[hi]]
        total += np.bincount(part[np.repeat(rows[lo:hi], np.diff(first[lo : hi + 1]))], minlength=WIDTH)
    return total


def fit(index: np.ndarray, first: np.ndarray, extra: np.ndarray, y: np.ndarray, apart: float = 4.5, steps: int = 150, rate: float = 0.1, ridge: float = 1e-5) -> Model:
    """Adam on the class-balanced log loss with a ridge penalty, over the features that tell the classes apart.

    A feature is used if its shares of positive and negative documents differ by ``apart`` standard errors.
    """
    positive = int(y.sum())
    negative = len(y) - positive
    inside, outside = _document_counts(index, first, y == 1), _document_counts(index, first, y != 1)
    share = (inside + outside) / len(y)
    error = np.sqrt(np.maximum(share * (1 - share) * (1 / positive + 1 / negative), 1e-12))
    known = np.flatnonzero(np.abs(inside / positive - outside / negative) >= apart * error)
    known = known[(inside + outside)[known] >= 3]
    column = np.full(WIDTH, -1, np.int32)
    column[known] = np.arange(len(known))
    col = column[index]
    used = col >= 0
    doc, col = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(first))[used], col[used]
    begin = np.searchsorted(doc, np.arange(len(y) + 1))
    n, size = len(known), len(known) + extra.shape[1] + 1
    theta, mean, square = np.zeros(size), np.zeros(size), np.zeros(size)
    weight = np.where(y == 1, 0.5 / positive, 0.5 / negative)
    for step in range(1, steps + 1):
        p = sigmoid(common.sums(theta[:n][col], begin) + extra @ theta[n:-1] + theta[-1])
        miss = weight * (p - y)
        gradient = np.concatenate([np.bincount(col, weights=miss[doc], minlength=n), miss @ extra, [miss.sum()]]) + ridge * np.append(theta[:-1], 0)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(WIDTH, np.float32)
    weights[known] = theta[:n]
    return Model(weights, theta[n:-1], float(theta[-1]))
