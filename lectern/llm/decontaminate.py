"""Benchmark decontamination by edit distance between benchmark items and windows of documents.

Texts are sequences of words (runs of letters and digits, A-Z as a-z).  A window of a document is a hit if at
most ``k`` words must be inserted, deleted or replaced to turn the item into it, with ``k`` a quarter of the
item's words.  An item is cut into equal parts of at most ``PART`` words, one of which has its share of the edits
or less, and the parts are looked up one by one, so recall doesn't fall with the item's length.
Windows of a part's size are embedded by the CGK random walk: at step j the walk writes the
word it stands on and moves on if random bit j of that word says so, which turns a small edit distance into a
small Hamming distance.  Bit sampling then compares ``SAMPLED`` places of the embeddings in each of ``TABLES``
repetitions, and where a window agrees with its part in any of them the item is verified by exact edit distance.

Only windows of places that can be hits at all are embedded, at every word: an item of m words within k edits keeps at least
m - q + 1 - q * k of its q-grams, on diagonals at most k apart.  This bound loses nothing.

``recall(distance share)`` is the chance of the sampling alone.  Items go to the tasks in groups of at most
``AT_ONCE`` items and ``AT_ONCE_BYTES``; more items take more passes over the documents.

Cases: items with fewer than ``LEAST_WORDS`` words, null or empty ones are too short to tell and never hit;
null and empty documents have no hits; repeated documents give repeated rows, repeated items (one id) rows
that differ at most in their place; of several hits of an item in a document the one with the fewest edits
counts, then the first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

SHARE = 0.25
LEAST_WORDS = 5
EMBEDDINGS = 8
TABLES = 256
SAMPLED = 2
#: Words embedded as one, at most; parts have at least half as many.
PART = 64
AT_ONCE = 20_000
AT_ONCE_BYTES = 32 << 20
HITS = "doc_id long, item_id long, distance int, item_words int, start_byte long, end_byte long"
_FILTER_BITS = 22
#: Embedded words held at once.
_HELD = 4_000_000


def recall(differing: float, tables: int = TABLES, sampled: int = SAMPLED) -> float:
    """Chance that embeddings which differ in this share of places agree in some table."""
    return 1 - (1 - (1 - differing) ** sampled) ** tables


def _gram(h: np.ndarray, q: int) -> np.ndarray:
    out = np.full(max(0, len(h) - q + 1), q, np.uint64)
    for i in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return common.mix(out)


class Items:
    """Benchmark items as word hashes, with their q-grams indexed and their embeddings made."""

    def __init__(self, ids: np.ndarray, items: list[np.ndarray], seed: int = 7):
        self.ids, self.items = ids, items
        self.length = np.array([len(x) for x in items], np.int64)
        self.edits = np.floor(self.length * SHARE).astype(np.int64)
        three = self.length - 2 - 3 * self.edits
        self.q = np.where(three >= 1, 3, 2)
        self.least = np.where(three >= 1, three, self.length - 1 - 2 * self.edits)
        self.parts = -(-self.length // PART)
        self.part = self.length // self.parts
        draw = np.random.default_rng(seed)
        longest = int(self.part.max(initial=0))
        self.bit_seed = draw.integers(0, 2**63, (3 * longest, EMBEDDINGS), np.uint64)
        self.table_embedding = draw.integers(0, EMBEDDINGS, TABLES)
        self.table_place = draw.random((TABLES, SAMPLED))
        self.index = {q: self._indexed(q) for q in (2, 3)}
        # the words after the last whole part belong to none
        self.embedded = [self.embed(x[: p * n].reshape(p, n)) for x, p, n in zip(items, self.parts, self.part, strict=True)]

    def _indexed(self, q: int) -> tuple[np.ndarray, ...] | None:
        rows = [i for i in range(len(self.items)) if self.q[i] == q]
        if not rows:
            return None
        grams = np.concatenate([_gram(self.items[i], q) for i in rows])
        item = np.concatenate([np.full(self.length[i] - q + 1, i) for i in rows])
        place = np.concatenate([np.arange(self.length[i] - q + 1) for i in rows])
        order = np.argsort(grams, kind="stable")
        keys, first = np.unique(grams[order], return_index=True)
        there = np.zeros(1 << _FILTER_BITS, bool)
        there[keys >> np.uint64(64 - _FILTER_BITS)] = True
        return there, keys, np.append(first, len(grams)), item[order], place[order]

    def embed(self, windows: np.ndarray) -> np.ndarray:
        """CGK embeddings of equally long windows: windows x embeddings x places (twice the length)."""
        n, m = windows.shape
        padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
        at = np.zeros((n, EMBEDDINGS), np.int64)
        row = np.arange(n)[:, None]
        out = np.empty((n, EMBEDDINGS, 2 * m), np.uint64)
        for j in range(2 * m):
            symbol = padded[row, at]
            out[:, :, j] = symbol
            at += (common.mix(symbol ^ self.bit_seed[j]) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, m, out=at)
        return out

    def alike(self, item: int, windows: np.ndarray) -> np.ndarray:
        """Windows whose embedding agrees with that of the item's first part in all sampled places of some table."""
        return self._agree(item, 0, self.embed(windows))

    def _agree(self, item: int, part: int, theirs: np.ndarray) -> np.ndarray:
        place = (self.table_place * (2 * self.part[item])).astype(np.int64)
        e = self.table_embedding[:, None]
        return (theirs[:, e, place] == self.embedded[item][part][e, place]).all(axis=2).any(axis=1)

    def alike_starts(self, item: int, h: np.ndarray, starts: np.ndarray, low: int, high: int) -> np.ndarray:
        """Which starts of the item, in order, have a window like one of its parts in the document ``h[low:high]``."""
        n, begin = int(self.part[item]), np.arange(self.parts[item]) * self.part[item]
        number = np.full(int(starts[-1] - starts[0]) + 1, -1)
        number[starts - starts[0]] = np.arange(len(starts))
        found = np.zeros(len(starts), bool)
        block = max(1, _HELD // (2 * n * EMBEDDINGS + len(begin)))
        end = min(high, int(starts[-1] + begin[-1]) + 1)
        for lo in range(max(low, int(starts[0])), end, block):
            at = np.arange(lo, min(lo + block, end))
            shift = at[:, None] - begin - starts[0]
            which = np.where((shift >= 0) & (shift < len(number)), number[np.clip(shift, 0, len(number) - 1)], -1)
            asked = (which >= 0) & ~found[which]
            some = asked.any(axis=1)
            which, asked, place = which[some], asked[some], at[some][:, None] + np.arange(n)
            theirs = self.embed(np.where(place < high, h[np.minimum(place, len(h) - 1)], np.uint64(0)))
            for part in range(len(begin)):
                row = np.flatnonzero(asked[:, part])
                if len(row):
                    found[which[row[self._agree(item, part, theirs[row])], part]] = True
        return found

    def best(self, item: int, region: np.ndarray) -> tuple[int, int, int]:
        """Least edits between the item and any part of the region, and that part (the first such, from its end)."""
        word = self.items[item]
        last = self._last_row(word, region, np.zeros(len(region) + 1, np.int64))
        end = int(last.argmin())
        back = self._last_row(word[::-1], region[:end][::-1], np.arange(end + 1))
        return int(last[end]), end - int(back.argmin()), end

    @staticmethod
    def _last_row(word: np.ndarray, region: np.ndarray, row: np.ndarray) -> np.ndarray:
        steps = np.arange(len(region) + 1)
        for i, symbol in enumerate(word):
            nxt = np.empty_like(row)
            nxt[0] = i + 1
            nxt[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != symbol))
            row = np.minimum.accumulate(nxt - steps) + steps
        return row

    def candidates(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, item, places in ``h`` where the item may begin, also outside the document) that keep enough q-grams."""
        doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for q, index in self.index.items():
            if index is None or len(h) < q:
                continue
            there, keys, begin, items, places = index
            grams = _gram(h, q)
            at = np.flatnonzero(there[grams >> np.uint64(64 - _FILTER_BITS)])
            at = at[doc_of[at] == doc_of[at + q - 1]]
            slot = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
            real = keys[slot] == grams[at]
            at, slot = at[real], slot[real]
            n = begin[slot + 1] - begin[slot]
            post = np.repeat(begin[slot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            item, start, doc = items[post], np.repeat(at, n) - places[post], np.repeat(doc_of[at], n)
            order = np.lexsort((start, item, doc))
            item, start, doc = item[order], start[order], doc[order]
            last = np.arange(len(item)) + self.least[item] - 1
            inside = last < len(item)
            last = np.minimum(last, max(len(item) - 1, 0))
            good = inside & (item[last] == item) & (doc[last] == doc) & (start[last] - start <= self.edits[item])
            i, j = np.flatnonzero(good), last[good]
            if not len(i):
                continue
            new = np.flatnonzero(np.concatenate([[True], (np.diff(doc[i]) > 0) | (np.diff(item[i]) > 0)]))
            for a, b in zip(new, np.append(new[1:], len(i)), strict=True):
                d, x = int(doc[i[a]]), int(item[i[a]])
                k = self.edits[x]
                low, high = start[j[a:b]] - k, start[i[a:b]] + k
                # both ascend, so ranges that meet follow each other
                apart = np.flatnonzero(low[1:] > high[:-1] + 1)
                ranges = zip(low[np.append(0, apart + 1)], high[np.append(apart, len(high) - 1)], strict=True)
                yield d, x, np.concatenate([np.arange(lo, hi + 1) for lo, hi in ranges])

    def hits(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, edits, first word, last word + 1) of the best window."""
        for d, x, starts in self.candidates(h, first):
            m, k = int(self.length[x]), int(self.edits[x])
            starts = starts[self.alike_starts(x, h, starts, int(first[d]), int(first[d + 1]))]
            best = None
            for group in np.split(starts, np.flatnonzero(np.diff(starts) > m) + 1) if len(starts) else []:
                low, high = max(int(group[0]) - k, int(first[d])), min(int(group[-1]) + m + 2 * k, int(first[d + 1]))
                edits, a, b = self.best(x, h[low:high])
                if edits <= k and (best is None or edits < best[0]):
                    best = edits, low + a, low + b
            if best is not None:
                yield d, x, *best


def _found(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch, t in common.chunks(batches):
        w = common.words(t, common.NOT_ALNUM)
        rows = list(items.hits(common.hash_words(t.data, w), w.first))
        if not rows:
            continue
        doc, item, edits, start, end = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        origin = t.offsets[doc]
        yield pa.record_batch([
            batch.column("doc_id").take(pa.array(doc)), pa.array(items.ids[item]), pa.array(edits.astype(np.int32)), pa.array(items.length[item].astype(np.int32)),
            pa.array(w.start[start] - origin), pa.array(w.end[end - 1] - origin),
        ], ["doc_id", "item_id", "distance", "item_words", "start_byte", "end_byte"])


def _load(rows: pa.Table) -> Items | None:
    table = rows.combine_chunks()
    t = common.texts(table["text"].combine_chunks())
    w = common.words(t, common.NOT_ALNUM)
    h = common.hash_words(t.data, w)
    long = [i for i in range(len(t)) if w.first[i + 1] - w.first[i] >= LEAST_WORDS]
    return Items(table["item_id"].to_numpy()[long], [h[w.first[i] : w.first[i + 1]] for i in long]) if long else None


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, distance, item_words, start_byte, end_byte``: every document with an item, and where."""
    keyed = common.keyed_texts(docs, id_col, text_col)
    found = [keyed.mapInArrow(lambda b, items=items: _found(b, items), HITS) for items in _groups(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], HITS)


def _clean(batches: Iterator[pa.RecordBatch], items: Items, text: str) -> Iterator[pa.RecordBatch]:
    for batch, t in common.chunks(batches, text):
        w = common.words(t, common.NOT_ALNUM)
        kept = np.ones(len(t), bool)
        kept[[d for d, *_ in items.hits(common.hash_words(t.data, w), w.first)]] = False
        yield batch.filter(pa.array(kept))


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark item, decided row by row, without a join."""
    for items in _groups(benchmark):
        docs = docs.mapInArrow(lambda b, items=items: _clean(b, items, text_col), docs.schema)
    return docs


def _groups(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in parts of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    count, size = items.agg(F.count("*"), F.sum(F.length("text").cast("long") * 4)).first()
    groups = max(1, -(-count // AT_ONCE), -(-(size or 0) // AT_ONCE_BYTES))
    for g in range(groups):
        loaded = _load(items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toArrow())
        if loaded is not None:
            yield loaded
