"""Shared pieces: settled tables, the vocabulary files, and texts as flat byte arrays.

A text column of an Arrow batch becomes one byte array plus document offsets, so that words, shingles and
n-grams are numpy operations over whole batches instead of loops over documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import checkpoint_dir

#: White space between words: space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of longer characters.
NOT_ALNUM = np.array([not (chr(b).isalnum() if b < 128 else True) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
SENTENCE_MARK = np.array([chr(b) in ".,!" for b in range(256)])
#: Bytes of text that are turned into arrays at once; a single longer document is taken alone.
CHUNK_BYTES = 4 << 20
#: Longer words are hashed one by one, so that a huge word can't stretch the vectorised loop.
LONG_WORD = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def settle(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, whatever executor is lost."""
    path = f"{checkpoint_dir(df.sparkSession)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns ``doc_id`` and ``text``, whatever else the table has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class Texts(NamedTuple):
    """Documents as one byte array: document i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def texts(column: pa.Array) -> Texts:
    """A string column as bytes; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with at most ``size`` bytes of text each (or one document)."""
    for batch in batches:
        all_texts = texts(batch.column(text))
        start = 0
        while start < len(all_texts):
            end = int(np.searchsorted(all_texts.offsets, all_texts.offsets[start] + size, "right")) - 1
            end = min(max(end, start + 1), len(all_texts))
            lo, hi = all_texts.offsets[start], all_texts.offsets[end]
            yield batch.slice(start, end - start), Texts(all_texts.data[lo:hi], all_texts.offsets[start : end + 1] - lo)
            start = end


class Words(NamedTuple):
    """Words of documents: word j is ``data[start[j]:end[j]]``; document i has words ``first[i]`` to ``first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(t: Texts, separator: np.ndarray = SPACE, cut: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Runs of bytes that aren't separators; with ``cut``, also cut between a byte of its first and one of its second set."""
    inside = np.zeros(len(t.data) + 2, bool)
    np.logical_not(separator[t.data], out=inside[1:-1])
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = t.offsets[(t.offsets > 0) & (t.offsets < len(t.data))]
    begins[edge] = inside[1:-1][edge]
    ends[edge - 1] = inside[1:-1][edge - 1]
    if cut is not None:
        between = cut[0][t.data[:-1]] & cut[1][t.data[1:]]
        begins[1:] |= between
        ends[:-1] |= between
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, t.offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (in a new array)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hash_words(data: np.ndarray, w: Words, fold: bool = True) -> np.ndarray:
    """64-bit hash of every word; with ``fold``, A-Z count as a-z."""
    if fold:
        data = LOWER[data]
    length = w.end - w.start
    out = length.astype(np.uint64)
    active = np.flatnonzero(length <= LONG_WORD)
    at, left, value = w.start[active], length[active], out[active]
    i = 0
    while len(active):
        value = value * _BASE + data[at].astype(np.uint64) + np.uint64(1)
        i += 1
        done = left == i
        if done.any():
            out[active[done]] = value[done]
            keep = ~done
            active, at, left, value = active[keep], at[keep], left[keep], value[keep]
        at = at + 1
    for j in np.flatnonzero(length > LONG_WORD):
        out[j] = int.from_bytes(hashlib.blake2b(data[w.start[j] : w.end[j]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def hash_word(word: bytes) -> int:
    """The same hash for one (already folded) word."""
    data = np.frombuffer(word, np.uint8)
    w = Words(np.array([0]), np.array([len(data)]), np.array([0, 1]))
    return int(hash_words(data, w, fold=False)[0])


class WordCache:
    """Values of words by hash in sorted arrays; emptied when it holds ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 1_500_000):
        self.limit = limit
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.size = 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.ones(len(keys), bool) if not len(self.keys) else self.keys[at] != keys

    def add(self, keys: np.ndarray) -> None:
        """New sorted keys; their rows follow the ones there are."""
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.rows = np.insert(self.rows, at, self.size + np.arange(len(keys)))
        self.size += len(keys)

    def row(self, keys: np.ndarray) -> np.ndarray:
        return self.rows[np.searchsorted(self.keys, keys)]

    def full(self) -> bool:
        return self.size > self.limit


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per document; documents without values have 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def group_blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of whole groups from a stream sorted by ``keys`` (no nulls), and where each group begins and ends."""
    held: list[pa.RecordBatch] = []

    def whole(table: pa.Table, upto: int | None = None) -> tuple[pa.Table, np.ndarray]:
        change = np.zeros(max(len(table) - 1, 0), bool)
        for k in keys:
            values = table[k].to_numpy()
            change |= values[1:] != values[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1, [len(table)]])
        return (table, edges) if upto is None else (table.slice(0, edges[-2]), edges[:-1])

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        # a group that goes on past this batch is left for later; batches of one group only are just held
        first, last = held[0], batch
        if all(first[k][0].as_py() == last[k][len(last) - 1].as_py() for k in keys):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        done, edges = whole(table, 0)
        if len(done):
            yield done, edges
        held = table.slice(len(done)).to_batches()
    if held:
        yield whole(pa.Table.from_batches(held).combine_chunks())


def reached(near, n: int) -> np.ndarray:
    """Component of each of ``n`` things (the first thing of it); ``near(i, rest)`` says which of ``rest`` are linked to ``i``.

    Each thing is compared with those that nothing has reached yet, so a group that all links to its first
    thing takes one comparison.
    """
    root = np.full(n, -1)
    rest = np.arange(n)
    while len(rest):
        start, rest = rest[0], rest[1:]
        root[start] = start
        queue = [start]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            if hit.any():
                found = rest[hit]
                root[found] = start
                queue.extend(found.tolist())
                rest = rest[~hit]
    return root
