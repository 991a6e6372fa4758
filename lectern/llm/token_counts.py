"""Token counts by rank-synchronous merging of ragged symbol arrays.

The distinct words of a batch are held as one ragged array of symbol ids.  Each round looks up the rank of
every adjacent pair, applies each sequence's lowest-ranked pair everywhere in that sequence at once, and
drops the swallowed symbols; sequences without a known pair are done.  A pair made by a merge always ranks
after that merge, so a round per sequence gives what merging one pair at a time gives.  The symbols that
survive are the tokens.  Text is normalised and split into pre-tokens by the vocabulary's own rules.

Words are split at ASCII white space first, and between an ASCII letter and one of ``.,!``, which no pre-token
or special string crosses; each worker keeps the counts of the words it has seen (bounded), so a repeated
word is merged once.

Cases: null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as one token, as
the library does by default; every input row gives one row, repeated rows too; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048


class Merger:
    """Merge table of a byte-level BPE vocabulary with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, self.suffix = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or ""
        self.size = np.int64(len(vocab))
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.vocab = vocab
        special = [re.escape(x["content"]) for x in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(special) + ")") if special else None
        self.byte_chars = {c for c, _ in self.split("".join(map(chr, range(33, 127))))}

    def pre_tokens(self, word: str) -> tuple[int, list[str]]:
        """Number of special tokens in ``word``, and its pre-tokens in byte characters."""
        if word.isascii() and word.isalpha():
            return 0, [word.lower()]
        parts = self.special.split(word) if self.special and "<" in word else [word]
        out = [piece for part in parts[::2] if part for piece, _ in self.split(self.normalize(part))]
        return len(parts) // 2, out

    def symbols(self, pre_token: str) -> list[int]:
        """Start symbols; characters outside the vocabulary have none."""
        ids = [self.vocab.get(c) for c in pre_token[:-1]]
        ids.append(self.vocab.get(pre_token[-1:] + self.suffix))
        return [i for i in ids if i is not None]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merged(self, symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of symbols left in each sequence of a ragged array."""
        final = length.copy()
        alive = np.flatnonzero(length > 1)
        symbols = symbols[np.repeat(length > 1, length)]
        length = length[alive]
        none = len(self.keys)
        while len(alive):
            first = np.cumsum(length) - length
            sequence = np.repeat(np.arange(len(length)), length)
            rank = np.full(len(symbols), none)
            inner = np.flatnonzero(sequence[:-1] == sequence[1:])
            rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
            best = np.minimum.reduceat(rank, first)
            hit = np.flatnonzero((rank == best[sequence]) & (rank < none))
            if len(hit):
                # of overlapping places (a a a) the first, third, ... are merged
                new_run = np.concatenate([[True], (np.diff(hit) > 1) | (sequence[hit[1:]] != sequence[hit[:-1]])])
                run_start = hit[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
                hit = hit[(hit - run_start) % 2 == 0]
                symbols = symbols.copy()
                symbols[hit] = self.made[rank[hit]]
                keep = np.ones(len(symbols), bool)
                keep[hit + 1] = False
                length = length - np.bincount(sequence[hit], minlength=len(length))
                symbols, sequence = symbols[keep], sequence[keep]
            final[alive] = length
            going = (best < none) & (length > 1)
            symbols = symbols[going[sequence]]
            alive, length = alive[going], length[going]
        return final

    def counts(self, words: list[str]) -> np.ndarray:
        total = np.zeros(len(words), np.int64)
        flat: list[int] = []
        length: list[int] = []
        owner: list[int] = []
        for i, word in enumerate(words):
            total[i], pieces = self.pre_tokens(word)
            for piece in pieces:
                ids = self.symbols(piece)
                flat.extend(ids)
                length.append(len(ids))
                owner.append(i)
        if flat:
            left = self.merged(np.array(flat, np.int64), np.array(length, np.int64))
            total += np.bincount(np.array(owner), weights=left, minlength=len(words)).astype(np.int64)
        return total


class Counter:
    """Token counts of words, remembered by word hash while a worker lives, up to a bound."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.clear()

    def clear(self) -> None:
        self.words, self.values = common.WordCache(), np.zeros(0, np.int64)

    def look_up(self, data: np.ndarray, w: common.Words) -> np.ndarray:
        keys, place, back = np.unique(common.hash_words(data, w, fold=False), return_index=True, return_inverse=True)
        if not len(keys):
            return np.zeros(0, np.int64)
        if self.words.full():
            self.clear()
        new = np.flatnonzero(self.words.missing(keys))
        if len(new):
            at = place[new]
            strings = [data[s:e].tobytes().decode() for s, e in zip(w.start[at], w.end[at], strict=True)]
            counted = self.merger.counts(strings)
            self.words.add(keys[new])
            self.values = np.concatenate([self.values, counted])
        return self.values[self.words.row(keys)][back]


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    known = counter(path)
    for batch, t in common.chunks(batches):
        w = common.words(t, cut=(common.ASCII_LETTER, common.SENTENCE_MARK))
        tokens = known.look_up(t.data, w)
        yield pa.record_batch([batch.column("doc_id"), pa.array(t.lengths(), pa.int64()), pa.array(common.sums(tokens, w.first), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; one pass over the texts, no shuffle."""
    path = path or common.tokenizer_path(VOCABULARY)
    counted = common.keyed_texts(docs, id_col, text_col).mapInArrow(lambda b: _counted(b, path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
