"""Subword lattice likelihood: a text's probability summed over all of its segmentations.

The vocabulary and its first weights are those of an existing subword model: a piece's score is its negative
rank, so weights start in proportion to 1 / (rank + ``RANK_SHIFT``).  The weights are then fitted to the
training texts by expectation-maximisation over the distinct words and their counts, with the first weights
as a prior.  A word is a lattice: an edge for every piece of the vocabulary that matches there, and byte
pieces for a character without a piece.  The forward recursion in log space adds up all paths; a text's score
is the sum over its words, plus the end symbol's.  Words are independent, so a word is scored once for all
its repetitions in a batch.

The base score is a smoothed word unigram.  Counts of the most frequent words (``HEAD`` at most, a fixed bound) go
to every task; rarer words of a document are joined with their counts by hash, and no rare word is hot.

Cases: a null or empty text is the end symbol alone; without training texts the weights stay the first ones
and every count is 0; words of any length are scored whole; rows without an id are left out; rows that
repeat an id and text count once in the result but as often as they occur in training; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

MODEL = "piece_bpe_32k.model"
#: Words whose counts every task gets; 16 bytes each.
HEAD = 300_000
ITERATIONS = 2
RANK_SHIFT = 100.0
#: Weight of the first weights as a prior, in pieces.
PRIOR = 50_000.0
#: Distinct words held by a task before their counts are handed on.
COMBINED = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARK = "▁"
_FILTER_BITS = 20


class Pieces:
    """Vocabulary of a subword model: pieces by hash of their characters, byte pieces, first log weights."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        kept = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i))]
        self.byte_id = np.zeros(256, np.int64)
        strings, ids, scores = [], [], np.zeros(len(kept))
        for row, i in enumerate(kept):
            piece, scores[row] = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = row
            else:
                strings.append(piece)
                ids.append(row)
        self.size = len(kept)
        weight = 1 / (scores.max() - scores + RANK_SHIFT)
        self.first = np.log(weight / weight.sum())
        self.longest = max(map(len, strings))
        keys = np.array([piece_hash(p) for p in strings], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, np.int64)[order]
        self.there = np.zeros(1 << _FILTER_BITS, bool)
        self.there[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1; a table of leading bits rules most hashes out."""
        out = np.full(len(keys), -1, np.int64)
        some = np.flatnonzero(self.there[keys >> np.uint64(64 - _FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == keys[some], self.ids[at], -1)
        return out


def piece_hash(piece: str) -> int:
    h = len(piece)
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
    return int(common.mix(np.array([h], np.uint64))[0])


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Edges of the words' lattices: ``edge[l][i]`` is the piece of l + 1 characters that begins at place i, or -1.

    Words lie one after the other, each with the mark of a word's begin in front.
    """

    def __init__(self, vocabulary: Pieces, words: list[str]):
        self.vocabulary = vocabulary
        marked = [_MARK + w for w in words]
        flat = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.length = np.fromiter(map(len, marked), np.int64, len(marked))
        self.begin = np.cumsum(self.length) - self.length
        n = len(flat)
        left = np.repeat(self.begin + self.length, self.length) - np.arange(n)
        self.edge = []
        h = np.zeros(n, np.uint64)
        for size in range(1, min(vocabulary.longest, int(self.length.max(initial=0))) + 1):
            h = h[: n - size + 1] * _BASE + flat[size - 1 :] + np.uint64(1)
            row = np.full(n, -1, np.int64)
            fits = np.flatnonzero(left[: len(h)] >= size)
            # the length is part of the hash: added at the end with its power of the base
            start = np.uint64(size * pow(int(_BASE), size, 2**64) & (2**64 - 1))
            row[fits] = vocabulary.find(common.mix(h[fits] + start))
            self.edge.append(row)
        alone = np.flatnonzero(self.edge[0] < 0) if self.edge else np.zeros(0, np.int64)
        self.byte_at, self.byte_piece = [], []
        for i in alone:
            for b in chr(int(flat[i])).encode():
                self.byte_at.append(i)
                self.byte_piece.append(vocabulary.byte_id[b])

    def weights(self, log_p: np.ndarray) -> list[np.ndarray]:
        out = [np.where(row >= 0, log_p[row], -np.inf) for row in self.edge]
        if self.byte_at:
            at = np.array(self.byte_at)
            out[0][np.unique(at)] = 0.0
            np.add.at(out[0], at, log_p[np.array(self.byte_piece)])
        return out

    def forward(self, weight: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Alpha by place (list index) over words sorted from the longest, that order, and log P of every word."""
        order = np.argsort(-self.length, kind="stable")
        begin, length = self.begin[order], self.length[order]
        alpha = [np.zeros(len(order))]
        total = np.zeros(len(order))
        for place in range(1, int(length.max(initial=0)) + 1):
            n = int(np.searchsorted(-length, -place, "right"))
            terms = [alpha[place - s][:n] + weight[s - 1][begin[:n] + place - s] for s in range(1, min(place, len(weight)) + 1)]
            alpha.append(_log_sum(terms))
            done = int(np.searchsorted(-length, -place, "left"))
            total[done:n] = alpha[place][done:n]
        back = np.empty(len(order))
        back[order] = total
        return alpha, order, back

    def expected(self, log_p: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in all words, each word ``count`` times."""
        weight = self.weights(log_p)
        alpha, order, total = self.forward(weight)
        begin, length, total, count = self.begin[order], self.length[order], total[order], count[order]
        uses = np.zeros(self.vocabulary.size)
        longest = int(length.max(initial=0))
        beta: list[np.ndarray] = [np.zeros(0)] * (longest + 1)
        per_place = np.zeros(len(self.edge[0])) if self.edge else np.zeros(0)
        for place in range(longest, -1, -1):
            n = int(np.searchsorted(-length, -place, "right"))
            done = int(np.searchsorted(-length, -place, "left"))
            b = np.full(n, -np.inf)
            b[done:n] = 0.0
            for s in range(1, min(len(weight), longest - place) + 1):
                m = int(np.searchsorted(-length, -(place + s), "right"))
                if not m:
                    break
                at = begin[:m] + place
                through = weight[s - 1][at] + beta[place + s][:m]
                b[:m] = np.logaddexp(b[:m], through)
                share = np.exp(alpha[place][:m] + through - total[:m]) * count[:m]
                row = self.edge[s - 1][at]
                known = row >= 0
                uses += np.bincount(row[known], weights=share[known], minlength=len(uses))
                if s == 1:
                    per_place[at] = share
            beta[place] = b
        if self.byte_at:
            np.add.at(uses, np.array(self.byte_piece), per_place[np.array(self.byte_at)])
        return uses


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    top = np.max(terms, axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    total = np.zeros_like(safe)
    for t in terms:
        total += np.exp(t - safe)
    with np.errstate(divide="ignore"):
        return np.log(total) + safe


def _folded(data: np.ndarray) -> np.ndarray:
    return common.LOWER[data]


def _strings(data: np.ndarray, w: common.Words, at: np.ndarray) -> list[str]:
    return [data[s:e].tobytes().decode() for s, e in zip(w.start[at], w.end[at], strict=True)]


def _slices(words: list[str], characters: int = 400_000) -> Iterator[slice]:
    start = total = 0
    for i, w in enumerate(words):
        total += len(w) + 1
        if total > characters:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(words):
        yield slice(start, len(words))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of distinct words, combined over what a task reads; one row with a null word per batch for its texts."""
    held: dict[int, int] = {}
    names: dict[int, bytes] = {}

    def out():
        rows = pa.record_batch([pa.array(list(names.values()), pa.binary()), pa.array(list(held.keys()), pa.uint64()).view(pa.int64()), pa.array(list(held.values()), pa.int64())], ["word", "hash", "n"])
        held.clear()
        names.clear()
        return rows

    for _, t in common.chunks(batches):
        data = _folded(t.data)
        w = common.words(t)
        keys, place, n = np.unique(common.hash_words(data, w, fold=False), return_index=True, return_counts=True)
        for key, at, more in zip(keys.tolist(), place.tolist(), n.tolist(), strict=True):
            if key in held:
                held[key] += more
            else:
                held[key] = more
                names[key] = data[w.start[at] : w.end[at]].tobytes()
        yield pa.record_batch([pa.array([None], pa.binary()), pa.array([0], pa.int64()), pa.array([len(t)], pa.int64())], ["word", "hash", "n"])
        if len(held) > COMBINED:
            yield out()
    if held:
        yield out()


def word_counts(training: DataFrame) -> DataFrame:
    """``word, hash, n`` over column ``text``; the null word stands for the ends of texts."""
    counted = training.select("text").mapInArrow(_word_counts, "word binary, hash long, n long")
    return counted.groupBy("word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"))


def _expected(batches: Iterator[pa.RecordBatch], path: str, log_p: np.ndarray) -> Iterator[pa.RecordBatch]:
    vocabulary = pieces(path)
    uses = np.zeros(vocabulary.size)
    for batch in batches:
        words = [w.decode() for w in batch.column("word").to_pylist()]
        n = batch.column("n").to_numpy()
        for part in _slices(words):
            uses += Lattice(vocabulary, words[part]).expected(log_p, n[part])
    used = np.flatnonzero(uses)
    yield pa.record_batch([pa.array(used), pa.array(uses[used])], ["piece", "uses"])


def fit(counts: DataFrame, path: str, ends: int, iterations: int = ITERATIONS) -> tuple[np.ndarray, float]:
    """Log weights of the pieces and of the end symbol."""
    first = pieces(path).first
    log_p, end = first, np.log(0.05)
    log_p = first + np.log1p(-np.exp(end))
    for _ in range(iterations):
        current = log_p
        rows = counts.where("word is not null").mapInArrow(lambda b: _expected(b, path, current), "piece long, uses double")
        rows = rows.groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()  # at most a row per piece
        uses = np.zeros(len(first))
        uses[rows["piece"].to_numpy()] = rows["uses"].to_numpy()
        uses = uses + PRIOR * np.exp(first)
        total = uses.sum() + ends + 1
        log_p, end = np.log(uses / total), np.log((ends + 1) / total)
    return log_p, float(end)


class Scorer:
    """Log probabilities of words under one model, remembered by word hash up to a bound."""

    def __init__(self, path: str, log_p: np.ndarray):
        self.vocabulary, self.log_p = pieces(path), log_p
        self.clear()

    def clear(self) -> None:
        self.words, self.values = common.WordCache(), np.zeros(0)

    def __call__(self, keys: np.ndarray, place: np.ndarray, data: np.ndarray, w: common.Words) -> np.ndarray:
        """For distinct word hashes and the number of a word that has each."""
        if self.words.full():
            self.clear()
        new = np.flatnonzero(self.words.missing(keys))
        if len(new):
            strings = _strings(data, w, place[new])
            fresh = []
            for part in _slices(strings):
                lattice = Lattice(self.vocabulary, strings[part])
                fresh.append(lattice.forward(lattice.weights(self.log_p))[2])
            self.words.add(keys[new])
            self.values = np.concatenate([self.values, *fresh])
        return self.values[self.words.row(keys)]


#: The scorer of the model that this worker used last, so that its words serve the next task too.
_last: dict[str, Scorer] = {}


def scorer(path: str, log_p: np.ndarray, name: str) -> Scorer:
    if name not in _last:
        _last.clear()
        _last[name] = Scorer(path, log_p)
    return _last[name]


def _scored(batches: Iterator[pa.RecordBatch], path: str, model: tuple[np.ndarray, float], name: str, head: tuple[np.ndarray, np.ndarray], norm: float) -> Iterator[pa.RecordBatch]:
    log_p, end = model
    score_words = scorer(path, log_p, name)
    head_keys, head_counts = head
    for batch, t in common.chunks(batches):
        data = _folded(t.data)
        w = common.words(t)
        keys, place, back = np.unique(common.hash_words(data, w, fold=False), return_index=True, return_inverse=True)
        if len(keys):
            word_score = score_words(keys, place, data, w)[back]
            at = np.minimum(np.searchsorted(head_keys, keys), max(len(head_keys) - 1, 0))
            in_head = head_keys[at] == keys if len(head_keys) else np.zeros(len(keys), bool)
            base = np.where(in_head, np.log10((head_counts[at] if len(head_keys) else 0) + 0.5) - norm, 0.0)[back]
            known = in_head[back]
        else:
            word_score = base = np.zeros(0)
            known = np.zeros(0, bool)
        doc = w.doc()
        rare = np.flatnonzero(~known)
        pair, n = np.unique(np.stack([doc[rare].astype(np.uint64), keys[back[rare]] if len(keys) else np.zeros(0, np.uint64)]), axis=1, return_counts=True) if len(rare) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
        first = np.searchsorted(pair[0], np.arange(len(t) + 1, dtype=np.uint64))
        rows = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(pair[1].view(np.int64)), pa.array(n, pa.int64())], ["hash", "n"]))
        yield pa.record_batch([
            batch.column("doc_id"),
            pa.array(np.diff(w.first) + 1, pa.int64()),
            pa.array(common.sums(known.astype(np.int64), w.first), pa.int64()),
            pa.array(common.sums(base, w.first)),
            pa.array((common.sums(word_score, w.first) + end) / np.log(10)),
            rows,
        ], ["doc_id", "n_tokens", "head_known", "head_score", "score", "rare"])


SCORED = "doc_id long, n_tokens long, head_known long, head_score double, score double, rare array<struct<hash: long, n: long>>"


def _step(n: Column) -> Column:
    """Counts in steps of a thirty-second of a power of two."""
    return F.floor(F.log2(n) * 32)


def _head_step(words: DataFrame, head: int) -> int:
    """The lowest step from which on there are at most ``head`` words; reads a histogram of some hundred rows."""
    left, lowest = head, 1 << 30
    for step, n in sorted(words.groupBy(_step(F.col("n")).alias("step")).count().collect(), reverse=True):
        left -= n
        if left < 0:
            break
        lowest = step
    return lowest


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, head: int = HEAD) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``; scores are log10 probabilities."""
    path = path or common.tokenizer_path(MODEL)
    counts = common.settle(word_counts(training), "words")
    total, distinct, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    total, ends = int(total or 0), int(ends or 0)
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    model = fit(counts, path, ends)
    words = counts.where("word is not null").select("hash", "n")
    top = words.where(_step(F.col("n")) >= _head_step(words, head)).toArrow()  # at most ``head`` rows
    keys = top["hash"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    frequent = keys[order], top["n"].to_numpy()[order]
    name = uuid.uuid4().hex
    keyed = common.keyed_texts(docs, id_col, text_col).where("doc_id is not null")
    scored = common.settle(keyed.mapInArrow(lambda b: _scored(b, path, model, name, frequent, norm), SCORED), "scored")
    rare = scored.select("doc_id", F.explode("rare").alias("r")).select("doc_id", "r.hash", F.col("r.n").alias("times")).dropDuplicates(["doc_id", "hash"])
    rest = words.withColumnRenamed("n", "c")
    joined = rare.join(rest, "hash", "left").groupBy("doc_id").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * (F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5) - norm)).alias("rare_score"),
    )
    end_score = float(np.log10(ends + 0.5)) - norm
    light = scored.drop("rare").dropDuplicates(["doc_id"])
    return light.join(joined, "doc_id", "left").select(
        "doc_id", "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0)) + end_score).alias("base_score"),
        "score",
    )


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
