"""Alignment of two tokenizers over the same texts, by merge-path partitioning of their token ends.

Every text, with one space before it, is encoded by a byte-level vocabulary (A) and by a subword model (B).
Both lists of token ends are sorted byte offsets.  Diagonal binary searches cut the merge of the two lists
into pieces of equal work; each piece alone finds where its A and B tokens overlap and end together, and the
groups that a piece boundary cut are stitched from the pieces beside it.  A group lies between two offsets
where tokens of both sides end; its A and B tokens are linked pairwise.

How many documents hold a linked pair of ids is counted over the whole corpus.  Documents are taken in blocks:
a block lists its pairs once with the number of its documents that hold them, counts are summed by pair, the
best count of an A id is found from them, and each block gets back the counts of the pairs on its list.  So a
pair that is in every document travels once a block.

Texts are cut before a space or line feed that follows no white space.  No token of either vocabulary crosses
such a cut (``Pair`` checks the vocabularies), so the tokens of a repeated word are looked up, by a 64-bit hash.

Cases: null and empty texts, and texts that either side's tokens don't spell byte for byte (a literal U+2581),
have no tokens: all counts 0, no groups, ``''`` in place of a hash.  Every row gives one row, rows without an
id and repeated rows too; each row counts as a document.  An empty table gives no rows; other columns are
ignored.  A text of any length is handled whole, in memory in proportion to it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Elements of the merge that one piece handles.
PIECE = 1 << 15
#: Bytes of text turned into arrays at once, and of the texts that share one list of pairs.
CHUNK_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
#: Words kept by a worker, and bytes of new words encoded as one string.
KEPT_WORDS = 600_000
JOINED_BYTES = 1 << 16
#: Links of a group up to which they are listed one by one; larger groups are first reduced to distinct ids.
LISTED = 256
WORD_MARK = "▁"
#: A word in front of others, so that they are encoded as inside a text.
LEAD = b" ."

DOCUMENTS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_pairs array<long>, places binary, times binary, pairs array<long>, holders array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = "doc_id long, start long, end long, a_ids array<int>, b_ids array<int>"


class Tokens(NamedTuple):
    """Token ids of consecutive words: those of word i are ``ids[first[i]:first[i + 1]]``."""

    ids: np.ndarray
    size: np.ndarray


class Pair:
    """Both tokenizers, and the tokens of words seen before."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.library_a = Tokenizer.from_file(path_a)
        self.library_a.encode_special_tokens = True
        self.library_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self._byte_level(self.library_a)
        pieces = [self.library_b.id_to_piece(i) for i in range(self.library_b.vocab_size())]
        if any(WORD_MARK in p.lstrip(WORD_MARK) or "\n" in p for p in pieces):
            raise ValueError("pieces of B cross the start of a word; texts can't be cut there")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.library_b.is_byte(i) else p.replace(WORD_MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.length_a, self.length_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.digits, self.n_digits = _decimals(max(len(pieces), len(self.bytes_a)))
        self.clear()

    @staticmethod
    def _byte_level(library) -> list[bytes]:
        """Bytes of every entry: printable bytes stand for themselves, the others for code points from 256 on."""
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = [b for b in range(256) if b not in set(kept)]
        byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}
        return [
            bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
            for token in map(library.id_to_token, range(library.get_vocab_size(with_added_tokens=True)))
        ]

    def clear(self) -> None:
        self.words = common.WordCache(KEPT_WORDS)
        self.valid = np.zeros(0, bool)
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.begin = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.size = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def _a(self, joined: bytes) -> list[int]:
        return self.library_a.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids

    def _b(self, joined: bytes) -> list[int]:
        return self.library_b.encode(joined[1:].decode())  # B puts the space before itself

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, Tokens, Tokens]:
        """Which words both sides spell, and the tokens of those; many words are encoded as one text."""
        valid = np.ones(len(words), bool)
        out: list[list[Tokens]] = [[], []]
        length = np.array([len(w) for w in words], np.int64)
        part = (np.cumsum(length) - length) // JOINED_BYTES
        alone = np.array([_ends_blank(w) for w in words], bool)  # the end of a text: what follows would change its tokens
        lo = 0
        for hi in [*(np.flatnonzero((np.diff(part) > 0) | alone[1:] | alone[:-1]) + 1).tolist(), len(words)]:
            got = self._together(words[lo:hi])
            if got is None:
                for i in range(lo, hi):
                    one = self._together(words[i : i + 1])
                    valid[i] = one is not None
                    for side in (0, 1):
                        out[side].append(one[side] if one else Tokens(np.zeros(0, np.int32), np.zeros(1, np.int64)))
            else:
                for side in (0, 1):
                    out[side].append(got[side])
            lo = hi
        both = [Tokens(np.concatenate([t.ids for t in o]), np.concatenate([t.size for t in o])) for o in out]
        return valid, both[0], both[1]

    def _together(self, words: list[bytes]) -> list[Tokens] | None:
        joined = LEAD + b"".join(words)
        ends = np.cumsum([len(LEAD), *map(len, words)])
        out = []
        for encode, spelled, length in ((self._a, self.bytes_a, self.length_a), (self._b, self.bytes_b, self.length_b)):
            ids = encode(joined)
            if b"".join([spelled[i] for i in ids]) != joined:
                return None
            ids = np.array(ids, np.int32)
            upto = np.searchsorted(np.cumsum(length[ids]), ends, "right")
            out.append(Tokens(ids[upto[0] :], np.diff(upto)))
        return out

    def look_up(self, data: np.ndarray, w: common.Words) -> tuple[np.ndarray, list[Tokens]]:
        """Which words are valid, and the tokens of all words in order (none for invalid ones)."""
        keys, place, back = np.unique(common.hash_words(data, w, fold=False), return_index=True, return_inverse=True)
        if not len(keys):
            nothing = Tokens(np.zeros(0, np.int32), np.zeros(0, np.int64))
            return np.zeros(0, bool), [nothing, nothing]
        if self.words.full():
            self.clear()
        new = np.flatnonzero(self.words.missing(keys))
        if len(new):
            at = place[new]
            valid, *tokens = self.encoded([data[s:e].tobytes() for s, e in zip(w.start[at], w.end[at], strict=True)])
            self.words.add(keys[new])
            self.valid = np.concatenate([self.valid, valid])
            for side, t in enumerate(tokens):
                self.begin[side] = np.concatenate([self.begin[side], len(self.flat[side]) + np.cumsum(t.size) - t.size])
                self.size[side] = np.concatenate([self.size[side], t.size])
                self.flat[side] = np.concatenate([self.flat[side], t.ids])
        row = self.words.row(keys)[back]
        out = []
        for side in (0, 1):
            size = self.size[side][row]
            shift = self.begin[side][row] - (np.cumsum(size) - size)
            out.append(Tokens(self.flat[side][np.repeat(shift, size) + np.arange(int(size.sum()))], size))
        return self.valid[row], out


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _ends_blank(word: bytes) -> bool:
    return word[-1] <= 0x20 or word[-1] == 0x7F or (word[-1] >= 0x80 and not word[-4:].decode(errors="ignore")[-1].isprintable())


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, from the left, and how many there are."""
    count = np.array([len(str(i)) for i in range(n)], np.int64)
    digits = np.zeros((int(count.max()), n), np.uint8)
    for d in range(len(digits)):
        digits[d] = np.arange(n) // 10 ** np.maximum(count - 1 - d, 0) % 10 + ord("0")
    return digits, count


def spaced(t: common.Texts) -> common.Texts:
    """Every text that isn't empty, with one space before it."""
    filled = t.lengths() > 0
    data = np.insert(t.data, t.offsets[:-1][filled], ord(" "))
    return common.Texts(data, t.offsets + np.concatenate([[0], np.cumsum(filled)]))


def words(t: common.Texts) -> common.Words:
    """Texts cut before each space or line feed that follows a character which isn't white space.

    Characters that any of the libraries might take for white space count as such, so some cuts are left out.
    """
    d = t.data
    n = len(d)
    # fixed values: white space beyond ASCII in UTF-8, by its last two or three bytes
    blank = (d <= 0x20) | (d == 0x7F)
    if n > 1:
        two = np.zeros(n, bool)
        two[1:] = (d[:-1] == 0xC2) & ((d[1:] == 0x85) | (d[1:] == 0xA0))
        blank |= two
    if n > 2:
        x, y, z = d[:-2], d[1:-1], d[2:]
        three = ((x == 0xE1) & ((y == 0x9A) | (y == 0xA0))) | ((x == 0xE2) & ((y == 0x80) | (y == 0x81))) | ((x == 0xE3) & (y == 0x80)) | ((x == 0xEF) & (y == 0xBB) & (z == 0xBF))
        blank[2:] |= three
    cut = np.zeros(n, bool)
    if n > 1:
        cut[1:] = ((d[1:] == 0x20) | (d[1:] == 0x0A)) & ~blank[:-1]
    begins = t.offsets[:-1][t.lengths() > 0]
    cut[begins] = True
    start = np.flatnonzero(cut)
    return common.Words(start, np.append(start[1:], n)[: len(start)], np.searchsorted(start, t.offsets))


def diagonals(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` where every ``step``-th element of their merge begins (of equals, ``a`` goes first)."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, step), total)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        further = a[mid] <= b[d[open_] - mid - 1]
        lo[open_] = np.where(further, mid + 1, lo[open_])
        hi[open_] = np.where(further, hi[open_], mid)
    return lo, d - lo


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What one piece finds alone: where an end of its ``a`` is also in its ``b`` (which holds one element more)."""
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a) if len(b) else np.zeros(0, np.int64)
    return hit, at[hit]


def groups(ends_a: np.ndarray, ends_b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """First A and first B token of every group, and the numbers of tokens at the end.

    A piece reports the ends it shares; what lies open at its edges belongs to the group that the next shared
    end closes, whichever piece finds that.
    """
    from_a, from_b = diagonals(ends_a, ends_b, step)
    cut_a, cut_b = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for p in range(len(from_a) - 1):
        hit_a, hit_b = common_ends(ends_a[from_a[p] : from_a[p + 1]], ends_b[from_b[p] : from_b[p + 1] + 1])
        cut_a.append(hit_a + from_a[p] + 1)
        cut_b.append(hit_b + from_b[p] + 1)
    return np.concatenate(cut_a), np.concatenate(cut_b)


class Aligned(NamedTuple):
    """Texts with the tokens of both sides: document i has A tokens ``doc_a[i]`` to ``doc_a[i + 1]`` and so on."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    doc_group: np.ndarray


def align(t: common.Texts, tokenizers: Pair) -> Aligned:
    t = spaced(t)
    w = words(t)
    valid, (a, b) = tokenizers.look_up(t.data, w)
    spelled = common.sums(~valid, w.first) == 0  # a text with a word that isn't spelled has no tokens
    kept = spelled[w.doc()]
    first = np.concatenate([[0], np.cumsum(np.diff(w.first) * spelled)])
    ids, doc = [], []
    for side in (a, b):
        ids.append(side.ids[np.repeat(kept, side.size)])
        doc.append(np.concatenate([[0], np.cumsum(side.size[kept])])[first])
    ends_a, ends_b = np.cumsum(tokenizers.length_a[ids[0]]), np.cumsum(tokenizers.length_b[ids[1]])
    cut_a, cut_b = groups(ends_a, ends_b)
    return Aligned(ids[0], ids[1], ends_a, cut_a, cut_b, doc[0], doc[1], np.searchsorted(cut_a, doc[0]))


def group_hashes(x: Aligned, tokenizers: Pair) -> list[str]:
    """SHA-256 of each document's groups, written ``a1,a2|b1;a3|b2,b3``; ``''`` without tokens."""
    n_a, n_b = np.diff(x.cut_a), np.diff(x.cut_b)
    total = len(x.ids_a) + len(x.ids_b)
    ids, mark = np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
    at_a = np.arange(len(x.ids_a)) + np.repeat(x.cut_b[:-1], n_a)
    at_b = np.arange(len(x.ids_b)) + np.repeat(x.cut_a[1:], n_b)
    ids[at_a], ids[at_b] = x.ids_a, x.ids_b
    mark[at_a[x.cut_a[1:] - 1]], mark[at_b[x.cut_b[1:] - 1]] = ord("|"), ord(";")
    size = tokenizers.n_digits[ids] + 1
    end = np.cumsum(size)
    start = end - size
    out = np.empty(int(end[-1]) if total else 0, np.uint8)
    for d, digit in enumerate(tokenizers.digits):
        there = size > d + 1
        out[start[there] + d] = digit[ids[there]]
    out[end - 1] = mark
    upto = np.concatenate([[0], end])[x.doc_a + x.doc_b]
    return [hashlib.sha256(out[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(upto[:-1], upto[1:], strict=True)]


def links(x: Aligned, n_b_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair (``a * n_b_ids + b``) and number of occurrences of every linked pair, by document and pair."""
    n_a, n_b = np.diff(x.cut_a), np.diff(x.cut_b)
    doc = np.searchsorted(x.doc_group, np.arange(len(n_a)), "right") - 1
    listed = np.flatnonzero(n_a * n_b <= LISTED)
    many = (n_a * n_b)[listed]
    inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    g = np.repeat(listed, many)
    a, b = x.ids_a[x.cut_a[g] + inside // n_b[g]], x.ids_b[x.cut_b[g] + inside % n_b[g]]
    found = [((doc[g] << 32) | (a.astype(np.int64) * n_b_ids + b), np.ones(len(g), np.int64))]
    for g in np.flatnonzero(n_a * n_b > LISTED):
        (a, of_a), (b, of_b) = (
            np.unique(ids[cut[g] : cut[g + 1]], return_counts=True) for ids, cut in ((x.ids_a, x.cut_a), (x.ids_b, x.cut_b))
        )
        found.append((((doc[g] << 32) | (a.astype(np.int64)[:, None] * n_b_ids + b)).ravel(), (of_a[:, None] * of_b).ravel()))
    key, times = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.add.reduceat(times, first) if len(first) else times


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, all first bytes before all second ones, which packs well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


class _Block:
    def __init__(self):
        self.bytes, self.columns, self.doc_pairs, self.pairs, self.times = 0, [], [], [], []

    def row(self, number: int, n_b_ids: int) -> pa.RecordBatch:
        pairs, times, n_pairs = (np.concatenate(v) for v in (self.pairs, self.times, self.doc_pairs))
        known, place = np.unique(pairs, return_inverse=True)
        # places of a document rise, so their differences are small
        step = np.diff(place, prepend=0)
        first = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
        step[first] = place[first]
        lists = [pa.ListArray.from_arrays([0, len(n_pairs)], pa.concat_arrays([c[i] for c in self.columns])) for i in range(6)]
        values = [
            pa.array([number]), *lists, pa.array([n_pairs]), pa.array([_planes(step)]), pa.array([_planes(times)]),
            pa.array([known]), pa.array([np.bincount(place, minlength=len(known))]),
        ]
        return pa.record_batch(values, [c.split()[0] for c in DOCUMENTS.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    tokenizers = pair(path_a, path_b)
    number = TaskContext.get().partitionId() << 32
    block = _Block()
    for batch, t in common.chunks(batches, size=CHUNK_BYTES):
        x = align(t, tokenizers)
        doc, pairs, times = links(x, len(tokenizers.bytes_b))
        of_group = np.diff(x.cut_a) * np.diff(x.cut_b)
        counts = [np.diff(x.doc_a), np.diff(x.doc_b), np.diff(x.doc_group), common.sums(of_group, x.doc_group)]
        block.columns.append([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(group_hashes(x, tokenizers), pa.string())])
        block.doc_pairs.append(np.bincount(doc, minlength=len(t)))
        block.pairs.append(pairs)
        block.times.append(times)
        block.bytes += len(t.data)
        if block.bytes >= BLOCK_BYTES:
            yield block.row(number, len(tokenizers.bytes_b))
            block, number = _Block(), number + 1
    if block.columns:
        yield block.row(number, len(tokenizers.bytes_b))


def _scored(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows of one block; ``answers`` has the count of each pair on its list, negative where it isn't the best of its A id."""
    out = []
    pairs, count = (answers[c].to_numpy() for c in ("pair", "count"))
    order = np.argsort(pairs)
    count = count[order]
    for row in documents.to_batches():
        n_pairs = row.column("n_pairs").flatten().to_numpy()
        first = np.concatenate([[0], np.cumsum(n_pairs)])
        step, times = (_values(row.column(c)[0].as_py()) for c in ("places", "times"))
        run = np.cumsum(step)
        begun = first[:-1][n_pairs > 0]
        place = run - np.repeat((run[begun] - step[begun]), n_pairs[n_pairs > 0])
        of_pair = count[place]
        best = common.sums(np.where(of_pair > 0, times, 0), first)
        total = common.sums(np.abs(of_pair) * times, first)
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        columns = [row.column(c).flatten() for c in names]
        out.append(pa.record_batch([*columns, pa.array(best), pa.array(total), row.column("groups_sha256").flatten()], [*names, "n_best", "count_sum", "groups_sha256"]))
    return pa.Table.from_batches(out, pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RESULT.split(", ")]))


def alignment(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best`` counts the links whose pair is held by as many documents as any pair of that A id; ``count_sum``
    adds up the numbers of documents over all links.
    """
    path_a, path_b = path_a or common.tokenizer_path(VOCABULARY_A), path_b or common.tokenizer_path(VOCABULARY_B)
    texts = common.keyed_texts(docs, id_col, text_col)
    blocks = common.settle(texts.mapInArrow(lambda b: _blocks(b, path_a, path_b), DOCUMENTS), "aligned", compression="zstd")
    listed = blocks.select("block", F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders"))
    counts = pair_counts(listed, path_b)
    signed = F.when(F.col("best"), F.col("count")).otherwise(-F.col("count"))
    answers = listed.select("block", "pair").join(counts.select("pair", signed.alias("count")), "pair").select(F.col("block").alias("of_block"), "pair", "count")
    documents = blocks.drop("pairs", "holders")
    return documents.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_scored, RESULT)


def pair_counts(listed: DataFrame, path_b: str) -> DataFrame:
    """``pair, count, best`` over the whole corpus; an A id has at most as many pairs as B has entries."""
    import sentencepiece

    n_b_ids = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
    counts = listed.groupBy("pair").agg(F.sum("holders").alias("count")).withColumn("a", F.expr(f"pair div {n_b_ids}"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _grouped(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    tokenizers = pair(path_a, path_b)
    for batch, t in common.chunks(batches, size=CHUNK_BYTES // 4):
        x = align(t, tokenizers)
        doc = np.searchsorted(x.doc_group, np.arange(len(x.cut_a) - 1), "right") - 1
        base = np.concatenate([[0], x.ends_a])
        start = base[x.cut_a[:-1]] - base[x.doc_a[doc]]
        end = base[x.cut_a[1:]] - base[x.doc_a[doc]]
        ids = [pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(i, pa.int32())) for c, i in ((x.cut_a, x.ids_a), (x.cut_b, x.ids_b))]
        yield pa.record_batch([batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(end), *ids], [c.split()[0] for c in GROUPS.split(", ")])


def aligned_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """The groups themselves: ``doc_id, start, end`` (bytes of space and text), ``a_ids, b_ids``; one pass, no shuffle."""
    path_a, path_b = path_a or common.tokenizer_path(VOCABULARY_A), path_b or common.tokenizer_path(VOCABULARY_B)
    return common.keyed_texts(docs, id_col, text_col).mapInArrow(lambda b: _grouped(b, path_a, path_b), GROUPS)
