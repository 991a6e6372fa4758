"""Repeated passages of documents, by a logarithmic family of sparse suffix arrays.

Every byte is found that lies in a string of ``WINDOW`` bytes which also starts in a document with a smaller
id.  The corpus is cut into batches.  A batch's suffix array is sparse: windows with one least 16-byte gram
hash form a segment, and one suffix per segment is kept, so that equal windows of any two documents lie in
segments with the same gram, and suffixes are ordered by that gram.  A batch sends its sorted suffixes, cut
by range, to the owners of the ranges.  An owner takes batch after batch into levels: a new run is merged
with the level of its size, the result with the next, and so on, so each suffix is merged a logarithmic
number of times.  Every run is then merge-scanned against the levels for its suffixes' matches:

* the segment's bytes start in an earlier document as a whole: all of its windows are repeats;
* nothing else has the gram: none is;
* otherwise the segment's bytes are sent to the owner of the gram, which compares the single windows.

Equal suffixes of a batch are one, with their least document.  A gram that ``HOT`` different segments of one
batch share (a common line, say) would collect too much at one owner: the batch sends only a mark, and windows of
such grams are compared at owners of the windows' own hashes, again one of a kind per batch.  Answers are
bits per suffix and masks of windows, so little comes back, and texts travel compressed by the batch.

Cases: null and empty texts, and texts shorter than a window, have no repeats; repeats inside one document
don't count; rows of one id are one document for the comparison and each gives a row; rows without an id are
left out; an empty table gives no rows; texts of any length are one piece; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

WINDOW = 50
GRAM = 16
#: Windows in a segment at most: the first and last window, and the number, then tell all of its bytes.
LONGEST = 50
#: Bytes of text in a batch (more only for one longer document), and in a block worked on at once.
BATCH_BYTES = 4 << 20
BLOCK_BYTES = 256 << 10
#: Bytes of text for each range of grams; a range has about a suffix for every 20 bytes.
RANGE_BYTES = 8 << 20
#: Different segments of a batch with one gram from which on the gram is hot.
HOT = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = common.mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_MARK = np.uint64((1 << 40) - 1)
_LAST = np.int64(2**63 - 1)
BATCHES = "ids binary, offsets binary, size long, text binary"
RUNS = "bucket int, batch long, kind int, n long, rows binary"
ANSWERS = "bucket int, batch long, kind int, n long, answer binary"
REPEATS = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _zip(data: bytes | np.ndarray) -> bytes:
    return pa.compress(pa.py_buffer(np.ascontiguousarray(data) if isinstance(data, np.ndarray) else data), codec="zstd", asbytes=True)


def _unzip(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, codec="zstd") if size else b"", np.uint8)


def _planes(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of 64-bit values as their lowest bytes, byte plane by byte plane, compressed."""
    parts = [x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T for x, width in columns]
    return _zip(np.concatenate([np.ascontiguousarray(p).reshape(-1) for p in parts]))


def _columns(data: bytes, n: int, *widths: int) -> list[np.ndarray]:
    raw = _unzip(data, n * sum(widths))
    out, at = [], 0
    for width in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(full.reshape(-1).view("<u8"))
        at += n * width
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    h, size = _BYTE[data], 1
    while size < GRAM:
        h = h[:-size] * (_BASE + np.uint64(2 * size)) + h[size:]
        size *= 2
    return common.mix(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _window_hash(g: np.ndarray, at: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of the windows that begin at ``at``, from the grams that make them up."""
    base = _BASE + np.uint64(1012 if second else 0)
    h = g[at]
    for step in (GRAM, 2 * GRAM, WINDOW - GRAM):
        h = h * base + g[at + step]
    return common.mix(h ^ base)


class Segments(NamedTuple):
    """Runs of windows with one least gram: first byte, number of windows, document, gram, hash of the bytes."""

    start: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    gram: np.ndarray
    code: np.ndarray


def segments(t: common.Texts) -> Segments:
    parts: list[tuple[np.ndarray, ...]] = []
    lo = 0
    while lo < len(t):
        hi = max(lo + 1, int(np.searchsorted(t.offsets, t.offsets[lo] + BLOCK_BYTES, "right")) - 1)
        origin, end = int(t.offsets[lo]), int(t.offsets[hi])
        if end - origin >= WINDOW:
            g = gram_hashes(t.data[origin:end])
            least = _least(g, WINDOW - GRAM + 1)
            n = len(least)
            valid = np.ones(n + 1, bool)
            last = (t.offsets[lo + 1 : hi + 1] - origin)[:, None] + np.arange(1 - WINDOW, 0)
            valid[np.clip(last, -1, n).reshape(-1)] = False  # -1 and n are the spare place at the end
            valid = valid[:n]
            edge = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])]))
            size = np.diff(np.append(edge, n))
            edge, size = edge[valid[edge]], size[valid[edge]]
            pieces = -(-size // LONGEST)
            begin = np.repeat(edge, pieces)
            step = np.arange(len(begin)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            count = np.minimum(np.repeat(size, pieces) - step * LONGEST, LONGEST)
            begin = begin + step * LONGEST
            code = common.mix(_window_hash(g, begin) * _BASE + _window_hash(g, begin + count - 1) + count.astype(np.uint64))
            # mixed again, since least hashes are small ones and ranges should be even
            parts.append((begin + origin, count, common.mix(least[begin]) >> np.uint64(16), code >> np.uint64(25)))
        lo = hi
    start, count, gram, code = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64 if i < 2 else np.uint64) for i in range(4))
    return Segments(start, count, np.searchsorted(t.offsets, start, "right") - 1, gram, code)


class Batch:
    """A batch's texts, segments, and its suffixes: distinct (gram, code) in order, each with its least document."""

    def __init__(self, ids: bytes, offsets: bytes, size: int, text: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.t = common.Texts(_unzip(text, size), np.frombuffer(offsets, np.int64))
        s = self.s = segments(self.t)
        self.doc = self.ids[s.doc]
        code = s.code
        order = np.lexsort((code, s.gram))
        gram, sorted_code = s.gram[order], code[order]
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)]
        new = new_gram | np.concatenate([[True], sorted_code[1:] != sorted_code[:-1]])[: len(gram)]
        kinds = np.bincount(np.cumsum(new_gram)[new] - 1) if len(gram) else np.zeros(0, np.int64)
        hot = (kinds >= HOT)[np.cumsum(new_gram) - 1] if len(gram) else np.zeros(0, bool)
        new = np.where(hot, new_gram, new)
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        self.suffix = np.empty(len(gram), np.int64)
        self.suffix[order] = number
        least = np.minimum.reduceat(self.doc[order], first) if len(first) else np.zeros(0, np.int64)
        marked = hot[first]
        self.gram = gram[first]
        self.code = np.where(marked, _MARK, sorted_code[first])
        self.least = np.where(marked, _LAST, least)
        self.lead = order[first]  # a segment of the suffix

    def answered(self, answers: list[tuple[int, int, int, bytes]]) -> None:
        """``repeat`` and ``single`` by segment, and the segments and windows to compare one by one."""
        parts = sorted((b, n, a) for b, kind, n, a in answers if kind == 0)
        flags = np.concatenate([_unzip(a, n) for _, n, a in parts]) if parts else np.zeros(0, np.uint8)
        whole, contested, hot = ((flags >> i & 1).astype(bool) for i in range(3))
        s = self.suffix
        self.repeat = whole[s] | (self.doc > self.least[s])
        asked = np.flatnonzero(contested & ~hot & ~whole)
        # the least document's segment stands for the suffix
        own = np.flatnonzero(self.doc == self.least[s])
        holder = np.full(len(self.gram), -1)
        holder[s[own]] = own
        self.asked, self.holder = asked, holder[asked]
        loose = np.flatnonzero(hot[s] & ~self.repeat)
        count = self.s.count[loose]
        place = np.repeat(self.s.start[loose], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        doc = np.repeat(self.doc[loose], count)
        one, two = self._hashes(place)
        order = np.lexsort((doc, two, one))
        one, two, self.loose_place, self.loose_doc = one[order], two[order], place[order], doc[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[: len(one)]
        self.loose_group = np.cumsum(new) - 1
        self.loose = one[new], two[new], self.loose_doc[new]

    def _hashes(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
        for a in range(0, len(place), 4096):
            some = place[a : a + 4096]
            g = gram_hashes(self.t.data[some[:, None] + np.arange(WINDOW)].reshape(-1))
            at = np.arange(len(some)) * WINDOW
            one[a : a + 4096], two[a : a + 4096] = _window_hash(g, at), _window_hash(g, at, True)
        return one, two


def _batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[np.ndarray] = []
    data: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        row = pa.record_batch([[np.concatenate(ids).tobytes()], [offsets.tobytes()], [int(offsets[-1])], [_zip(np.concatenate(data))]], ["ids", "offsets", "size", "text"])
        ids.clear(), data.clear(), sizes.clear()
        return row

    for batch, t in common.chunks(stream, size=1 << 20):
        ids.append(batch.column("doc_id").to_numpy())
        data.append(t.data)
        sizes.append(t.lengths())
        held += len(t.data)
        if held >= BATCH_BYTES:
            yield out()
            held = 0
    if ids:
        yield out()


def _loaded(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Batch, list]]:
    for rows in stream:
        for i in range(len(rows)):
            ids, offsets, size, text, number = (rows.column(c)[i].as_py() for c in ("ids", "offsets", "size", "text", "batch"))
            answers = rows.column("answers")[i].as_py() if "answers" in rows.schema.names else None
            yield number, Batch(ids, offsets, size, text), [(a["bucket"], a["kind"], a["n"], a["answer"]) for a in answers or []]


def _row(bucket: int, batch: int, kind: int, n: int, blob: bytes, name: str = "rows") -> pa.RecordBatch:
    return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([batch], pa.int64()), pa.array([kind], pa.int32()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "batch", "kind", "n", name])


def _ranges(key: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the parts of a sorted key of so many bits."""
    edges = np.searchsorted(key, np.arange(1, buckets, dtype=np.uint64) * np.uint64(2**bits // buckets))
    for b, (lo, hi) in enumerate(zip(np.append(0, edges), np.append(edges, len(key)), strict=True)):
        if hi > lo:
            yield b, int(lo), int(hi)


def _suffixes(stream: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for number, batch, _ in _loaded(stream):
        for b, lo, hi in _ranges(batch.gram, 48, buckets):
            yield _row(b, number, 0, hi - lo, _planes((batch.gram[lo:hi], 6), (batch.code[lo:hi], 5), (batch.least[lo:hi].view(np.uint64), 8)))


class Levels:
    """Runs of suffixes, the largest first; each is more than twice the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, gram: np.ndarray, code: np.ndarray, doc: np.ndarray) -> None:
        run = gram, code, doc
        while self.levels and len(self.levels[-1][0]) <= 2 * len(run[0]):
            run = self._merged(self.levels.pop(), run)
        self.levels.append(run)

    def one(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        while len(self.levels) > 1:
            self.levels.append(self._merged(self.levels.pop(), self.levels.pop()))
        return self.levels[0]

    @staticmethod
    def _merged(a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gram, code, doc = (np.concatenate([x, y]) for x, y in zip(a, b, strict=True))
        order = np.lexsort((code, gram))
        gram, code, doc = gram[order], code[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (code[1:] != code[:-1])]))
        return gram[first], code[first], np.minimum.reduceat(doc, first)


def _matched(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to the runs of a range: bit 0 whole repeat, bit 1 other segments have the gram, bit 2 hot gram."""
    for table, edges in common.group_blocks(stream, ["bucket"]):
        blobs, sizes, owners, buckets = table["rows"], table["n"].to_pylist(), table["batch"].to_pylist(), table["bucket"].to_pylist()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            levels = Levels()
            for i in range(lo, hi):
                gram, code, doc = _columns(blobs[i].as_py(), sizes[i], 6, 5, 8)
                levels.add(gram, code, doc.view(np.int64))
            gram, code, least = levels.one()
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            grams, kinds = gram[first], np.diff(np.append(first, len(gram)))
            hot = np.logical_or.reduceat(code == _MARK, first)
            # (number of the gram, code) as one sorted key
            key = (np.repeat(np.arange(len(grams), dtype=np.uint64), kinds) << np.uint64(40)) | code
            for i in range(lo, hi):
                g, c, d = _columns(blobs[i].as_py(), sizes[i], 6, 5, 8)
                number = np.searchsorted(grams, g)
                at = np.searchsorted(key, (number.astype(np.uint64) << np.uint64(40)) | c)
                flags = (least[at] < d.view(np.int64)) & (c != _MARK)
                answer = flags.astype(np.uint8) | ((kinds[number] > 1).astype(np.uint8) << 1) | (hot[number].astype(np.uint8) << 2)
                yield _row(buckets[i], owners[i], 0, len(g), _zip(answer), "answer")


def _contested(stream: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Segments (kind 1: documents, numbers of windows, bytes) and windows of hot grams (kind 2: hashes, documents)."""
    for number, batch, answers in _loaded(stream):
        batch.answered(answers)
        for b, lo, hi in _ranges(batch.gram[batch.asked], 48, buckets):
            hold = batch.holder[lo:hi]
            start, count = batch.s.start[hold], batch.s.count[hold]
            size = count + WINDOW - 1
            at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            head = _planes((batch.doc[hold].view(np.uint64), 8), (count.astype(np.uint64), 1))
            body = _zip(batch.t.data[at])
            yield _row(b, number, 1, hi - lo, len(head).to_bytes(4, "little") + head + body)
        one, two, doc = batch.loose
        for b, lo, hi in _ranges(one, 64, buckets):
            yield _row(b, number, 2, hi - lo, _planes((one[lo:hi], 8), (two[lo:hi], 8), (doc[lo:hi].view(np.uint64), 8)))


def _first_docs(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Least document of each (one, two), for every row."""
    order = np.lexsort((doc, two, one))
    a, b, d = one[order], two[order], doc[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    out = np.empty_like(doc)
    out[order] = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _compared(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, edges in common.group_blocks(stream, ["bucket", "kind"]):
        blobs, sizes, owners, buckets, kinds = table["rows"], table["n"].to_pylist(), table["batch"].to_pylist(), table["bucket"].to_pylist(), table["kind"].to_pylist()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            one, two, docs, counts = [], [], [], []
            for i in range(lo, hi):
                blob = blobs[i].as_py()
                if kinds[i] == 2:
                    a, b, d = _columns(blob, sizes[i], 8, 8, 8)
                    count = np.ones(sizes[i], np.int64)
                else:
                    head = int.from_bytes(blob[:4], "little")
                    d, count = _columns(blob[4 : 4 + head], sizes[i], 8, 1)
                    count = count.astype(np.int64)
                    size = count + WINDOW - 1
                    g = gram_hashes(_unzip(blob[4 + head :], int(size.sum())))
                    at = np.repeat((np.cumsum(size) - size) - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    a, b = _window_hash(g, at), _window_hash(g, at, True)
                one.append(a), two.append(b), counts.append(count)
                docs.append(np.repeat(d.view(np.int64), count))
            doc = np.concatenate(docs)
            repeat = _first_docs(np.concatenate(one), np.concatenate(two), doc) < doc
            at = 0
            for i, count in zip(range(lo, hi), counts, strict=True):
                n = int(count.sum())
                begin = np.cumsum(count) - count
                turn = np.arange(n) - np.repeat(begin, count)
                mask = np.add.reduceat(repeat[at : at + n].astype(np.uint64) << turn.astype(np.uint64), begin)
                yield _row(buckets[i], owners[i], kinds[i], len(count), _planes((mask, 7)), "answer")
                at += n


def _finished(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, batch, answers in _loaded(stream):
        batch.answered(answers)
        cover = np.zeros(len(batch.t.data) + 1, np.int32)
        s = batch.s
        whole = np.flatnonzero(batch.repeat)
        _mark(cover, s.start[whole], s.start[whole] + s.count[whole] + WINDOW - 1)
        masks = _answers(answers, 1)
        of_suffix = np.zeros(len(batch.gram), np.uint64)
        of_suffix[batch.asked] = masks
        mask = np.where(batch.doc == batch.least[batch.suffix], of_suffix[batch.suffix], 0).astype(np.uint64)
        for i in range(LONGEST):
            at = s.start[np.flatnonzero(mask >> np.uint64(i) & np.uint64(1))] + i
            _mark(cover, at, at + WINDOW)
        loose = _answers(answers, 2).astype(bool)
        if len(loose):
            group = batch.loose_group
            at = batch.loose_place[loose[group] | (batch.loose_doc > batch.loose[2][group])]
            _mark(cover, at, at + WINDOW)
        removed = np.cumsum(cover[:-1]) > 0
        yield from _rows(batch, removed)


def _mark(cover: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    np.add.at(cover, start, 1)
    np.add.at(cover, end, -1)


def _answers(answers: list[tuple[int, int, int, bytes]], kind: int) -> np.ndarray:
    parts = sorted((b, n, a) for b, k, n, a in answers if k == kind)
    return np.concatenate([_columns(a, n, 7)[0] for _, n, a in parts]) if parts else np.zeros(0, np.uint64)


def _rows(batch: Batch, removed: np.ndarray, some: int = 1000) -> Iterator[pa.RecordBatch]:
    t = batch.t
    w = common.words(common.Texts(removed.astype(np.uint8), t.offsets), np.array([True] + [False] * 255))
    kept = ~removed
    total = np.concatenate([[0], np.cumsum(kept)])
    data, edge = t.data[kept], total[t.offsets]
    origin = t.offsets[w.doc()]
    for lo in range(0, len(t), some):
        hi = min(lo + some, len(t))
        a, b = w.first[lo], w.first[hi]
        spans = pa.StructArray.from_arrays([pa.array(w.start[a:b] - origin[a:b]), pa.array(w.end[a:b] - origin[a:b])], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(w.first[lo : hi + 1] - a, pa.int32()), spans)
        blob = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((edge[lo : hi + 1] - edge[lo]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[edge[lo] : edge[hi]]))])
        yield pa.record_batch([pa.array(batch.ids[lo:hi]), pa.array(np.diff(t.offsets[lo : hi + 1])), lists, blob.cast(pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the repeated runs of each document's UTF-8 bytes, and the other bytes."""
    keyed = common.keyed_texts(docs, id_col, text_col).where("doc_id is not null")
    batches = keyed.mapInArrow(_batches, BATCHES).withColumn("batch", F.monotonically_increasing_id())
    batches = common.settle(batches, "batches")
    total = batches.agg(F.sum("size")).first()[0] or 0
    buckets = int(max(8, -(-total // RANGE_BYTES)))

    def owned(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys, "batch")

    def with_answers(answers: DataFrame) -> DataFrame:
        by_batch = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "kind", "n", "answer")).alias("answers"))
        return batches.join(by_batch, "batch", "left")

    runs = batches.mapInArrow(lambda s: _suffixes(s, buckets), RUNS)
    matched = common.settle(owned(runs, "bucket").mapInArrow(_matched, ANSWERS), "matched")
    contested = with_answers(matched).mapInArrow(lambda s: _contested(s, buckets), RUNS)
    compared = common.settle(owned(contested, "bucket", "kind").mapInArrow(_compared, ANSWERS), "compared")
    return with_answers(matched.unionByName(compared)).mapInArrow(_finished, REPEATS)

