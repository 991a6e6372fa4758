"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

A piece of length n belongs to class k when capacity/(k+1) < n <= capacity/k, and a bin of class k holds
exactly k pieces, so a bin's content depends on counts alone and never on the other pieces' lengths.
Documents may be cut, so a document is cut into slices of exactly ``capacity // k`` tokens (k = 1, 2, ... by
what is left) until at most ``capacity // TAIL_CLASS`` tokens remain: full bins of whole slices waste fewer
than k tokens, and the rest is small enough that its class wastes little.

Pieces are dealt to workers by a hash of their unique key; every worker numbers its pieces of a class from the
class's running count of the workers before it and fills its bins independently.  Only counts by (class,
worker) are exchanged.  The last, unfinished bin of each class goes to one task, together fewer than
six pieces per token of capacity whatever the input: first-fit-decreasing puts them into shared sequences.

``sequences`` gives the packed sequences with their ids: places are found from lengths alone, then the ids join
by a key of their piece and meet once by sequence.  ``pack`` describes the pieces inside those sequences.

Cases: a null or empty text is one piece with the end token alone; an empty table gives no rows; texts of any
length are cut into as many pieces as needed; repeated rows are packed like other rows; other columns are
ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import common

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 1
#: The rest of a document is cut further until it is in this class or a later one.
TAIL_CLASS = 64
#: Sequence ids: class in the upper bits, number of the bin in the lower 40; class 0 holds the last bins.
CLASS_SHIFT = 40
#: Sequences of one whole piece need no count and are numbered from here.
WHOLE = 1 << 62
#: Strings handed to the library at once, and words joined to one string.
ENCODED = 512
JOINED = 256
WORD_END = "</w>"
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
SEQUENCES = "sequence_id long, ids binary, pieces array<struct<doc_id: long, start: long, length: long, doc_tokens: long, offset: long>>"
ID_BYTES = 4


def cuts(n: int, capacity: int = CAPACITY, tail_class: int = TAIL_CLASS) -> list[int]:
    """Lengths of the pieces of ``n`` tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest > max(1, capacity // tail_class):
        size = capacity // -(-capacity // rest)
        out.append(size)
        rest -= size
    return [*out, rest] if rest else out


class IdCache:
    """Token ids of words: sorted word hashes with places in one flat array, kept while a worker lives, up to a bound."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.encode = library.encode_batch_fast
        self.ends_word = np.zeros(library.get_vocab_size(with_added_tokens=True), bool)
        self.ends_word[[i for token, i in library.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.words = common.WordCache()
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the number of ids of each.

        Words of ASCII letters are one pre-token each: many are encoded as one text and told apart by the ids
        that end a word.
        """
        plain = np.array([w.isascii() and w.isalpha() for w in words], bool)
        size = np.zeros(len(words), np.int64)
        some = [w for w, p in zip(words, plain, strict=True) if p]
        joined = [" ".join(some[lo : lo + JOINED]) for lo in range(0, len(some), JOINED)]
        flat_plain = self._encoded(joined)[0]
        ends = np.flatnonzero(self.ends_word[flat_plain])
        size[plain] = np.diff(ends, prepend=-1)
        flat_other, size[~plain] = self._encoded([w for w, p in zip(words, plain, strict=True) if not p])
        flat = np.empty(int(size.sum()), np.int32)
        of_plain = np.repeat(plain, size)
        flat[of_plain], flat[~of_plain] = flat_plain, flat_other
        return flat, size

    def _encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(strings), ENCODED):
            ids = [x.ids for x in self.encode(strings[lo : lo + ENCODED], add_special_tokens=False)]
            size.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter((i for x in ids for i in x), np.int32, int(size[-1].sum())))
        return np.concatenate(flat), np.concatenate(size)

    def look_up(self, data: np.ndarray, w: common.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the number of ids of each word."""
        keys, place, back = np.unique(common.hash_words(data, w, fold=False), return_index=True, return_inverse=True)
        if not len(keys):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.words.full():
            self.clear()
        new = np.flatnonzero(self.words.missing(keys))
        if len(new):
            at = place[new]
            strings = [data[s:e].tobytes().decode() for s, e in zip(w.start[at], w.end[at], strict=True)]
            flat, size = self.ids_of(strings)
            self.words.add(keys[new])
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])
        row = self.words.row(keys)[back]
        size = self.size[row]
        shift = self.begin[row] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(int(size.sum()))], size


@lru_cache(maxsize=1)
def id_cache(path: str) -> IdCache:
    return IdCache(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, tail_class: int) -> Iterator[pa.RecordBatch]:
    cache = id_cache(path)
    width = 2 if max(len(cache.ends_word), end_id + 1) <= 1 << 16 else ID_BYTES
    for batch, t in common.chunks(batches, size=2 << 20):
        w = common.words(t, cut=(common.ASCII_LETTER, common.SENTENCE_MARK))  # no token crosses such a cut
        ids, size = cache.look_up(t.data, w)
        per_doc = common.sums(size, w.first)
        first = np.cumsum(per_doc) - per_doc
        # the end token follows each document
        ids = np.insert(ids, first + per_doc, end_id).astype(f"<u{width}")
        total = per_doc + 1
        first = np.cumsum(total) - total
        lengths = [cuts(int(n), capacity, tail_class) for n in total]
        owner = np.repeat(np.arange(len(total)), [len(x) for x in lengths])
        length = np.array([n for x in lengths for n in x], np.int64)
        begin = np.cumsum(length) - length
        blob = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer((np.append(begin, len(ids)) * width).astype(np.int64)), pa.py_buffer(ids)])
        yield pa.record_batch([batch.column("doc_id").take(pa.array(owner)), pa.array(begin - first[owner]), pa.array(length), pa.array(total[owner]), blob.cast(pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])


def tokenize_and_cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, tail_class: int = TAIL_CLASS) -> DataFrame:
    """Pieces of every document with their ids (little-endian unsigned: 16-bit if all ids of the vocabulary fit, else 32-bit)."""
    path = path or common.tokenizer_path(VOCABULARY)
    keyed = common.keyed_texts(docs, id_col, text_col)
    return keyed.mapInArrow(lambda b: _pieces(b, path, capacity, end_id, tail_class), PIECES)


def _fit(frames: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    """First-fit-decreasing over the bounded set of pieces in unfinished bins."""
    some = list(frames)
    if not some:
        return
    frame = pd.concat(some, ignore_index=True)
    frame = frame.sort_values(["length", "piece"], ascending=[False, True], ignore_index=True)
    free = np.zeros(0, np.int64)
    bins = np.zeros(len(frame), np.int64)
    for i, n in enumerate(frame["length"].to_numpy()):
        room = np.flatnonzero(free >= n)
        if not len(room):
            free, room = np.append(free, capacity), [len(free)]
        bins[i] = room[0]
        free[room[0]] -= n
    frame["sequence_id"] = bins
    frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
    if len(frame):
        yield frame


def worker(workers: int) -> Column:
    """The worker that a piece is dealt to."""
    return F.pmod(F.xxhash64("piece"), F.lit(workers)).cast("int")


def _alone(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pieces that are a sequence each, with their places."""
    return pieces.where(F.col("length") * 2 > capacity).withColumns({"sequence_id": F.lit(WHOLE) + F.col("piece"), "offset": F.lit(0).cast("long")})


def place(pieces: DataFrame, capacity: int = CAPACITY, workers: int | None = None) -> DataFrame:
    """``pieces`` (settled, with ``length`` and a unique ``piece``) plus ``sequence_id`` and ``offset``.

    ``pieces`` is read more than once, so places depend on its values alone: pieces are dealt and ordered by their
    key, which repeated and null document ids don't tie.  ``workers`` is the number of parts whose bins are filled apart; at most
    4096, since their counts by class meet in one window per class.
    """
    spark = pieces.sparkSession
    workers = workers or min(4096, max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    classed = pieces.withColumn("_k", F.floor(F.lit(capacity) / F.col("length")).cast("int"))
    shared = classed.where("_k > 1").withColumn("_worker", worker(workers))
    counts = shared.groupBy("_k", "_worker").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_worker").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_k", "_worker", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_k")).alias("_all"))
    # at most workers x classes rows
    own = Window.partitionBy("_k", "_worker").orderBy("piece")
    ranked = shared.withColumn("_rank", F.row_number().over(own) - 1).join(F.broadcast(offsets), ["_k", "_worker"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).withColumn("_bin", F.floor(F.col("_rank") / F.col("_k")).cast("long"))
    in_full = F.col("_bin") < F.floor(F.col("_all") / F.col("_k"))
    inside = Window.partitionBy("_k", "_bin").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.where(in_full).withColumns({
        "offset": F.coalesce(F.sum("length").over(inside), F.lit(0)),
        "sequence_id": F.shiftleft(F.col("_k").cast("long"), CLASS_SHIFT) + F.col("_bin"),
    })
    names = [*pieces.columns, "sequence_id", "offset"]
    rest = ranked.where(~in_full).select(*pieces.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", sequence_id long, offset long"
    fitted = rest.repartition(1).mapInPandas(lambda it: _fit(it, capacity), schema)
    return _alone(pieces, capacity).select(*names).unionByName(full.select(*names)).unionByName(fitted.select(*names))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences from pieces in the order of sequence and offset: the ids of a sequence lie side by side."""
    for table, edges in common.group_blocks(batches, ["sequence_id"]):
        column = {n: table[n].combine_chunks() for n in table.column_names}
        ids = column["ids"]
        _, offsets, data = ids.buffers()
        offsets = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1]
        begin = np.append(0, np.cumsum(column["length"].to_numpy()))
        low, high = int(offsets[0]), int(offsets[-1])
        width = (high - low) // int(begin[-1])
        wide = np.frombuffer(data, np.uint8)[low:high].view(f"<u{width}").astype("<u4")
        blob = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((begin[edges] * ID_BYTES).astype(np.int32)), pa.py_buffer(wide)])
        names = ["doc_id", "start", "length", "doc_tokens", "offset"]
        pieces = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([column[n] for n in names], names))
        yield pa.record_batch([column["sequence_id"].take(pa.array(edges[:-1])), blob, pieces], ["sequence_id", "ids", "pieces"])


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``sequence_id, ids, pieces``: the ids of every sequence (little-endian unsigned 32-bit, at most ``capacity``).

    ``pieces`` says whose they are, by offset: ``doc_id, start, length, doc_tokens, offset``, counted in tokens.
    """
    pieces = tokenize_and_cut(docs, id_col, text_col, path, capacity, end_id)
    pieces = common.settle(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces", compression="zstd")
    alone = _alone(pieces, capacity).drop("piece")
    shared = pieces.where(F.col("length") * 2 <= capacity)
    placed = place(shared.drop("ids"), capacity).join(shared.select("piece", "ids"), "piece").drop("piece")
    placed = placed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return alone.mapInArrow(_joined, SEQUENCES).unionByName(placed.mapInArrow(_joined, SEQUENCES))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of ``sequences``: ``doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset``.

    ``ids_crc32`` is taken from the ids at the piece's place in its sequence.
    """
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"]

    def described(p: Column) -> Column:
        ids = F.col("ids").substr((p.offset * ID_BYTES + 1).cast("int"), (p.length * ID_BYTES).cast("int"))
        return F.struct(p.doc_id.alias("doc_id"), p.start.alias("start"), p.length.alias("length"), p.doc_tokens.alias("doc_tokens"), F.crc32(ids).alias("ids_crc32"), p.offset.alias("offset"))

    packed = sequences(docs, id_col, text_col, path, capacity, end_id)
    each = packed.select("sequence_id", F.transform("pieces", described).alias("pieces")).select("sequence_id", F.inline("pieces"))
    return each.select(*names)
