"""Near-duplicate documents by min-max hashing.

Every hash function gives two signature values of a document, the least and the greatest hash of its
shingles, so ``HASHES`` evaluations make ``2 * HASHES`` values; each agrees for two documents with the
probability of their Jaccard similarity.  Bands of ``ROWS`` values are hashed to keys.

* Documents with equal shingle sets (128-bit sums of hashes, and sizes) are one class with one representative.
* Documents of a key are compared by one byte of each signature value, and only those that agree in
  ``LEAST_AGREEING`` values and may be similar enough by size are joined, to their group's first document: no pairs are
  emitted.  Components of these candidate links are families; all similar documents of one key are in one family.
* The full shingle sets of a family meet once, and components over exact similarity come out of them.

Large keys and families are cut into blocks that meet two by two, so a task holds at most two blocks.
``recall(similarity)`` is the chance that a pair shares a key: 0.999995 at 0.75.

Cases: documents without words or text have an empty set and link with nothing; documents of fewer than five
words have one shingle, the whole sequence; rows without an id are left out; rows that repeat an id (and text)
are one document; an empty table gives no rows; other columns are ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.components import components

SHINGLE = 5
#: Linked if 100 * intersection >= 75 * union.
PERCENT = 75
HASHES = 64
ROWS = 4
#: Of 128 values; documents at 0.75 agree in 96 on average, with a standard deviation of 4.9.
LEAST_AGREEING = 68
#: Documents of a key, and shingles of a family, in one block.
KEY_BLOCK = 4096
FAMILY_BLOCK = 1_500_000
SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, signature binary"


def recall(similarity: float) -> float:
    return 1 - (1 - similarity**ROWS) ** (2 * HASHES // ROWS)


_draw = np.random.default_rng(11)
_FACTOR = _draw.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _draw.integers(0, 2**63, 2 * HASHES // ROWS, np.uint64)


def shingle_sets(t: common.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each document, sorted, and where each document's begin."""
    w = common.words(t)
    h = common.hash_words(t.data, w)
    whole = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        whole = whole * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(whole)]
    whole = common.mix(whole)
    sets = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            sets.append(np.unique(whole[a : b - SHINGLE + 1]))
        elif b > a:
            value = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                value = value * np.uint64(0x9E3779B97F4A7C15) + x
            sets.append(common.mix(common.mix(value)))
        else:
            sets.append(np.zeros(0, np.uint64))
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(size)])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = 2 * HASHES // ROWS
    for batch, t in common.chunks(batches, size=2 << 20):
        values, first = shingle_sets(t)
        some = np.flatnonzero(np.diff(first) > 0)
        begin = first[some]
        signature = np.zeros((len(t), 2 * HASHES), np.uint64)
        h1, h2 = np.zeros(len(t), np.uint64), np.zeros(len(t), np.uint64)
        if len(some):
            for i, factor in enumerate(_FACTOR):
                hashed = values * factor
                signature[some, 2 * i] = np.minimum.reduceat(hashed, begin)
                signature[some, 2 * i + 1] = np.maximum.reduceat(hashed, begin)
            h1[some] = np.add.reduceat(values, begin)
            h2[some] = np.add.reduceat(common.mix(values), begin)
        keys = np.repeat(_BAND[None, :], len(t), axis=0)
        for r in range(ROWS):
            keys = common.mix(keys + signature[:, r::ROWS])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
        low = common.mix(signature).astype(np.uint8).tobytes()
        blob = pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer((np.arange(len(t) + 1) * 2 * HASHES).astype(np.int32)), pa.py_buffer(low)])
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists, blob], ["doc_id", "n_shingles", "h1", "h2", "keys", "signature"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (document, first document of its group) between likely similar documents of a key."""
    for table, edges in common.group_blocks(batches, ["key", "cell"]):
        ids = table["doc_id"].to_numpy()
        size = table["n_shingles"].to_numpy()
        signature = np.frombuffer(table["signature"].combine_chunks().buffers()[2], np.uint8)
        skip = table["signature"].combine_chunks().offset * 2 * HASHES
        signature = signature[skip : skip + len(table) * 2 * HASHES].reshape(-1, 2 * HASHES)
        left, right = [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            mine, n = signature[lo:hi], size[lo:hi]

            def near(i: int, rest: np.ndarray, mine=mine, n=n) -> np.ndarray:
                fits = (np.minimum(n[i], n[rest]) * 100 >= PERCENT * np.maximum(n[i], n[rest]))
                fits[fits] = np.count_nonzero(mine[rest[fits]] == mine[i], axis=1) >= LEAST_AGREEING
                return fits

            root = common.reached(near, hi - lo)
            moved = np.flatnonzero(root != np.arange(hi - lo))
            left.append(ids[lo + moved])
            right.append(ids[lo + root[moved]])
        if left:
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, t in common.chunks(batches):
        values, first = shingle_sets(t)
        blob = pa.Array.from_buffers(pa.large_binary(), len(t), [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(values)])
        yield pa.record_batch([batch.column("family"), batch.column("blocks"), batch.column("doc_id"), blob.cast(pa.binary())], ["family", "blocks", "doc_id", "shingles"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (document, first document of its component) by exact similarity inside a family's cell."""
    for table, edges in common.group_blocks(batches, ["family", "cell"]):
        ids = table["doc_id"].to_numpy()
        column = table["shingles"].combine_chunks().cast(pa.large_binary())
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            part = column.slice(lo, hi - lo)
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + hi - lo + 1] // 8
            flat = np.frombuffer(part.buffers()[2], np.uint64)[offsets[0] : offsets[-1]]
            first = offsets - offsets[0]
            number = np.unique(flat, return_inverse=True)[1]
            size = np.diff(first)
            marked = np.zeros(int(number.max()) + 1, bool)

            def near(i: int, rest: np.ndarray, number=number, first=first, size=size, marked=marked) -> np.ndarray:
                fits = np.minimum(size[i], size[rest]) * 100 >= PERCENT * np.maximum(size[i], size[rest])
                some = rest[fits]
                if len(some):
                    own = number[first[i] : first[i + 1]]
                    marked[own] = True
                    n = size[some]
                    begin = np.cumsum(n) - n
                    at = np.repeat(first[some] - begin, n) + np.arange(int(n.sum()))
                    common_n = np.add.reduceat(marked[number[at]].astype(np.int64), begin)
                    marked[own] = False
                    fits[fits] = common_n * 100 >= PERCENT * (size[i] + n - common_n)
                return fits

            root = common.reached(near, hi - lo)
            moved = np.flatnonzero(root != np.arange(hi - lo))
            if len(moved):
                yield pa.record_batch([pa.array(ids[lo + moved]), pa.array(ids[lo + root[moved]])], ["a", "b"])


def in_cells(rows: DataFrame, key: str, blocks: str = "blocks") -> DataFrame:
    """Rows of each key once for every cell (pair of the key's ``blocks`` blocks) that their block is in."""
    own = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    rows = rows.withColumn("_own", own).withColumn("_other", other)
    return rows.withColumn("cell", F.least("_own", "_other") * F.col(blocks) + F.greatest("_own", "_other")).drop("_own", "_other", blocks)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    keyed = common.keyed_texts(docs, id_col, text_col).where("doc_id is not null")
    sketch = common.settle(keyed.mapInArrow(_sketches, SKETCH), "sketches")
    light = sketch.select("doc_id", "n_shingles", "h1", "h2").dropDuplicates(["doc_id"])
    print_ = ["h1", "h2", "n_shingles"]
    classes = light.where("n_shingles > 0").groupBy(*print_).agg(F.min("doc_id").alias("rep"))
    firsts = classes.select(F.col("rep").alias("doc_id"))
    firsts = common.settle(sketch.select("doc_id", "n_shingles", "keys", "signature").join(firsts, "doc_id").dropDuplicates(["doc_id"]), "firsts")

    keys = firsts.select("doc_id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keys.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / F.lit(KEY_BLOCK)).cast("long")).drop("n")
    members = members.join(firsts.select("doc_id", "n_shingles", "signature"), "doc_id")
    cells = in_cells(members, "key").repartition("key", "cell").sortWithinPartitions("key", "cell", "n_shingles", "doc_id")
    links = components(cells.mapInArrow(_candidates, "a long, b long"), name="candidates")

    families = links.select(F.col("member").alias("doc_id"), F.col("component").alias("family"))
    families = families.unionByName(links.select(F.col("component").alias("doc_id"), F.col("component").alias("family")).distinct())
    families = families.join(firsts.select("doc_id", "n_shingles"), "doc_id")
    sizes = families.groupBy("family").agg(F.ceil(F.sum("n_shingles") / F.lit(FAMILY_BLOCK)).cast("long").alias("blocks"))
    families = common.settle(families.drop("n_shingles").join(sizes, "family"), "families")
    sets = keyed.join(families, "doc_id").mapInArrow(_sets, "family long, blocks long, doc_id long, shingles binary")
    cells = in_cells(sets, "family").repartition("family", "cell").sortWithinPartitions("family", "cell", "doc_id")
    linked = components(cells.mapInArrow(_exact, "a long, b long"), name="linked")

    of_rep = linked.select(F.col("member").alias("rep"), "component")
    joined = light.join(classes, print_, "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(of_rep, "rep", "left")
    component = F.coalesce("component", "rep")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component: the one with the smallest id, of equal ids the smallest hash.

    A document is an id with a text, known by a 64-bit hash of both: rows that share an id but no text with anything
    stay, a repeated row stays once.  Rows without an id stay.
    """
    keyed = docs.where(F.col(id_col).isNotNull()).withColumn("_row", F.xxhash64(F.col(id_col), F.col(text_col)))
    found = near_duplicates(keyed, "_row", text_col).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_component"))
    first = keyed.select(F.col(id_col).alias("_id"), "_row").join(found, "_row").groupBy("_component").agg(F.min(F.struct("_id", "_row")).alias("_f"))
    kept = keyed.join(first.select("_f._row"), "_row", "left_semi").dropDuplicates([id_col, "_row"]).drop("_row")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
