"""Canonical hashes and the deterministic hash embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from lectern.functions import text as T

# Fixed values of the deterministic embedding.
HASH_DIMENSIONS = 384
HASH_MODEL = "local-hash-baseline"
#: Texts whose slots are summed at once.
HASH_ROWS = 2048


def json_string(value: Column | str) -> Column:
    """A string as a JSON literal, quotes included."""
    wrapped = F.to_json(F.struct(T._col(value).alias("v")), {"ignoreNullFields": "false"})
    return F.rtrim(F.substring(wrapped, 6, 2_000_000_000), F.lit("}"))


def stable_hash(fields: dict[str, Column], length: int = 16) -> Column:
    """SHA-256 of the compact JSON object with sorted keys, cut to ``length`` hex characters."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    document = F.to_json(ordered, {"ignoreNullFields": "false"})
    return F.substring(F.sha2(document, 256), 1, length)


def content_hash(text: Column | str) -> Column:
    """Hash of the lower-cased, whitespace-collapsed text: equal for copies that differ in layout."""
    flat = T.collapse(F.lower(T._col(text)))
    return F.substring(F.sha2(json_string(flat), 256), 1, 24)


def cache_key(model: str, text: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\x00"), T._col(text)), 256)


#: Codes that a task keeps by token.
KNOWN_CODES = 1_000_000


def _code(token: str, dimensions: int) -> int:
    """Twice the slot of a token plus its sign bit."""
    value = int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big")
    return value % dimensions * 2 + value % 2


def _cells(
    tokens: pa.ListArray, times: np.ndarray | None, dimensions: int, known: dict[str, int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, slot, weight)`` of the non-zero slots, by row: every token adds ``times`` (one) to its slot or takes it away."""
    found = tokens.flatten().dictionary_encode()
    if len(known) > KNOWN_CODES:
        known.clear()
    names = found.dictionary.to_pylist()
    for name in names:
        if name not in known:
            known[name] = _code(name, dimensions)
    codes = np.array([known[name] for name in names], np.int64)[found.indices.to_numpy(zero_copy_only=False)]
    rows = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    signed = codes % 2 * 2.0 - 1.0
    sums = np.bincount(rows * dimensions + codes // 2, weights=signed if times is None else signed * times, minlength=len(tokens) * dimensions)
    at = np.flatnonzero(sums)
    return at // dimensions, at % dimensions, sums[at]


def hash_counted(df: DataFrame, tokens: str, times: str | None = None, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """``df`` with ``slots array<int>, weights array<double>`` in place of its ``tokens`` (and of how many ``times`` each
    stands there): sparse unit vectors, one row per row of ``df`` with at least one non-zero slot; nothing is shuffled,
    and a task hashes a token that it sees again only once."""
    keys = [c for c in df.columns if c not in (tokens, times)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, HASH_ROWS):
                part = batch.slice(start, HASH_ROWS)
                n = part.column(times).flatten().to_numpy(zero_copy_only=False) if times else None
                rows, slots, weights = _cells(part.column(tokens), n, dimensions, known)
                sizes = np.bincount(rows, minlength=part.num_rows)
                norms = np.sqrt(np.bincount(rows, weights=weights * weights, minlength=part.num_rows))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[sizes > 0])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    *[part.column(name).filter(pa.array(sizes > 0)) for name in keys],
                    pa.ListArray.from_arrays(offsets, pa.array(slots.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(weights / norms[rows])),
                ], names=[*keys, "slots", "weights"])

    cells = StructType([
        *[df.schema[name] for name in keys], StructField("slots", ArrayType(IntegerType())), StructField("weights", ArrayType(DoubleType()))])
    return df.mapInArrow(run, cells)


def hash_embedding(df: DataFrame, key: str, text: str, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """Sparse unit vectors ``(key, slots, weights)`` of the rows of ``df`` whose text has a non-zero slot."""
    return hash_counted(df.select(key, T.tokens(text).alias("_tokens")), "_tokens", None, dimensions)


def dense_embedding(sparse: DataFrame, key: str, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """The same vectors as ``array<double>`` of fixed length."""
    cells = F.map_from_arrays("slots", "weights")
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda i: F.coalesce(F.try_element_at(cells, i), F.lit(0.0)),
    )
    return sparse.select(key, dense.alias("embedding"))
