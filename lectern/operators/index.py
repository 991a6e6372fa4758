"""Lexical and vector indexes as plain tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lectern.functions import hashing as H
from lectern.functions import text as T
from lectern.operators import chunking

ROUTING = ("chunk_id", "ord", "document_type", "level")
#: Chunks whose terms are counted at once.
COUNTED_ROWS = 4096


@dataclass(frozen=True)
class Index:
    """Index tables over one chunk corpus.

    ``postings``: one row per (chunk, term) with tf, chunk length and the filter columns.
    ``terms``: document frequency per term.  ``stats``: one row, chunk count and average length.
    ``vectors``: optional, ``chunk_id, ord, document_type, level`` and ``embedding`` (or sparse ``slots, weights``).
    ``packed``: optional, the postings again, one row per chunk with ``terms`` and ``tfs``; without it a search groups them.
    """

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    vectors: DataFrame | None = None
    embedding_model: str | None = None
    packed: DataFrame | None = None


def packed_postings(chunks: DataFrame) -> DataFrame:
    """``terms`` and their ``tfs`` of every searchable chunk with any token, one row per chunk: nothing is shuffled.

    The tokens of a batch of chunks are numbered once, and equal (chunk, token) pairs are counted together.
    """
    rows = chunking.indexable(chunks).select(*ROUTING, T.tokens(F.coalesce("retrieval_text", "text")).alias("_tokens"))
    kept = [*rows.schema.fields[:-1], StructField("dl", IntegerType())]
    cells = StructType([*kept, StructField("terms", ArrayType(StringType())), StructField("tfs", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_ROWS):
                part = batch.slice(start, COUNTED_ROWS)
                lengths = part.column("_tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                found = part.column("_tokens").flatten().dictionary_encode()
                size = max(1, len(found.dictionary))
                pairs = np.repeat(np.arange(part.num_rows), lengths) * size + found.indices.to_numpy(zero_copy_only=False)
                pairs, counts = np.unique(pairs, return_counts=True)
                held = lengths > 0
                sizes = np.bincount(pairs // size, minlength=part.num_rows)[held]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    *[part.column(name).filter(pa.array(held)) for name in ROUTING],
                    pa.array(lengths[held].astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, found.dictionary.take(pa.array(pairs % size))),
                    pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
                ], names=cells.names)

    return rows.mapInArrow(run, cells)


def unpacked(packed: DataFrame) -> DataFrame:
    """Postings of ``packed_postings``."""
    rows = packed.select(*ROUTING, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("_t"))
    return rows.select(*ROUTING, "dl", F.col("_t.terms").alias("term"), F.col("_t.tfs").cast("bigint").alias("tf"))


def postings(chunks: DataFrame) -> DataFrame:
    """Term frequencies of the searchable chunks."""
    return unpacked(packed_postings(chunks))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of searchable chunks and their average token length."""
    length = T.token_count(F.coalesce("retrieval_text", "text"))
    return chunking.indexable(chunks).agg(
        F.count("*").alias("n"), F.coalesce(F.avg(length), F.lit(0.0)).alias("average_length")
    )


def vocabulary(chunks: DataFrame) -> DataFrame:
    """``(term, df, length)`` in one pass over the chunks; the row without a term has the number of searchable chunks
    and the sum of their token lengths."""
    words = chunking.indexable(chunks).select(T.tokens(F.coalesce("retrieval_text", "text")).alias("_tokens"))
    marked = F.concat(F.array_distinct("_tokens"), F.array(F.lit(None).cast("string")))
    rows = words.select(F.size("_tokens").alias("_n"), F.explode_outer(marked).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("_n"))).alias("length"))


def summary(words: DataFrame) -> DataFrame:
    """``corpus_stats`` of a ``vocabulary``."""
    whole = words.filter("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.sum("length").alias("_length"))
    return whole.select("n", F.coalesce(F.col("_length") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("average_length"))


def lexical(chunks: DataFrame) -> Index:
    packed = packed_postings(chunks)
    return of_packed(chunks, packed, corpus_stats(chunks))


def of_packed(chunks: DataFrame, packed: DataFrame, stats: DataFrame, vectors: DataFrame | None = None, model: str | None = None) -> Index:
    """The index of ``packed_postings``; the other lexical tables follow from them when they are read."""
    entries = unpacked(packed)
    frequencies = entries.groupBy("term").agg(F.count("*").alias("df"))
    return Index(chunks, entries, frequencies, stats, vectors, model, packed)


def hash_vectors(chunks: DataFrame) -> DataFrame:
    """Sparse vectors of the deterministic hash embedding for every searchable chunk with any token."""
    rows = chunking.indexable(chunks).select(*ROUTING, T.tokens(F.coalesce("retrieval_text", "text")).alias("_tokens"))
    return H.hash_counted(rows, "_tokens")


def packed_vectors(packed: DataFrame) -> DataFrame:
    """The same vectors from ``packed_postings``, without reading the texts again."""
    return H.hash_counted(packed.select(*ROUTING, "terms", "tfs"), "terms", "tfs")


def packed_stats(chunks: DataFrame, packed: DataFrame) -> DataFrame:
    """``corpus_stats`` from the lengths in ``packed_postings``; a chunk without tokens counts with length zero."""
    n = chunking.indexable(chunks).agg(F.count("*").alias("n"))
    whole = packed.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("_length"))
    return n.crossJoin(whole).select("n", F.coalesce(F.col("_length") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("average_length"))


def embed(texts: DataFrame, key: str, text: str, embed_fn: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Vectors from a user function, called once per Arrow batch of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embed_fn(batch[text].tolist())
            yield pd.DataFrame({key: batch[key], "embedding": [list(map(float, v)) for v in vectors]})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def fill_cache(
    texts: DataFrame, cache: DataFrame, model: str, embed_fn: Callable[[list[str]], np.ndarray]
) -> tuple[DataFrame, DataFrame]:
    """``(embedded texts, new cache rows)``: every distinct text is embedded once, cached ones never.

    ``texts`` needs a ``text`` column.  A text repeated in a third of the rows is deduplicated on its
    key before anything is embedded; the join back meets one row per key.
    """
    keyed = texts.withColumn("cache_key", H.cache_key(model, F.col("text")))
    known = cache.filter(F.col("model") == model).select("cache_key", "embedding")
    missing = keyed.groupBy("cache_key").agg(F.first("text").alias("text")).join(known, "cache_key", "left_anti")
    fresh = embed(missing, "cache_key", "text", embed_fn).select("cache_key", F.lit(model).alias("model"), "embedding")
    everything = known.unionByName(fresh.select("cache_key", "embedding"))
    return keyed.join(everything, "cache_key"), fresh


def cache_usage(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """One row: cache hits (per text) and misses (per distinct text)."""
    per_key = texts.select(H.cache_key(model, F.col("text")).alias("cache_key")).groupBy("cache_key").agg(
        F.count("*").alias("_n")
    )
    known = cache.filter(F.col("model") == model).select("cache_key", F.lit(True).alias("_known"))
    return per_key.join(known, "cache_key", "left").agg(
        F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).alias("cache_hits"),
        F.count_if(F.col("_known").isNull()).alias("cache_misses"),
    )


def check_model(index: Index, model: str) -> None:
    """Vectors of different models are never compared."""
    if index.embedding_model is not None and index.embedding_model != model:
        raise ValueError(f"index was built with {index.embedding_model!r}, queries use {model!r}")
