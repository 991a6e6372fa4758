from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import common, packing, token_counts
from tests.llm.conftest import ODD, frame, texts_of

HARD = [
    "aaaa aaa aaaaaaa don't I'LL", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|> a<|endoftext|>", "İstanbul ΣΑΣ é ½ ١٢ 中文字　x y",
    "​z\x1cw\x85v", "123 a1b2!!??", "ﬁ Ω ﻿hi 😀👍🏽", "a" * 300, "!" * 77 + "ab" * 50, "été ö",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(common.tokenizer_path(token_counts.VOCABULARY))


def test_counts_are_the_library_s(spark, documents, library):
    for df in (frame(spark, [*ODD, *HARD]), documents):
        texts = texts_of(df)
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df).collect()}
        for i, t in texts.items():
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert got[i] == (len((t or "").encode()), n, n > 2048), t


def test_repeated_rows_and_empty_tables(odd, none):
    assert token_counts.token_counts(odd.union(odd)).count() == 2 * len(ODD)
    assert token_counts.token_counts(none).count() == 0
    assert packing.pack(none).count() == 0


def test_cuts():
    for n in (1, 31, 32, 33, 900, 1100, 2047, 2048, 2049, 50_000):
        pieces = packing.cuts(n)
        assert sum(pieces) == n and max(pieces) <= 2048 and min(pieces) >= 1


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_packing_round_trip(spark, odd, documents, library, which):
    df = odd.union(odd.withColumn("doc_id", odd.doc_id + 100)) if which == "odd" else documents
    rows = packing.pack(df).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in texts_of(df).items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    room = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        room += at if at & (at - 1) == 0 else 2048
    assert room - total <= 0.01 * total + 2048


def test_small_capacity(spark):
    df = frame(spark, ["a b c d e f g h i j k"] * 7)
    rows = packing.pack(df, capacity=8).collect()
    assert sum(r.length for r in rows) == 7 * 12 and max(r.offset + r.length for r in rows) <= 8


def test_sequences_hold_the_ids(spark, odd, documents, library):
    # repeated and missing ids: pieces are told apart all the same
    twice = odd.unionByName(odd.limit(5)).unionByName(odd.selectExpr("CAST(NULL AS long) AS doc_id", *odd.columns[1:]))
    for df in (twice, documents):
        docs, total = [], 0
        for r in packing.sequences(df).collect():
            ids, at = np.frombuffer(r.ids, "<u4").tolist(), 0
            for p in r.pieces:
                assert p.offset == at
                docs.append((p.doc_id, p.doc_tokens, p.start, ids[at : at + p.length]))
                at += p.length
            assert at == len(ids) <= packing.CAPACITY
            total += at
        want = {}
        for r in df.select("doc_id", "text").collect():
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
            for start, n in zip(np.cumsum([0, *packing.cuts(len(ids))]), packing.cuts(len(ids)), strict=False):
                key = (r.doc_id, len(ids), int(start), tuple(ids[start : start + n]))
                want[key] = want.get(key, 0) + 1
        got = {}
        for d, n, start, ids in docs:
            got[d, n, start, tuple(ids)] = got.get((d, n, start, tuple(ids)), 0) + 1
        assert got == want and total == sum(len(k[3]) * n for k, n in want.items())


def test_tied_pieces_have_one_place(spark):
    # ids missing or all the same, in two orders of arrival
    for doc_id in ("CAST(NULL AS long)", "5L"):
        pieces = spark.range(3000).selectExpr("id AS piece", f"{doc_id} AS doc_id", "0L AS start", "CAST(id % 3 * 300 + 100 AS long) AS length", "900L AS doc_tokens")
        one, other = (sorted((r.piece, r.sequence_id, r.offset) for r in packing.place(p, workers=8).collect()) for p in (pieces, pieces.orderBy("length", F.desc("piece"))))
        assert one == other and len({p for p, *_ in one}) == len(one) == 3000
        assert len({o[1:] for o in one}) == 3000
    workers = pieces.select(packing.worker(8).alias("w")).groupBy("w").count().collect()
    assert len(workers) == 8 and max(r["count"] for r in workers) < 600
