from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import alignment, common
from tests.llm.conftest import ODD, frame, texts_of

HARD = [
    *ODD, "  lead", "tail  ", "\n\nx\n y", "a\r\nb \r c", "x  y　 z \nw", "literal ▁ mark", "it's  I'LL 1234567 §§§",
    "<|endoftext|> <s> <0x0A>", "\t\ttab \x00 nul\x1c x", "日本語のテキストは空白がない。" * 30, "ไทยไม่มีช่องว่าง", "é combining ́x", "a" * 5000 + "b" * 700, " ", "\n", "​ ﻿ x",
]


def brute(texts: list[str | None]) -> list[tuple]:
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(common.tokenizer_path(alignment.VOCABULARY_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(alignment.VOCABULARY_B))
    # byte-level characters by the vocabulary's own single-byte pre-tokens
    tokens = alignment.Pair._byte_level(a)
    all_groups, links = [], []
    for text in texts:
        found = []
        if text:
            full = (" " + text).encode()
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [tokens[i] for i in ia]
            bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ib, b.id_to_piece(ib), strict=True)]
            if b"".join(ba) == full == b"".join(bb):
                ends_a, ends_b = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
                x = y = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    to_x, to_y = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
                    found.append((ia[x:to_x], ib[y:to_y]))
                    x, y = to_x, to_y
        all_groups.append(found)
        links.append(Counter((i, j) for x, y in found for i in x for j in y))
    count = Counter(p for doc in links for p in doc)
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for found, linked in zip(all_groups, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
        out.append((
            sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), sum(linked.values()),
            sum(m for (i, j), m in linked.items() if count[i, j] == most[i]), sum(m * count[p] for p, m in linked.items()),
            hashlib.sha256(text.encode()).hexdigest() if found else "",
        ))
    return out


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_hard_texts_against_brute_force(spark, monkeypatch, small):
    if small:  # several blocks, pieces and reduced groups
        for name, value in (("BLOCK_BYTES", 300), ("CHUNK_BYTES", 100), ("PIECE", 3), ("LISTED", 1)):
            monkeypatch.setattr(alignment, name, value)
        docs = [(i, t) for i, t in enumerate(HARD)]
        assert_blocks(docs)
    got = rows_of(alignment.alignment(frame(spark, HARD)))
    assert got == sorted(((i, *r) for i, r in enumerate(brute(HARD))), key=str)


def assert_blocks(docs) -> None:
    """The functions of a task with small blocks, in this process (workers don't see the patched sizes)."""
    import pyarrow as pa

    class Context:
        partitionId = staticmethod(lambda: 3)

    import pyspark

    before = pyspark.TaskContext.get
    pyspark.TaskContext.get = staticmethod(lambda: Context)
    try:
        batch = pa.record_batch([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs], pa.string())], ["doc_id", "text"])
        paths = [common.tokenizer_path(v) for v in (alignment.VOCABULARY_A, alignment.VOCABULARY_B)]
        blocks = [b.to_pylist()[0] for b in alignment._blocks(iter([batch]), *paths)]
        rows = list(alignment._blocks(iter([batch]), *paths))
    finally:
        pyspark.TaskContext.get = before
    assert len(blocks) > 3 and len({b["block"] for b in blocks}) == len(blocks)
    count, best = Counter(), Counter()
    for b in blocks:
        count.update(dict(zip(b["pairs"], b["holders"], strict=True)))
    for p, n in count.items():
        best[p // 32000] = max(best[p // 32000], n)
    out = []
    for b, row in zip(blocks, rows, strict=True):
        answers = pa.table({"pair": pa.array(b["pairs"][::-1], pa.int64()), "count": pa.array([count[p] * (1 if count[p] == best[p // 32000] else -1) for p in b["pairs"][::-1]], pa.int64())})
        out += [tuple(r.values()) for r in alignment._scored(pa.Table.from_batches([row]), answers).to_pylist()]
    assert out == [(i, *r) for i, r in enumerate(brute([t for _, t in docs]))]


def test_whole_table_against_brute_force(spark, documents):
    texts = texts_of(documents)
    got = rows_of(alignment.alignment(documents))
    assert got == sorted(((i, *r) for i, r in zip(texts, brute(list(texts.values())), strict=True)), key=str)


def test_repeated_rows_missing_ids_and_no_rows(spark, none):
    assert alignment.alignment(none).collect() == []
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (7, "one two"), (7, None)], "doc_id long, text string")
    got = rows_of(alignment.alignment(df))
    assert [r[1:] for r in got] == [r[1:] for r in sorted(zip([None, None, 7, 7], *zip(*brute(["one two"] * 3 + [None]), strict=True), strict=True), key=str)]


def test_groups_spell_the_text(spark, documents):
    groups = alignment.aligned_groups(documents.limit(40)).collect()
    tokens = alignment.pair(*[common.tokenizer_path(v) for v in (alignment.VOCABULARY_A, alignment.VOCABULARY_B)])
    texts = texts_of(documents)
    at = defaultdict(int)
    for g in groups:
        spelled = (" " + texts[g.doc_id]).encode()[g.start : g.end]
        assert g.start == at[g.doc_id] and spelled == b"".join(tokens.bytes_a[i] for i in g.a_ids) == b"".join(tokens.bytes_b[i] for i in g.b_ids)
        at[g.doc_id] = g.end
    assert all(at[d] == len(texts[d].encode()) + 1 for d in at)


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_merge_path_pieces(step):
    rng = np.random.default_rng(step)
    for _ in range(50):
        end = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, end + 1, int(rng.integers(0, 40))), end)) for _ in range(2))
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        from_a, from_b = alignment.diagonals(a, b, step)
        for d, x, y in zip([*range(0, len(merged), step), len(merged)], from_a, from_b, strict=True):
            assert x == sum(1 for _, s in merged[:d] if s == 0) and x + y == d
        cut_a, cut_b = alignment.groups(a, b, step)
        shared = np.intersect1d(a, b)
        assert (a[cut_a[1:] - 1] == shared).all() and (b[cut_b[1:] - 1] == shared).all()
