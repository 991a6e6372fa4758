from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import components, embeddings, minhash, suffix_dedup
from tests.llm.conftest import ODD, frame, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> set:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def smallest(n, links):
    root = {i: i for i in n}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in n}


def brute_near(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    links = []
    for i, s in sets.items():
        shared = collections.Counter(j for g in s for j in where[g] if j < i)
        links += [(i, j) for j, n in shared.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
    low = smallest(sets, links)
    return {i: (len(sets[i]), low[i], low[i] == i) for i in sets}


def near_copies(n=120, words=80):
    draw = random.Random(3)
    base = [f"w{draw.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(draw.randrange(6)):
            copy[draw.randrange(words)] = f"v{draw.randrange(9999)}"
        out.append(" ".join(copy))
    return out


def check_near(df):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_near(texts_of(df))


def test_near_duplicates_on_the_table(documents):
    check_near(documents)


def test_near_duplicates_odd_cases(spark, odd, none):
    check_near(frame(spark, [*ODD, *ODD, "e d", *near_copies()]))
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.near_duplicates(odd.union(odd)).count() == len(ODD)
    no_id = odd.withColumn("doc_id", F.lit(None).cast("long"))
    assert minhash.near_duplicates(no_id).count() == 0 and minhash.deduplicate(no_id).count() == len(ODD)


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "KEY_BLOCK", 16)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 1500)
    check_near(frame(spark, near_copies()))


def test_deduplicate_keeps_first_rows(spark):
    df = frame(spark, near_copies(40))
    rows = minhash.deduplicate(df).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, v in brute_near(texts_of(df)).items() if v[2])
    assert minhash.deduplicate(df).columns == df.columns


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    got = {r.member: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest({x for p in links for x in p}, links)
    assert got == {i: c for i, c in want.items() if c != i}


def brute_vectors(rows):
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[i] = label, x / np.sqrt(x @ x)
    links = [(a, b) for a in ok for b in ok if a != b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= 0.98]
    low = smallest([r[0] for r in rows], links)
    n = collections.Counter(a for a, _ in links)
    return {i: (n[i], low[i], low[i] == i) for i, _, _ in rows}


@pytest.mark.parametrize("block", [4, 1024])
def test_vectors(spark, block):
    draw = np.random.default_rng(0)
    rows, centers = [], draw.normal(size=(30, 16))
    for i in range(300):
        x = centers[i % 30] + draw.normal(size=16) * 0.12
        rows.append((i, [float(np.float32(a)) for a in x], i % 3 if i % 50 else None))
    rows += [(1000 + i, rows[7 + i % 2][1], rows[7 + i % 2][2]) for i in range(9)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] + [1.0] * 15, 1), (2005, [float("inf")] * 16, 1), (2006, [1.0] * 4, 1), (2007, [2.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, block=block).collect()}
    assert got == brute_vectors(rows)
    assert embeddings.near_duplicates(df.union(df), block=block).count() == len(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def brute_repeats(texts):
    first: dict[bytes, int] = {}
    data = {i: (texts[i] or "").encode() for i in sorted(texts)}
    for i, b in data.items():
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p + 1 : p + 51] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
        out[i] = len(b), [tuple(e) for e in edge.tolist()], bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
    return out


def check_repeats(df):
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.repeats(df).collect()}
    assert got == brute_repeats(texts_of(df))


def passages(n=150):
    draw = random.Random(2)
    line = "x common line that many documents share with all others "
    junk = ["".join(draw.choice("abc ") for _ in range(draw.randint(0, 300))) for _ in range(n)]
    out = [j[:50] + line + draw.choice(["", "z" * draw.randint(40, 400)]) + draw.choice(junk)[:120] + j[50:] for j in junk]
    return [*out, "b" * 50, "b" * 50, "a" * 49, "a" * 49, "é" * 60 + "b" * 77, "é" * 60, *ODD]


def test_repeats_on_the_table(documents):
    check_repeats(documents)


def test_repeated_passages(spark, none):
    check_repeats(frame(spark, passages()).repartition(4))
    assert suffix_dedup.repeats(none).count() == 0


def test_small_batches_and_hot_grams(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    df = frame(spark, passages())
    docs = df.select("doc_id", "text").toArrow()
    # the settings hold on the driver alone, so the tasks' functions are called here
    run_locally(docs)


def run_locally(table):
    import pyarrow as pa

    batches = [dict(zip(("ids", "offsets", "size", "text"), (c[0].as_py() for c in b.columns), strict=True)) for b in suffix_dedup._batches(iter(table.to_batches(max_chunksize=9)))]
    stored = [pa.RecordBatch.from_pylist([b | {"batch": i}]) for i, b in enumerate(batches)]
    assert len(stored) > 3

    def owned(rows, keys):
        rows = pa.Table.from_batches(list(rows))
        return rows.sort_by([(k, "ascending") for k in [*keys, "batch"]]).to_batches() if len(rows) else []

    def answered(answers):
        by = collections.defaultdict(list)
        for a in answers:
            by[a.column("batch")[0].as_py()] += a.to_pylist()
        return [pa.RecordBatch.from_pylist([b | {"batch": i, "answers": by[i]}]) for i, b in enumerate(batches)]

    matched = list(suffix_dedup._matched(iter(owned(suffix_dedup._suffixes(iter(stored), 5), ["bucket"]))))
    compared = list(suffix_dedup._compared(iter(owned(suffix_dedup._contested(iter(answered(matched)), 5), ["bucket", "kind"]))))
    assert any(a.column("kind")[0].as_py() == 2 for a in compared)
    got = {}
    for rows in suffix_dedup._finished(iter(answered([*matched, *compared]))):
        for r in rows.to_pylist():
            got[r["doc_id"]] = r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], r["kept"]
    assert got == brute_repeats(dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)))


def test_levels_merge_geometrically():
    levels = suffix_dedup.Levels()
    for i in range(37):
        n = np.arange(10, dtype=np.uint64)
        levels.add(n, n * np.uint64(i % 3), np.full(10, i))
    sizes = [len(x[0]) for x in levels.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    gram, code, doc = levels.one()
    assert len(gram) == 28 and doc.max() == 2


def test_an_id_with_two_texts_is_two_documents(spark):
    copy, own = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight nine ten"
    rows = [(1, copy), (1, own), (2, copy), (3, copy + " theta"), (3, own), (3, own), (4, None), (4, ""), (None, copy), (None, copy)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _component", "'x' AS n_shingles")
    kept = sorted(((r.doc_id, r.text) for r in minhash.deduplicate(df).select("doc_id", "text").collect()), key=str)
    assert kept == sorted([(1, copy), (1, own), (4, None), (4, ""), (None, copy), (None, copy)], key=str)
