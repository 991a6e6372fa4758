from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from lectern.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows: list[tuple]) -> list[tuple]:
    """The trie node by node."""
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((n is not None, n or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(paths[c]) == len(node))
        out.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), leaves[node], saved[node],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS hi", "2 AS n_turns", "'s' AS shard")
    return sorted((tuple(r) for r in prefix_trie.trie(df, **options).drop("hi", "lo").collect()), key=str)


def generated(seed: int, families: int = 4) -> list[tuple]:
    """Few texts, so that many prefixes are shared; missing heads, ties, nulls, copies, one long conversation and a hot first turn."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(families * 100), families * 12) + [-205, -200]:
        shared = rng.random() < 0.4
        for n in range(rng.randint(1, 9)):
            turn = None if rng.random() < 0.05 else n // 2 if rng.random() < 0.2 else n
            rows.append((c, turn, rng.choice(["user", None, "assistant"]), "hello" if shared and n < 3 else rng.choice(["a", "bé", "", None, "😀 c"])))
    rows += [(7, n, "user", f"turn {n % 3}") for n in range(90)] + [(8, n, "user", f"turn {n % 3}") for n in range(60)]
    rows += [(c, n, "user", "same") for c in range(1000, 1040) for n in range(2)] + [(1050, 3, "user", "same")] * 7
    return rows + [(None, 0, "user", "no conversation"), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "limit"), [(1, 1024), (2, 20), (3, 3)])
def test_against_brute_force(spark, seed, limit):
    """Small limits make path pieces of few levels, many subtree shards and a deep tree of shard roots."""
    rows = generated(seed)
    assert run(spark, rows, least_limit=limit) == brute(rows)


def test_registered_query(spark, sf):
    got = sorted((tuple(r) for r in queries.op11_prefix_trie(spark, sf).collect()), key=str)
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_no_rows_and_turnless(spark):
    assert run(spark, []) == []
    # 101 shares five turns of a head that isn't there, and has fewer of its own
    few = [(c, 0, None, None) for c in range(1, 60)]
    assert run(spark, few) == brute(few)
    assert any(r[1] == 0 and r[3] == 59 for r in run(spark, few))


def test_queue_spills():
    rng = random.Random(5)
    queue = prefix_trie.SpillingQueue(held=10)
    sent = [(rng.randrange(40), rng.randrange(3), rng.randrange(100)) for _ in range(20_000)]
    for m in sent:
        queue.push(m)
    assert len(queue.runs) > 100
    for key in sorted({m[:2] for m in sent} | {(41, 0)}):
        if key[0] == 7:
            continue  # nobody takes these
        assert queue.take(key) == ([sum(m[2] for m in sent if m[:2] == key)] if key[0] < 41 else None)


def test_runs_of_ids(monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_IDS", 3)
    rows = [(0, 0, 0, i) for i in range(10)] + [(1, 5, 5, 4)] + [(2, -1, 0, i) for i in range(3)]

    class Context:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: Context))
    batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + 4], strict=True)], [*prefix_trie.NODE, "conv_id"]) for lo in range(0, len(rows), 4)]
    hashes = [tuple(r.values()) for b in prefix_trie._id_hashes(prefix_trie._id_runs(iter(batches))) for r in b.to_pylist()]
    want = {k: ",".join(str(r[3]) for r in rows if r[:3] == k) for k in dict.fromkeys(r[:3] for r in rows)}
    assert hashes == [(*k, hashlib.sha256(v.encode()).hexdigest()) for k, v in want.items()]


def test_running_values_over_batches_and_ranges(monkeypatch):
    class Context:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: Context))
    conv, times = [1, 1, 1, 1, 2, 2, 3], [2, 1, 5, 1, 1, 1, 9]
    batches = [pa.record_batch([pa.array(conv[lo : lo + 3]), pa.array(times[lo : lo + 3])], ["conv_id", "times"]) for lo in (0, 3, 6)]
    got = [x for b in prefix_trie._ranges(iter(batches), "times") for x in b.column("before").to_pylist()]
    assert got == [0, 2, 3, 8, 0, 1, 0]
