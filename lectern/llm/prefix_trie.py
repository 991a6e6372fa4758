"""Prefix trie of rebuilt conversations, with subtree totals by time-forward processing.

Conversations are rebuilt first: up to five turns come from the conversation whose id ends in 00, the rest are
their own.  A node is a distinct sequence of first turns; it is known by its depth and 128 bits, the running
exclusive-or of a hash of every (turn, place).  Turns are numbered and running values taken over ranges of
(conversation, place) with a carry from range to range, so one conversation may hold most of the table.

Totals go from children to parents.  Nodes are sorted by reverse level order; a node takes what its children sent
from a priority queue, adds its own share, and sends its totals forward to the time of its parent.  This runs
within shards.  A shard is a whole subtree of at most ``limit`` turns (``limit`` grows with the square root of the
table, 1024 at least), or, for nodes above those subtrees, the piece of a path that has one smallest member and
at most ``limit`` levels.  Subtrees are final at once and send their totals up; then one queue runs over the roots
of the path pieces, whose number also grows with the square root; with the totals that it delivers, the path
pieces are run again.  The queue keeps a bounded number of messages in memory and writes the others as sorted runs
to an unnamed scratch file that ends with the task.

Cases: a null role or text is empty; turns of equal number (null first) are in the order of the MD5 of role and
text; repeated rows are turns of their own; rows without a conversation id belong to no conversation and are left
out; conversations that are rebuilt without turns end at the root; an empty table gives no rows, not even a root;
other columns are ignored.  The remainder of a negative id has its sign, as in SQL.  The hash of the conversations that end at a node is taken in one stream per node,
from runs of ids that are sorted and joined before.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import common

#: Ids of one group of conversations, and the number of cases of turns shared.
FAMILY = 100
SHARED = 6
#: Turns of a shard at least, messages kept in memory by a queue, ids of a joined run, turns exploded at once.
LEAST_LIMIT = 1024
HELD = 1 << 18
RUN_IDS = 1024
EXPLODED = 1 << 16
NODE = ["depth", "hi", "lo"]
PARENT = ["parent_depth", "parent_hi", "parent_lo"]
TOTALS = ["n_children", "n_leaves", "saved_tokens"]


def _ranges(batches: Iterator[pa.RecordBatch], count: str | None) -> Iterator[pa.RecordBatch]:
    """Adds the range's number, and per conversation the sum of ``count`` before, or the exclusive-or of ``hi`` and ``lo`` up to each row."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    last, carried = None, [0, 0]
    for batch in batches:
        if not len(batch):
            continue
        conv = batch.column("conv_id").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        size = np.diff(np.append(first, len(conv)))
        out = []
        for lane, name in enumerate([count] if count else ["hi", "lo"]):
            values = batch.column(name).to_numpy()
            run = np.cumsum(values) if count else np.bitwise_xor.accumulate(values)
            before = np.concatenate([run[:1] * 0, run[first[1:] - 1]])
            start = carried[lane] if conv[0] == last else 0
            if count:
                before[0] -= start
                run = run - np.repeat(before, size)
                out.append(run - values)
            else:
                before[0] ^= start
                run = run ^ np.repeat(before, size)
                out.append(run)
            carried[lane] = int(run[-1])
        last = conv[-1]
        names = ["before"] if count else ["to_hi", "to_lo"]
        columns = [*batch.columns, pa.array(np.full(len(conv), number, np.int64)), *(pa.array(v) for v in out)]
        yield pa.record_batch(columns, [*batch.schema.names, "range", *names])


def _running(rows: DataFrame, by: list[str], count: str | None, name: str) -> DataFrame:
    """``rows`` with running values of each conversation in the order of ``by``, computed by ranges.

    A range goes on with at most one conversation of the one before, so there are fewer carries than ranges.
    """
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]
    names = ["before"] if count else ["to_hi", "to_lo"]
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by])
    schema = ", ".join([*fields, "range long", *(f"{n} long" for n in names)])
    run = common.settle(ranged.mapInArrow(lambda b: _ranges(b, count), schema), name)
    of_range = run.groupBy("conv_id", "range").agg(*([F.sum(count).alias("n")] if count else [F.bit_xor("hi").alias("n"), F.bit_xor("lo").alias("m")]))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.sum("n")] if count else [F.bit_xor("n"), F.bit_xor("m")]
    carried = of_range.select("conv_id", "range", F.row_number().over(Window.partitionBy("conv_id").orderBy("range")).alias("at"), *[c.over(earlier).alias(f"c{i}") for i, c in enumerate(carry)])
    carried = F.broadcast(carried.where("at > 1").drop("at"))  # at most one row a range
    joined = run.join(carried, ["conv_id", "range"], "left")
    for i, n in enumerate(names):
        add = F.coalesce(f"c{i}", F.lit(0))
        joined = joined.withColumn(n, F.col(n) + add if count else F.col(n).bitwiseXOR(add))
    return joined.drop("range", *[f"c{i}" for i in range(len(names))])


def rebuilt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id, n_turns``) and their rebuilt turns (``conv_id, n_turns, place, sign, n_chars``)."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    signed = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)).alias("sign"), F.length(text_).cast("long").alias("n_chars"),
    )
    counted = signed.groupBy("conv_id", "turn", "sign").agg(F.count("*").alias("times"), F.max("n_chars").alias("n_chars"))
    numbered = common.settle(_running(counted, ["conv_id", "turn", "sign"], "times", "ranges"), "turns")
    blocks = numbered.withColumn("_from", F.explode(F.expr(f"sequence(0L, times - 1, {EXPLODED}L)")))
    inside = F.explode(F.sequence("_from", F.least(F.col("_from") + EXPLODED, F.col("times")) - 1))
    own = blocks.select("conv_id", "sign", "n_chars", "before", inside.alias("_k")).select("conv_id", (F.col("before") + F.col("_k")).alias("place"), "sign", "n_chars")
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < SHARED - 1)).groupBy(F.col("conv_id").alias("head")).agg(
        F.sort_array(F.collect_list(F.struct("place", "sign", "n_chars"))).alias("first")
    )
    convs = numbered.groupBy("conv_id").agg(F.sum("times").alias("n_own")).withColumns({
        "shared": F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED, "head": F.col("conv_id") - F.col("conv_id") % FAMILY,
    })
    first = F.coalesce(F.expr("slice(first, 1, cast(shared AS int))"), F.expr("cast(array() AS array<struct<place: long, sign: string, n_chars: long>>)"))
    plan = convs.join(heads, "head", "left").withColumn("first", first).withColumn("taken", F.size("first").cast("long"))
    plan = common.settle(plan.withColumn("n_turns", F.greatest(F.col("n_own") - F.col("shared"), F.lit(0)) + F.col("taken")), "conversations")
    shared = plan.select("conv_id", "n_turns", F.inline("first"))
    kept = own.join(plan.select("conv_id", "n_turns", "shared", "taken"), "conv_id").where("place >= shared")
    rest = kept.select("conv_id", "n_turns", (F.col("place") - F.col("shared") + F.col("taken")).alias("place"), "sign", "n_chars")
    return plan.select("conv_id", "n_turns"), shared.unionByName(rest)


def _members(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for every node on the path of every conversation."""
    lanes = turns.select(
        "conv_id", "n_turns", "place", "n_chars", F.xxhash64("sign", "place").alias("hi"), F.xxhash64(F.lit(1), "place", "sign").alias("lo")
    )
    run = _running(lanes, ["conv_id", "place"], None, "ranges")
    below = run.select(
        "conv_id", "n_turns", "n_chars", (F.col("place") + 1).alias("depth"), F.col("to_hi").alias("hi"), F.col("to_lo").alias("lo"),
        F.col("to_hi").bitwiseXOR(F.col("hi")).alias("parent_hi"), F.col("to_lo").bitwiseXOR(F.col("lo")).alias("parent_lo"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv_id", "n_turns", zero.alias("n_chars"), zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), none.alias("parent_hi"), none.alias("parent_lo"))
    return common.settle(below.unionByName(root), "members")


def _id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node, sorted, joined with commas in runs of ``RUN_IDS`` at most."""
    from pyspark import TaskContext

    number, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in NODE]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        ids = batch.column("conv_id").to_pylist()
        edges = np.flatnonzero(change).tolist()
        cuts = sorted({x for lo, hi in zip([0, *edges], [*edges, len(ids)], strict=True) for x in range(lo, hi, RUN_IDS)}) if ids else []
        runs = [",".join(map(str, ids[lo:hi])) for lo, hi in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        yield pa.record_batch(
            [*(pa.array(c[cuts]) for c in columns), pa.array([number] * len(cuts), pa.int64()), pa.array(range(at, at + len(cuts)), pa.int64()), pa.array(runs, pa.string())],
            [*NODE, "range", "run", "ids"],
        )
        at += len(cuts)


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's runs; one hash state at a time, however many runs a node has."""
    node, state = None, None

    def done(rows: list) -> pa.RecordBatch:
        return pa.record_batch([*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[1] for r in rows], pa.string())], [*NODE, "ends_sha256"])

    for batch in batches:
        rows = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"]), strict=True):
            if key != node:
                if node:
                    rows.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield done(rows)
    if node:
        yield done([(node, state.hexdigest())])


def _ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node where any does."""
    order = [*NODE, "conv_id"]
    at_end = members.where("depth = n_turns").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    runs = at_end.mapInArrow(_id_runs, "depth long, hi long, lo long, range long, run long, ids string")
    runs = runs.repartition(*NODE).sortWithinPartitions(*NODE, "range", "run")
    return runs.mapInArrow(_id_hashes, "depth long, hi long, lo long, ends_sha256 string")


class SpillingQueue:
    """Messages of whole numbers by key, smallest first; those beyond ``held`` go to sorted runs in a scratch file."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs = held, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            self.heap.sort()
            keep = len(self.heap) // 2
            run = self._run(np.array(self.heap[keep:], np.int64))
            heapq.heappush(self.runs, (next(run), len(self.runs), run))
            del self.heap[keep:]

    @staticmethod
    def _run(rows: np.ndarray, block: int = 4096) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()  # unnamed, private to the task, gone with it
        rows.tofile(file)
        width, left = rows.shape[1], len(rows)
        file.seek(0)

        def read(left: int) -> Iterator[tuple]:
            with file:
                while left:
                    part = np.fromfile(file, np.int64, min(block, left) * width).reshape(-1, width)
                    left -= len(part)
                    yield from map(tuple, part.tolist())

        return read(left)

    def take(self, key: tuple) -> list[int]:
        """Sums of the values sent to ``key``; messages with smaller keys are for nodes that aren't here, and go."""
        n = len(key)
        total = None
        while True:
            from_run = bool(self.runs) and (not self.heap or self.runs[0][0] < self.heap[0])
            head = self.runs[0][0] if from_run else self.heap[0] if self.heap else None
            if head is None or head[:n] > key:
                return total
            if from_run:
                _, i, run = self.runs[0]
                following = next(run, None)
                heapq.heapreplace(self.runs, (following, i, run)) if following else heapq.heappop(self.runs)
            else:
                heapq.heappop(self.heap)
            if head[:n] == key:
                total = list(head[n:]) if total is None else [a + b for a, b in zip(total, head[n:], strict=True)]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Time-forward pass over shards sorted by reverse level; nodes get the totals of what their shard holds below them."""
    queue, shard_now = SpillingQueue(), None
    for batch in batches:
        out = []
        names = ["shard", *NODE, "parent_hi", "parent_lo", "own", "in_children", "in_leaves", "in_saved"]
        for shard, depth, hi, lo, parent_hi, parent_lo, own, children, leaves, saved in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if shard != shard_now:
                queue, shard_now = SpillingQueue(), shard  # what is left was for parents in other shards
            got = queue.take((-depth, hi, lo)) or (0, 0, 0)
            children, leaves, saved = children + got[0], leaves + got[1], saved + got[2] + own
            if not children:
                leaves = 1
            out.append((children, leaves, saved))
            if depth:
                queue.push((1 - depth, parent_hi, parent_lo, 1, leaves, saved))
        totals = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.record_batch([*batch.columns, *(pa.array(t, pa.int64()) for t in totals)], [*batch.schema.names, *TOTALS])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Time-forward pass over shard roots, deepest first: each adds the whole totals of the shards below it."""
    queue = SpillingQueue()
    for batch in batches:
        out = []
        names = ["depth", "shard", "n_leaves", "saved_tokens", "above_depth", "above"]
        for depth, shard, leaves, saved, above_depth, above in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            got = queue.take((-depth, shard)) or (0, 0)
            leaves, saved = leaves + got[0], saved + got[1]
            out.append((leaves, saved))
            if above is not None:
                queue.push((-above_depth, above, leaves, saved))
        totals = list(zip(*out, strict=True)) if out else [(), ()]
        yield pa.record_batch([batch.column(c) for c in PARENT] + [pa.array(t, pa.int64()) for t in totals], [*PARENT, "n_leaves", "saved_tokens"])


def _forward(nodes: DataFrame) -> DataFrame:
    ordered = nodes.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "hi", "lo")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema), *(f"{t} long" for t in TOTALS)])
    return ordered.mapInArrow(_within, schema)


def _sent(rows: DataFrame, children: Column, leaves: Column, saved: Column) -> DataFrame:
    """Messages, added up by the node they go to."""
    return rows.groupBy(*PARENT).agg(F.sum(children).alias("in_children"), F.sum(leaves).alias("in_leaves"), F.sum(saved).alias("in_saved"))


def _received(nodes: DataFrame, *messages: DataFrame) -> DataFrame:
    total = messages[0]
    for m in messages[1:]:
        total = total.unionByName(m)
    total = total.groupBy(*PARENT).agg(*[F.sum(c).alias(c) for c in ("in_children", "in_leaves", "in_saved")])
    total = total.select(*[F.col(p).alias(n) for p, n in zip(PARENT, NODE, strict=True)], "in_children", "in_leaves", "in_saved")
    return nodes.join(total, NODE, "left").fillna(0, ["in_children", "in_leaves", "in_saved"])


def totals(nodes: DataFrame, members: DataFrame, least_limit: int = LEAST_LIMIT) -> DataFrame:
    """``nodes`` with ``n_children, n_leaves, saved_tokens``."""
    turns = nodes.where("depth = 0").select("weight").first()
    limit = max(least_limit, math.isqrt(turns[0]) if turns else 0)
    top = nodes.where(F.col("weight") > limit)
    # the first node of each path that isn't above all subtrees is the root of its subtree shard
    above = members.join(top.select(*NODE), NODE).groupBy("conv_id").agg(F.count("*").alias("depth"))
    cut = members.select("conv_id", *NODE).join(above.withColumnRenamed("depth", "_cut"), "conv_id", "left").where(F.col("depth") == F.coalesce("_cut", F.lit(0)))
    cut = cut.select("conv_id", F.xxhash64(*NODE).alias("shard"), F.col("depth").alias("cut"))
    nothing = {c: F.lit(0).cast("long") for c in ("in_children", "in_leaves", "in_saved")}
    small = common.settle(_forward(nodes.where(F.col("weight") <= limit).join(cut, "conv_id").withColumns(nothing)), "subtrees")
    from_small = _sent(small.where("depth = cut AND depth > 0"), F.lit(1), F.col("n_leaves"), F.col("saved_tokens"))

    path = common.settle(top.withColumn("shard", F.xxhash64(F.lit(-1), "conv_id", F.expr(f"depth div {limit}"))), "paths")
    parents = path.select(*[F.col(n).alias(p) for n, p in zip(NODE, PARENT, strict=True)], F.col("shard").alias("above"))
    heads = path.groupBy("shard").agg(F.min("depth").alias("above_depth")).withColumnRenamed("shard", "above")
    roots = path.join(parents, PARENT, "left").where("above IS NULL OR above <> shard").join(heads, "above", "left")
    roots = common.settle(roots.select(*NODE, *PARENT, "shard", "above", "above_depth"), "roots")
    below = roots.where("above IS NOT NULL")
    known = _sent(below, F.lit(1), F.lit(0), F.lit(0))  # that there is a child; what it brings follows
    local = _forward(_received(path, from_small, known)).select(*NODE, "n_leaves", "saved_tokens")
    ordered = roots.join(local, NODE).repartition(1).sortWithinPartitions(F.desc("depth"), "shard")
    whole = ordered.mapInArrow(_across, "parent_depth long, parent_hi long, parent_lo long, n_leaves long, saved_tokens long").where("parent_depth >= 0")
    from_paths = _sent(whole, F.lit(1), F.col("n_leaves"), F.col("saved_tokens"))
    done = _forward(_received(path, from_small, from_paths))
    return small.drop("cut").unionByName(done)


def trie(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", least_limit: int = LEAST_LIMIT
) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``; ``hi`` and ``lo`` name the node with its depth.

    ``least_limit`` is the size of a shard on small tables.
    """
    members = _members(*rebuilt(turns, conv, turn, role, text))
    grouped = members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n_turns") - F.col("depth") + 1).alias("weight"),
        F.max("n_chars").alias("n_chars"), F.min("parent_hi").alias("parent_hi"), F.min("parent_lo").alias("parent_lo"),
    )
    own = (F.col("n_convs") - 1) * F.col("n_chars")
    nodes = common.settle(grouped.withColumns({"parent_depth": F.col("depth") - 1, "own": own}).drop("n_chars"), "nodes")
    known = totals(nodes, members, least_limit).select(*NODE, *PARENT, "conv_id", "n_convs", *TOTALS)
    parents = nodes.select(*[F.col(n).alias(p) for n, p in zip(NODE, PARENT, strict=True)], F.col("conv_id").alias("parent_conv_id"))
    joined = known.join(parents, PARENT, "left").join(_ends(members), NODE, "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *TOTALS, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "hi", "lo"
    )
