"""Near-duplicate vectors by product quantisation.

A bounded sample of unit vectors gives coarse centroids and, for the residuals, one codebook per subspace.
Every vector is put into the inverted list of its nearest centroid and coded; as a query it visits the lists
that can hold a vector within the radius: a vector x that lies nearer to centroid c than to c' is at least
(d(q,c)^2 - d(q,c')^2) / (2 |c - c'|) away from q, so a list is left out only where this exceeds the radius.
In a list, asymmetric distances (a table of the query's distances to all codewords, added up over a vector's
codes) pick candidates; each vector's own quantisation error is added to the radius, so a candidate is never
lost to it.  Candidates are checked by exact cosine in double precision.  Recall is 1 but for rounding.

Equal vectors of a label are one class, compared once and counted with its size.  Lists are cut into blocks
of ``BLOCK`` members and queries that meet pairwise, so a task holds two blocks; a block gives one row per
vector, never its pairs.

Cases: vectors that are null, empty or zero, or hold null or non-finite components, and vectors without a
label, link with nothing; vectors of different lengths don't link; rows without an id are left out; rows that
repeat an id are one vector, that which sorts first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.components import components

COSINE = 0.98
#: Vectors that the index is fitted on, at most; every vector is indexed.
SAMPLE = 20_000
SUBSPACES = 8
CODEWORDS = 64
BLOCK = 1024
_SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centers = x[draw.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centers)
        n = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1), 0)


def nearest(x: np.ndarray, centers: np.ndarray, block: int = 8192) -> np.ndarray:
    return np.concatenate([squared(x[i : i + block], centers).argmin(1) for i in range(0, len(x), block)] or [np.zeros(0, np.int64)])


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float):
        self.radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        self.cosine = cosine
        lists = int(np.clip(np.sqrt(rows) / 4, 1, 4096))
        width = sample.shape[1]
        self.coarse = kmeans(sample, lists, 1)
        residual = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.linspace(0, width, min(SUBSPACES, max(1, width)) + 1).astype(int)
        self.books = [kmeans(residual[:, a:b], CODEWORDS, 2 + a) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.between = np.sqrt(squared(self.coarse, self.coarse))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error of unit vectors."""
        lists = nearest(x, self.coarse)
        residual = x - self.coarse[lists]
        codes = np.stack([nearest(residual[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], axis=1)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return lists, codes.astype(np.uint8), np.sqrt(((residual - back) ** 2).sum(1))

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Lists that may hold a vector within the radius, for each vector."""
        d = squared(x, self.coarse)
        best = d.argmin(1)
        apart = np.where(self.between[best] > 0, self.between[best], 1)
        return (d - d.min(1)[:, None]) / (2 * apart) <= self.radius + _SLACK

    def candidates(self, q: np.ndarray, center: np.ndarray, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Which members of a list may be within the radius of each query, by asymmetric distance."""
        residual = q - center
        total = np.zeros((len(q), len(codes)))
        for m, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            total += squared(residual[:, a:b], book)[:, codes[:, m]]
        return np.sqrt(total) <= self.radius + error + _SLACK


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column as unit rows in double precision, padded with zeros."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


def _indexed(batches: Iterator[pa.RecordBatch], index: Index, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 4096):
            part = batch.slice(lo, 4096)
            x = _matrix(part.column("v"), width)
            lists, codes, error = index.encode(x)
            query, probe = np.nonzero(index.probes(x))
            probes = pa.ListArray.from_arrays(pa.array(np.searchsorted(query, np.arange(len(x) + 1)), pa.int32()), pa.array(probe.astype(np.int32)))
            yield pa.record_batch([
                part.column("label"), part.column("rep"), part.column("n"), part.column("v"), pa.array(lists.astype(np.int32)),
                pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), probes,
            ], ["label", "rep", "n", "v", "list", "codes", "error", "probes"])


INDEXED = "label string, rep long, n long, v array<double>, list int, codes binary, error double, probes array<int>"


def _links(batches: Iterator[pa.RecordBatch], index: Index, width: int) -> Iterator[pa.RecordBatch]:
    """For each cell of a list: number of links of its queries, and the local component of everything linked."""
    for table, edges in common.group_blocks(batches, ["label_key", "list", "cell"]):
        x = _matrix(table["v"].combine_chunks(), width)
        ids, n, label = table["rep"].to_numpy(), table["n"].to_numpy(), table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        size = table["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        member, lists, error = table["is_member"].to_numpy(), table["list"].to_numpy(), table["error"].to_numpy(zero_copy_only=False)
        codes = np.array([np.frombuffer(c, np.uint8) for c in table["codes"].to_pylist()])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rows = np.arange(lo, hi)
            queries, members = rows[~member[lo:hi]], rows[member[lo:hi]]
            if not len(queries) or not len(members):
                continue
            count = np.zeros(len(queries), np.int64)
            left, right = [], []
            for a in range(0, len(queries), 256):
                q = queries[a : a + 256]
                i, j = np.nonzero(index.candidates(x[q], index.coarse[lists[lo]], codes[members], error[members]))
                same = (label[q[i]] == label[members[j]]) & (size[q[i]] == size[members[j]]) & (ids[q[i]] != ids[members[j]])
                i, j = i[same], j[same]
                exact = np.einsum("ij,ij->i", x[q[i]], x[members[j]]) >= index.cosine
                i, j = i[exact], j[exact]
                count[a : a + 256] = np.bincount(i, weights=n[members[j]], minlength=len(q)).astype(np.int64)
                left.append(ids[q[i]])
                right.append(ids[members[j]])
            u, v = np.concatenate(left), np.concatenate(right)
            if not len(u):
                continue
            names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = _spread(flat[: len(u)], flat[len(u) :], len(names))
            links = np.zeros(len(names), np.int64)
            some = count > 0
            links[np.searchsorted(names, ids[queries[some]])] = count[some]
            yield pa.record_batch([pa.array(names), pa.array(links), pa.array(names[root])], ["rep", "links", "root"])


def _spread(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of each component of a few thousand nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    one = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda c: c != 0)
    one = common.settle(one.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    classes = one.where("usable").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = common.settle(classes, "classes")
    total, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return one.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    fitted = classes.select("v", "rep").orderBy(F.xxhash64("rep"), "rep").limit(sample).toArrow()  # at most ``sample`` rows
    index = Index(_matrix(fitted["v"].combine_chunks(), width), total, cosine)

    coded = common.settle(classes.mapInArrow(lambda b: _indexed(b, index, width), INDEXED), "indexed")
    members = coded.drop("probes").withColumn("is_member", F.lit(True))
    queries = coded.withColumn("list", F.explode("probes")).drop("probes").withColumn("is_member", F.lit(False))
    counts = members.groupBy("label", "list").agg(F.count("*").alias("m")).join(queries.groupBy("label", "list").agg(F.count("*").alias("q")), ["label", "list"])
    parts = counts.select("label", "list", F.ceil(F.col("m") / F.lit(block)).alias("mb"), F.ceil(F.col("q") / F.lit(block)).alias("qb"))
    both = members.unionByName(queries).join(parts, ["label", "list"])
    turn = F.xxhash64("rep")
    own = F.when(F.col("is_member"), F.pmod(turn, F.col("mb"))).otherwise(F.pmod(turn, F.col("qb")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("is_member"), F.col("qb")).otherwise(F.col("mb")) - 1))
    both = both.withColumn("_own", own).withColumn("_other", others).withColumn("cell", F.when(F.col("is_member"), F.col("_own") * F.col("qb") + F.col("_other")).otherwise(F.col("_other") * F.col("qb") + F.col("_own")))
    both = both.withColumn("label_key", F.xxhash64("label")).drop("_own", "_other", "mb", "qb")
    cells = both.repartition("label_key", "list", "cell").sortWithinPartitions("label_key", "list", "cell")
    found = common.settle(cells.mapInArrow(lambda b: _links(b, index, width), "rep long, links long, root long"), "links")
    comps = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), name="vector_links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = classes.join(links, "rep", "left").join(comps.withColumnRenamed("member", "rep"), "rep", "left")
    per_class = per_class.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = one.where("usable").join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(one.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
