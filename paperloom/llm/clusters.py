"""Clusters of mutually similar vectors by grid density clustering.

Directions are quantised on a few rotated grids: the features of a paper are its coordinates along
the axes of a rotation, and its cell is named by the axes, with their signs, along which it is longest.
A paper near a border counts in the cells on both sides of it: with one axis to a cell it is in the
cells of its two longest ones. So each vector is copied a constant number of times, which does not
depend on the number of rows but in two steps (see ``grid_shape``). Papers of a cell are told apart
into sub-cells around a leader, the smallest key with a cosine of at least the threshold, and counted
in SQL; a sub-cell with at least two papers is dense. Dense cells that share a paper are adjacent; the
smallest key is propagated over adjacent cells until nothing changes. Clusters are described by their
size and the papers of their densest cells.

Vectors travel as 8-bit integers with their rounding error; a link is believed where the error cannot
undo it, and otherwise checked on the full vectors. Two papers of the very threshold share a cell of
one of the grids with the probability 1 - ``miss``, whatever the number of rows; a paper needs one link
only, so a cluster of n papers is missed far more seldom than a pair. ``miss`` is a parameter: the
smaller it is, the more grids there are, and no bucket has a cap.

A hot cell is read as a stream that keeps its leaders only, and is split by a salt where it exceeds a
bounded number of rows; the leaders of its parts are then compared with each other.

Defined results: papers without a vector, with a null, zero or non-finite one, or of another length
than most, are in no cluster; exact duplicate rows count once; of several vectors for one paper the
smallest holds; clusters smaller than ``min_size`` are not reported; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.runtime import checkpoint, small_enough

THRESHOLD, MIN_SIZE = 0.80, 3
PART = 500_000  # rows of a cell that one task reads
MISS = 0.03  # pairs at the threshold that share no cell of any grid
DOUBTFUL = 200_000  # links that may be given to every worker for the check on full vectors


def papers(embeddings: DataFrame) -> DataFrame:
    """(collection, citation_key, vec): one finite, non-zero vector per paper."""
    vec = F.col("vec").cast("array<float>")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return (
        embeddings.filter(F.col("vec").isNotNull() & F.col("citation_key").isNotNull())
        .select("collection", "citation_key", vec.alias("vec"))
        .filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
        .filter((norm > 0) & (norm < float("inf")))
        .groupBy("collection", "citation_key").agg(F.min("vec").alias("vec"))
    )


def longest_axes(turned: np.ndarray, named: int, of: int) -> np.ndarray:
    """Cells of each row: all choices of ``named`` among the ``of`` axes along which it is longest, with signs."""
    at = np.argpartition(-np.abs(turned), of - 1, axis=1)[:, :of]
    signed = 2 * at.astype(np.int64) + (np.take_along_axis(turned, at, 1) > 0)
    base = 2 * turned.shape[1]
    out = []
    for chosen in combinations(range(of), named):
        code = np.zeros(len(turned), np.int64)
        for column in np.sort(signed[:, list(chosen)], axis=1).T:
            code = code * base + column
        out.append(code)
    return np.stack(out, axis=1)


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """(count, dim, dim): random orthogonal matrices."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)]).astype(np.float32)


def meeting_chance(dim: int, cosine: float, named: int, of: int, tries: int = 4000) -> float:
    """Share of pairs of random directions with that cosine that share a cell of one grid."""
    if dim < 2:
        return 1.0
    rng = np.random.default_rng(11)
    a, b = rng.standard_normal((2, tries, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = cosine * a + math.sqrt(1 - cosine * cosine) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = longest_axes(a, named, of), longest_axes(b, named, of)
    return float((x[:, :, None] == y[:, None, :]).any((1, 2)).mean())


def grid_shape(rows: int, dim: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int, int]:
    """(axes that name a cell, axes that they are chosen from, grids).

    One of two axes up to a million rows, two of four up to a hundred million, three of six beyond: cells
    stay within some ten thousand rows, and a vector is copied 8, 24 and 80 times at 64 dimensions."""
    named = min(1 if rows <= 10**6 else 2 if rows <= 10**8 else 3, dim)
    of = min(2 * named, dim)
    p = meeting_chance(dim, threshold, named, of)
    return named, of, 1 if p >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-p)))


def cells(rows: DataFrame, dim: int, shape: tuple[int, int, int], salts: int, seed: int = 5) -> DataFrame:
    """(cell, collection, citation_key, q, err, salt): each paper once per cell, with its 8-bit unit vector and the length of its rounding error."""
    named, of, grids = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotations(dim, grids, seed)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = np.asarray(b.column(2).flatten(), np.float64).reshape(n, dim)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            q = np.clip(np.rint(v * 127 / np.abs(v).max(axis=1, keepdims=True)), -127, 127).astype(np.int8)
            back = q / np.linalg.norm(q.astype(np.float64), axis=1, keepdims=True)
            err = np.linalg.norm(back - v, axis=1) + 1e-6
            v = v.astype(np.float32)
            code = np.concatenate([longest_axes(v @ t, named, of) + (g << 48) for g, t in enumerate(turn)], axis=1)
            index = pa.array(np.repeat(np.arange(n), code.shape[1]))
            packed = pa.array([x.tobytes() for x in q], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(code.reshape(-1)), *(c.take(index) for c in (b.column(0), b.column(1), packed, pa.array(err.astype(np.float32))))],
                names=["cell", "collection", "citation_key", "q", "err"],
            )

    spread = rows.select("collection", "citation_key", "vec").mapInArrow(run, "cell bigint, collection string, citation_key string, q binary, err float")
    return spread.withColumn("salt", F.pmod(F.xxhash64("citation_key"), F.lit(salts)).cast("int"))


class Leaders:
    """Sub-cells of the cell being read: leaders so far, with the bounds of their rounding errors."""

    def __init__(self, dim: int, threshold: float):
        self.threshold = threshold
        self.keys: list[str] = []
        self.matrix = np.zeros((16, dim), np.float32)
        self.err = np.zeros(16, np.float32)

    def _near(self, block: np.ndarray, err: np.ndarray, others: np.ndarray, other_err: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the others each row of a block is surely near to, and which it may be."""
        off = block @ others.T - self.threshold
        slack = err[:, None] + other_err[None, :]
        return off >= slack, np.abs(off) < slack

    def _lead(self, keys: list[str], vectors: np.ndarray, errs: np.ndarray) -> None:
        have = len(self.keys)
        while have + len(keys) > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.err = np.concatenate([self.err, np.zeros_like(self.err)])
        self.matrix[have : have + len(keys)], self.err[have : have + len(keys)] = vectors, errs
        self.keys += keys

    def add(self, keys: list[str], vectors: np.ndarray, errs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leader's number, sure) for all leaders that a row follows or may follow; rows come in the order of their keys."""
        out = []
        for start in range(0, len(keys), 512):
            block, err = vectors[start : start + 512], errs[start : start + 512]
            have = len(self.keys)
            covered = np.zeros(len(block), bool)
            if have:
                sure, maybe = self._near(block, err, self.matrix[:have], self.err[:have])
                covered = sure.any(axis=1)
                for kind, hits in ((True, sure), (False, maybe)):
                    i, k = np.nonzero(hits)
                    out.append((i + start, k, np.full(len(i), kind)))
            # leaders made in this block come after those before it
            left = np.flatnonzero(~covered)
            if not len(left):
                continue
            sure, maybe = self._near(block, err, block[left], err[left])
            made = []
            for j, i in enumerate(left):
                if covered[i]:
                    continue
                k = have + len(made)
                made.append(int(i))
                sure[i, j] = True
                for kind, hits in ((True, sure[i:, j]), (False, maybe[i + 1 :, j])):
                    at = np.flatnonzero(hits) + i + (not kind)
                    if len(at):
                        out.append((at + start, np.full(len(at), k), np.full(len(at), kind)))
                covered[i:] |= sure[i:, j]
            self._lead([keys[start + i] for i in made], block[made], err[made])
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def sub_cells(spread: DataFrame, group: list[str], dim: int, threshold: float) -> DataFrame:
    """(group..., citation_key, leader, sure, q, err): the leaders of each paper in its cell, and of leaders the vector; cells are read as sorted streams."""
    parted = spread.repartition(*group).sortWithinPartitions(*group, "citation_key").select(*group, "citation_key", "q", "err")
    n = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(n).to_pylist()
            v = np.frombuffer(b"".join(b.column(n + 1).to_pylist()), np.int8).reshape(b.num_rows, dim).astype(np.float32)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            errs = b.column(n + 2).to_numpy()
            marks = list(zip(*(b.column(i).to_pylist() for i in range(n)), strict=True))
            at, leaders, sure, start = [], [], [], 0
            for i in range(1, len(marks) + 1):
                if i == len(marks) or marks[i] != marks[start]:
                    if marks[start] != now:
                        now, lead = marks[start], Leaders(dim, threshold)
                    row, leader, kind = lead.add(keys[start:i], v[start:i], errs[start:i])
                    at.append(row + start)
                    sure.append(kind)
                    leaders += [lead.keys[k] for k in leader.tolist()]
                    start = i
            index, sure = pa.array(np.concatenate(at)), np.concatenate(sure)
            heads = pa.compute.not_equal(b.column(n).take(index), pa.array(leaders, pa.string()))
            q, err = b.column(n + 1).take(index), b.column(n + 2).take(index)
            q, err = (pa.compute.if_else(heads, pa.scalar(None, c.type), c) for c in (q, err))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(index) for i in range(n + 1)), pa.array(leaders, pa.string()), pa.array(sure), q, err], names=[*group, "citation_key", "leader", "sure", "q", "err"])

    kinds = dict(parted.dtypes)
    return parted.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in group) + ", citation_key string, leader string, sure boolean, q binary, err float")


def dense_cells(rows: DataFrame, dim: int, n_rows: int, threshold: float = THRESHOLD, part: int = PART, miss: float = MISS) -> DataFrame:
    """(collection, a, b, cell_size, sure): papers a of dense sub-cells with the leader b that names the cell, itself
    among them, and the papers counted in the cells that they share."""
    salts = max(1, math.ceil(n_rows / part))
    found = sub_cells(cells(rows, dim, grid_shape(n_rows, dim, threshold, miss), salts), ["collection", "cell", "salt"], dim, threshold)
    if salts > 1:
        found = checkpoint(found)
        heads = found.filter(F.col("q").isNotNull()).select("collection", "cell", "citation_key", "q", "err")
        between = sub_cells(heads, ["collection", "cell"], dim, threshold).filter("citation_key <> leader")
        found = found.unionByName(between.withColumn("salt", F.lit(-1)))
    own = Window.partitionBy("collection", "cell", "salt", "leader")
    counted = found.select("collection", "cell", "salt", "citation_key", "leader", "sure").withColumn("size", F.count(F.lit(1)).over(own) + F.when(F.col("salt") < 0, 1).otherwise(0))
    return counted.filter("size >= 2").groupBy("collection", F.col("citation_key").alias("a"), F.col("leader").alias("b")).agg(F.sum("size").alias("cell_size"), F.max("sure").alias("sure"))


def checked(found: DataFrame, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The links of which rounding leaves no doubt, and those whose full vectors have the cosine."""
    doubtful = found.filter("not sure")
    if small_enough(doubtful, DOUBTFUL):
        doubtful = F.broadcast(doubtful)
    unit = rows.select("collection", "citation_key", "vec", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm"))
    a = unit.withColumnsRenamed({"citation_key": "a", "vec": "va", "norm": "na"})
    b = unit.withColumnsRenamed({"citation_key": "b", "vec": "vb", "norm": "nb"})
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    near = a.join(doubtful, ["collection", "a"]).join(b, ["collection", "b"]).filter(dot / (F.col("na") * F.col("nb")) >= threshold)
    fields = ["collection", "a", "b", "cell_size"]
    return found.filter("sure").select(*fields).unionByName(near.select(*fields))


def propagate(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(collection, citation_key, label): the smallest key of each connected set, by minimum labels with shortcuts."""
    both = checkpoint(edges.select("collection", "a", "b").union(edges.select("collection", "b", "a")).distinct())
    labels = checkpoint(both.groupBy("collection", "a").agg(F.min("b").alias("m")).select("collection", "a", F.least("a", "m").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select("collection", F.col("a").alias("b"), F.col("label").alias("other")), ["collection", "b"]).groupBy("collection", "a").agg(F.min("other").alias("m"))
        step = labels.join(near, ["collection", "a"]).select("collection", "a", "label", F.least("label", "m").alias("new"))
        jump = step.join(step.select("collection", F.col("a").alias("new"), F.col("new").alias("root")), ["collection", "new"], "left")
        after = checkpoint(jump.select("collection", "a", F.least("new", F.coalesce("root", "new")).alias("new"), "label"))
        changed = after.filter("new <> label").limit(1).count()
        labels = after.select("collection", "a", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("a", "citation_key")
    raise RuntimeError("labels have not converged")


def members(embeddings: DataFrame, threshold: float = THRESHOLD, min_size: int = MIN_SIZE, miss: float = MISS, part: int = PART) -> DataFrame:
    """(collection, citation_key, cluster_key, size, density) of the papers in clusters of at least ``min_size``."""
    rows = checkpoint(papers(embeddings))
    shapes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    n, most = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max(F.struct("n", (-F.col("dim")).alias("d")))).collect()[0]
    dim = -most["d"] if most else 1
    rows = rows.filter(F.size("vec") == dim)
    found = checkpoint(dense_cells(rows, dim, n, threshold, part, miss))
    links = checkpoint(checked(found, rows, threshold))
    labels = propagate(links.filter("a <> b"))
    dense = links.groupBy("collection", F.col("a").alias("citation_key")).agg(F.sum("cell_size").alias("density"))
    sizes = labels.groupBy("collection", F.col("label").alias("cluster_key")).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    return (
        labels.withColumnRenamed("label", "cluster_key").join(sizes, ["collection", "cluster_key"])
        .join(dense, ["collection", "citation_key"], "left")
        .select("collection", "citation_key", "cluster_key", "size", F.coalesce("density", F.lit(0)).alias("density"))
    )


def described(found: DataFrame, typical: int = 5) -> DataFrame:
    """(collection, cluster_key, size, typical): each cluster with the papers of its densest cells.

    The top papers are kept by a bounded aggregate, not by collecting the cluster."""
    ranked = F.struct((-F.col("density")).alias("d"), F.col("citation_key").alias("k"))
    parts = found.withColumn("part", F.pmod(F.xxhash64("citation_key"), F.lit(32))).groupBy("collection", "cluster_key", "size", "part").agg(F.slice(F.array_sort(F.collect_list(ranked)), 1, typical).alias("t"))
    top = parts.groupBy("collection", "cluster_key", "size").agg(F.slice(F.array_sort(F.flatten(F.collect_list("t"))), 1, typical).alias("t"))
    return top.select("collection", "cluster_key", "size", F.transform("t", lambda x: x["k"]).alias("typical"))
