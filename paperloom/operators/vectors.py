"""Vectors: cosine search, statistics, outliers and checks (VE5-VE19, VE22, JN17-JN19, PL4, PL10-PL15)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096  # queries that travel to every partition at a time


def doubles(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """VE5: zero vectors are at 0 from all."""
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n == 0, 1.0).otherwise(n)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int = 10) -> DataFrame:
    """VE6, JN18: the k nearest of all rows for each of a stated set of queries.

    Queries travel in blocks of a fixed size; each partition keeps its best k per query, so that what
    is shuffled is bounded by queries times partitions. Equal cosines are ordered by key."""
    kind = dict(vectors.dtypes)[key]
    keys_as = pa.int64() if kind == "bigint" else pa.string()
    out = None
    for keys, matrix in query_blocks(queries, key, vec):
        size = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(size == 0, 1, size)

        def run(batches: Iterator[pa.RecordBatch], keys=np.array(keys), matrix=matrix) -> Iterator[pa.RecordBatch]:
            asked, found, cosines = np.zeros(0, np.int64), keys[:0], np.zeros(0)
            floor = np.full(len(keys), -np.inf)
            for b in batches:
                if not b.num_rows:
                    continue
                ids = np.array(b.column(0).to_pylist())
                sims = np.round(matrix @ unit_rows(b.column(1)).T, 9)
                sims[keys[:, None] == ids[None, :]] = -np.inf
                if len(ids) > k:
                    floor = np.maximum(floor, np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k])
                i, j = np.nonzero((sims >= floor[:, None]) & (sims > -np.inf))
                asked, found, cosines = np.concatenate([asked, i]), np.concatenate([found, ids[j]]), np.concatenate([cosines, sims[i, j]])
                order = np.lexsort((found, -cosines, asked))
                asked, found, cosines = asked[order], found[order], cosines[order]
                # the place of each row among those of its query
                place = np.arange(len(asked)) - np.searchsorted(asked, asked)
                asked, found, cosines, place = asked[place < k], found[place < k], cosines[place < k], place[place < k]
                floor[asked[place == k - 1]] = cosines[place == k - 1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[asked], keys_as), pa.array(found, keys_as), pa.array(cosines, pa.float64())], names=["query", "neighbour", "cosine"])

        part = vectors.select(key, vec).mapInArrow(run, f"query {kind}, neighbour {kind}, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query {kind}, neighbour {kind}, cosine double, rank int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("cosine").desc(), "neighbour"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one batch at length 1; zero vectors stay."""
    v = np.array(column.to_pylist(), np.float64)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def query_blocks(queries: DataFrame, key: str, vec: str) -> Iterator[tuple[list, np.ndarray]]:
    """(keys, vectors) of a stated set of queries, in blocks of a fixed size."""
    rows = []
    for r in queries.select(key, vec).toLocalIterator():
        rows.append(r)
        if len(rows) == BLOCK:
            yield [x[0] for x in rows], np.array([x[1] for x in rows], np.float64)
            rows = []
    if rows:
        yield [x[0] for x in rows], np.array([x[1] for x in rows], np.float64)


def links(vectors: DataFrame, queries: DataFrame, key: str, vec: str, threshold: float = 0.7) -> DataFrame:
    """JN17, JN19: all rows at or above the threshold for each of a stated set of queries, however many.

    Equal vectors are compared once and named by their members at the end; nothing else is left out."""
    kind = dict(vectors.dtypes)[key]
    rows = vectors.select(key, vec, F.xxhash64(F.to_json(F.struct(vec))).alias("_class"))
    first = rows.groupBy("_class").agg(F.min_by(vec, key).alias(vec))
    asked = queries.select(key, vec, F.xxhash64(F.to_json(F.struct(vec))).alias("_class"))
    out = None
    for keys, matrix in query_blocks(asked.groupBy("_class").agg(F.min_by(vec, key).alias(vec)), "_class", vec):
        size = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(size == 0, 1, size)

        def run(batches: Iterator[pa.RecordBatch], keys=np.array(keys), matrix=matrix) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    ids = np.array(b.column(0).to_pylist())
                    sims = np.round(matrix @ unit_rows(b.column(1)).T, 9)
                    i, j = np.nonzero(sims >= threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(sims[i, j], pa.float64())], names=["_q", "_class", "cosine"])

        part = first.select("_class", vec).mapInArrow(run, "_q bigint, _class bigint, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query {kind}, neighbour {kind}, cosine double")
    named = out.join(asked.select(F.col("_class").alias("_q"), F.col(key).alias("query")), "_q").join(rows.select("_class", F.col(key).alias("neighbour")), "_class")
    return named.filter("query <> neighbour").select("query", "neighbour", "cosine")


def edges(near: DataFrame, threshold: float = 0.7) -> DataFrame:
    """JN19: links of the stated queries at or above the threshold."""
    return near.filter(F.col("cosine") >= threshold).select("query", "neighbour", "cosine")


def similarity_checks(pairs: DataFrame, a: str = "a", b: str = "b", value: str = "cosine") -> DataFrame:
    """VE16: of a long similarity table: values out of range, off the diagonal's 1 (0 for zero vectors) and unlike their mirror."""
    mirror = pairs.select(F.col(a).alias(b), F.col(b).alias(a), F.col(value).alias("_m"))
    both = pairs.join(mirror, [a, b], "left")
    off = F.col(a) != F.col(b)
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col(value) < -1.000001) | (F.col(value) > 1.000001)).alias("out_of_range"), F.count_if(~off & (F.abs(F.col(value) - 1) > 1e-6) & (F.abs(F.col(value)) > 1e-6)).alias("bad_diagonal"),
        F.count_if(F.col("_m").isNull() | (F.abs(F.col(value) - F.col("_m")) > 1e-6)).alias("asymmetric"), F.round(F.avg(F.when(off, F.col(value))), 6).alias("mean_off_diagonal"),
    )


def matrix_checks(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """VE16 of the similarities of all rows with all rows, made and checked in blocks and never kept.

    Vectors of another dimension than most, or with nulls, are counted as damaged and are in no pair; the
    mean is that of finite values."""
    usual = vectors.filter(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    good = F.coalesce((F.size(vec) == (usual[0][0] if usual else 0)) & ~F.exists(vec, lambda x: x.isNull()), F.lit(False))
    names = ["n", "not_finite", "out_of_range", "bad_diagonal", "asymmetric", "n_off", "off"]
    schema = ", ".join(f"{c} {'double' if c == 'off' else 'bigint'}" for c in names)
    out = vectors.sparkSession.createDataFrame([], schema)
    rows = vectors.filter(good).select(F.monotonically_increasing_id().alias("_i"), key, vec)
    for keys, block in query_blocks(rows, key, vec):
        size = np.linalg.norm(block, axis=1, keepdims=True)
        unit = block / np.where(size == 0, 1, size)

        def run(batches: Iterator[pa.RecordBatch], keys=np.array(keys), unit=unit) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                own, v = np.array(b.column(0).to_pylist()), unit_rows(b.column(1))
                sims, mirror = unit @ v.T, (v @ unit.T).T
                same, finite = keys[:, None] == own[None, :], np.isfinite(sims)
                aim = np.where((np.abs(v).max(1) == 0)[None, :], 0.0, 1.0)
                got = [sims.size, (~finite).sum(), (~(np.abs(sims) <= 1.000001)).sum(), (same & ~(np.abs(sims - aim) <= 1e-6)).sum(), (~(np.abs(sims - mirror) <= 1e-6)).sum(), (finite & ~same).sum()]
                yield pa.RecordBatch.from_arrays([*(pa.array([int(x)], pa.int64()) for x in got), pa.array([float(sims[finite & ~same].sum())], pa.float64())], names=names)

        out = out.unionByName(rows.select(key, vec).mapInArrow(run, schema))
    total = out.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return total.join(vectors.agg(F.count_if(~good).alias("damaged")), F.lit(True)).select(*names[:5], "damaged", F.round(F.col("off") / F.nullif("n_off", F.lit(0)), 6).alias("mean_off_diagonal"))


def norm_statistics(vectors: DataFrame, vec: str) -> DataFrame:
    """VE8: number, dimension and norms of the vectors; the deviation is of the population."""
    n = vectors.select(F.size(vec).alias("dim"), norm(F.col(vec)).alias("norm"))
    r = lambda c: F.round(c, 6)
    return n.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim"), r(F.avg("norm")).alias("mean"), r(F.stddev_pop("norm")).alias("std"), r(F.min("norm")).alias("least"), r(F.max("norm")).alias("most"), r(F.percentile("norm", F.lit(0.5))).alias("median"))


def dimension_statistics(vectors: DataFrame, vec: str) -> DataFrame:
    """VE8: mean, deviation and bounds of each dimension."""
    return vectors.select(F.posexplode(doubles(F.col(vec))).alias("dim", "x")).groupBy("dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most"))


def quality(vectors: DataFrame, key: str, vec: str, skipped: Column | None = None) -> DataFrame:
    """VE14, VE15, VE18: zero vectors, unusual numbers, uneven dimensions, and whether all is well."""
    skip = skipped if skipped is not None else F.lit(False)
    bad = lambda t: F.aggregate(doubles(F.col(vec)), F.lit(0), lambda s, x: s + t(x).cast("int"))
    got = vectors.filter(F.col(vec).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((norm(F.col(vec)) < 1e-10) & skip).alias("skipped_zero"), F.count_if((norm(F.col(vec)) < 1e-10) & ~skip).alias("failed_zero"),
        F.coalesce(F.sum(bad(lambda x: F.isnan(x))), F.lit(0)).alias("n_nan"), F.coalesce(F.sum(bad(lambda x: F.abs(x) == float("inf"))), F.lit(0)).alias("n_inf"),
        F.min(F.size(vec)).alias("least_dim"), F.max(F.size(vec)).alias("most_dim"),
    )
    return got.withColumn("valid", (F.col("failed_zero") == 0) & (F.col("n_nan") == 0) & (F.col("n_inf") == 0) & (F.col("least_dim") == F.col("most_dim")))


def flat_dimensions(vectors: DataFrame, vec: str, least: float = 1e-6) -> DataFrame:
    """VE14: dimensions that hardly vary."""
    return vectors.select(F.posexplode(doubles(F.col(vec))).alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("variance")).filter(F.col("variance") < least).select("dim")


def outliers(vectors: DataFrame, key: str, vec: str, method: str = "zscore") -> DataFrame:
    """VE17, VE12: vectors of unusual norm by z-score over 2.5 or by 1.5 times the quartile range; none of fewer than three."""
    n = vectors.select(key, norm(F.col(vec)).alias("norm"))
    stats = n.agg(F.count(F.lit(1)).alias("n"), F.avg("norm").alias("m"), F.stddev_pop("norm").alias("s"), F.percentile("norm", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    all_ = n.join(F.broadcast(stats), F.lit(True)).filter(F.col("n") >= 3)
    width = F.col("q")[1] - F.col("q")[0]
    odd = (F.col("s") > 0) & (F.abs(F.col("norm") - F.col("m")) / F.col("s") > 2.5) if method == "zscore" else (F.col("norm") < F.col("q")[0] - 1.5 * width) | (F.col("norm") > F.col("q")[1] + 1.5 * width)
    return all_.filter(odd).select(key, F.round("norm", 6).alias("norm"))


def query_checks(vectors: DataFrame, queries: DataFrame, key: str, vec: str, slack: float = 1e-9) -> DataFrame:
    """VE16: the similarities of a stated set of queries with all rows: values out of range (NaN among them), rows whose own
    similarity is not 1 (0 for zero vectors), values unlike their mirror, and the mean off the diagonal."""
    names = ["n", "out_of_range", "bad_diagonal", "asymmetric", "off_sum", "off_n"]
    out = None
    for at, (keys, matrix) in enumerate(query_blocks(queries, key, vec)):
        size = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(size == 0, 1, size)

        def run(batches: Iterator[pa.RecordBatch], keys=np.array(keys), matrix=matrix, first=at == 0) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = unit_rows(b.column(1))
                    here, mirror = matrix @ v.T, v @ matrix.T
                    other = keys[:, None] != np.array(b.column(0).to_pylist())[None, :]
                    own = (v * v).sum(axis=1)
                    bad = int((~(np.abs(own - 1) <= slack) & (own != 0)).sum()) if first else 0
                    row = [here.size, int((~(np.abs(here) <= 1 + slack)).sum()), bad, int((np.abs(here - mirror.T) > slack).sum()), float(here[other].sum()), int(other.sum())]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)

        part = vectors.select(key, vec).mapInArrow(run, "n bigint, out_of_range bigint, bad_diagonal bigint, asymmetric bigint, off_sum double, off_n bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "n bigint, out_of_range bigint, bad_diagonal bigint, asymmetric bigint, off_sum double, off_n bigint")
    total = out.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return total.select(*names[:4], F.round(F.col("off_sum") / F.nullif("off_n", F.lit(0)), 6).alias("mean_off_diagonal"))


def cosine_counts(vectors: DataFrame, queries: DataFrame, key: str, vec: str) -> DataFrame:
    """(c, n): how often each cosine, in steps of 10^-6, occurs between a stated set of queries and all other rows.

    Counted where they are computed, so that at most two million counts a partition travel, however many pairs there are."""
    out = None
    for keys, matrix in query_blocks(queries, key, vec):
        size = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(size == 0, 1, size)

        def run(batches: Iterator[pa.RecordBatch], keys=np.array(keys), matrix=matrix) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    others = keys[:, None] != np.array(b.column(0).to_pylist())[None, :]
                    step, n = np.unique(np.rint(np.round(matrix @ unit_rows(b.column(1)).T, 9)[others] * 1e6).astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n.astype(np.int64))], names=["step", "n"])

        part = vectors.select(key, vec).mapInArrow(run, "step bigint, n bigint")
        out = part if out is None else out.unionByName(part)
    counts = vectors.sparkSession.createDataFrame([], "step bigint, n bigint") if out is None else out.groupBy("step").agg(F.sum("n").alias("n"))
    return counts.select((F.col("step") / 1e6).alias("c"), "n")


def similarity_histogram(vectors: DataFrame, queries: DataFrame, key: str, vec: str, bins: int = 10) -> DataFrame:
    """PL10: (bin, n) of the cosines from -1 to 1, input of heat maps and distributions."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("c") + 1) * bins / 2))).cast("int")
    return cosine_counts(vectors, queries, key, vec).groupBy(at.alias("bin")).agg(F.sum("n").alias("n"))


def similarity_statistics(vectors: DataFrame, queries: DataFrame, key: str, vec: str) -> DataFrame:
    """VE9: number, mean, deviation, bounds and quantiles of the cosines of a stated set of queries with all other rows."""
    c = cosine_counts(vectors, queries, key, vec)
    quantiles = [0.05, 0.25, 0.5, 0.75, 0.95]
    r = lambda x: F.round(x, 6)
    mean = F.sum(F.col("c") * F.col("n")) / F.sum("n")
    got = c.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), r(mean).alias("mean"), r(F.sqrt(F.greatest(F.sum(F.col("c") * F.col("c") * F.col("n")) / F.sum("n") - mean * mean, F.lit(0.0)))).alias("std"),
        r(F.min("c")).alias("least"), r(F.max("c")).alias("most"), F.percentile("c", quantiles, F.col("n")).alias("q"),
    )
    return got.select("n", "mean", "std", "least", "most", *[r(F.col("q")[i]).alias(f"p{round(100 * q)}") for i, q in enumerate(quantiles)])


def silhouette(vectors: DataFrame, queries: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """VE10: (query, own, silhouette) of a stated set of queries against all rows: how much nearer its own cluster is than
    the nearest other one, by mean Euclidean distance; 0 for the only one of its cluster.

    Each partition sums the distances of each query to each label, so queries times labels travel."""
    kind, of = dict(vectors.dtypes)[key], dict(vectors.dtypes)[label]
    out = None
    for keys, matrix in query_blocks(queries, key, vec):

        def run(batches: Iterator[pa.RecordBatch], keys=keys, matrix=matrix) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = np.array(b.column(1).to_pylist(), np.float64)
                    gap = np.sqrt(np.maximum((matrix**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * matrix @ v.T, 0))
                    gap[np.array(keys)[:, None] == np.array(b.column(0).to_pylist())[None, :]] = 0
                    names, at = np.unique(np.array(b.column(2).to_pylist()), return_inverse=True)
                    sums = np.zeros((len(keys), len(names)))
                    for k in range(len(names)):
                        sums[:, k] = gap[:, at == k].sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.array(keys), len(names)).tolist(), b.column(0).type), pa.array(np.tile(names, len(keys)).tolist(), b.column(2).type), pa.array(sums.reshape(-1))], names=["query", "label", "gap"]
                    )

        part = vectors.select(key, vec, label).mapInArrow(run, f"query {kind}, label {of}, gap double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query {kind}, own {of}, silhouette double")
    sizes = vectors.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    own = queries.select(F.col(key).alias("query"), F.col(label).alias("own"))
    far = out.groupBy("query", "label").agg(F.sum("gap").alias("gap")).join(sizes, "label").join(own, "query")
    mine = F.max(F.when(F.col("label") == F.col("own"), F.col("n")))
    near = far.groupBy("query", "own").agg(mine.alias("n"), F.max(F.when(F.col("label") == F.col("own"), F.col("gap") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(F.col("label") != F.col("own"), F.col("gap") / F.col("n"))).alias("b"))
    value = F.when((F.col("n") > 1) & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return near.select("query", "own", value.alias("silhouette"))


def dimension_medians(vectors: DataFrame, vec: str, accuracy: int = 100_000) -> DataFrame:
    """VE8: median of each dimension, exact while it has fewer values than ``accuracy``, by a bounded sketch beyond."""
    return vectors.select(F.posexplode(doubles(F.col(vec))).alias("dim", "x")).groupBy("dim").agg(F.percentile_approx("x", 0.5, accuracy).alias("median"))


def cluster_metrics(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """VE10: inertia, Calinski-Harabasz and Davies-Bouldin of given labels, from grouped centroids."""
    long = vectors.select(label, F.monotonically_increasing_id().alias("id"), F.posexplode(doubles(F.col(vec))).alias("dim", "x"))
    centre = vectors.select(label, F.posexplode(doubles(F.col(vec))).alias("dim", "x")).groupBy(label, "dim").agg(F.avg("x").alias("c"))
    mean = vectors.select(F.posexplode(doubles(F.col(vec))).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"))
    n = vectors.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    dist = long.join(centre, [label, "dim"]).groupBy(label, "id").agg(F.sum(F.pow(F.col("x") - F.col("c"), F.lit(2))).alias("d2"))
    within = dist.groupBy(label).agg(F.sum("d2").alias("w"), F.avg(F.sqrt("d2")).alias("s"))
    between = centre.join(mean, "dim").groupBy(label).agg(F.sum(F.pow(F.col("c") - F.col("m"), F.lit(2))).alias("b2")).join(n, label)
    # labels against labels: as many rows as the square of the number of clusters
    a, b = centre.select(F.col(label).alias("i"), "dim", F.col("c").alias("ci")), centre.select(F.col(label).alias("j"), "dim", F.col("c").alias("cj"))
    gap = a.join(b, "dim").filter("i <> j").groupBy("i", "j").agg(F.sqrt(F.sum(F.pow(F.col("ci") - F.col("cj"), F.lit(2)))).alias("gap"))
    s = within.select(label, "s")
    db = gap.join(s.select(F.col(label).alias("i"), F.col("s").alias("si")), "i").join(s.select(F.col(label).alias("j"), F.col("s").alias("sj")), "j").groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.col("gap")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    sums = within.agg(F.sum("w").alias("inertia"), F.count(F.lit(1)).alias("k")).join(between.agg(F.sum(F.col("n") * F.col("b2")).alias("b"), F.sum("n").alias("n")), F.lit(True)).join(db, F.lit(True))
    return sums.select("k", F.round("inertia", 4).alias("inertia"), F.round((F.col("b") / (F.col("k") - 1)) / (F.col("inertia") / (F.col("n") - F.col("k"))), 4).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin"))


def confidence_ellipse(points: DataFrame, x: str, y: str, part: list[str], n_std: float = 2.0) -> DataFrame:
    """VE22: centre, half axes and angle of the ellipse of the sample covariance of each group."""
    got = points.groupBy(*part).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("a"), F.covar_samp(x, y).alias("b"), F.var_samp(y).alias("c"))
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, F.lit(2)) + F.pow(F.col("b"), F.lit(2)))
    return got.select(*part, F.round("mx", 6).alias("centre_x"), F.round("my", 6).alias("centre_y"), F.round(n_std * F.sqrt(half + root), 6).alias("major"), F.round(n_std * F.sqrt(F.greatest(half - root, F.lit(0.0))), 6).alias("minor"), F.round(F.degrees(F.atan2(F.col("b") * 2, F.col("a") - F.col("c")) / 2), 4).alias("angle"))


def projected(vectors: DataFrame, key: str, vec: str, k: int = 2) -> DataFrame:
    """VE2, VE7: coordinates on the first k principal components of the centred vectors, from their covariance.

    The covariance is summed per partition; its size is the square of the dimension."""
    values, parts = covariance_spectrum(vectors, vec)
    mean, basis = parts
    axes = basis[:, :k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            p = (v - mean) @ axes if b.num_rows else np.zeros((0, k))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, i]) for i in range(k))], names=[key, *(f"pc{i + 1}" for i in range(k))])

    kind = dict(vectors.dtypes)[key]
    return vectors.select(key, vec).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"pc{i + 1} double" for i in range(k)))


def covariance_spectrum(vectors: DataFrame, vec: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(variances, (mean, components)): eigenvalues and vectors of the sample covariance; signs by the largest loading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, None, None
        for b in batches:
            if b.num_rows:
                v = np.array(b.column(0).to_pylist(), np.float64)
                n, s, q = n + len(v), v.sum(0) + (0 if s is None else s), v.T @ v + (0 if q is None else q)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary())], names=["n", "s", "q"])

    rows = vectors.select(vec).mapInArrow(run, "n bigint, s binary, q binary").toLocalIterator()
    n, s, q = 0, 0.0, 0.0
    for r in rows:
        d = len(r[1]) // 8
        n, s, q = n + r[0], s + np.frombuffer(r[1]), q + np.frombuffer(r[2]).reshape(d, d)
    mean = s / n
    cov = (q - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1, 1)
    return values, (mean, basis)


def explained_variance(vectors: DataFrame, vec: str) -> DataFrame:
    """VE11, WN3: share of variance of each component and running share."""
    values, _ = covariance_spectrum(vectors, vec)
    share = values / values.sum()
    rows = [(i + 1, float(a), float(c)) for i, (a, c) in enumerate(zip(share, np.cumsum(share), strict=True))]
    return vectors.sparkSession.createDataFrame(rows, "component int, share double, cumulative double").select("component", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))
