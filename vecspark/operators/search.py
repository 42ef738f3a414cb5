"""Exhaustive search: nearest neighbours, radius search, pairwise and by-id distances, over dense and binary vectors.

The queries are the stated set; they are taken in blocks that fit ``BLOCK_BYTES`` and broadcast, block by block. The
base is scanned where it lies: each task compares its rows with the block in numpy and passes on its best k for each
query, so that only k rows a task and query are shuffled, to the final ranking. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.functions import vectors as V
from vecspark.functions.vectors import Metric
from vecspark.sources.shared import ship

#: Vectors of queries that are broadcast at a time.
BLOCK_BYTES = 16 << 20
#: Queries that are fetched without counting them first.
FEW = 1024
#: Distances that a task holds at a time.
CELLS = 1 << 22
#: Queries of which a task ranks the best at a time where any pair may be among them, and pairs that it compares then.
TILE, TILE_CELLS = 128, 1 << 20


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column, all of one length, as float64."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def distances(metric: Metric, q: np.ndarray, b: np.ndarray, p: float = 2.0, integer: bool = False) -> np.ndarray:
    """All distances of the rows of q and b, exact for integers below 2^26 (as float64)."""
    if metric == Metric.INNER_PRODUCT:
        return q @ b.T
    if metric == Metric.L2 and integer:
        return (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (q @ b.T)
    out = np.empty((len(q), len(b)))
    step = max(1, CELLS // max(1, b.size))
    for i in range(0, len(q), step):
        x, y = q[i : i + step, None, :], b[None, :, :]
        with np.errstate(all="ignore"):
            if metric == Metric.L2:
                d = ((x - y) ** 2).sum(2)
            elif metric == Metric.L1:
                d = np.abs(x - y).sum(2)
            elif metric == Metric.LINF:
                d = np.abs(x - y).max(2)
            elif metric == Metric.LP:
                d = (np.abs(x - y) ** p).sum(2)
            elif metric == Metric.CANBERRA:
                d = (np.abs(x - y) / (np.abs(x) + np.abs(y))).sum(2)
            elif metric == Metric.BRAY_CURTIS:
                d = np.abs(x - y).sum(2) / np.abs(x + y).sum(2)
            elif metric == Metric.JENSEN_SHANNON:
                m = (x + y) / 2
                d = 0.5 * (-x * np.log(m / x) - y * np.log(m / y)).sum(2)
            else:
                d = np.minimum(x, y).sum(2) / np.maximum(x, y).sum(2)
        out[i : i + step] = d
    return out


def paired(metric: Metric, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to the rows of y at the same place."""
    if metric == Metric.L2:
        return ((x - y) ** 2).sum(1)
    if metric == Metric.INNER_PRODUCT:
        return (x * y).sum(1)
    return np.array([distances(metric, x[i : i + 1], y[i : i + 1])[0, 0] for i in range(len(x))])


def near_rows(q: np.ndarray, b: np.ndarray, k: int, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in q and b of all pairs that may be among the k nearest by L2 and within ``worst`` of each query.

    A matrix product gives distances that are off by rounding; ``slack`` bounds that, so that no neighbour is lost and
    few other pairs are left to compare exactly. Pairs whose product isn't finite are left too.
    """
    with np.errstate(all="ignore"):
        size = (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :]
        slack = 1e-15 * (q.shape[1] + 8) * size
        about = size - 2 * (q @ b.T)
        if len(b) > k:
            worst = np.fmin(worst, np.partition(about + slack, k - 1, axis=1)[:, k - 1])
        return np.nonzero(~(about - slack > worst[:, None]))


class Best:
    """The k best of each of n queries, over any number of blocks of candidates; with each row a number of the caller's, its ``tag``."""

    def __init__(self, n: int, k: int, similarity: bool):
        self.k, self.sign = k, -1 if similarity else 1
        self.query, self.dist, self.id, self.tag = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.worst = np.full(n, np.inf)

    def add(self, dist: np.ndarray, ids: np.ndarray) -> None:
        """A matrix of distances of all queries to some rows."""
        self.add_some(np.arange(len(dist)), dist, ids)

    def add_some(self, query: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """A matrix of distances of some queries, each once, to some rows."""
        d = self.sign * dist
        near = d <= self.worst[query][:, None]
        if len(ids) > self.k and np.count_nonzero(near) > 4 * self.k * len(d):  # as at first: not all are to be sorted
            near &= ~(d > np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k])  # NaN is last there
        q, c = np.nonzero(near)
        if len(q):
            self.add_rows(query[q], d[q, c] * self.sign, ids[c])

    def add_rows(self, query: np.ndarray, dist: np.ndarray, ids: np.ndarray, tag: int = 0) -> None:
        tags = np.concatenate([self.tag, np.full(len(query), tag)])
        query, dist, ids = np.concatenate([self.query, query]), np.concatenate([self.dist, self.sign * dist]), np.concatenate([self.id, ids])
        valid = np.flatnonzero(~np.isnan(dist))
        order = valid[np.lexsort((ids[valid], dist[valid], query[valid]))]
        query, dist, ids, tags = query[order], dist[order], ids[order], tags[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.dist, self.id, self.tag = query[keep], dist[keep], ids[keep], tags[keep]
        last = (np.arange(len(query)) - first == self.k - 1) & keep
        self.worst[query[last]] = dist[last]

    def batch(self, query_ids: np.ndarray):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(query_ids[self.query]), pa.array(self.id), pa.array(self.sign * self.dist)], ["query_id", "id", "dist"])


class Tiles:
    """``Best`` of any number of queries, ``TILE`` of them at a time, so that what is ranked for a step stays small."""

    def __init__(self, n: int, k: int, similarity: bool):
        self.parts = [(a, min(n, a + TILE), Best(min(n, a + TILE) - a, k, similarity)) for a in range(0, n, TILE)]

    def each(self, rows: int) -> Iterator[tuple[int, int, Best, slice]]:
        """First and last query of a tile, its best, and ``TILE_CELLS`` pairs' worth of ``rows`` rows."""
        step = max(1, TILE_CELLS // TILE)
        for a, b, best in self.parts:
            for i in range(0, rows, step):
                yield a, b, best, slice(i, min(rows, i + step))

    def batches(self, query_ids: np.ndarray) -> Iterator:
        for a, b, best in self.parts:
            yield best.batch(query_ids[a:b])


FOUND = "query_id bigint, id bigint, dist double"


def query_blocks(queries: DataFrame, columns: tuple[str, ...] = ("vec",)) -> Iterator[tuple]:
    """(ids, matrix of each column) of the queries, ``BLOCK_BYTES`` of vectors at a time. Rows with null vectors are left out."""
    rows = queries.select(F.col("query_id").cast("bigint").alias("query_id"), *columns).where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    few = rows.limit(FEW + 1).collect()  # most query sets are small: one job
    n = 1
    if len(few) > FEW:
        size = rows.agg(F.count("*"), *[F.max(F.size(c)) for c in columns]).first()
        n = max(1, -(-size[0] * 8 * sum(size[1:]) // BLOCK_BYTES))
    for b in range(n):
        block = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) if n > 1 else rows
        got = sorted(few if len(few) <= FEW else block.collect(), key=lambda r: r[0])
        yield (np.array([r[0] for r in got], np.int64), *[np.array([r[c] for r in got], np.float64).reshape(len(got), -1) if got else np.zeros((0, 1)) for c in columns])


def blockwise(base: DataFrame, blocks, task: Callable, schema: str) -> DataFrame:
    """The union over query blocks of ``task(block, batches)`` on the partitions of ``base``."""
    ship(base.sparkSession)
    sc, out = base.sparkSession.sparkContext, None
    for block in blocks:
        shared = sc.broadcast(block)
        part = base.mapInArrow(lambda batches, shared=shared: task(shared.value, batches), schema)
        out = part if out is None else out.unionByName(part)
    return out


def ranked(found: DataFrame, k: int, similarity: bool = False) -> DataFrame:
    """The k best rows of each query with rank 0..k-1, by distance and id."""
    order = F.col("dist").desc() if similarity else F.col("dist").asc()
    placed = found.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(order, "id"))).where(F.col("_n") <= k)
    return placed.withColumn("rank", F.col("_n") - 1).drop("_n")


def padded(result: DataFrame, queries: DataFrame, k: int, similarity: bool = False) -> DataFrame:
    """k rows for every query: id -1 and the worst distance where there are no more neighbours."""
    worst = float(np.finfo(np.float32).max)
    all_ranks = queries.select(F.col("query_id").alias("_q")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    joined = all_ranks.join(result, (F.col("_q") == F.col("query_id")) & (F.col("_r") == F.col("rank")), "left")
    return joined.select(F.col("_q").alias("query_id"), F.col("_r").alias("rank"), F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("dist", F.lit(-worst if similarity else worst)).alias("dist"))


def knn(queries: DataFrame, base: DataFrame, k: int, metric: Metric = Metric.L2, p: float = 2.0, integer: bool = False, pad: bool = False) -> DataFrame:
    """query_id, rank, id, dist: the k nearest rows of ``base`` (id, vec) of each of ``queries`` (query_id, vec).

    Null vectors are left out; a NaN distance is no neighbour, so that a query with NaN has none.
    """
    if k < 1:
        raise ValueError("k must be positive")

    def task(block, batches):
        ids, q = block
        tiles = Tiles(len(ids), k, metric.similarity)
        for batch in batches:
            x, own = matrix(batch.column("vec")), batch.column("id").to_numpy(zero_copy_only=False)
            for a, b, best, part in tiles.each(len(x)):
                if metric != Metric.L2 or integer:
                    best.add(distances(metric, q[a:b], x[part], p, integer), own[part])
                    continue
                at, of = near_rows(q[a:b], x[part], k, best.worst)
                pairs = max(1, CELLS // q.shape[1])
                for j in range(0, len(at), pairs):
                    y, z = at[j : j + pairs], of[j : j + pairs]
                    best.add_rows(y, paired(Metric.L2, q[a + y], x[part][z]), own[part][z])
        yield from tiles.batches(ids)

    rows = base.where("vec IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "vec")
    out = ranked(blockwise(rows, query_blocks(queries), task, FOUND), k, metric.similarity).select("query_id", "rank", "id", "dist")
    return padded(out, queries, k, metric.similarity) if pad else out


def assign(queries: DataFrame, base: DataFrame, metric: Metric = Metric.L2, integer: bool = False) -> DataFrame:
    """query_id, id: the nearest row."""
    return knn(queries, base, 1, metric, integer=integer).select("query_id", "id")


def range_search(queries: DataFrame, base: DataFrame, radius: float, metric: Metric = Metric.L2, integer: bool = False) -> DataFrame:
    """query_id, id, dist of all rows nearer than the radius (strictly; for similarities: above it)."""

    def task(block, batches):
        import pyarrow as pa

        ids, q = block
        for batch in batches:
            b, own = matrix(batch.column("vec")), batch.column("id").to_numpy(zero_copy_only=False)
            step = max(1, CELLS // max(1, len(ids)))
            for i in range(0, len(b) if len(ids) else 0, step):
                d = distances(metric, q, b[i : i + step], integer=integer)
                x, y = np.nonzero(d > radius if metric.similarity else d < radius)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(own[i + y]), pa.array(d[x, y])], ["query_id", "id", "dist"])

    rows = base.where("vec IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "vec")
    return blockwise(rows, query_blocks(queries), task, FOUND)


def pairwise(queries: DataFrame, base: DataFrame, metric: Metric = Metric.L2, p: float = 2.0, integer: bool = False) -> DataFrame:
    """query_id, id, dist of every query and row: the result is the whole matrix."""

    def task(block, batches):
        import pyarrow as pa

        ids, q = block
        for batch in batches:
            b, own = matrix(batch.column("vec")), batch.column("id").to_numpy(zero_copy_only=False)
            step = max(1, CELLS // max(1, len(ids)))
            for i in range(0, len(b) if len(ids) else 0, step):
                d = distances(metric, q, b[i : i + step], p, integer)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, d.shape[1])), pa.array(np.tile(own[i : i + step], len(ids))), pa.array(d.ravel())], ["query_id", "id", "dist"])

    rows = base.where("vec IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "vec")
    return blockwise(rows, query_blocks(queries), task, FOUND)


def pair_distances(pairs: DataFrame, queries: DataFrame, base: DataFrame, metric: Metric = Metric.L2, kind: str = "double") -> DataFrame:
    """query_id, id, dist for given pairs (query_id, id): two equi-joins. Ids that aren't in the base are infinitely far."""
    q = queries.select(F.col("query_id").alias("_q"), F.col("vec").alias("_qv"))
    b = base.select(F.col("id").alias("_b"), F.col("vec").alias("_bv"))
    far = F.lit(float("-inf") if metric.similarity else float("inf"))
    joined = pairs.join(q, F.col("query_id") == F.col("_q")).join(b, F.col("id") == F.col("_b"), "left")
    return joined.select("query_id", "id", F.coalesce(V.distance(metric, F.col("_qv"), F.col("_bv"), kind=kind).cast("double"), far).alias("dist"))


def knn_by_ids(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: Metric = Metric.L2, kind: str = "double") -> DataFrame:
    """Nearest neighbours among each query's own list ``candidates`` (query_id, ids); a list ends at its first negative id."""
    stop = F.array_position(F.transform("ids", lambda x: x < 0), True)
    valid = F.when(stop > 0, F.slice("ids", 1, stop.cast("int") - 1)).otherwise(F.col("ids"))
    pairs = candidates.select("query_id", F.explode(valid).alias("id"))
    return ranked(pair_distances(pairs, queries, base, metric, kind).where(~F.col("dist").isin(float("inf"), float("-inf"))), k, metric.similarity)


def nearest_1d(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """k nearest of numbers: ``queries`` (query_id, x), ``base`` (id, x). As 1-vectors, by absolute difference."""
    vec = lambda d: d.withColumn("vec", F.array(F.col("x").cast("double")))
    return knn(vec(queries), vec(base), k, Metric.L1)


# Binary vectors: packed words.


def words_matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1).view(np.uint64) if len(column) else np.zeros((0, 1), np.uint64)


def word_blocks(queries: DataFrame) -> Iterator[tuple]:
    rows = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "words").where("words IS NOT NULL")
    size = rows.agg(F.count("*"), F.max(F.size("words"))).first()
    n = max(1, -(-size[0] * 8 * (size[1] or 0) // BLOCK_BYTES))
    for b in range(n):
        block = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) if n > 1 else rows
        got = sorted(block.collect(), key=lambda r: r[0])
        yield np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got] or [[0]], np.int64).reshape(max(1, len(got)), -1).view(np.uint64)[: len(got)]


def hamming_matrix(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(b)), np.int64)
    for w in range(q.shape[1] if len(q) and len(b) else 0):
        out += np.bitwise_count(q[:, w, None] ^ b[None, :, w])
    return out


def _hamming_task(emit):
    def task(block, batches):
        ids, q = block
        for batch in batches:
            b, own = words_matrix(batch.column("words")), batch.column("id").to_numpy(zero_copy_only=False)
            step = max(1, CELLS // max(1, len(ids)))
            for i in range(0, len(b) if len(ids) else 0, step):
                yield from emit(ids, hamming_matrix(q, b[i : i + step]), own[i : i + step])

    return task


def _words(base: DataFrame) -> DataFrame:
    return base.where("words IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "words")


def hamming_knn(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """As ``knn`` for packed bits: ``queries`` (query_id, words), ``base`` (id, words)."""

    def task(block, batches):
        ids, q = block
        best = Best(len(ids), k, False)
        for batch in batches:
            b, own = words_matrix(batch.column("words")), batch.column("id").to_numpy(zero_copy_only=False)
            step = max(1, CELLS // max(1, len(ids)))
            for i in range(0, len(b) if len(ids) else 0, step):
                best.add(hamming_matrix(q, b[i : i + step]).astype(np.float64), own[i : i + step])
        yield best.batch(ids)

    out = ranked(blockwise(_words(base), word_blocks(queries), task, FOUND), k)
    return out.select("query_id", "rank", "id", F.col("dist").cast("bigint").alias("dist"))


def hamming_range(queries: DataFrame, base: DataFrame, radius: int, inclusive: bool = False) -> DataFrame:
    """query_id, id, dist of all rows of fewer than ``radius`` differing bits (inclusive: as many at most)."""

    def emit(ids, d, own):
        import pyarrow as pa

        x, y = np.nonzero(d <= radius if inclusive else d < radius)
        yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(own[y]), pa.array(d[x, y])], ["query_id", "id", "dist"])

    return blockwise(_words(base), word_blocks(queries), _hamming_task(emit), "query_id bigint, id bigint, dist bigint")


def hamming_histogram(queries: DataFrame, base: DataFrame) -> DataFrame:
    """dist, n: how many pairs of a query and a row have each distance; counted before anything is shuffled."""

    def task(block, batches):
        import pyarrow as pa

        _, q = block
        counts = np.zeros(q.shape[1] * 64 + 1 if len(q) else 1, np.int64)
        for batch in batches:
            b = words_matrix(batch.column("words"))
            step = max(1, CELLS // max(1, len(q)))
            for i in range(0, len(b) if len(q) else 0, step):
                counts += np.bincount(hamming_matrix(q, b[i : i + step]).ravel(), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["dist", "n"])

    return blockwise(_words(base), word_blocks(queries), task, "dist bigint, n bigint").groupBy("dist").agg(F.sum("n").alias("n"))


