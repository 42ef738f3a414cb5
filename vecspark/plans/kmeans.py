"""k-means: training on a bounded sample or over the whole table, and its parts as table operators."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.operators.search import CELLS, Metric, distances, matrix
from vecspark.sources.shared import ship

#: Points of a training set by centroid: more are sampled, fewer bring a warning.
MAX_POINTS, MIN_POINTS = 256, 39
#: Bytes of a sample that is trained on in one place; larger ones are trained by passes over the table.
LOCAL_BYTES = 64 << 20


def sample(df: DataFrame, n: int, seed: int = 1234) -> DataFrame:
    """About n rows, always the same for a seed: those of low hash of their id, or all where there are no more. No shuffle."""
    every = df.count()
    return df if every <= n else df.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * n / every))


def rows_of(df: DataFrame) -> np.ndarray:
    """A bounded table's vectors, by id."""
    got = df.select("id", "vec").where("vec IS NOT NULL").collect()
    return np.array([r[1] for r in sorted(got, key=lambda r: r[0])], np.float64).reshape(len(got), -1) if got else np.zeros((0, 1))


def nearest(x: np.ndarray, centroids: np.ndarray, metric: Metric = Metric.L2) -> tuple[np.ndarray, np.ndarray]:
    """Number of and distance to the best centroid; the first of equals."""
    ids, best = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, CELLS // max(1, len(centroids)))
    for i in range(0, len(x), step):
        d = distances(metric, x[i : i + step], centroids, integer=metric == Metric.L2)
        ids[i : i + step] = d.argmax(1) if metric.similarity else d.argmin(1)
        best[i : i + step] = d[np.arange(len(d)), ids[i : i + step]]
    return ids, best


def split_empty(centroids: np.ndarray, sizes: np.ndarray) -> int:
    """Each empty cluster takes half of the largest one, both moved apart by 1/1024; returns how many were empty."""
    n = 0
    for i in np.flatnonzero(sizes == 0):
        j = int(np.argmax(sizes))
        if sizes[j] < 2:
            break
        sign = np.where(np.arange(centroids.shape[1]) % 2 == 0, 1, -1) / 1024
        centroids[i], centroids[j] = centroids[j] * (1 + sign), centroids[j] * (1 - sign)
        sizes[i] = sizes[j] // 2
        sizes[j] -= sizes[i]
        n += 1
    return n


@dataclass
class KMeans:
    """Parameters, and after ``fit`` the centroids and the objective of each iteration."""

    k: int
    iterations: int = 25
    redo: int = 1
    seed: int = 1234
    spherical: bool = False
    whole: bool = False
    metric: Metric = Metric.L2
    frozen: np.ndarray | None = None
    initial: np.ndarray | None = None
    centroids: np.ndarray = field(default=None, repr=False)
    objective: list[float] = field(default_factory=list)

    def _post(self, c: np.ndarray) -> np.ndarray:
        if self.spherical:
            n = np.linalg.norm(c, axis=1, keepdims=True)
            c = np.where(n > 0, c / np.where(n > 0, n, 1), c)
        return np.rint(c) if self.whole else c

    def _check(self, n: int) -> None:
        if n < self.k:
            raise ValueError(f"{n} points for {self.k} centroids")
        if n < MIN_POINTS * self.k:
            warnings.warn(f"{n} points for {self.k} centroids; {MIN_POINTS * self.k} are advised", stacklevel=3)

    def fit_array(self, x: np.ndarray, weights: np.ndarray | None = None) -> KMeans:
        x = np.asarray(x, np.float64)
        if not np.isfinite(x).all():
            raise ValueError("training points have NaN or infinite elements")
        if self.metric != Metric.L2 and self.metric != Metric.INNER_PRODUCT:
            raise ValueError("k-means takes L2 or inner product")
        self._check(len(x))
        weights = np.ones(len(x)) if weights is None else np.asarray(weights, np.float64)
        best = None
        for r in range(self.redo):
            if self.initial is not None:
                c = np.array(self.initial, np.float64)
            else:
                c = x[np.random.default_rng(self.seed + r).permutation(len(x))[: self.k]].copy()
            kept = 0 if self.frozen is None else len(self.frozen)
            if kept:
                c[:kept] = self.frozen
            c, history = self._post(c), []
            for _ in range(self.iterations):
                ids, d = nearest(x, c, self.metric)
                history.append(float((d * weights).sum()))
                sizes = np.bincount(ids, weights, self.k)
                sums = np.stack([np.bincount(ids, weights * x[:, j], self.k) for j in range(x.shape[1])], 1)
                new = np.where(sizes[:, None] > 0, sums / np.where(sizes > 0, sizes, 1)[:, None], c)
                split_empty(new, np.bincount(ids, minlength=self.k))
                if kept:
                    new[:kept] = self.frozen
                c = self._post(new)
            last = float((nearest(x, c, self.metric)[1] * weights).sum())
            if best is None or (last > best if self.metric.similarity else last < best):
                best, self.centroids, self.objective = last, c, history
        return self

    def fit(self, df: DataFrame) -> KMeans:
        """Trains on ``df`` (id, vec): on a sample of ``MAX_POINTS`` a centroid if there are more."""
        n, d = df.where("vec IS NOT NULL").agg(F.count("*"), F.max(F.size("vec"))).first()
        self._check(n)
        small = df if n <= MAX_POINTS * self.k else sample(df, MAX_POINTS * self.k, self.seed)
        if min(n, MAX_POINTS * self.k) * d * 8 <= LOCAL_BYTES:
            return self.fit_array(rows_of(small))
        if self.initial is None:
            first = rows_of(sample(small, 2 * self.k + 64, self.seed))[: self.k]  # about twice as many as needed
            first = first if len(first) == self.k else rows_of(small.orderBy(F.xxhash64("id", F.lit(self.seed)), "id").limit(self.k))
        else:
            first = np.array(self.initial, np.float64)
        c = self._post(first)
        self.objective = []
        for _ in range(self.iterations):
            got = {r["list_no"]: r for r in cluster_sums(small, c, self.metric).collect()}  # a row a centroid
            self.objective.append(sum(r["objective"] for r in got.values()))
            new, sizes = c.copy(), np.zeros(self.k, np.int64)
            for i, r in got.items():
                new[i], sizes[i] = np.array([r[f"s{j}"] for j in range(d)]) / r["n"], r["n"]
            split_empty(new, sizes)
            c = self._post(new)
        self.centroids = c
        return self


def assigned(df: DataFrame, centroids: np.ndarray, metric: Metric = Metric.L2) -> DataFrame:
    """``df`` with list_no, the number of the nearest centroid, and cd, its distance. No shuffle."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, d = nearest(matrix(batch.column("vec")), shared.value, metric)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int32()), pa.array(d)], [*batch.schema.names, "list_no", "cd"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.where("vec IS NOT NULL").mapInArrow(run, f"{types}, list_no int, cd double")


def cluster_sums(df: DataFrame, centroids: np.ndarray, metric: Metric = Metric.L2) -> DataFrame:
    """list_no, n, objective and the sums s0, s1, ... of each cluster's vectors: one pass, summed up in each task."""
    ship(df.sparkSession)
    shared, (k, d) = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64)), centroids.shape

    def run(batches):
        import pyarrow as pa

        n, total, sums = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, d))
        for batch in batches:
            x = matrix(batch.column("vec"))
            if len(x):
                ids, dist = nearest(x, shared.value, metric)
                n += np.bincount(ids, minlength=k)
                total += np.bincount(ids, dist, k)
                np.add.at(sums, ids, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some]), *[pa.array(sums[some, j]) for j in range(d)]], ["list_no", "n", "objective", *[f"s{j}" for j in range(d)]])

    schema = "list_no int, n bigint, objective double, " + ", ".join(f"s{j} double" for j in range(d))
    parts = df.select("vec").where("vec IS NOT NULL").mapInArrow(run, schema)
    return parts.groupBy("list_no").agg(F.sum("n").alias("n"), F.sum("objective").alias("objective"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(d)])


def kmeans_1d(x: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """The optimal centroids of numbers, and their cost, by dynamic programming over the sorted numbers.

    The best place to split moves to the right with the end, so that each layer is filled by divide and conquer.
    """
    x = np.sort(np.asarray(x, np.float64))
    n = len(x)
    s, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cost = lambda a, b: s2[b] - s2[a] - (s[b] - s[a]) ** 2 / (b - a)  # noqa: E731  of x[a:b]
    before = np.array([0.0, *(cost(0, j) for j in range(1, n + 1))])
    splits = [np.zeros(n + 1, np.int64)]
    for layer in range(1, k):
        now, split = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        jobs = [(layer + 1, n, layer, n - 1)]
        while jobs:
            low, high, a, b = jobs.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            at = np.arange(a, min(b, mid - 1) + 1)
            values = before[at] + cost(at, mid)
            best = int(np.argmin(values))
            now[mid], split[mid] = values[best], at[best]
            jobs += [(low, mid - 1, a, int(at[best])), (mid + 1, high, int(at[best]), b)]
        before = now
        splits.append(split)
    ends, j = [], n
    for split in reversed(splits):
        ends.append((int(split[j]), j))
        j = int(split[j])
    return np.array([(s[b] - s[a]) / (b - a) for a, b in reversed(ends)]), float(max(0.0, before[n]))


def progressive(x: np.ndarray, k: int, steps: int = 10, iterations: int = 10) -> np.ndarray:
    """k-means on more and more leading dimensions, each started from the last one's centroids."""
    d = x.shape[1]
    c = None
    for i in range(steps):
        own = max(1, int(round(d ** ((i + 1) / steps))))
        start = None if c is None else np.hstack([c, np.zeros((k, own - c.shape[1]))])
        c = KMeans(k, iterations, initial=start).fit_array(x[:, :own]).centroids
    return c
