"""Vector transforms: trained on a bounded sample, applied to rows where they lie."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.operators.search import matrix
from vecspark.plans.codecs import Product
from vecspark.sources.shared import ship


@dataclass
class Linear:
    """y = A x + b."""

    a: np.ndarray = field(default=None, repr=False)
    b: np.ndarray = field(default=None, repr=False)

    def train(self, x: np.ndarray) -> Linear:
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x @ self.a.T + (0 if self.b is None else self.b)

    @property
    def orthonormal(self) -> bool:
        small = self.a @ self.a.T if len(self.a) <= self.a.shape[1] else self.a.T @ self.a
        return bool(np.allclose(small, np.eye(len(small)), atol=4e-5))

    def reverse(self, y: np.ndarray) -> np.ndarray:
        if not self.orthonormal:
            raise ValueError("only an orthonormal transform is reversed")
        return (y - (0 if self.b is None else self.b)) @ self.a


def random_rotation(rows: int, columns: int, seed: int = 1234) -> np.ndarray:
    """Orthonormal rows (or columns, where these are fewer) from the QR factors of a Gaussian matrix."""
    n = max(rows, columns)
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0][:rows, :columns]


@dataclass
class Rotation(Linear):
    d: int = 0
    seed: int = 1234

    def train(self, x: np.ndarray) -> Rotation:
        self.a = random_rotation(self.d or x.shape[1], x.shape[1], self.seed)
        return self


@dataclass
class PCA(Linear):
    """Main directions. power: of the eigenvalues that the directions are scaled by (-0.5: whitening).

    rotate: a random rotation after; bins: directions dealt over bins so that the products of their variances are balanced.
    """

    d: int = 0
    power: float = 0.0
    rotate: bool = False
    bins: int = 0
    values: np.ndarray = field(default=None, repr=False)

    def train(self, x: np.ndarray) -> PCA:
        mean = x.mean(0)
        return self.from_moments(len(x), mean, (x - mean).T @ (x - mean) / max(1, len(x)))

    def from_moments(self, n: int, mean: np.ndarray, covariance: np.ndarray) -> PCA:
        values, axes = np.linalg.eigh(covariance)
        order = np.argsort(-values)
        self.values, axes = np.maximum(values[order], 0), axes[:, order].T
        axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]
        own = axes[: self.d or len(axes)]
        if self.bins:
            room, load = [len(own) // self.bins] * self.bins, [0.0] * self.bins
            dealt: list[list[int]] = [[] for _ in range(self.bins)]
            for i in range(len(own)):
                free = min((b for b in range(self.bins) if len(dealt[b]) < room[b]), key=lambda b: (load[b], b))
                dealt[free].append(i)
                load[free] += float(np.log(self.values[i] + 1e-30))
            keep = [i for b in dealt for i in b]
        else:
            keep = list(range(len(own)))
        scale = np.power(np.maximum(self.values[keep], 1e-30), self.power) if self.power else np.ones(len(keep))
        self.a = own[keep] * scale[:, None]
        if self.rotate:
            self.a = random_rotation(len(self.a), len(self.a)) @ self.a
        self.b = -self.a @ mean
        return self


def moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of all vectors of a table: d + d * d sums, taken in each task and then added up."""
    ship(df.sparkSession)
    d = df.where("vec IS NOT NULL").agg(F.max(F.size("vec"))).first()[0] or 0

    def run(batches):
        import pyarrow as pa

        n, s, p = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column("vec"))
            if len(x):
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d), pa.int32()), pa.array([n, *[0] * d]), pa.array([list(s), *map(list, p)], pa.list_(pa.float64()))], ["i", "n", "sums"])

    parts = df.select("vec").where("vec IS NOT NULL").mapInArrow(run, "i int, n bigint, sums array<double>")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", j)) for j in range(d)]).alias("sums")).collect()  # d + 1 rows
    rows = {r["i"]: r for r in got}
    n = rows[-1]["n"]
    mean = np.array(rows[-1]["sums"]) / n
    return n, mean, np.array([rows[i]["sums"] for i in range(d)]) / n - np.outer(mean, mean)


@dataclass
class ITQ(Linear):
    """Iterative quantisation: main directions, then a rotation that brings vectors near to their signs."""

    d: int = 0
    iterations: int = 50
    seed: int = 1234

    def train(self, x: np.ndarray) -> ITQ:
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        pca = PCA(d=self.d or x.shape[1]).train(unit)
        y, r = pca.apply(unit), random_rotation(len(pca.a), len(pca.a), self.seed)
        for _ in range(self.iterations):
            u, _, v = np.linalg.svd(np.sign(y @ r).T @ y)
            r = (u @ v).T
        self.a, self.b = r.T @ pca.a, r.T @ pca.b
        return self


@dataclass
class OPQ(Linear):
    """A rotation for a product codec: the codec and the rotation that best meets its codes, by turns."""

    m: int = 1
    d: int = 0
    iterations: int = 50
    bits: int = 8
    seed: int = 1234

    def train(self, x: np.ndarray) -> OPQ:
        d = self.d or x.shape[1]
        self.a = random_rotation(d, x.shape[1], self.seed)
        bits = min(self.bits, max(1, int(np.log2(max(2, len(x) // 39)))))
        codec = Product(self.m, bits)
        for i in range(self.iterations):
            y = self.apply(x)
            if i % 10 == 0:
                codec = Product(self.m, bits, seed=self.seed + i).train(y)
            else:  # one step of k-means for each part, from the codewords as they are
                codes = codec.encode(y)
                for p in range(self.m):
                    own = y[:, p * codec.size : (p + 1) * codec.size]
                    n = np.bincount(codes[:, p], minlength=1 << bits)
                    sums = np.stack([np.bincount(codes[:, p], own[:, j], 1 << bits) for j in range(codec.size)], 1)
                    codec.book[p] = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codec.book[p])
            u, _, v = np.linalg.svd(codec.decode(codec.encode(y)).T @ x, full_matrices=False)
            self.a = u @ v
        return self


@dataclass
class Normalize:
    """Unit length; zero vectors stay. Other norms than L2 aren't offered."""

    norm: float = 2.0

    def train(self, x: np.ndarray) -> Normalize:
        if self.norm != 2.0:
            raise ValueError("only the L2 norm")
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n > 0, n, 1)

    def reverse(self, y: np.ndarray) -> np.ndarray:
        return y


@dataclass
class Center:
    mean: np.ndarray = field(default=None, repr=False)

    def train(self, x: np.ndarray) -> Center:
        self.mean = x.mean(0)
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x - self.mean

    def reverse(self, y: np.ndarray) -> np.ndarray:
        return y + self.mean


@dataclass
class Remap:
    """Dimension i of the result is dimension order[i], or 0 where that is -1."""

    order: list[int]
    d_in: int

    @classmethod
    def padded(cls, d_in: int, d_out: int, uniform: bool = True) -> Remap:
        """To ``d_out`` dimensions; uniform: zeros spread among them."""
        if uniform and d_out >= d_in:
            at = [i * d_out // d_in for i in range(d_in)]
            order = [-1] * d_out
            for i, j in enumerate(at):
                order[j] = i
            return cls(order, d_in)
        return cls([i if i < d_in else -1 for i in range(d_out)], d_in)

    def train(self, x: np.ndarray) -> Remap:
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        own = np.array(self.order)
        return np.where(own >= 0, x[:, np.maximum(own, 0)], 0)

    def reverse(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(y), self.d_in))
        for j, i in enumerate(self.order):
            if i >= 0:
                out[:, i] = y[:, j]
        return out


def chained(x: np.ndarray, chain: list) -> np.ndarray:
    for t in chain:
        x = t.apply(x)
    return x


def transformed(df: DataFrame, chain: list, reverse: bool = False) -> DataFrame:
    """``df`` (with vec) through a chain of transforms, or back."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(chain)
    names = df.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column("vec"))
            if len(x):
                for t in reversed(shared.value) if reverse else shared.value:
                    x = t.reverse(x) if reverse else t.apply(x)
            d = x.shape[1] if len(x) else 1
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, d)[: len(x) + 1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([vec if n == "vec" else batch.column(n) for n in names], names)

    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'vec' else f.dataType.simpleString()}" for f in df.schema.fields)
    return df.where("vec IS NOT NULL").mapInArrow(run, schema)
