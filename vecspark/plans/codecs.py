"""Codecs: what a vector is stored as. Each is trained on a bounded sample, encodes to small whole numbers, decodes.

A codec has ``train(x)``, ``encode(x) -> codes`` (n by ``width``) and ``decode(codes) -> x``. Distances to codes are
distances to what they decode to; for product codes this equals the sum over the parts' tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from vecspark.operators.search import Metric, distances
from vecspark.plans.kmeans import KMeans, nearest


class Flat:
    """The vectors themselves."""

    def train(self, x: np.ndarray) -> Flat:
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return x

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes


@dataclass
class Product:
    """Each of m equal parts is the number of its nearest codeword. ``book``: m by 2^bits by d/m."""

    m: int
    bits: int = 8
    mode: str = "default"
    seed: int = 1234
    book: np.ndarray = field(default=None, repr=False)

    def train(self, x: np.ndarray) -> Product:
        k, d = 1 << self.bits, x.shape[1] // self.m
        if d * self.m != x.shape[1]:
            raise ValueError(f"{self.m} parts don't divide {x.shape[1]} dimensions")
        parts = [x[:, i * d : (i + 1) * d] for i in range(self.m)]
        if self.mode == "shared":
            one = KMeans(k, seed=self.seed).fit_array(np.vstack(parts)).centroids
            self.book = np.stack([one] * self.m)
        else:
            starts = [None] * self.m
            if self.mode == "hot_start":
                starts = list(self.book)
            elif self.mode in ("hypercube", "hypercube_pca"):
                starts = [self._corners(p, k) for p in parts]
            self.book = np.stack([KMeans(min(k, len(p)), seed=self.seed, initial=s).fit_array(p).centroids for p, s in zip(parts, starts, strict=True)])
        return self

    def _corners(self, x: np.ndarray, k: int) -> np.ndarray:
        """Corners of a box around the mean: along the axes of largest spread, or the main directions."""
        mean, b = x.mean(0), self.bits
        if self.mode == "hypercube_pca":
            values, axes = np.linalg.eigh(np.cov((x - mean).T))
            axes = (axes * np.sqrt(np.maximum(values, 0)))[:, ::-1].T[:b]
        else:
            axes = np.diag(x.std(0))[np.argsort(-x.std(0))[:b]]
        signs = ((np.arange(k)[:, None] >> np.arange(len(axes)) & 1) * 2 - 1).astype(float)
        return mean + signs @ axes

    @property
    def size(self) -> int:
        return self.book.shape[2]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(x[:, i * self.size : (i + 1) * self.size], self.book[i])[0] for i in range(self.m)], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.hstack([self.book[i][codes[:, i].astype(np.int64)] for i in range(self.m)])

    def tables(self, q: np.ndarray, metric: Metric = Metric.L2) -> np.ndarray:
        """Distance of each part of each query to each codeword: n by m by k."""
        return np.stack([distances(metric, q[:, i * self.size : (i + 1) * self.size], self.book[i]) for i in range(self.m)], 1)

    def by_tables(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Sums of the tables' entries: queries by codes."""
        return sum(tables[:, i, codes[:, i].astype(np.int64)] for i in range(self.m))

    def code_distances(self) -> np.ndarray:
        """Distances of codewords to each other: m by k by k."""
        return np.stack([distances(Metric.L2, b, b) for b in self.book])

    def refine_order(self, iterations: int = 2_000, seed: int = 1234) -> Product:
        """Renumbers each part's codewords so that numbers of few differing bits are near: annealed swaps."""
        for i in range(self.m):
            k = len(self.book[i])
            target = distances(Metric.L2, self.book[i], self.book[i])
            bits = np.bitwise_count(np.arange(k)[:, None] ^ np.arange(k)[None, :]).astype(float)
            scale = target.mean() / max(bits.mean(), 1e-9)
            order, rng, heat = np.arange(k), np.random.default_rng(seed + i), 0.7
            loss = lambda o: (np.abs(target[np.ix_(o, o)] / scale - bits)).sum()
            now = loss(order)
            for _ in range(iterations if k <= 256 else 0):
                a, b = rng.integers(0, k, 2)
                new = order.copy()
                new[[a, b]] = order[[b, a]]
                # only rows and columns a and b change
                rows = lambda o: sum(np.abs(target[o[r], o] / scale - bits[r]).sum() for r in (a, b))  # noqa: B023, E731
                change = 2 * (rows(new) - rows(order))
                if change < 0 or rng.random() < heat * np.exp(-abs(change) / max(1e-9, 0.01 * now)) * 0.01:
                    order, now = new, now + change
                heat *= 0.999
            self.book[i] = self.book[i][order]
        return self


@dataclass
class Scalar:
    """Each element in 4, 6 or 8 bits, half precision, or as it is in 8 bits. ranges: minmax, meanstd, quantiles, optim."""

    kind: str = "8bit"
    ranges: str = "minmax"
    argument: float = 0.0
    low: np.ndarray = field(default=None, repr=False)
    span: np.ndarray = field(default=None, repr=False)

    @property
    def top(self) -> int:
        return {"8bit": 255, "6bit": 63, "4bit": 15, "8bit_uniform": 255, "4bit_uniform": 15}[self.kind]

    def train(self, x: np.ndarray) -> Scalar:
        if self.kind in ("fp16", "8bit_direct"):
            return self
        y = x.reshape(-1, 1) if self.kind.endswith("uniform") else x
        if self.ranges == "minmax":
            low, high = y.min(0), y.max(0)
            low, high = low - (high - low) * self.argument, high + (high - low) * self.argument
        elif self.ranges == "meanstd":
            mean, std = y.mean(0), y.std(0) * (self.argument or 1)
            low, high = mean - std, mean + std
        elif self.ranges == "quantiles":
            low, high = np.quantile(y, self.argument, 0), np.quantile(y, 1 - self.argument, 0)
        else:  # optim: least squares of the grid's start and step, by turns
            low, high = y.min(0), y.max(0)
            for _ in range(25):
                step = np.where(high > low, (high - low) / self.top, 1)
                n = np.clip(np.floor((y - low) / step + 0.5), 0, self.top)
                var = n.var(0)
                slope = np.where(var > 0, ((n - n.mean(0)) * (y - y.mean(0))).mean(0) / np.where(var > 0, var, 1), step)
                low = y.mean(0) - slope * n.mean(0)
                high = low + slope * self.top
        self.low, self.span = low, np.where(high > low, high - low, 0)
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "fp16":
            return x.astype(np.float16).view(np.uint16).astype(np.int64)
        if self.kind == "8bit_direct":
            return np.clip(np.trunc(x), 0, 255).astype(np.int64)
        share = np.where(self.span > 0, (x - self.low) / np.where(self.span > 0, self.span, 1), 0)
        return np.floor(np.clip(share, 0, 1) * self.top).astype(np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        if self.kind == "fp16":
            return codes.astype(np.uint16).view(np.float16).astype(np.float64)
        if self.kind == "8bit_direct":
            return codes.astype(np.float64)
        return self.low + (codes + 0.5) / self.top * self.span


@dataclass
class Residual:
    """A sum of codewords, one of each of m books: each step codes what the ones before left, over a beam of choices."""

    m: int
    bits: int = 8
    beam: int = 5
    refine: int = 0
    seed: int = 1234
    books: list[np.ndarray] = field(default=None, repr=False)

    def train(self, x: np.ndarray) -> Residual:
        self.books = []
        for i in range(self.m):
            left = x - self.decode(self.encode(x)) if self.books else x
            self.books.append(KMeans(1 << self.bits, seed=self.seed + i).fit_array(left).centroids)
        for _ in range(self.refine):
            self.refit(x)
        return self

    def step(self, left: np.ndarray, book: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One step of a beam: of residuals n by b by d, the parent and codeword of the best ``beam`` children, and theirs."""
        n, b, d = left.shape
        cost = distances(Metric.L2, left.reshape(n * b, d), book, integer=True).reshape(n, b * len(book))
        keep = np.argsort(cost, axis=1, kind="stable")[:, :beam]
        parent, word = keep // len(book), keep % len(book)
        return parent, word, left[np.arange(n)[:, None], parent] - book[word]

    def encode(self, x: np.ndarray) -> np.ndarray:
        left, codes = x[:, None, :], np.zeros((len(x), 1, 0), np.int64)
        for book in self.books:
            parent, word, left = self.step(left, book, self.beam)
            codes = np.concatenate([codes[np.arange(len(x))[:, None], parent], word[:, :, None]], 2)
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        codes = codes.astype(np.int64)
        return sum((b[codes[:, i]] for i, b in enumerate(self.books)), np.zeros((len(codes), self.books[0].shape[1])))

    def refit(self, x: np.ndarray) -> float:
        """New codewords by least squares for the codes as they are; returns the mean squared error."""
        codes = self.encode(x)
        sizes = [len(b) for b in self.books]
        chosen = np.zeros((len(x), sum(sizes)))
        for i, first in enumerate(np.cumsum([0, *sizes[:-1]])):
            chosen[np.arange(len(x)), first + codes[:, i]] = 1
        solved = np.linalg.lstsq(chosen, x, rcond=None)[0]
        self.books = np.split(solved, np.cumsum(sizes)[:-1])
        return float(((x - self.decode(codes)) ** 2).sum(1).mean())

    def all_sums(self) -> np.ndarray:
        """Every sum of codewords, the last book running fastest: centroids of a coarse quantizer."""
        out = self.books[0]
        for b in self.books[1:]:
            out = (out[:, None, :] + b[None, :, :]).reshape(-1, b.shape[1])
        return out

    def split(self, level: int) -> tuple[Residual, Residual]:
        """The first ``level`` books as a coarse quantizer, and the rest."""
        return Residual(level, self.bits, self.beam, books=self.books[:level]), Residual(self.m - level, self.bits, self.beam, books=self.books[level:])


@dataclass
class LocalSearch(Residual):
    """As ``Residual``, but all books are free: codes are improved one book at a time, shaken, and kept if better."""

    rounds: int = 4
    shakes: int = 3

    def train(self, x: np.ndarray) -> LocalSearch:
        super().train(x)
        for _ in range(self.rounds):
            self.refit(x)
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        best = Residual.encode(self, x)
        if len(self.books) < self.m:
            return best
        error = ((x - self.decode(best)) ** 2).sum(1)
        rng = np.random.default_rng(self.seed)
        for _ in range(self.shakes):
            codes = best.copy()
            at = rng.integers(0, self.m, len(x))
            codes[np.arange(len(x)), at] = rng.integers(0, len(self.books[0]), len(x))
            for i, book in enumerate(self.books):
                left = x - self.decode(codes) + book[codes[:, i]]
                codes[:, i] = nearest(left, book)[0]
            now = ((x - self.decode(codes)) ** 2).sum(1)
            better = now < error
            best[better], error[better] = codes[better], now[better]
        return best


@dataclass
class Split:
    """An additive codec for each of several equal parts."""

    parts: int
    make: type = Residual
    m: int = 2
    bits: int = 8
    codecs: list = field(default=None, repr=False)

    def train(self, x: np.ndarray) -> Split:
        self.codecs = [self.make(self.m, self.bits).train(p) for p in np.split(x, self.parts, 1)]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([c.encode(p) for c, p in zip(self.codecs, np.split(x, self.parts, 1), strict=True)])

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.hstack([c.decode(p) for c, p in zip(self.codecs, np.split(codes, self.parts, 1), strict=True)])


@dataclass
class TwoLevel:
    """Product codes, and product codes of what these leave. Vectors are compared with the sum of both levels."""

    first: Product
    second: Product

    @property
    def bits(self) -> int:
        return max(self.first.bits, self.second.bits)

    def train(self, x: np.ndarray) -> TwoLevel:
        self.first.train(x)
        self.second.train(x - self.first.decode(self.first.encode(x)))
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        own = self.first.encode(x)
        return np.hstack([own, self.second.encode(x - self.first.decode(own))])

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.first.decode(codes[:, : self.first.m]) + self.second.decode(codes[:, self.first.m :])


@dataclass
class RowRange:
    """Each row scaled to 0..1 by its own least and greatest element (kept in half precision or full), then coded."""

    inner: object
    half: bool = False

    def _range(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, span = x.min(1), x.max(1) - x.min(1)
        if self.half:
            low, span = low.astype(np.float16).astype(float), span.astype(np.float16).astype(float)
        return low, span

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        low, span = self._range(x)
        return (x - low[:, None]) / np.where(span > 0, span, 1)[:, None]

    def train(self, x: np.ndarray) -> RowRange:
        self.inner.train(self._scaled(x))
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        low, span = self._range(x)
        return np.column_stack([low, span, self.inner.encode(self._scaled(x))])

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, :1] + codes[:, 1:2] * self.inner.decode(codes[:, 2:])


@dataclass
class Lattice:
    """Each part as the nearest point of a sphere of whole numbers (squared radius r2) and its length's step of 2^bits."""

    parts: int
    r2: int
    bits: int = 4
    top: np.ndarray = field(default=None, repr=False)

    def train(self, x: np.ndarray) -> Lattice:
        norms = np.stack([np.linalg.norm(p, axis=1) for p in np.split(x, self.parts, 1)], 1)
        self.low, self.top = norms.min(0), norms.max(0)
        return self

    def shapes(self, d: int) -> np.ndarray:
        """All descending rows of d whole numbers whose squares sum to r2."""
        out: list[list[int]] = []

        def grow(row: list[int], left: int) -> None:
            if len(row) == d:
                if not left:
                    out.append(row)
                return
            for v in range(min(row[-1] if row else int(left**0.5), int(left**0.5)), -1, -1):
                if v * v * (d - len(row)) < left:
                    break
                grow([*row, v], left - v * v)

        grow([], self.r2)
        return np.array(out)

    def points(self, x: np.ndarray) -> np.ndarray:
        """The lattice point nearest in direction: the shape whose product with the sorted sizes is largest, in x's order and signs."""
        shapes = self.shapes(x.shape[1])
        order = np.argsort(-np.abs(x), axis=1, kind="stable")
        best = shapes[np.argmax(np.take_along_axis(np.abs(x), order, 1) @ shapes.T, axis=1)]
        out = np.zeros_like(x)
        np.put_along_axis(out, order, best.astype(float), 1)
        return np.where(x < 0, -out, out)

    def encode(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i, p in enumerate(np.split(x, self.parts, 1)):
            norm = np.linalg.norm(p, axis=1)
            span = max(self.top[i] - self.low[i], 1e-12)
            step = np.clip(np.floor((norm - self.low[i]) / span * (1 << self.bits)), 0, (1 << self.bits) - 1)
            out += [step[:, None], self.points(p)]
        return np.hstack(out)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = []
        for i, c in enumerate(np.split(codes, self.parts, 1)):
            span = self.top[i] - self.low[i]
            norm = self.low[i] + (c[:, 0] + 0.5) / (1 << self.bits) * span
            out.append(c[:, 1:] / self.r2**0.5 * norm[:, None])
        return np.hstack(out)


@dataclass
class Signs:
    """One bit an element: whether it reaches its threshold, 0 or the median. Decodes to +1 and -1."""

    thresholds: bool = False
    at: np.ndarray = field(default=None, repr=False)

    def train(self, x: np.ndarray) -> Signs:
        self.at = np.median(x, 0) if self.thresholds else np.zeros(x.shape[1])
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return (x >= self.at).astype(np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return 2.0 * codes - 1


@dataclass
class Spectral:
    """Bits of floor(2 (x - threshold) / period): 1 where it is odd. kinds: global, centroid, half (a quarter period later), median."""

    period: float
    kind: str = "global"
    at: np.ndarray = field(default=None, repr=False)

    def train(self, x: np.ndarray) -> Spectral:
        self.at = np.median(x, 0) if self.kind == "median" else np.full(x.shape[1], -self.period / 4 if self.kind == "half" else 0.0)
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.floor(2 * (x - self.at) / self.period).astype(np.int64) & 1

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return 2.0 * codes - 1


def small_tables(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables (n by m by k) as numbers 0..255, with the scale and bias by which sums are turned back."""
    low = tables.min(2, keepdims=True)
    span = (tables - low).max((1, 2))
    scale = np.where(span > 0, 255 / np.where(span > 0, span, 1), 1)
    return np.floor((tables - low) * scale[:, None, None] + 0.5).astype(np.int64), scale, low.sum((1, 2))


