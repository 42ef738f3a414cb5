"""Sweeps of search parameters: operating points of recall and time."""

from __future__ import annotations

import time
from collections.abc import Iterator
from itertools import product

from pyspark.sql import DataFrame

from vecspark.operators.aggregate import intersection, recall_at
from vecspark.plans.index import VectorIndex

POINTS = "key string, perf double, t double"


def ranges(index: VectorIndex) -> dict[str, list]:
    """Values worth trying: powers of two of nprobe below the number of lists, of the refinement's factor, of the code budget."""
    out: dict[str, list] = {}
    if index.nlist:
        out["nprobe"] = [1 << i for i in range(max(1, index.nlist.bit_length())) if 1 << i < index.nlist] or [1]
    if index.refine is not None:
        out["k_factor"] = [float(1 << i) for i in range(7)]
    return out


def combinations(values: dict[str, list]) -> Iterator[dict]:
    for own in product(*values.values()):
        yield dict(zip(values, own, strict=True))


def explore(index: VectorIndex, queries: DataFrame, truth: DataFrame, k: int, values: dict[str, list] | None = None, criterion: str = "intersection") -> DataFrame:
    """key, perf, t of every combination: the share of true neighbours found (or of true nearest ones), and the seconds."""
    rows = []
    for own in combinations(ranges(index) if values is None else values):
        kept = {name: getattr(index, name) for name in own}
        for name, value in own.items():
            setattr(index, name, value)
        began = time.time()
        found = index.search(queries, k).cache()
        found.count()
        took = time.time() - began
        perf = (intersection if criterion == "intersection" else recall_at)(found, truth, k).first()[0]
        found.unpersist()
        for name, value in kept.items():
            setattr(index, name, value)
        rows.append((",".join(f"{a}={b}" for a, b in own.items()), float(perf), took))
    return queries.sparkSession.createDataFrame(rows, POINTS)
