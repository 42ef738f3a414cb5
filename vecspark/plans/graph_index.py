"""Graph indexes: vectors or their codes, and a neighbour graph, one row a shard.

A shard (about ``graph.SHARD_ROWS`` rows) is built by one task and written as one row of packed arrays. A search broadcasts a
block of queries and scans the rows: no vector and no edge is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.operators.search import FOUND, blockwise, matrix, query_blocks, ranked
from vecspark.plans import graph
from vecspark.plans.index import VectorIndex, transformed
from vecspark.sources.shared import stored

PACKED = "shard int, ids binary, vec binary, level binary, src binary, dst binary"


def packed(base: DataFrame, edges: DataFrame, shards: int | None = None) -> DataFrame:
    """A row a shard: its ids, vectors, and edges between places in the ids."""

    def run(key, rows, links):
        import pyarrow as pa

        if not rows.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), *[pa.binary()] * 5)], names=names)
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], matrix(rows.column("vec").combine_chunks())[order]
        src, dst = (np.searchsorted(ids, links.column(c).to_numpy()).astype("<i4") for c in ("src", "dst"))
        level = links.column("level").to_numpy().astype("<i4")
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (ids.astype("<i8"), x.astype("<f8"), level, src, dst)]], names=names)

    names = ["shard", "ids", "vec", "level", "src", "dst"]
    return graph.sharded(base, shards).groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(run, PACKED)


def search(queries: DataFrame, shards: DataFrame, k: int, ef: int = 16, radius: float | None = None) -> DataFrame:
    """query_id, rank, id, dist by walks over the packed shards; with a radius, those found within it."""

    def task(block, batches):
        import pyarrow as pa

        qids, q = block
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                level, src, dst = (np.frombuffer(r[c], "<i4") for c in ("level", "src", "dst"))
                best = graph.best_of_shard(qids, q, ids, np.frombuffer(r["vec"], "<f8").reshape(len(ids), -1), level, src, dst, k, ef, radius)
                yield best.batch(qids) if len(best.id) else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "id", "dist"])

    return ranked(blockwise(shards, query_blocks(queries), task, FOUND), k if radius is None else 1 << 30)


@dataclass
class GraphIndex:
    """Transforms, a codec, and a graph (``hnsw`` or ``nsg`` of ``m`` links) over what the codes stand for. L2 only."""

    kind: str
    m: int = 32
    inner: VectorIndex = field(default_factory=VectorIndex)
    ef: int = 64
    build_ef: int = 40
    shards: DataFrame = field(default=None, repr=False)

    def train(self, df: DataFrame) -> GraphIndex:
        self.inner.train(df)
        return self

    def add(self, df: DataFrame) -> GraphIndex:
        """Shards of every row are built and written once; rows of a later call make shards of their own."""
        codes = self.inner.encode(df)
        vectors = VectorIndex(codec=self.inner.codec).decode(codes)  # transforms are not taken back: queries go through them
        edges = graph.build(vectors, self.kind, m=self.m, ef=self.build_ef)
        new = stored(packed(vectors, edges), "graph")
        self.shards = new if self.shards is None else self.shards.unionByName(new)
        return self

    def search(self, queries: DataFrame, k: int, ef: int | None = None, radius: float | None = None) -> DataFrame:
        own = transformed(queries.select(F.col("query_id").alias("id"), "vec"), self.inner.chain).withColumnRenamed("id", "query_id") if self.inner.chain else queries
        return search(own, self.shards, k, max(ef or self.ef, k), radius)


