"""Neighbour graphs as tables: edges (level, src, dst), searched from shard to shard.

A graph is built over each of ``shards`` parts of the base, by hash of the id, of bounded size: shards grow in number,
not in size, with the base. A build is one task's numpy work on its shard. A search walks every shard's graph and
merges the best, so that its recall is that of the shards' graphs.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.operators.search import FOUND, Best, Metric, distances, matrix, query_blocks, ranked
from vecspark.sources.shared import ship

#: Rows of a shard, about.
SHARD_ROWS = 20_000
EDGES = "shard int, level int, src bigint, dst bigint"


def sharded(base: DataFrame, shards: int | None = None) -> DataFrame:
    """id, vec, shard."""
    ship(base.sparkSession)
    n = shards or max(1, -(-base.count() // SHARD_ROWS))
    rows = base.where("vec IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))


def diverse(point: np.ndarray, candidates: list[tuple[float, int]], x: np.ndarray, most: int) -> list[int]:
    """Of candidates (distance to the point, row), nearest first, those nearer to the point than to any that is kept."""
    kept: list[int] = []
    for d, i in sorted(candidates):
        if len(kept) >= most:
            break
        if not kept or ((x[kept] - x[i]) ** 2).sum(1).min() > d:
            kept.append(i)
    return kept


def walk(x: np.ndarray, links, q: np.ndarray, starts: list[int], ef: int) -> list[tuple[float, int]]:
    """The ``ef`` nearest rows that a best-first walk over ``links`` finds, as (squared distance, row)."""
    d0 = ((x[starts] - q) ** 2).sum(1).tolist()
    seen, todo = set(starts), sorted(zip(d0, starts, strict=True))
    heapq.heapify(todo)
    best = [(-d, -i) for d, i in todo]
    heapq.heapify(best)
    while len(best) > ef:
        heapq.heappop(best)
    while todo:
        d, i = heapq.heappop(todo)
        if len(best) >= ef and d > -best[0][0]:
            break
        new = [j for j in links(i) if j not in seen]
        if not new:
            continue
        seen.update(new)
        for e, j in zip(((x[new] - q) ** 2).sum(1).tolist(), new, strict=True):
            if len(best) < ef or e < -best[0][0]:
                heapq.heappush(todo, (e, j))
                heapq.heappush(best, (-e, -j))
                if len(best) > ef:
                    heapq.heappop(best)
    return sorted((-d, -i) for d, i in best)


def hnsw(x: np.ndarray, m: int = 32, ef: int = 40, seed: int = 12345) -> tuple[list[dict[int, list[int]]], int]:
    """Layers of links (2m neighbours below, m above) and the row to start from."""
    n = len(x)
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int)
    layers: list[dict[int, list[int]]] = [{} for _ in range(int(level.max(initial=0)) + 1)]
    order = np.argsort(-level, kind="stable").tolist()
    start = order[0] if order else -1
    for i in order:
        at = [start]
        for layer in range(len(layers) - 1, -1, -1):
            own = layers[layer]
            links = lambda j, own=own: own.get(j, [])
            if layer > level[i]:
                at = [walk(x, links, x[i], at, 1)[0][1]]
                continue
            if own:
                near = walk(x, links, x[i], [j for j in at if j in own] or [next(iter(own))], ef)
                most = 2 * m if layer == 0 else m
                own[i] = diverse(x[i], near, x, most)
                for j in own[i]:
                    back = [*own[j], i]
                    own[j] = back if len(back) <= most else diverse(x[j], [(float(((x[k] - x[j]) ** 2).sum()), k) for k in back], x, most)
                at = [j for _, j in near]
            else:
                own[i] = []
    return layers, start


def knn_lists(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k nearest others of each row."""
    out = np.zeros((len(x), min(k, len(x) - 1)), np.int64)
    for i in range(0, len(x), 512):
        d = distances(Metric.L2, x[i : i + 512], x, integer=True)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 512] = np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def descent(x: np.ndarray, k: int, rounds: int = 10, sample: int = 10, seed: int = 2021) -> np.ndarray:
    """Approximate ``knn_lists``: neighbours of neighbours are tried until few rows gain."""
    n, k = len(x), min(k, len(x) - 1)
    rng = np.random.default_rng(seed)
    lists = np.stack([rng.choice(n - 1, k, replace=False) for _ in range(n)]) if n > 1 else np.zeros((n, 0), np.int64)
    lists += lists >= np.arange(n)[:, None]
    dist = ((x[lists] - x[:, None, :]) ** 2).sum(2)
    for _ in range(rounds):
        gained = 0
        back: list[list[int]] = [[] for _ in range(n)]
        for i, own in enumerate(lists):
            for j in own:
                if len(back[j]) < sample * 2:
                    back[j].append(i)
        for i in range(n):
            near = np.unique(np.concatenate([lists[i], np.array(back[i], np.int64)]))
            tried = np.unique(np.concatenate([lists[near].ravel(), near]))
            tried = tried[(tried != i) & ~np.isin(tried, lists[i])]
            if not len(tried):
                continue
            d = ((x[tried] - x[i]) ** 2).sum(1)
            every, ids = np.concatenate([dist[i], d]), np.concatenate([lists[i], tried])
            keep = np.lexsort((ids, every))[:k]
            gained += int((keep >= k).sum())
            lists[i], dist[i] = ids[keep], every[keep]
        if gained <= 0.001 * n * k:
            break
    return lists


def nsg(x: np.ndarray, knn: np.ndarray, r: int = 32, pool: int = 64) -> tuple[dict[int, list[int]], int]:
    """Links pruned to diverse directions out of a kNN graph, reverse links, and a tree from the medoid to all rows."""
    n = len(x)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    out: dict[int, list[int]] = {}
    for i in range(n):
        found = walk(x, lambda j: knn[j].tolist(), x[i], [start], pool)
        near = {j: d for d, j in found if j != i} | {int(j): float(((x[j] - x[i]) ** 2).sum()) for j in knn[i] if j != i}
        out[i] = diverse(x[i], [(d, j) for j, d in near.items()], x, r)
    for i in range(n):
        for j in list(out[i]):
            if i not in out[j]:
                both = [*out[j], i]
                out[j] = both if len(both) <= r else diverse(x[j], [(float(((x[k] - x[j]) ** 2).sum()), k) for k in both], x, r)
    reached, todo = {start}, [start]
    while len(reached) < n:
        while todo:
            i = todo.pop()
            new = [j for j in out[i] if j not in reached]
            reached.update(new)
            todo += new
        rest = [i for i in range(n) if i not in reached]
        if rest:  # link the first unreached row to the nearest that is reached
            i, own = rest[0], np.array(sorted(reached))
            near = int(own[((x[own] - x[i]) ** 2).sum(1).argmin()])
            out[near].append(i)
            reached.add(i)
            todo.append(i)
    return out, start


def build(base: DataFrame, kind: str = "hnsw", m: int = 32, ef: int = 40, k: int = 64, shards: int | None = None) -> DataFrame:
    """Edges of each shard's graph. A shard's start is an edge of level -1 from it to itself."""

    def run(key, table):
        import pyarrow as pa

        shard = key[0].as_py()
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], matrix(table.column("vec").combine_chunks())[order]
        if kind == "hnsw":
            layers, start = hnsw(x, m, ef)
        elif kind == "nsg":
            links, start = nsg(x, knn_lists(x, min(k, len(x) - 1)), m)
            layers = [links]
        else:
            lists, start = (descent(x, k) if kind == "descent" else knn_lists(x, k)), 0
            layers = [{i: own.tolist() for i, own in enumerate(lists)}]
        rows = [(level, i, j) for level, own in enumerate(layers) for i, near in own.items() for j in near] + [(-1, start, start)] * bool(len(x))
        level, a, b = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        return pa.table([pa.array(np.full(len(level), shard), pa.int32()), pa.array(level, pa.int32()), pa.array(ids[a]), pa.array(ids[b])], names=["shard", "level", "src", "dst"])

    return sharded(base, shards).groupBy("shard").applyInArrow(run, EDGES)


def search(queries: DataFrame, base: DataFrame, edges: DataFrame, k: int, ef: int = 16, radius: float | None = None, shards: int | None = None) -> DataFrame:
    """query_id, rank, id, dist by walks over the shards' graphs; with a radius, those found within it."""
    out = None
    for block in query_blocks(queries):
        run = _searched(base.sparkSession.sparkContext.broadcast(block), k, ef, radius)
        parts = sharded(base, shards).groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(run, FOUND)
        out = parts if out is None else out.unionByName(parts)
    return ranked(out, k if radius is None else 1 << 30)


def _links(src: np.ndarray, dst: np.ndarray, n: int):
    """Place -> places that its edges lead to, in order of the edges: two arrays, whatever the graph's size."""
    order = np.argsort(src, kind="stable")
    first, to = np.searchsorted(src[order], np.arange(n + 1)), dst[order]
    return lambda i: to[first[i] : first[i + 1]].tolist()


def best_of_shard(qids, q, ids, x, level, src, dst, k: int, ef: int, radius: float | None) -> Best:
    """The best of a shard for each query: ids and vectors x by place, edges (level, src, dst) between places."""
    best = Best(len(qids), k if radius is None else max(k, len(ids)), False)
    if not len(ids) or not len(level):
        return best
    layers = {lv: _links(src[level == lv], dst[level == lv], len(ids)) for lv in np.unique(level).tolist()}
    start = int(src[np.argmax(level == -1)]) if -1 in layers else 0
    none, parts = lambda i: [], []
    for n in range(len(qids)):
        at = [start]
        for lv in sorted((v for v in layers if v > 0), reverse=True):
            at = [walk(x, layers[lv], q[n], at, 1)[0][1]]
        found = walk(x, layers.get(0, none), q[n], at, max(ef, k))
        parts.append(np.array([(d, i) for d, i in found if radius is None or d < radius], float).reshape(-1, 2))
    if parts:  # ranked once, not for each query
        found = np.concatenate(parts)
        best.add_rows(np.repeat(np.arange(len(parts)), [len(p) for p in parts]), found[:, 0], ids[found[:, 1].astype(np.int64)])
    return best


def _searched(shared, k: int, ef: int, radius: float | None):
    """(key, rows, links) of a shard -> the best it has for each query of a broadcast block."""

    def run(key, rows, links):
        import pyarrow as pa

        qids, q = shared.value
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        x = matrix(rows.column("vec").combine_chunks())[order] if len(ids) else np.zeros((0, 1))
        level, src, dst = (links.column(c).to_numpy() for c in ("level", "src", "dst"))
        best = best_of_shard(qids, q, ids, x, level, np.searchsorted(ids, src), np.searchsorted(ids, dst), k, ef, radius)
        return pa.Table.from_batches([best.batch(qids)])

    return run


def from_neighbours(knn: DataFrame, shards: int = 1) -> DataFrame:
    """Level-0 edges from a result (query_id, rank, id) of a search of the base in itself; own matches are left out."""
    shard = F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int")
    inside = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int") == shard
    return knn.where((F.col("query_id") != F.col("id")) & inside).select(shard.alias("shard"), F.lit(0).alias("level"), F.col("query_id").alias("src"), F.col("id").alias("dst"))


def with_starts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Edges with given rows (shard, id) as starts of their shards, in place of those that there are."""
    own = starts.select("shard", F.lit(-1).alias("level"), F.col("id").alias("src"), F.col("id").alias("dst"))
    return edges.where("level >= 0").unionByName(own)


def relinked(edges: DataFrame, base: DataFrame, most: int) -> DataFrame:
    """Each row's level-0 links in order of distance, the first ``most``: (shard, src, dst, rank, dist)."""
    from pyspark.sql import Window as W

    from vecspark.functions.vectors import l2

    a = base.select(F.col("id").alias("_a"), F.col("vec").alias("_av"))
    b = base.select(F.col("id").alias("_b"), F.col("vec").alias("_bv"))
    both = edges.where("level = 0").join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b"))
    far = both.select("shard", "src", "dst", l2(F.col("_av"), F.col("_bv")).alias("dist"))
    return far.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("dist", "dst")) - 1).where(F.col("rank") < most)


def singletons(edges: DataFrame, base: DataFrame) -> DataFrame:
    """id of the rows that no level-0 edge reaches."""
    reached = edges.where("level = 0 AND src <> dst").select(F.col("dst").alias("_d")).distinct()
    return base.select("id").join(reached, F.col("id") == F.col("_d"), "left_anti")


def linked_singletons(edges: DataFrame, base: DataFrame, knn: DataFrame) -> DataFrame:
    """Edges to every row that none reaches, from its nearest neighbour in ``knn`` (query_id, rank, id)."""
    lone = singletons(edges, base).select(F.col("id").alias("_i"))
    first = knn.where(F.col("query_id") != F.col("id")).groupBy("query_id").agg(F.min_by("id", "rank").alias("near"))
    new = first.join(lone, F.col("query_id") == F.col("_i")).select(F.col("near").alias("src"), F.col("query_id").alias("dst"))
    shard = edges.select(F.col("src").alias("_s"), "shard").distinct()
    own = new.join(shard, F.col("src") == F.col("_s")).select("shard", F.lit(0).alias("level"), "src", "dst")
    return edges.unionByName(own)
