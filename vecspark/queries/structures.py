"""Queries over trained indexes, transforms, graphs and codecs: approximate, so without SQL; tests hold their recall.

Models are trained on a bounded sample, the rows of least hash of id; every row is indexed. Results have the searched
description as ``index_name``, so that one query shows several indexes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vecspark.functions.vectors import Metric
from vecspark.operators import search as S
from vecspark.operators.aggregate import intersection
from vecspark.plans import binary as B
from vecspark.plans import codecs as C
from vecspark.plans import graph, kmeans, transforms as X, tuning
from vecspark.plans.factory import binary_index, vector_index
from vecspark.plans.index import TRAIN_ROWS, VectorIndex, product_modes
from vecspark.queries.searching import K, _both
from vecspark.queries.sql import fold, joined, l2, sql, texts, top
from vecspark.registry import query
from vecspark.sources import tables as T


def built(spark, sf_dir, description: str, metric: Metric = Metric.L2, nprobe: int = 8, k_factor: float | None = None):
    base = T.floats(spark, sf_dir)
    index = vector_index(T.DIM, description, metric)
    if isinstance(index, VectorIndex):
        index.nprobe = max(index.nprobe, nprobe)
        index.k_factor = k_factor or index.k_factor
    return index.train(base).add(base)


def _indexes(name: str, *descriptions: str, metric: Metric = Metric.L2, nprobe: int = 8, k_factor: float | None = None, text: str | None = None) -> None:
    """Searches probe and rescore as much as it takes to find nine of ten true neighbours; tests measure just these settings."""

    @query(f"index_{name}", text)
    def run(spark, sf_dir):
        queries, out = T.as_queries(T.floats(spark, sf_dir)), None
        for d in descriptions:
            found = built(spark, sf_dir, d, metric, nprobe, k_factor).search(queries, K).drop("list_no").withColumn("index_name", F.lit(d))
            out = found if out is None else out.unionByName(found)
        return out.withColumn("dist", F.round("dist", 6)) if text else out


_FLAT = top(f"SELECT fq.query_id, f.id, {fold('({a} - {b}) * ({a} - {b})', 'fq.vec', 'f.vec', 'DOUBLE')} AS dist FROM fq, f", K)
_indexes("flat", "Flat", "Flat,IDMap", text=sql(f"SELECT query_id, rank, id, round(dist, 6) AS dist, index_name FROM ({_FLAT}), (VALUES ('Flat'), ('Flat,IDMap')) n(index_name)"))
_indexes("ivf_flat", "IVF16,Flat", "IVF16,FlatDedup", "IVF16_HNSW32,Flat", "IVF16_NSG32,Flat", nprobe=12)
_indexes("ivf_inner_product", "IVF16,Flat", "IVF16,SQ8", metric=Metric.INNER_PRODUCT, nprobe=12)
_indexes("ivfpq", "IVF16,PQ16x6,RFlat", "IVF16,PQ8x6,Refine(SQ8)", "IVF16,PQ16+32", nprobe=14, k_factor=20)
_indexes("scalar", "SQ8", "SQ6", "SQ4,RFlat", "SQfp16", "IVF16,SQ8", nprobe=14)
_indexes("product", "PQ16x6,RFlat", "PQ32x4fs,RFlat", "IVF16,PQ32x4fs,RFlat", nprobe=14, k_factor=12)
_indexes("additive", "RQ8x5,RFlat", "LSQ8x5,RFlat", "PRQ4x2x5,RFlat", "PLSQ4x2x5,RFlat", "IVF8,RQ8x5,RFlat", k_factor=32)
_indexes("coarse_additive", "IVF32(RCQ2x3),Flat", "IMI2x3,Flat", "Residual2x2,PQ16x5,RFlat", "Residual16,PQ16x5,RFlat", nprobe=56, k_factor=16)
_indexes("transformed", "PCA48,RFlat", "PCAR48,RFlat", "RR64,Flat", "L2norm,Flat", "Pad96,Flat", "OPQ16_64,PQ16x5,RFlat", "ITQ64,LSH,RFlat", "PCA48,IVF16,Flat,RFlat", nprobe=14, k_factor=40)
_indexes("hashed", "LSH,RFlat", "LSHr,RFlat", "LSHt,RFlat", k_factor=50)
_indexes("lattice", "ZnLattice8x14_6,RFlat", "RowMin(SQ8)", "RowMin16(SQ4),RFlat", k_factor=16)
_indexes("graph", "HNSW16", "HNSW16,SQ8", "NSG16", "RR64,HNSW16,Flat")


@query("index_lossy")
def index_lossy(spark, sf_dir):
    """index_name, recall of codes that lose too much for nine of ten without rescoring, or with it."""
    base = T.floats(spark, sf_dir)
    queries = T.as_queries(base)
    truth, out = S.knn(queries, base, K), None
    for d in ("IVF16,PQ16x6", "IVF16,PQ16x6+32x6", "SQ4", "LSH", "ITQ32,SH0.3", "PCAW32,Flat", "RQ8x5"):
        share = intersection(built(spark, sf_dir, d, nprobe=16).search(queries, K), truth, K).select(F.lit(d).alias("index_name"), F.col("share").alias("recall"))
        out = share if out is None else out.unionByName(share)
    return out


@query("index_binary")
def index_binary(spark, sf_dir):
    """Binary indexes by their descriptions."""
    base = T.bits(spark, sf_dir)
    queries, out = T.as_queries(base), None
    for d in ("BFlat", "BIVF8", "BHNSW16", "BHash8x8"):
        index = binary_index(T.DIM, d)
        index.nprobe, index.flips = 6, 2
        found = index.train(base).add(base).search(queries, K).withColumn("index_name", F.lit(d))
        out = found if out is None else out.unionByName(found)
    return out


@query("index_product_modes")
def index_product_modes(spark, sf_dir):
    """The rules of a flat product index: differing bits, differing numbers, symmetric, polysemous."""
    base = T.floats(spark, sf_dir)
    queries = T.as_queries(base)
    index = VectorIndex(codec=C.Product(16, 4)).train(base)
    index.codec.refine_order()
    index.add(base)
    out = None
    for mode in ("hamming", "generalized", "symmetric", "polysemous", "polysemous_generalized"):
        found = product_modes(index, queries, K, mode, ht=24 if mode == "polysemous" else 14).select("query_id", "rank", "id", "dist").withColumn("index_name", F.lit(mode))
        out = found if out is None else out.unionByName(found)
    return out


@query("index_reconstruct")
def index_reconstruct(spark, sf_dir):
    """Every row as its code stands for it."""
    index = built(spark, sf_dir, "IVF16,SQ8")
    return index.reconstruct(index.codes.select("id"))


@query("index_search_and_reconstruct")
def index_search_and_reconstruct(spark, sf_dir):
    return built(spark, sf_dir, "IVF16,SQ8").search_and_reconstruct(T.as_queries(T.floats(spark, sf_dir)), 3)


@query("index_recall")
def index_recall(spark, sf_dir):
    """index_name, recall: the mean share of the true 10 nearest among the 10 found, for indexes that should find nine of ten."""
    base = T.floats(spark, sf_dir)
    queries = T.as_queries(base)
    truth = S.knn(queries, base, K)
    out = None
    for d in ("IVF16,Flat", "IVF16,SQ8", "SQ8", "SQfp16", "IVF16,PQ32x6,RFlat", "PCA48,IVF16,SQ8,RFlat"):
        share = intersection(built(spark, sf_dir, d, nprobe=12).search(queries, K), truth, K).select(F.lit(d).alias("index_name"), F.col("share").alias("recall"))
        out = share if out is None else out.unionByName(share)
    return out


@query("kmeans_train")
def kmeans_train(spark, sf_dir):
    """list_no, centroid after training on the whole table (below the sample's bound)."""
    base = T.floats(spark, sf_dir)
    model = kmeans.KMeans(8, 10).fit(base)
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.centroids)], "list_no int, centroid array<double>")


@query("kmeans_spherical_whole")
def kmeans_spherical_whole(spark, sf_dir):
    base = T.floats(spark, sf_dir)
    rows = kmeans.rows_of(kmeans.sample(base, TRAIN_ROWS))
    a, b = kmeans.KMeans(8, 5, spherical=True).fit_array(rows), kmeans.KMeans(8, 5, whole=True).fit_array(rows * 100)
    return spark.createDataFrame([(k, i, [float(x) for x in c]) for k, m in (("spherical", a), ("whole", b)) for i, c in enumerate(m.centroids)], "kind string, list_no int, centroid array<double>")


@query("kmeans_one_dimension")
def kmeans_one_dimension(spark, sf_dir):
    """The first element's six centroids, from the training sample, and their cost over every row."""
    base = T.floats(spark, sf_dir)
    c, _ = kmeans.kmeans_1d(kmeans.rows_of(kmeans.sample(base, TRAIN_ROWS))[:, 0], 6)
    far = F.array_min(F.array(*[F.pow(F.get("vec", 0).cast("double") - F.lit(float(v)), F.lit(2)) for v in c]))
    cost = base.agg(F.sum(far)).first()[0]
    return spark.createDataFrame([(i, float(v), cost) for i, v in enumerate(c)], "list_no int, centroid double, cost double")


@query("kmeans_progressive")
def kmeans_progressive(spark, sf_dir):
    c = kmeans.progressive(kmeans.rows_of(kmeans.sample(T.floats(spark, sf_dir), TRAIN_ROWS)), 8, 4, 4)
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "list_no int, centroid array<double>")


@query("moments", sql("SELECT i::INTEGER AS i, n, total, " + joined("list(product ORDER BY j) AS products") + " FROM (SELECT a.i, a.j, count(*) AS n, sum(a.x)::BIGINT AS total, sum(a.x * a.y)::BIGINT AS product FROM (SELECT id, i, j, vec[i + 1] AS x, vec[j + 1] AS y FROM v, range(0, 64) r(i), range(0, 64) s(j)) a GROUP BY a.i, a.j) GROUP BY i, n, total"))
def moments(spark, sf_dir):
    """Sums and products of all dimensions, from the covariance that PCA is trained on."""
    n, mean, covariance = X.moments(T.integers(spark, sf_dir))
    products = np.rint((covariance + np.outer(mean, mean)) * n).astype(int)
    rows = [(i, n, int(round(mean[i] * n)), [int(p) for p in products[i]]) for i in range(T.DIM)]
    return texts(spark.createDataFrame(rows, "i int, n bigint, total bigint, products array<bigint>"), "products")


@query("transform_chain")
def transform_chain(spark, sf_dir):
    """Rows through a chain of transforms and back."""
    base = T.floats(spark, sf_dir)
    x = kmeans.rows_of(kmeans.sample(base, 4096))
    chain = [X.Center().train(x), X.Rotation().train(x)]
    return X.transformed(X.transformed(base, chain), chain, reverse=True).select("id", F.transform("vec", lambda v: F.round(v, 6)).alias("vec"))


def _graphs(name: str, kind: str, **more) -> None:
    @query(f"graph_{name}")
    def run(spark, sf_dir):
        queries, base = _both(spark, sf_dir, T.floats)
        return graph.search(queries, base, graph.build(base, kind, **more), K, ef=64)


_graphs("hnsw", "hnsw", m=16)
_graphs("nsg", "nsg", m=16, k=24)
_graphs("descent", "descent", k=24)
_graphs("exact_lists", "knn", k=24)


@query("graph_range")
def graph_range(spark, sf_dir):
    queries, base = _both(spark, sf_dir, T.floats)
    return graph.search(queries, base, graph.build(base, "hnsw", 16), K, ef=64, radius=1.2).select("query_id", "id", "dist")


@query("graph_edges")
def graph_edges(spark, sf_dir):
    return graph.build(T.floats(spark, sf_dir), "knn", k=8)


def _self_knn(spark, sf_dir, k: int):
    base = T.integers(spark, sf_dir)
    return base, S.knn(base.withColumnRenamed("id", "query_id"), base, k, integer=True)


_KNN = f"n AS ({top('SELECT q.id AS query_id, v.id, ' + l2('q.vec', 'v.vec') + ' AS dist FROM v q, v', 6)})"
_EDGES = "e AS (SELECT query_id AS src, id AS dst, dist FROM n WHERE query_id <> id)"


@query("graph_from_neighbours", sql("SELECT 0 AS shard, 0 AS level, src, dst FROM e", _KNN, _EDGES))
def graph_from_neighbours(spark, sf_dir):
    return graph.from_neighbours(_self_knn(spark, sf_dir, 6)[1])


@query("graph_relinked", sql("SELECT src, dst, dist::DOUBLE AS dist, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS rank FROM e) WHERE rank < 3", _KNN, _EDGES))
def graph_relinked(spark, sf_dir):
    base, knn = _self_knn(spark, sf_dir, 6)
    return graph.relinked(graph.from_neighbours(knn), base, 3).select("src", "dst", "dist", "rank")


@query("graph_singletons", sql("SELECT id FROM v WHERE id NOT IN (SELECT dst FROM e)", _KNN, _EDGES))
def graph_singletons(spark, sf_dir):
    base, knn = _self_knn(spark, sf_dir, 6)
    return graph.singletons(graph.from_neighbours(knn), base)


@query("graph_linked_singletons", sql("SELECT count(*) AS lone FROM v WHERE id NOT IN (SELECT dst FROM e) AND id NOT IN (SELECT src FROM e)", _KNN, _EDGES))
def graph_linked_singletons(spark, sf_dir):
    """Rows that no edge reaches after each got one from its nearest neighbour: none."""
    base, knn = _self_knn(spark, sf_dir, 6)
    return graph.singletons(graph.linked_singletons(graph.from_neighbours(knn), base, knn), base).agg(F.count("*").alias("lone"))


@query("graph_from_starts")
def graph_from_starts(spark, sf_dir):
    """A search over one kNN graph of all rows from a given start. All tasks find the links; the walk is one task's."""
    queries, base = _both(spark, sf_dir, T.floats)
    links = graph.from_neighbours(S.knn(base.withColumnRenamed("id", "query_id"), base, 24 + 1))
    edges = graph.with_starts(links, base.where("id = 3").select(F.lit(0).alias("shard"), "id"))
    return graph.search(queries, base, edges, K, ef=64, shards=1)


@query("binary_graph")
def binary_graph(spark, sf_dir):
    """A graph over bits: as vectors of 0 and 1, whose squared distance is the Hamming distance."""
    from vecspark.functions.vectors import unpacked_bits

    base = T.bits(spark, sf_dir).select("id", F.transform(unpacked_bits(F.col("words"), T.DIM), lambda x: x.cast("double")).alias("vec"))
    found = graph.search(T.as_queries(base), base, graph.build(base, "hnsw", 16), K, ef=64)
    return found.select("query_id", "rank", "id", F.col("dist").cast("bigint").alias("dist"))


@query("binary_ivf_trained")
def binary_ivf_trained(spark, sf_dir):
    queries, base = _both(spark, sf_dir, T.bits)
    c = B.binary_centroids(base, T.DIM, 8)
    return B.ivf_search(queries, B.ivf_add(base, c), c, K, 4)


@query("parameter_sweep")
def parameter_sweep(spark, sf_dir):
    """key, perf, t for nprobe 1, 2, 4, 8 of 16 lists."""
    queries, base = _both(spark, sf_dir, T.floats)
    return tuning.explore(built(spark, sf_dir, "IVF16,Flat"), queries, S.knn(queries, base, K), K)


@query("random_results")
def random_results(spark, sf_dir):
    """A baseline: ids by hash of query and rank."""
    queries, base = _both(spark, sf_dir)
    n = base.count()
    picks = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("rank"))
    return picks.select("query_id", "rank", F.pmod(F.xxhash64("query_id", "rank"), F.lit(n)).alias("id"))


def _generated(name: str, make, *arguments) -> None:
    @query(f"generate_{name}")
    def run(spark, sf_dir):
        return make(spark, 1000, 16, *arguments)


_generated("uniform", T.uniform)
_generated("gaussian", T.gaussian)
_generated("whole_numbers", T.whole_numbers, 256)
_generated("smooth", T.smooth)
