"""Trained models: codecs, transforms, k-means, graphs, layouts; recall against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark.operators import search as S
from vecspark.operators.aggregate import intersection
from vecspark.plans import codecs as C
from vecspark.plans import graph
from vecspark.plans import layout as L
from vecspark.plans import transforms as X
from vecspark.plans.factory import codec_of, split_parts, vector_index
from vecspark.plans.index import VectorIndex
from vecspark.plans.kmeans import KMeans, kmeans_1d, split_empty
from vecspark.sources import tables as T

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(1)
POINTS = RNG.normal(size=(400, 16)) + 4 * RNG.integers(0, 4, 400)[:, None]


def test_kmeans_objective_falls_and_rejects():
    model = KMeans(4, 10).fit_array(POINTS)
    assert model.objective[-1] <= model.objective[0]
    with pytest.raises(ValueError):
        KMeans(5).fit_array(POINTS[:4])
    with pytest.raises(ValueError):
        KMeans(2).fit_array(np.array([[np.nan], [1.0]]))


def test_kmeans_over_a_table_equals_one_in_place(spark, monkeypatch):
    from vecspark.plans import kmeans

    base = T.floats(spark, SF)
    start = kmeans.rows_of(base.where("id < 4"))
    near = KMeans(4, 3, initial=start).fit(base).centroids
    monkeypatch.setattr(kmeans, "LOCAL_BYTES", 0)
    assert np.allclose(near, KMeans(4, 3, initial=start).fit(base).centroids)


def test_split_empty_takes_the_largest():
    c, n = np.array([[1.0, 2.0], [0.0, 0.0]]), np.array([10, 0])
    assert split_empty(c, n) == 1 and n.tolist() == [5, 5] and not np.array_equal(c[0], c[1])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=3, max_size=9), st.integers(1, 3))
def test_kmeans_1d_is_optimal(values, k):
    from itertools import combinations

    x = np.sort(np.array(values, float))
    cost = min(sum(((p - p.mean()) ** 2).sum() for p in np.split(x, list(cut))) for cut in combinations(range(1, len(x)), k - 1))
    assert kmeans_1d(x, k)[1] == pytest.approx(cost, abs=1e-6)


@pytest.mark.parametrize("codec", [C.Product(4, 4), C.Scalar("8bit"), C.Scalar("4bit", "quantiles", 0.01), C.Scalar("8bit", "optim"), C.Scalar("fp16"), C.Residual(3, 4), C.LocalSearch(3, 4, rounds=1), C.Split(2, C.Residual, 2, 4), C.RowRange(C.Scalar("8bit")), C.Lattice(2, 14, 6)], ids=lambda c: type(c).__name__)
def test_codecs_keep_most_of_the_variance(codec):
    codec.train(POINTS)
    left = ((codec.decode(codec.encode(POINTS)) - POINTS) ** 2).sum()
    assert left < 0.5 * ((POINTS - POINTS.mean(0)) ** 2).sum()


def test_product_tables_equal_decoded_distances():
    codec = C.Product(4, 4).train(POINTS)
    codes = codec.encode(POINTS[:50])
    want = S.distances(S.Metric.L2, POINTS[:5], codec.decode(codes))
    assert np.allclose(codec.by_tables(codec.tables(POINTS[:5]), codes), want)
    small, scale, bias = C.small_tables(codec.tables(POINTS[:5]))
    sums = sum(small[:, i, codes[:, i]] for i in range(4)) / scale[:, None] + bias[:, None]
    assert np.abs(sums - want).max() < 0.05 * want.max()


def test_residual_beam_is_no_worse_than_greedy():
    codec = C.Residual(3, 3, beam=1).train(POINTS)
    error = lambda c: ((c.decode(c.encode(POINTS)) - POINTS) ** 2).sum()
    greedy = error(codec)
    codec.beam = 5
    assert error(codec) <= greedy
    a, b = codec.split(1)
    assert len(a.books) == 1 and len(b.books) == 2 and a.all_sums().shape == (8, 16)


def test_transforms_go_back():
    for t in (X.Rotation(), X.PCA(), X.Center(), X.PCA(bins=4)):
        t.train(POINTS)
        assert np.allclose(t.reverse(t.apply(POINTS)), POINTS, atol=1e-6)
    with pytest.raises(ValueError):
        X.Linear(np.ones((2, 16))).reverse(POINTS[:, :2])
    pad = X.Remap.padded(16, 24)
    assert pad.apply(POINTS).shape == (400, 24) and np.array_equal(pad.reverse(pad.apply(POINTS)), POINTS)
    assert np.allclose(np.cov(X.PCA(power=-0.5).train(POINTS).apply(POINTS).T, bias=True), np.eye(16), atol=1e-6)
    for t in (X.ITQ(d=8, iterations=5), X.OPQ(m=4, iterations=12, bits=4)):
        assert t.train(POINTS).orthonormal


def test_moments_equal_numpy(spark):
    base = T.floats(spark, SF)
    x = np.array([r[0] for r in base.select("vec").collect()])
    n, mean, covariance = X.moments(base)
    assert n == len(x) and np.allclose(mean, x.mean(0)) and np.allclose(covariance, np.cov(x.T, bias=True))


@pytest.mark.parametrize("text", ["Flat", "IVF16,SQ8", "IVF16,PQ32x5,RFlat", "PCA48,SQfp16,RFlat", "OPQ8_32,IVF4,PQ8x4,Refine(SQ8)"])
def test_indexes_find_nine_of_ten(spark, text):
    base = T.floats(spark, SF)
    queries = T.as_queries(base)
    index = vector_index(64, text)
    index.nprobe, index.k_factor = 16, 16.0
    found = index.train(base).add(base).search(queries, 10)
    assert intersection(found, S.knn(queries, base, 10), 10).first()[0] >= 0.9


@pytest.mark.parametrize("shift", [0.0, 1e6, 1e150])
def test_products_lose_no_neighbour(shift):
    """Far from the origin, where products lose all digits, with equal rows, NaN and infinity: as by differences."""
    rng = np.random.default_rng(5)
    q, b = rng.normal(size=(7, 12)) + shift, rng.normal(size=(300, 12)) + shift
    b[40:60], b[3, 2], b[4, 1], q[6, 0] = b[10], np.nan, np.inf, np.nan
    exact, made = S.Best(7, 9, False), S.Best(7, 9, False)
    ids = rng.permutation(300)
    with np.errstate(all="ignore"):
        for i in range(0, 300, 100):
            exact.add(S.distances(S.Metric.L2, q, b[i : i + 100]), ids[i : i + 100])
            x, y = S.near_rows(q, b[i : i + 100], 9, made.worst)
            made.add_rows(x, S.paired(S.Metric.L2, q[x], b[i + y]), ids[i + y])
    assert len(made.id) == 6 * 9
    assert (made.query == exact.query).all() and (made.id == exact.id).all() and (made.dist == exact.dist).all()


@pytest.mark.parametrize("text", ["BFlat", "BIVF4", "BHash6x8", "BHNSW8"])
def test_saved_binary_indexes_find_the_same(spark, tmp_path, text):
    from vecspark.plans.binary import load_binary
    from vecspark.plans.factory import binary_index

    base = T.bits(spark, SF).select("id", "words")
    index = binary_index(T.DIM, text).train(base).add(base)
    index.nprobe = 3
    index.save(str(tmp_path))
    back, queries = load_binary(spark, str(tmp_path)), T.as_queries(base)
    assert (back.kind, back.size, back.tables, back.nprobe) == (index.kind, index.size, index.tables, 3)
    found = sorted(map(tuple, back.search(queries, 5).collect()))
    assert found and found == sorted(map(tuple, index.search(queries, 5).collect()))


def test_second_level_codes_what_the_first_leaves():
    x = np.random.default_rng(3).normal(size=(600, 16))
    codec = vector_index(16, "IVF4,PQ4x4+8x5").codec.train(x)
    codes = codec.encode(x)
    assert codes.shape == (600, 12) and codes[:, :4].max() < 16 and codes[:, 4:].max() < 32
    first = codec.first.decode(codes[:, :4])
    assert np.allclose(codec.decode(codes) - first, codec.second.decode(codec.second.encode(x - first)))
    assert ((x - codec.decode(codes)) ** 2).sum() < 0.5 * ((x - first) ** 2).sum()


REGISTERED = ("flat", "ivf_flat", "ivf_inner_product", "ivfpq", "scalar", "product", "additive", "coarse_additive", "transformed", "hashed", "lattice", "graph")


@pytest.fixture(scope="session")
def truth(spark):
    """True neighbours at sf0.1 by metric."""
    base = T.floats(spark, "/root/testdata/sf0.1")
    return {m: {(r.query_id, r.id) for r in S.knn(T.as_queries(base), base, 10, metric=m).collect()} for m in (S.Metric.L2, S.Metric.INNER_PRODUCT)}


@pytest.mark.parametrize("name", REGISTERED)
def test_registered_indexes_find_nine_of_ten(spark, truth, name):
    """As registered, with no settings of the test's own."""
    import vecspark.queries  # noqa: F401
    from vecspark import registry

    want = truth[S.Metric.INNER_PRODUCT if name == "ivf_inner_product" else S.Metric.L2]
    found: dict[str, set] = {}
    for r in registry.queries()[f"index_{name}"](spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.index_name, set()).add((r.query_id, r.id))
    shares = {d: round(len(pairs & want) / len(want), 3) for d, pairs in found.items()}
    assert shares and min(shares.values()) >= 0.9, shares


def test_binary_indexes_find_nine_of_ten(spark):
    from vecspark import registry

    rows = registry.queries()["index_binary"](spark, "/root/testdata/sf0.1").collect()
    worst = {r.query_id: r.dist for r in rows if r.index_name == "BFlat" and r["rank"] == 9}
    near = {d: sum(r.dist <= worst[r.query_id] for r in rows if r.index_name == d) / (10 * len(worst)) for d in ("BIVF8", "BHNSW16", "BHash8x8")}
    assert min(near.values()) >= 0.9, near


def test_probed_lists_are_the_only_ones_read(spark, tmp_path):
    """A saved index is read by list; product codes take two bytes a part."""
    from vecspark.plans.index import load

    base = T.floats(spark, SF)
    index = vector_index(64, "IVF16,PQ8x4").train(base).add(base)
    assert dict(index.codes.dtypes)["code"] == "array<smallint>"
    index.save(f"{tmp_path}/i")
    again = load(spark, f"{tmp_path}/i")
    one = T.as_queries(base).limit(1)
    plan = again.search(one, 5, nprobe=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_no" in plan
    assert sorted(map(tuple, again.search(one, 5, nprobe=2).collect())) == sorted(map(tuple, index.search(one, 5, nprobe=2).collect()))


@pytest.mark.parametrize("kind", ["hnsw", "nsg", "descent"])
def test_graphs_find_nine_of_ten(spark, kind):
    base = T.floats(spark, SF)
    queries = T.as_queries(base)
    found = graph.search(queries, base, graph.build(base, kind, m=16, k=24, shards=2), 10, ef=64, shards=2)
    assert intersection(found, S.knn(queries, base, 10), 10).first()[0] >= 0.9


def test_factory_grammar():
    assert split_parts("A,B(C,D),E") == ["A", "B(C,D)", "E"]
    assert isinstance(codec_of("PQ8x4fs", 64), C.Product) and isinstance(codec_of("PLSQ2x2x4", 64), C.Split)
    assert vector_index(64, "PCAW16,IVF8_HNSW32,PQ4x4np,IDMap2").nlist == 8
    with pytest.raises(ValueError):
        vector_index(64, "Nothing7")


def test_merge_needs_equal_models(spark):
    base = T.floats(spark, SF)
    a = vector_index(64, "IVF4,SQ8").train(base)
    whole = a.add(base.where("id % 2 = 0")).merged(a.empty().add(base.where("id % 2 = 1")))
    assert whole.codes.count() == base.count()
    with pytest.raises(ValueError):
        whole.merged(vector_index(64, "IVF8,SQ8").train(base).add(base))
    assert whole.removed(F.col("id") < 100).codes.count() == base.where("id >= 100").count()


def test_equal_vectors_have_one_code(spark, tmp_path):
    from vecspark.plans.index import load

    base = T.floats(spark, SF).where("id < 100")
    twice = base.unionByName(base.withColumn("id", F.col("id") + 1000))
    index = vector_index(64, "IVF4,FlatDedup").train(base).add(twice)
    index.nprobe = 4
    assert index.codes.count() == 100 and index.instances.count() == 200
    queries = T.as_queries(base)
    want = sorted(map(tuple, S.knn(queries, twice, 6).select("query_id", "id").collect()))
    index.save(str(tmp_path))
    assert sorted(map(tuple, load(spark, str(tmp_path)).search(queries, 6).select("query_id", "id").collect())) == want
    left = index.removed(F.col("id") < 1000).search(queries, 1)
    assert {(r.query_id, r.id) for r in left.collect()} == {(r.query_id, r.query_id + 1000) for r in queries.collect()}


def test_edge_rows(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [float("nan"), 0.0]), (4, None)]
    base = spark.createDataFrame(rows, "id bigint, vec array<double>")
    queries = base.withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.rank): (r.id, r.dist) for r in S.knn(queries, base, 5, pad=True).collect()}
    assert got[1, 0] == (1, 0.0) and got[1, 1] == (2, 0.0) and got[1, 2] == (0, 1.0) and got[1, 3][0] == -1
    assert got[3, 0][0] == -1 and got[4, 0][0] == -1
    with pytest.raises(ValueError):
        S.knn(queries, base, 0)
    assert VectorIndex().add(base).codes.count() == 3
    empty = base.where("false")
    assert S.knn(queries, empty, 3).count() == 0 and S.knn(empty.withColumnRenamed("id", "query_id"), base, 3).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9), st.integers(1, 3)), min_size=1, max_size=25), st.integers(1, 6))
def test_layout_covers_every_slice(lists, units):
    rows = [(no, n, float(f), c) for no, (n, f, c) in enumerate(lists)]
    plan = L.plan(rows, units, L.Costs(10, 100, 5, 2), 8)
    for no, n, f, c in rows:
        own = [(a, b) for _, x, a, b in plan if x == no]
        slices = max(1, -(-n // 8))
        assert {s for a, b in own for s in range(a, b)} == set(range(slices))
    assert len({(u, no) for u, no, _, _ in plan}) == len(plan)


def _batches(name: str, values: np.ndarray, rows: int, **more):
    """Arrow batches of id, the values' rows under ``name``, and other columns."""
    import pyarrow as pa

    for i in range(0, len(values), rows):
        part = values[i : i + rows]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1]), pa.int32()), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), lists, *[pa.array(c[i : i + rows]) for c in more.values()]], ["id", name, *more])


def _peak(run):
    """What it gives, and the bytes that it holds at most."""
    import tracemalloc

    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


MODES = ("hamming", "generalized", "symmetric", "polysemous", "polysemous_generalized")


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("m,bits", [(4, 4), (16, 5), (8, 3)])
def test_product_modes_equal_all_pairs(spark, mode, m, bits):
    """Codes of one word and of two, ties by id, more queries than a tile has."""
    from vecspark.plans.index import product_modes

    x = np.round(POINTS, 1)
    base = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "id bigint, vec array<double>")
    index, ht = VectorIndex(codec=C.Product(m, bits)).train_array(x).add(base), 2 * m if mode == "polysemous" else m // 2 + 1
    y, codes, codec = x[:300], index.codec.encode(x), index.codec
    own = codes[:300]
    n = {True: (own[:, None, :] != codes[None]).sum(2), False: np.bitwise_count(own[:, None, :] ^ codes[None]).astype(int).sum(2)}["generalized" in mode]
    if mode == "symmetric":
        d = sum(codec.code_distances()[i][own[:, i, None], codes[None, :, i]] for i in range(m))
    else:
        d = n if mode in ("hamming", "generalized") else np.where(n < ht, codec.by_tables(codec.tables(y), codes), np.nan)
    want = []
    for q, row in enumerate(d):
        order = [i for i in np.lexsort((np.arange(len(row)), row)) if not np.isnan(row[i])][:7]
        want += [(q, r, i, float(row[i])) for r, i in enumerate(order)]
    found = product_modes(index, base.where("id < 300").withColumnRenamed("id", "query_id"), 7, mode, ht).select("query_id", "rank", "id", "dist")
    assert sorted(map(tuple, found.collect())) == want


def _task(monkeypatch, spark, module, search):
    """What a search runs on the base's partitions: task(block, batches)."""
    tasks = []
    monkeypatch.setattr(module, "blockwise", lambda base, blocks, task, schema: tasks.append(task) or spark.createDataFrame([], schema))
    search()
    return tasks[0]


@pytest.mark.parametrize("mode", MODES)
def test_product_modes_hold_few_pairs(spark, monkeypatch, mode):
    """2,000 queries by a batch of 5,000 codes: 10 million pairs of 16 numbers."""
    from vecspark.plans import index as module

    x = np.random.default_rng(2).normal(size=(5000, 64))
    index = VectorIndex(codec=C.Product(16, 4)).train_array(x[:1000]).add(T.floats(spark, SF))
    task = _task(monkeypatch, spark, module, lambda: module.product_modes(index, T.as_queries(T.floats(spark, SF)), 10, mode, 24 if mode == "polysemous" else 14))
    batches = list(_batches("code", index.codec.encode(x).astype(np.int16), 5000))
    found, peak = _peak(lambda: list(task((np.arange(2000), x[:2000]), batches)))
    assert sum(map(len, found)) == 20_000 and peak < 300e6


@pytest.mark.parametrize("similarity", [False, True])
def test_best_of_blocks_equals_sorting(similarity):
    """Ties, infinities and NaN, which some rows have nothing but."""
    rng = np.random.default_rng(8)
    d = rng.integers(0, 30, (6, 900)).astype(float)
    d[0, 5:], d[1], d[2, ::3], d[3, 4:700] = np.nan, np.nan, np.nan, np.inf
    ids, best = rng.permutation(900), S.Best(6, 7, similarity)
    for i in range(0, 900, 300):
        best.add(d[:, i : i + 300], ids[i : i + 300])
    want = [(q, v, j) for q in range(6) for v, j in sorted(((-1 if similarity else 1) * v, j) for v, j in zip(d[q], ids, strict=True) if v == v)[:7]]
    assert list(zip(best.query, best.dist, best.id, strict=True)) == want


def test_binary_lists_hold_few_pairs(spark, monkeypatch):
    """3,000 queries by a batch of 4,000 rows in two lists, of which some queries probe one: 10 million pairs."""
    from vecspark.plans import binary as module

    rng = np.random.default_rng(6)
    base, queries = T.bits(spark, SF), T.as_queries(T.bits(spark, SF))
    centroids = np.array([[0], [2**64 - 1]], np.uint64)
    words, lists = rng.integers(-(2**63), 2**63 - 1, (4000, 1)), rng.integers(0, 2, 4000).astype(np.int32)
    task = _task(monkeypatch, spark, module, lambda: module.ivf_search(queries, module.ivf_add(base, centroids), centroids, 10, 2))
    q, probing = words[:3000].view(np.uint64), {0: np.arange(3000), 1: np.arange(0, 3000, 7)}
    batches = list(_batches("words", words, 4000, list_no=lists))
    found, peak = _peak(lambda: list(task((np.arange(3000), q, probing), batches)))
    assert peak < 300e6
    got = sorted((r["query_id"], r["dist"], r["id"]) for b in found for r in b.to_pylist())
    want = []
    for i in range(3000):
        own = np.flatnonzero(lists == 0) if i % 7 else np.arange(4000)
        d = np.bitwise_count(q[i] ^ words[own, 0].view(np.uint64)).astype(int)
        want += [(i, int(d[j]), int(own[j])) for j in np.lexsort((own, d))[:10]]
    assert got == want


def test_one_graph_is_linked_by_all_tasks(spark):
    """From a given start: as over the lists that one task finds, which no task does."""
    import vecspark.queries  # noqa: F401
    from vecspark import registry

    found = registry.queries()["graph_from_starts"](spark, SF)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    base = T.floats(spark, SF)
    edges = graph.with_starts(graph.build(base, "knn", k=24, shards=1), base.where("id = 3").select(F.lit(0).alias("shard"), "id"))
    want = graph.search(T.as_queries(base), base, edges, 10, ef=64, shards=1)
    got = sorted(map(tuple, found.select("query_id", "rank", "id", "dist").collect()))
    assert len(got) == 250 and got == sorted(map(tuple, want.select("query_id", "rank", "id", "dist").collect()))
