"""Queries over exhaustive, inverted-file, binary and graph searches. Queries: every row whose id is divisible by 20."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vecspark.functions import selectors, vectors as V
from vecspark.functions.vectors import Metric
from vecspark.operators import search as S
from vecspark.plans import binary as B
from vecspark.plans import codecs as C
from vecspark.plans import index as I
from vecspark.queries.sql import LISTS, PAIRS, dot, fold, hamming, l2, sql, top
from vecspark.registry import query
from vecspark.sources import tables as T

K = 10


def _both(spark, sf_dir, table=T.integers):
    base = table(spark, sf_dir)
    return T.as_queries(base), base


def _whole(df):
    return df.withColumn("dist", F.col("dist").cast("bigint"))


@query("knn_l2", sql(top(PAIRS, K)))
def knn_l2(spark, sf_dir):
    return _whole(S.knn(*_both(spark, sf_dir), K, integer=True))


@query("knn_inner_product", sql(top(PAIRS.replace(l2("q.vec", "v.vec"), dot("q.vec", "v.vec")), K, True)))
def knn_inner_product(spark, sf_dir):
    return _whole(S.knn(*_both(spark, sf_dir), K, Metric.INNER_PRODUCT))


def _knn_metric(name: str, metric: Metric, expression: str, whole: bool = False, p: float = 2.0):
    pairs = f"SELECT q.query_id, v.id, {expression} AS dist FROM q, v"
    ranked = top(pairs, K, metric.similarity)

    @query(f"knn_{name}", sql(ranked if whole else f"SELECT query_id, rank, id, round(dist, 6) + 0.0 AS dist FROM ({ranked})"))
    def run(spark, sf_dir):
        out = S.knn(*_both(spark, sf_dir), K, metric, p)
        return _whole(out) if whole else out.withColumn("dist", F.round("dist", 6) + F.lit(0.0))


_knn_metric("l1", Metric.L1, fold("abs({a} - {b})", "q.vec", "v.vec"), True)
_knn_metric("linf", Metric.LINF, "list_max(list_transform(list_zip(q.vec, v.vec), lambda p: abs(p[1] - p[2])))::BIGINT", True)
_knn_metric("lp4", Metric.LP, fold("({a} - {b}) * ({a} - {b}) * ({a} - {b}) * ({a} - {b})", "q.vec", "v.vec"), True, 4.0)
_knn_metric("bray_curtis", Metric.BRAY_CURTIS, f"{fold('abs({a} - {b})', 'q.vec', 'v.vec')}::DOUBLE / {fold('{a} + {b}', 'q.vec', 'v.vec')}")
_knn_metric("jaccard", Metric.JACCARD, f"{fold('least({a}, {b})', 'q.vec', 'v.vec')}::DOUBLE / {fold('greatest({a}, {b})', 'q.vec', 'v.vec')}")
_knn_metric("jensen_shannon", Metric.JENSEN_SHANNON, "0.5 * " + fold("(-{a} * ln(({a} + {b}) / 2.0e0 / {a})) + (-{b} * ln(({a} + {b}) / 2.0e0 / {b}))", "q.vec", "v.vec", "DOUBLE"))
_knn_metric("canberra", Metric.CANBERRA, fold("CASE WHEN {a} + {b} = 0 THEN 'NaN'::DOUBLE ELSE abs({a} - {b})::DOUBLE / ({a} + {b}) END", "q.vec", "v.vec", "DOUBLE"))


@query("knn_selected", sql(top(PAIRS + " WHERE v.id % 2 = 1 AND v.id < 300", K)))
def knn_selected(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return _whole(S.knn(queries, base.where(selectors.id_range(0, 300) & (F.col("id") % 2 == 1)), K, integer=True))


@query("knn_padded", sql(f"SELECT q.query_id, r::INTEGER AS rank, coalesce(t.id, -1) AS id, coalesce(t.dist, 0) AS dist FROM q CROSS JOIN range(0, {K}) g(r) LEFT JOIN ({top(PAIRS + ' WHERE v.id < 4', K)}) t ON t.query_id = q.query_id AND t.rank = g.r"))
def knn_padded(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    out = S.knn(queries, base.where("id < 4"), K, integer=True, pad=True)
    return out.select("query_id", "rank", "id", F.when(F.col("id") < 0, 0).otherwise(F.col("dist")).cast("bigint").alias("dist"))


@query("assign_nearest", sql(f"SELECT query_id, id FROM ({top(PAIRS + ' WHERE v.id >= 10', 1)})"))
def assign_nearest(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return S.assign(queries, base.where("id >= 10"), integer=True)


@query("range_l2", sql(f"SELECT * FROM ({PAIRS}) WHERE dist < 20000"))
def range_l2(spark, sf_dir):
    return _whole(S.range_search(*_both(spark, sf_dir), 20000, integer=True))


@query("range_inner_product", sql(f"SELECT * FROM (SELECT q.query_id, v.id, {dot('q.vec', 'v.vec')} AS dist FROM q, v) WHERE dist > 1060000"))
def range_inner_product(spark, sf_dir):
    return _whole(S.range_search(*_both(spark, sf_dir), 1060000, Metric.INNER_PRODUCT))


@query("pairwise_l2", sql(PAIRS))
def pairwise_l2(spark, sf_dir):
    return _whole(S.pairwise(*_both(spark, sf_dir), integer=True))


@query("pairwise_l1", sql(PAIRS.replace(l2("q.vec", "v.vec"), fold("abs({a} - {b})", "q.vec", "v.vec"))))
def pairwise_l1(spark, sf_dir):
    return _whole(S.pairwise(*_both(spark, sf_dir), Metric.L1))


@query("distances_of_pairs", sql(f"SELECT q.query_id, q.query_id + i AS id, CASE WHEN v.id IS NULL THEN 'inf'::DOUBLE ELSE {l2('q.vec', 'v.vec')}::DOUBLE END AS dist FROM q CROSS JOIN range(0, 40, 3) r(i) LEFT JOIN v ON v.id = q.query_id + i"))
def distances_of_pairs(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    pairs = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(39), F.lit(3))).alias("i")).select("query_id", (F.col("query_id") + F.col("i")).alias("id"))
    return S.pair_distances(pairs, queries, base, kind="bigint")


@query("knn_by_ids", sql(top(PAIRS + " WHERE v.id BETWEEN q.query_id + 1 AND q.query_id + 12", 5)))
def knn_by_ids(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    near = F.concat(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.col("query_id") + i), F.array(F.lit(-1).cast("bigint"), F.col("query_id")))
    out = S.knn_by_ids(queries.select("query_id", near.alias("ids")), queries, base, 5, kind="bigint")
    return _whole(out).select("query_id", "rank", "id", "dist")


@query("nearest_numbers", sql(top("SELECT q.query_id, v.id, abs(q.vec[1] - v.vec[1]) AS dist FROM q, v", 5)))
def nearest_numbers(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    x = F.get("vec", 0).alias("x")
    return _whole(S.nearest_1d(queries.select("query_id", x), base.select("id", x), 5))


@query("split_dimensions", sql(f"SELECT query_id, id FROM ({top(PAIRS, 1)})"))
def split_dimensions(spark, sf_dir):
    """Halves of the dimensions searched apart: partial distances of the same rows are summed."""
    queries, base = _both(spark, sf_dir)
    half = lambda d, i: d.withColumn("vec", V.part(F.col("vec"), i, 32))
    parts = [S.pairwise(half(queries, i), half(base, i), integer=True) for i in range(2)]
    total = parts[0].unionByName(parts[1]).groupBy("query_id", "id").agg(F.sum("dist").alias("dist"))
    return S.ranked(total, 1).select("query_id", "id")


# Inverted files, over the eight lists of vectors 0 to 7.


def _centroids(base) -> np.ndarray:
    return np.array([r[0] for r in base.where("id < 8").orderBy("id").select("vec").collect()], np.float64)  # eight rows


def _ivf(base, codec=None, **more) -> I.VectorIndex:
    return I.VectorIndex(nlist=8, codec=codec or C.Flat(), centroids=_centroids(base), nprobe=3, **more).add(base)


IVF_PAIRS = f"SELECT p.query_id, a.id, {l2('p.vec', 'a.vec')} AS dist, a.list_no FROM p JOIN a USING (list_no)"
RANKED = "SELECT query_id, rank::INTEGER AS rank, id, dist, list_no::INTEGER AS list_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) - 1 AS rank FROM ({})) WHERE rank < 10"


@query("ivf_assign", sql("SELECT id, list_no::INTEGER AS list_no FROM a", LISTS))
def ivf_assign(spark, sf_dir):
    return _ivf(T.integers(spark, sf_dir)).codes.select("id", "list_no")


@query("ivf_probes", sql("SELECT query_id, probe, list_no::INTEGER AS list_no, cd::DOUBLE AS cd FROM p", LISTS))
def ivf_probes(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return _ivf(base).probes(queries)


@query("ivf_flat_search", sql(RANKED.format(IVF_PAIRS), LISTS))
def ivf_flat_search(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return _whole(_ivf(base).search(queries, K))


@query("ivf_all_lists", sql(f"SELECT query_id, rank, id, dist FROM ({top(PAIRS, K)})"))
def ivf_all_lists(spark, sf_dir):
    """More probes than lists: the exhaustive result."""
    queries, base = _both(spark, sf_dir)
    return _whole(_ivf(base).search(queries, K, nprobe=50)).drop("list_no")


@query("ivf_selected", sql(RANKED.format(IVF_PAIRS + " WHERE a.id % 3 = 0"), LISTS))
def ivf_selected(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return _whole(_ivf(base).search(queries, K, keep=F.col("id") % 3 == 0))


@query("ivf_preassigned", sql(RANKED.format(f"SELECT q.query_id, a.id, {l2('q.vec', 'a.vec')} AS dist, a.list_no FROM q JOIN a ON a.list_no IN (q.label % 8, (q.label + 1) % 8)"), LISTS))
def ivf_preassigned(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    given = queries.select("query_id", F.explode(F.array(F.col("label") % 8, (F.col("label") + 1) % 8)).alias("list_no"))
    return _whole(_ivf(base).search(queries, K, probes=given))


@query("ivf_range", sql(f"SELECT query_id, id, dist, list_no::INTEGER AS list_no FROM ({IVF_PAIRS}) WHERE dist < 24000", LISTS))
def ivf_range(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return _whole(_ivf(base).range_search(queries, 24000))


@query("ivf_stop_lists", sql(RANKED.format(IVF_PAIRS + " WHERE list_no IN (SELECT list_no FROM a GROUP BY list_no HAVING count(*) < 60)"), LISTS))
def ivf_stop_lists(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return _whole(_ivf(base, stop_size=60).search(queries, K))


@query("ivf_code_budget", sql("SELECT query_id, probe, list_no::INTEGER AS list_no, before::BIGINT AS before, least(n, 100 - before)::BIGINT AS allowed FROM (SELECT p.*, s.n, coalesce(sum(s.n) OVER (PARTITION BY query_id ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN (SELECT list_no, count(*) AS n FROM a GROUP BY list_no) s USING (list_no)) WHERE before < 100", LISTS))
def ivf_code_budget(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    index = _ivf(base)
    return I.visited(index.probes(queries), index.list_sizes(), 100).select("query_id", "probe", "list_no", "before", "allowed")


#: Codebooks: part m of the residuals of vectors 100 to 115 are the 16 codewords of part m (8 parts of 8 dimensions).
BOOK = "w AS (SELECT m::INTEGER AS m, (a.id - 100)::INTEGER AS j, list_transform(range(8 * m + 1, 8 * m + 9), lambda i: a.vec[i] - c.centroid[i]) AS word FROM a JOIN c USING (list_no), range(0, 8) r(m) WHERE a.id BETWEEN 100 AND 115)"
CODES = f"""e AS (SELECT id, list_no, m, j FROM (SELECT a.id, a.list_no, w.m, w.j, row_number() OVER (PARTITION BY a.id, w.m ORDER BY {l2('list_transform(range(8 * w.m + 1, 8 * w.m + 9), lambda i: a.vec[i] - c.centroid[i])', 'w.word')}, w.j) AS n FROM a JOIN c USING (list_no), w) WHERE n = 1),
t AS (SELECT p.query_id, p.list_no, w.m, w.j, {l2('list_transform(range(8 * w.m + 1, 8 * w.m + 9), lambda i: p.vec[i] - c.centroid[i])', 'w.word')} AS d FROM p JOIN c USING (list_no), w)"""
ADC = "SELECT t.query_id, e.id, sum(t.d)::BIGINT AS dist, e.list_no FROM t JOIN e ON e.list_no = t.list_no AND e.m = t.m AND e.j = t.j GROUP BY t.query_id, e.id, e.list_no"


def _ivfpq(base, **more) -> I.VectorIndex:
    centroids = _centroids(base)
    x = np.array([r[0] for r in base.where("id BETWEEN 100 AND 115").orderBy("id").select("vec").collect()], np.float64)  # 16 rows
    from vecspark.plans.kmeans import nearest

    left = x - centroids[nearest(x, centroids)[0]]
    book = np.stack([left[:, 8 * m : 8 * m + 8] for m in range(8)])
    return _ivf(base, C.Product(8, 4, book=book), **more)


@query("ivfpq_codes", sql("SELECT id, list_no::INTEGER AS list_no, string_agg(j::VARCHAR, ',' ORDER BY m) AS code FROM e GROUP BY id, list_no", LISTS, BOOK, CODES))
def ivfpq_codes(spark, sf_dir):
    codes = _ivfpq(T.integers(spark, sf_dir)).codes
    return codes.select("id", "list_no", F.array_join(F.transform("code", lambda x: x.cast("int").cast("string")), ",").alias("code"))


@query("ivfpq_search", sql(RANKED.format(ADC), LISTS, BOOK, CODES))
def ivfpq_search(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return _whole(_ivfpq(base).search(queries, K))


@query("ivfpq_tables", sql("SELECT query_id, list_no::INTEGER AS list_no, string_agg(d::VARCHAR, ',' ORDER BY m, j) AS lut FROM t GROUP BY query_id, list_no", LISTS, BOOK, CODES))
def ivfpq_tables(spark, sf_dir):
    """The table of each query and probed list, in columns: residual, parts and codewords."""
    queries, base = _both(spark, sf_dir)
    index = _ivfpq(base)
    c = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(index.centroids)], "_l int, centroid array<bigint>")
    book = F.array(*[F.array(*[F.lit(int(x)) for x in word]) for part in index.codec.book for word in part])
    probes = index.probes(queries).select(F.col("query_id").alias("_q"), "list_no")
    left = probes.join(queries, F.col("_q") == F.col("query_id")).join(F.broadcast(c), F.col("list_no") == F.col("_l"))
    lut = F.transform(book, lambda word, i: V.l2(F.slice(V.residual(F.col("vec"), F.col("centroid")), (F.floor(i / 16) * 8 + 1).cast("int"), 8), word, "bigint").cast("string"))
    return left.select("query_id", "list_no", F.array_join(lut, ",").alias("lut"))


@query("ivfpq_refined", sql(RANKED.format(f"SELECT t.query_id, t.id, {l2('q.vec', 'v.vec')} AS dist, t.list_no FROM ({RANKED.format(ADC).replace('rank < 10', 'rank < 40')}) t JOIN q USING (query_id) JOIN v ON v.id = t.id"), LISTS, BOOK, CODES))
def ivfpq_refined(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return _whole(_ivfpq(base, refine=C.Flat(), k_factor=4).search(queries, K))


@query("ivfpq_decoded", sql("SELECT e.id, list_sum(list_transform(list_zip(c.centroid, u.word), lambda p: (p[1] + p[2]) * (p[1] + p[2])))::BIGINT AS norm2 FROM (SELECT e.id, e.list_no, flatten(list(w.word ORDER BY e.m)) AS word FROM e JOIN w ON w.m = e.m AND w.j = e.j GROUP BY e.id, e.list_no) u JOIN c USING (list_no) JOIN (SELECT DISTINCT id FROM e) e ON e.id = u.id", LISTS, BOOK, CODES))
def ivfpq_decoded(spark, sf_dir):
    index = _ivfpq(T.integers(spark, sf_dir))
    return index.decode(index.codes).select("id", V.norm2(F.col("vec")).cast("bigint").alias("norm2"))


@query("ivfpq_radii", sql("SELECT list_no::INTEGER AS list_no, ceil(sqrt(max(n2)))::BIGINT AS radius FROM (SELECT e.id, e.list_no, list_sum(list_transform(flatten(list(w.word ORDER BY e.m)), lambda x: x * x))::BIGINT AS n2 FROM e JOIN w ON w.m = e.m AND w.j = e.j GROUP BY e.id, e.list_no) GROUP BY list_no", LISTS, BOOK, CODES))
def ivfpq_radii(spark, sf_dir):
    from dataclasses import replace

    from vecspark.operators.aggregate import radii

    index = _ivfpq(T.integers(spark, sf_dir))
    left = replace(index, by_residual=False)  # decodes the residuals alone
    decoded = left.decode(index.codes).withColumnRenamed("id", "_i")
    return radii(index.codes.select("id", "list_no").join(decoded, F.col("id") == F.col("_i")))


@query("flat_hamming_knn", sql(top(f"SELECT bq.query_id, b.id, {hamming('bq.bits', 'b.bits')} AS dist FROM bq, b", K)))
def flat_hamming_knn(spark, sf_dir):
    return S.hamming_knn(*_both(spark, sf_dir, T.bits), K)


@query("hamming_range", sql(f"SELECT * FROM (SELECT bq.query_id, b.id, {hamming('bq.bits', 'b.bits')} AS dist FROM bq, b) WHERE dist < 24"))
def hamming_range(spark, sf_dir):
    return S.hamming_range(*_both(spark, sf_dir, T.bits), 24)


@query("hamming_matches", sql(f"SELECT * FROM (SELECT bq.query_id, b.id, {hamming('bq.bits', 'b.bits')} AS dist FROM bq, b) WHERE dist <= 22"))
def hamming_matches(spark, sf_dir):
    return S.hamming_range(*_both(spark, sf_dir, T.bits), 22, inclusive=True)


@query("hamming_histogram", sql(f"SELECT dist, count(*) AS n FROM (SELECT {hamming('bq.bits', 'b.bits')} AS dist FROM bq, b) GROUP BY dist"))
def hamming_histogram(spark, sf_dir):
    return S.hamming_histogram(*_both(spark, sf_dir, T.bits))


@query("hamming_count", sql(f"SELECT count(*) AS n FROM (SELECT {hamming('bq.bits', 'b.bits')} AS dist FROM bq, b) WHERE dist <= 24"))
def hamming_count(spark, sf_dir):
    return S.hamming_histogram(*_both(spark, sf_dir, T.bits)).where("dist <= 24").agg(F.sum("n").alias("n"))


BLISTS = f"""bc AS (SELECT id AS list_no, bits AS centroid FROM b WHERE id < 8),
ba AS (SELECT id, bits, list_no FROM (SELECT b.*, bc.list_no, row_number() OVER (PARTITION BY b.id ORDER BY {hamming('b.bits', 'bc.centroid')}, bc.list_no) AS n FROM b, bc) WHERE n = 1),
bp AS (SELECT query_id, bits, list_no FROM (SELECT bq.*, bc.list_no, row_number() OVER (PARTITION BY bq.query_id ORDER BY {hamming('bq.bits', 'bc.centroid')}, bc.list_no) AS n FROM bq, bc) WHERE n <= 3)"""


@query("binary_ivf", sql(top(f"SELECT bp.query_id, ba.id, {hamming('bp.bits', 'ba.bits')} AS dist FROM bp JOIN ba USING (list_no)", K), BLISTS))
def binary_ivf(spark, sf_dir):
    queries, base = _both(spark, sf_dir, T.bits)
    c = np.array([r[0] for r in base.where("id < 8").orderBy("id").select("words").collect()], np.int64).view(np.uint64)  # eight rows
    return B.ivf_search(queries, B.ivf_add(base, c), c, K, 3)


def _hashed(bits: int, tables: int, flips: int) -> str:
    near = " OR ".join(f"{hamming(f'bq.bits[{t * bits + 1}:{(t + 1) * bits}]', f'b.bits[{t * bits + 1}:{(t + 1) * bits}]')} <= {flips}" for t in range(tables))
    return f"SELECT bq.query_id, b.id, {hamming('bq.bits', 'b.bits')} AS dist FROM bq, b WHERE {near}"


@query("binary_hash", sql(top(_hashed(8, 1, 1), K)))
def binary_hash(spark, sf_dir):
    return B.hash_search(*_both(spark, sf_dir, T.bits), K, 8, 1, 1)


@query("binary_multi_hash", sql(top(_hashed(8, 3, 1), K)))
def binary_multi_hash(spark, sf_dir):
    return B.hash_search(*_both(spark, sf_dir, T.bits), K, 8, 3, 1)


@query("binary_hash_range", sql(f"SELECT * FROM ({_hashed(8, 2, 1)}) WHERE dist < 26"))
def binary_hash_range(spark, sf_dir):
    return B.hash_search(*_both(spark, sf_dir, T.bits), K, 8, 2, 1, radius=26)
