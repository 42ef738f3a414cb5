"""Queries over aggregations of vectors, lists and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.operators import aggregate as A
from vecspark.operators import search as S
from vecspark.plans import kmeans
from vecspark.queries.searching import K, _both, _centroids, _ivf, _ivfpq, _whole
from vecspark.queries.sql import LISTS, PAIRS, sql, top
from vecspark.registry import query
from vecspark.sources import tables as T

_DIMS = "u AS (SELECT id, unnest(vec) AS x, unnest(range(0, 64)) AS dim FROM v)"


@query("matrix_stats", sql("SELECT dim::INTEGER AS dim, count(*) AS n, min(x) AS least, max(x) AS greatest, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, sum((x = 128)::INTEGER)::BIGINT AS zeros, 0::BIGINT AS nans FROM u GROUP BY dim", _DIMS))
def matrix_stats(spark, sf_dir):
    shifted = T.integers(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: x - 128))
    s = A.matrix_stats(shifted)
    return s.select("dim", "n", (F.col("least") + 128).alias("least"), (F.col("greatest") + 128).alias("greatest"), F.round(F.col("mean") + 128, 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "zeros", "nans")


@query("row_stats", sql("SELECT count(*) AS n, count(DISTINCT vec) AS distinct_rows, 0::BIGINT AS zero_rows, min(n2)::DOUBLE AS least_norm2, max(n2)::DOUBLE AS greatest_norm2 FROM (SELECT vec, list_sum(list_transform(vec, lambda x: x * x)) AS n2 FROM v)"))
def row_stats(spark, sf_dir):
    return A.row_stats(T.integers(spark, sf_dir))


@query("value_histogram", sql("SELECT label AS value, count(*) AS n FROM v GROUP BY label"))
def value_histogram(spark, sf_dir):
    return A.histogram(T.integers(spark, sf_dir), "label")


@query("binned_histogram", sql("SELECT least(greatest(floor((vec[1] - 100) / 4.0), 0), 15)::BIGINT AS bin, count(*) AS n FROM v GROUP BY 1"))
def binned_histogram(spark, sf_dir):
    return A.binned(T.integers(spark, sf_dir).withColumn("x", F.get("vec", 0)), "x", 100, 4, 16)


@query("bit_histogram", sql("SELECT bit::INTEGER AS bit, sum(x)::BIGINT AS n FROM (SELECT unnest(bits) AS x, unnest(range(0, 64)) AS bit FROM b) GROUP BY bit"))
def bit_histogram(spark, sf_dir):
    return A.bit_histogram(T.bits(spark, sf_dir), "words", 64)


@query("list_sizes", sql("SELECT list_no::INTEGER AS list_no, count(*) AS n FROM a GROUP BY list_no", LISTS))
def list_sizes(spark, sf_dir):
    return _ivf(T.integers(spark, sf_dir)).list_sizes()


@query("list_imbalance", sql("SELECT round(8.0 * sum(n * n) / (sum(n) * sum(n)), 9)::DOUBLE AS imbalance FROM (SELECT list_no, count(*) AS n FROM a GROUP BY list_no)", LISTS))
def list_imbalance(spark, sf_dir):
    return A.imbalance(_ivf(T.integers(spark, sf_dir)).list_sizes(), 8).select(F.round("imbalance", 9).alias("imbalance"))


@query("kmeans_step", sql("SELECT list_no::INTEGER AS list_no, n, (SELECT sum(cd) FROM a a2 WHERE a2.list_no = s.list_no)::BIGINT AS objective, dim::INTEGER AS dim, total FROM (SELECT list_no, dim, count(*) AS n, sum(x)::BIGINT AS total FROM (SELECT list_no, unnest(vec) AS x, unnest(range(0, 64)) AS dim FROM a) GROUP BY list_no, dim) s", LISTS))
def kmeans_step(spark, sf_dir):
    """One iteration: each cluster's size, objective and sums, from which the new centroids come."""
    base = T.integers(spark, sf_dir)
    sums = kmeans.cluster_sums(base, _centroids(base))
    long = sums.select("list_no", "n", F.col("objective").cast("bigint").alias("objective"), F.posexplode(F.array(*[F.col(f"s{j}").cast("bigint") for j in range(64)])).alias("dim", "total"))
    return long.select("list_no", "n", "objective", "dim", "total")


@query("weighted_centroids", sql("SELECT list_no::INTEGER AS list_no, sum(label + 1)::BIGINT AS n, sum(vec[1] * (label + 1))::BIGINT AS s0, sum(vec[2] * (label + 1))::BIGINT AS s1 FROM a GROUP BY list_no", LISTS))
def weighted_centroids(spark, sf_dir):
    base = T.integers(spark, sf_dir)
    rows = kmeans.assigned(base, _centroids(base)).withColumn("w", F.col("label").cast("bigint") + 1)
    return A.centroids(rows, 2, "w")


@query("access_heat", sql("SELECT (query_id // 200)::BIGINT AS batch, p.list_no::INTEGER AS list_no, count(*) AS frequency, count(*) * any_value(s.n) AS heat FROM p JOIN (SELECT list_no, count(*) AS n FROM a GROUP BY list_no) s USING (list_no) GROUP BY 1, 2", LISTS))
def access_heat(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    index = _ivf(base)
    return A.heat(index.probes(queries), index.list_sizes(), 200)


@query("duplicate_codes", sql("SELECT min(id) AS first, count(*) AS n, list_no::INTEGER AS list_no, code FROM (SELECT id, list_no, (vec[1] // 16)::VARCHAR || ',' || (vec[2] // 16)::VARCHAR AS code FROM a) GROUP BY list_no, code HAVING count(*) > 1", LISTS))
def duplicate_codes(spark, sf_dir):
    codes = _ivf(T.integers(spark, sf_dir)).codes
    short = F.concat_ws(",", *[F.floor(F.get("code", i) / 16).cast("string") for i in range(2)]).alias("code")
    return A.duplicates(codes.select("id", "list_no", short), "list_no", "code")


@query("fresh_codes", sql("SELECT id, code, id = min(id) OVER (PARTITION BY code) AS fresh FROM (SELECT id, (vec[1] // 32)::VARCHAR || ',' || (vec[2] // 32)::VARCHAR AS code FROM v)"))
def fresh_codes(spark, sf_dir):
    code = F.concat_ws(",", *[F.floor(F.get("vec", i) / 32).cast("string") for i in range(2)]).alias("code")
    return A.first_of_code(T.integers(spark, sf_dir).select("id", code), "code")


@query("deduplicated_search", sql(top("SELECT q.query_id, v.id, abs(q.vec[1] - v.vec[1]) + abs(q.vec[2] // 8 - v.vec[2] // 8) * 0 AS dist FROM q, v", K)))
def deduplicated_search(spark, sf_dir):
    """Equal vectors (here: of one element) are searched once; the result has all their ids."""
    queries, base = _both(spark, sf_dir)
    short = F.array(F.get("vec", 0)).alias("vec")
    firsts, instances = A.deduplicated(base.select("id", short))
    found = S.knn(queries.select("query_id", short), firsts, K, S.Metric.L1)
    return _whole(A.expanded(found, instances, K))


@query("observed_search", sql(top(PAIRS, K)))
def observed_search(spark, sf_dir):
    found = _whole(S.knn(*_both(spark, sf_dir), K, integer=True))
    return A.counters(found, "search", rows=F.count(F.lit(1)), farthest=F.max("dist"))


@query("ivfpq_list_codes", sql("SELECT list_no::INTEGER AS list_no, count(*) AS n FROM a GROUP BY list_no", LISTS))
def ivfpq_list_codes(spark, sf_dir):
    return _ivfpq(T.integers(spark, sf_dir)).list_sizes()
