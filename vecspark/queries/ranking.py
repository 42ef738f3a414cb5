"""Queries over merging, ranking, sorting and thresholds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.operators import aggregate as A
from vecspark.operators import maintain as M
from vecspark.operators import search as S
from vecspark.queries.searching import K, _both, _ivf, _whole
from vecspark.queries.sql import LISTS, PAIRS, sql, top
from vecspark.registry import query
from vecspark.sources import tables as T


def _shards(spark, sf_dir, n: int = 3):
    queries, base = _both(spark, sf_dir)
    return [S.knn(queries, base.where(F.col("id") % n == i), K, integer=True) for i in range(n)]


@query("merge_shards", sql(top(PAIRS, K)))
def merge_shards(spark, sf_dir):
    return _whole(A.merged(_shards(spark, sf_dir), K))


@query("merge_translated", sql(top(PAIRS.replace("v.id,", "v.id + 1000 AS id,"), K)))
def merge_translated(spark, sf_dir):
    ids = T.integers(spark, sf_dir).select("id", (F.col("id") + 1000).alias("external_id"))
    return _whole(A.merged([A.translated(p, ids) for p in _shards(spark, sf_dir)], K))


@query("query_replicas", sql(top(PAIRS, K)))
def query_replicas(spark, sf_dir):
    """Queries dealt over copies of the base: each copy answers its own."""
    queries, base = _both(spark, sf_dir)
    parts = [S.knn(queries.where(F.col("query_id") % 40 == 20 * i), base, K, integer=True) for i in range(2)]
    return _whole(parts[0].unionByName(parts[1]))


@query("query_batches", sql(f"SELECT (query_id // 100)::BIGINT AS batch, count(*) AS n, sum(dist)::BIGINT AS total FROM ({top(PAIRS, K)}) GROUP BY 1"))
def query_batches(spark, sf_dir):
    found = _whole(S.knn(*_both(spark, sf_dir), K, integer=True))
    return found.groupBy(F.floor(F.col("query_id") / 100).alias("batch")).agg(F.count("*").alias("n"), F.sum("dist").alias("total"))


@query("ties_by_id", sql("SELECT query_id, id, dist, (row_number() OVER (PARTITION BY query_id ORDER BY dist, id) - 1)::INTEGER AS rank FROM (SELECT q.query_id, v.id, abs(q.vec[1] - v.vec[1]) AS dist FROM q, v)"))
def ties_by_id(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    x = F.array(F.get("vec", 0)).alias("vec")
    pairs = S.pairwise(queries.select("query_id", x), base.select("id", x), S.Metric.L1)
    return _whole(A.ties_by_id(pairs).select("query_id", "id", "dist", "rank"))


@query("prefix_offsets", sql("SELECT list_no::INTEGER AS list_no, n, coalesce(sum(n) OVER (ORDER BY list_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM (SELECT list_no, count(*) AS n FROM a GROUP BY list_no)", LISTS))
def prefix_offsets(spark, sf_dir):
    return M.offsets(_ivf(T.integers(spark, sf_dir)).list_sizes())


@query("lists_by_size", sql("SELECT list_no::INTEGER AS list_no, n, row_number() OVER (ORDER BY n DESC, list_no)::INTEGER AS place FROM (SELECT list_no, count(*) AS n FROM a GROUP BY list_no)", LISTS))
def lists_by_size(spark, sf_dir):
    return _ivf(T.integers(spark, sf_dir)).list_sizes().withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "list_no")))


@query("argsort", sql("SELECT row_number() OVER (ORDER BY vec[1], id) - 1 AS at, id FROM v"))
def argsort(spark, sf_dir):
    return M.sorted_by(T.integers(spark, sf_dir).withColumn("x", F.get("vec", 0)), "x")


@query("bucket_sort", sql("SELECT label AS value, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS at, id FROM v"))
def bucket_sort(spark, sf_dir):
    return M.bucketed(T.integers(spark, sf_dir), "label")


@query("bulk_lookup", sql("SELECT id * 3 AS key, CASE WHEN id * 3 IN (SELECT id FROM v) THEN id * 3 + 7 ELSE -1 END AS value FROM v"))
def bulk_lookup(spark, sf_dir):
    base = T.integers(spark, sf_dir)
    return M.looked_up(base.select((F.col("id") * 3).alias("key")), base.select(F.col("id").alias("key"), (F.col("id") + 7).alias("value")))


@query("fuzzy_threshold", sql("SELECT count(*) BETWEEN 90 AND 260 AS inside FROM v WHERE vec[1] <= (SELECT max(x) FROM (SELECT vec[1] AS x FROM v ORDER BY 1 LIMIT 150))"))
def fuzzy_threshold(spark, sf_dir):
    rows = T.integers(spark, sf_dir).select(F.get("vec", 0).alias("x"))
    return M.fuzzy_limit(rows, "x", 100, 200).select(F.col("n").between(90, 260).alias("inside"))


@query("pareto_frontier", sql("SELECT key, perf, t FROM (SELECT *, max(perf) OVER (ORDER BY t, perf DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT id AS key, vec[1] AS perf, vec[2] AS t FROM v)) WHERE best IS NULL OR perf > best"))
def pareto_frontier(spark, sf_dir):
    return A.pareto(T.integers(spark, sf_dir).select(F.col("id").alias("key"), F.get("vec", 0).alias("perf"), F.get("vec", 1).alias("t")))


@query("time_for_performance", sql("SELECT min(vec[2]) AS t FROM v WHERE vec[1] >= 150"))
def time_for_performance(spark, sf_dir):
    return A.time_for(T.integers(spark, sf_dir).select(F.get("vec", 0).alias("perf"), F.get("vec", 1).alias("t")), 150)


@query("combined_knn_range", sql(f"SELECT query_id, id, min(dist) AS dist FROM (SELECT query_id, id, dist FROM ({top(PAIRS, 3)}) UNION ALL SELECT * FROM ({PAIRS}) WHERE dist < 22000) GROUP BY query_id, id"))
def combined_knn_range(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return _whole(A.combined(S.knn(queries, base, 3, integer=True), S.range_search(queries, base, 22000, integer=True)))


_TRUE = top(PAIRS, K)
_FOUND = "SELECT query_id, rank::INTEGER AS rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) - 1 AS rank FROM (SELECT p.query_id, a.id, list_sum(list_transform(list_zip(p.vec, a.vec), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS dist FROM p JOIN a USING (list_no))) WHERE rank < 10"


@query("one_recall", sql(f"SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM ({_FOUND}) f WHERE f.query_id = t.query_id AND f.id = t.id) THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS recall FROM ({_TRUE}) t WHERE t.rank = 0", LISTS))
def one_recall(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return A.recall_at(_ivf(base).search(queries, K), S.knn(queries, base, K, integer=True), K).select(F.round("recall", 9).alias("recall"))


@query("intersection_share", sql(f"SELECT round(count(f.id)::DOUBLE / count(*), 9) AS share FROM ({_TRUE}) t LEFT JOIN ({_FOUND}) f ON f.query_id = t.query_id AND f.id = t.id", LISTS))
def intersection_share(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return A.intersection(_ivf(base).search(queries, K), S.knn(queries, base, K, integer=True), K).select(F.round("share", 9).alias("share"))


@query("smallest_sums", sql("SELECT query_id, rank::INTEGER AS rank, i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, i, j) - 1 AS rank FROM (SELECT q.query_id, a.id AS i, b.id AS j, abs(q.vec[1] - a.vec[1]) + abs(q.vec[2] - b.vec[2]) AS d FROM q, v a, v b)) WHERE rank < 8"))
def smallest_sums(spark, sf_dir):
    """The smallest sums of one entry of each of two tables: only the 8 smallest of each can be in them."""
    queries, base = _both(spark, sf_dir)
    words = base.select("id", F.get("vec", 0).alias("x"), F.get("vec", 1).alias("y"))
    found = []
    for name, i in (("x", 0), ("y", 1)):
        numbers = queries.select("query_id", F.get("vec", i).alias("x"))
        found.append(_whole(S.nearest_1d(numbers, words.select("id", F.col(name).alias("x")), 8)).drop("rank"))
    a, b = found[0].select("query_id", F.col("id").alias("i"), F.col("dist").alias("d1")), found[1].select(F.col("query_id").alias("_q"), F.col("id").alias("j"), F.col("dist").alias("d2"))
    sums = a.join(b, F.col("query_id") == F.col("_q")).withColumn("d", F.col("d1") + F.col("d2"))
    return sums.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("d", "i", "j")) - 1).where("rank < 8").select("query_id", "rank", "i", "j", "d")
