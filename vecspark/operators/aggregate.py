"""Aggregations over results, lists, codes and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.operators.search import ranked


def merged(parts: list[DataFrame], k: int, similarity: bool = False) -> DataFrame:
    """The k best of the results (query_id, id, dist) of several shards; one row an id, its best."""
    out = parts[0].select("query_id", "id", "dist")
    for p in parts[1:]:
        out = out.unionByName(p.select("query_id", "id", "dist"))
    best = F.max("dist") if similarity else F.min("dist")
    return ranked(out.groupBy("query_id", "id").agg(best.alias("dist")), k, similarity).select("query_id", "rank", "id", "dist")


def translated(result: DataFrame, id_map: DataFrame) -> DataFrame:
    """A result with the ids of ``id_map`` (id, external_id); -1 where there is none."""
    m = id_map.select(F.col("id").alias("_i"), "external_id")
    return result.join(m, F.col("id") == F.col("_i"), "left").withColumn("id", F.coalesce("external_id", F.lit(-1))).drop("_i", "external_id")


def centroids(assigned: DataFrame, d: int, weight: str | None = None) -> DataFrame:
    """list_no, n, s0, s1, ...: sums of each cluster's vectors (times weight); their means are s / n."""
    w = F.col(weight) if weight else F.lit(1)
    return assigned.groupBy("list_no").agg(F.sum(w).alias("n"), *[F.sum(F.get("vec", j) * w).alias(f"s{j}") for j in range(d)])


def imbalance(sizes: DataFrame, k: int) -> DataFrame:
    """k * sum of squares / square of sum of list sizes: 1 for equal lists."""
    return sizes.agg((F.lit(k) * F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("imbalance"))


def matrix_stats(df: DataFrame) -> DataFrame:
    """For each dimension: count, least, greatest, mean, deviation, zeros and NaNs. Summed up before the shuffle."""
    x = df.select(F.posexplode("vec").alias("dim", "x"))
    return x.groupBy("dim").agg(
        F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"),
        F.sum((F.col("x") == 0).cast("bigint")).alias("zeros"), F.sum(F.isnan(F.col("x").cast("double")).cast("bigint")).alias("nans"),
    )


def row_stats(df: DataFrame) -> DataFrame:
    """One row: vectors, distinct ones, those of zero norm, least and greatest squared norm."""
    n2 = F.aggregate("vec", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x)
    rows = df.select(F.xxhash64("vec").alias("h"), n2.alias("n2")).groupBy("h").agg(F.count("*").alias("c"), F.max("n2").alias("n2"))
    return rows.agg(F.sum("c").alias("n"), F.count("*").alias("distinct_rows"), F.sum(F.when(F.col("n2") == 0, F.col("c")).otherwise(0)).alias("zero_rows"), F.min("n2").alias("least_norm2"), F.max("n2").alias("greatest_norm2"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def binned(df: DataFrame, column: str, low: float, width: float, bins: int) -> DataFrame:
    """Counts of equal bins; what is outside goes to the first or last."""
    b = F.least(F.greatest(F.floor((F.col(column) - low) / width), F.lit(0)), F.lit(bins - 1))
    return df.groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def bit_histogram(df: DataFrame, words: str, d: int) -> DataFrame:
    """For each bit, how many rows have it set."""
    from vecspark.functions.vectors import unpacked_bits

    return df.select(F.posexplode(unpacked_bits(F.col(words), d)).alias("bit", "x")).groupBy("bit").agg(F.sum("x").alias("n"))


def radii(decoded: DataFrame) -> DataFrame:
    """list_no, radius: the greatest norm of a list's decoded residuals (vec), rounded up."""
    n2 = F.aggregate("vec", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x)
    return decoded.select("list_no", n2.alias("n2")).groupBy("list_no").agg(F.ceil(F.sqrt(F.max("n2"))).alias("radius"))


def heat(probes: DataFrame, sizes: DataFrame, batch: int) -> DataFrame:
    """batch, list_no, frequency, heat (frequency times size) of the probes of every ``batch`` queries."""
    freq = probes.groupBy(F.floor(F.col("query_id") / batch).alias("batch"), "list_no").agg(F.count("*").alias("frequency"))
    s = sizes.select(F.col("list_no").alias("_l"), "n")
    return freq.join(s, F.col("list_no") == F.col("_l")).select("batch", "list_no", "frequency", (F.col("frequency") * F.col("n")).alias("heat"))


def duplicates(df: DataFrame, *by: str) -> DataFrame:
    """Groups of ids with equal ``by``, two or more: the group's least id, and how many there are. ``members`` gives the rest."""
    return df.groupBy(*by).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")


def members(df: DataFrame, *by: str) -> DataFrame:
    """id, first: each row beside the least id of its group of two or more; no group is gathered in one row."""
    groups = duplicates(df, *by).select(*[F.col(b).alias(f"_{b}") for b in by], "first")
    return df.join(groups, [F.col(b) == F.col(f"_{b}") for b in by]).select("id", "first")


def first_of_code(df: DataFrame, code: str) -> DataFrame:
    """``df`` with ``fresh``: whether the row has the least id of its code."""
    firsts = df.groupBy(F.col(code).alias("_c")).agg(F.min("id").alias("_f"))
    return df.join(firsts, F.col(code) == F.col("_c")).withColumn("fresh", F.col("id") == F.col("_f")).drop("_c", "_f")


def deduplicated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives (id, vec: the least id of equal vectors) and instances (first, id), by which results are expanded."""
    own = df.select("id", "vec")
    firsts = own.groupBy("vec").agg(F.min("id").alias("first"))
    return firsts.select(F.col("first").alias("id"), "vec"), own.join(firsts, "vec").select("first", "id")


def expanded(result: DataFrame, instances: DataFrame, k: int) -> DataFrame:
    """A result over representatives as one over all rows."""
    both = result.select("query_id", F.col("id").alias("_f"), "dist").join(instances, F.col("_f") == F.col("first"))
    return ranked(both.select("query_id", "id", "dist"), k).select("query_id", "rank", "id", "dist")


def recall_at(result: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """Share of queries whose true nearest is among the first r."""
    first = truth.where("rank = 0").select(F.col("query_id").alias("_q"), F.col("id").alias("_i"))
    hit = first.join(result.where(F.col("rank") < r), (F.col("_q") == F.col("query_id")) & (F.col("_i") == F.col("id")), "left")
    return hit.groupBy("_q").agg(F.count("id").alias("h")).agg(F.avg(F.least("h", F.lit(1))).alias("recall"))


def intersection(result: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """Mean share of the first r true neighbours that are among the first r found."""
    a = result.where(F.col("rank") < r).select("query_id", "id")
    b = truth.where(F.col("rank") < r).select(F.col("query_id").alias("_q"), F.col("id").alias("_i"))
    hits = b.join(a, (F.col("_q") == F.col("query_id")) & (F.col("_i") == F.col("id")), "left")
    return hits.agg((F.count("id") / F.count("*")).alias("share"))


def ties_by_id(result: DataFrame) -> DataFrame:
    """Ranks again, equal distances by id."""
    return result.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("dist", "id")) - 1)


def pareto(points: DataFrame) -> DataFrame:
    """Operating points (key, perf, t) that no faster (or as fast, earlier) point reaches: the frontier."""
    better = F.max("perf").over(W.orderBy("t", F.desc("perf"), "key").rowsBetween(W.unboundedPreceding, -1))
    return points.withColumn("_b", better).where(F.col("_b").isNull() | (F.col("perf") > F.col("_b"))).drop("_b")


def time_for(points: DataFrame, perf: float) -> DataFrame:
    """The least time that reaches a performance."""
    return points.where(F.col("perf") >= perf).agg(F.min("t").alias("t"))


def combined(knn: DataFrame, within: DataFrame) -> DataFrame:
    """Nearest neighbours and all rows within a radius, each id once."""
    both = knn.select("query_id", "id", "dist").unionByName(within.select("query_id", "id", "dist"))
    return both.groupBy("query_id", "id").agg(F.min("dist").alias("dist"))


def counters(result: DataFrame, name: str, **expressions: Column) -> DataFrame:
    """The result, observed under a name: counters that come with the query itself."""
    return result.observe(name, *[e.alias(k) for k, e in expressions.items()])
