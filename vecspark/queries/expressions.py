"""Queries over vector, bit and code expressions, and selectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.functions import selectors, vectors as V
from vecspark.functions.vectors import Metric
from vecspark.queries.sql import dot, fold, hamming, joined, l2, sql, texts
from vecspark.registry import query
from vecspark.sources import tables as T

X, Y = "vec", "other"


def _pairs(spark, sf_dir, table=T.integers):
    """Each row beside the one whose id is the next lower multiple of 20."""
    base = table(spark, sf_dir)
    other = base.select(F.col("id").alias("_id"), *[F.col(c).alias("other") for c in base.columns if c in ("vec", "words")])
    return base.join(other, F.col("_id") == F.col("id") - F.pmod("id", F.lit(20))).drop("_id")


PAIRED = "w AS (SELECT v.id, v.vec, o.vec AS other FROM v JOIN v o ON o.id = v.id - v.id % 20)"
FPAIRED = "w AS (SELECT f.id, f.vec, o.vec AS other FROM f JOIN f o ON o.id = f.id - f.id % 20)"
BPAIRED = "w AS (SELECT b.id, b.bits, o.bits AS other FROM b JOIN b o ON o.id = b.id - b.id % 20)"


def _metric(name: str, expression: str, build):
    @query(f"metric_{name}", sql(f"SELECT id, {expression} AS dist FROM w", PAIRED))
    def run(spark, sf_dir):
        return _pairs(spark, sf_dir).select("id", build().alias("dist"))


_metric("l2", l2("vec", "other"), lambda: V.l2(X, Y, "bigint"))
_metric("inner_product", dot("vec", "other"), lambda: V.inner_product(X, Y, "bigint"))
_metric("l1", fold("abs({a} - {b})", "vec", "other"), lambda: V.l1(X, Y, "bigint"))
_metric("linf", "list_max(list_transform(list_zip(vec, other), lambda p: abs(p[1] - p[2])))::BIGINT", lambda: V.linf(X, Y, "bigint"))
_metric("lp3", fold("abs({a} - {b}) * abs({a} - {b}) * abs({a} - {b})", "vec", "other") + "::DOUBLE", lambda: F.round(V.lp(X, Y, 3)))
_metric("canberra", "round(" + fold("CASE WHEN {a} + {b} = 0 THEN 'NaN'::DOUBLE ELSE abs({a} - {b})::DOUBLE / ({a} + {b}) END", "vec", "other", "DOUBLE") + ", 6)", lambda: F.round(V.canberra(X, Y), 6))
_metric("bray_curtis", f"round({fold('abs({a} - {b})', 'vec', 'other')}::DOUBLE / {fold('{a} + {b}', 'vec', 'other')}, 6)", lambda: F.round(V.bray_curtis(X, Y, "bigint"), 6))
_metric("jensen_shannon", "round(0.5 * " + fold("(-{a} * ln(({a} + {b}) / 2.0 / {a})) + (-{b} * ln(({a} + {b}) / 2.0 / {b}))", "vec", "other", "DOUBLE") + ", 6) + 0.0", lambda: F.round(V.jensen_shannon(X, Y), 6) + F.lit(0.0))
_metric("jaccard", f"round({fold('least({a}, {b})', 'vec', 'other')}::DOUBLE / {fold('greatest({a}, {b})', 'vec', 'other')}, 6)", lambda: F.round(V.jaccard(X, Y, "bigint"), 6))


@query("metric_directions", "SELECT * FROM (VALUES ('INNER_PRODUCT', 0, true), ('L2', 1, false), ('L1', 2, false), ('LINF', 3, false), ('LP', 4, false), ('CANBERRA', 20, false), ('BRAY_CURTIS', 21, false), ('JENSEN_SHANNON', 22, false), ('JACCARD', 23, true)) t(name, number, similarity)")
def metric_directions(spark, sf_dir):
    return spark.createDataFrame([(m.name, int(m), m.similarity) for m in Metric], "name string, number int, similarity boolean")


@query("vector_norms", sql("SELECT id, list_sum(list_transform(vec, lambda x: x * x))::BIGINT AS norm2, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))::BIGINT), 9) AS norm FROM v"))
def vector_norms(spark, sf_dir):
    return T.integers(spark, sf_dir).select("id", V.norm2(X, "bigint").alias("norm2"), F.round(F.sqrt(V.norm2(X, "bigint")), 9).alias("norm"))


@query("vector_unit", sql("SELECT id, " + joined("list_transform(vec, lambda x: floor(x / sqrt(list_sum(list_transform(vec, lambda y: y * y))::BIGINT) * 1e6)::BIGINT) AS unit") + " FROM v"))
def vector_unit(spark, sf_dir):
    return texts(T.integers(spark, sf_dir).select("id", F.transform(V.unit(X), lambda x: F.floor(x * 1e6)).alias("unit")), "unit")


@query("vector_arithmetic", sql("SELECT id, " + joined("list_transform(list_zip(vec, other), lambda p: p[1] + p[2]) AS added", "list_transform(list_zip(vec, other), lambda p: p[1] - p[2]) AS residual", "list_transform(list_zip(vec, other), lambda p: p[1] + 3 * p[2]) AS scaled") + " FROM w", PAIRED))
def vector_arithmetic(spark, sf_dir):
    return texts(_pairs(spark, sf_dir).select("id", V.add(X, Y).alias("added"), V.residual(X, Y).alias("residual"), V.madd(X, 3, Y).alias("scaled")), "added", "residual", "scaled")


@query("floor_square_root", sql(f"SELECT id, least(floor(sqrt({l2('vec', 'other')}))::BIGINT, 1023) AS root, {joined('list_transform(vec, lambda x: x * x) AS squares')} FROM w", PAIRED))
def floor_square_root(spark, sf_dir):
    return texts(_pairs(spark, sf_dir).select("id", V.floor_root(V.l2(X, Y, "bigint")).alias("root"), F.transform("vec", lambda x: x * x).alias("squares")), "squares")


@query("part_distances", sql("SELECT id, " + joined("list_transform(range(0, 8), lambda m: " + fold("({a} - {b}) * ({a} - {b})", "vec[8 * m + 1:8 * m + 8]", "other[8 * m + 1:8 * m + 8]") + ") AS parts") + " FROM w", PAIRED))
def part_distances(spark, sf_dir):
    return texts(_pairs(spark, sf_dir).select("id", F.array(*[V.l2(V.part(X, m, 8), V.part(Y, m, 8), "bigint") for m in range(8)]).alias("parts")), "parts")


@query("bits_hamming", sql(f"SELECT id, {hamming('bits', 'other')} AS dist FROM w", BPAIRED))
def bits_hamming(spark, sf_dir):
    return _pairs(spark, sf_dir, T.bits).select("id", V.hamming(F.col("words"), F.col("other")).cast("bigint").alias("dist"))


@query("codes_generalized_hamming", sql("SELECT id, list_sum(list_transform(list_zip(vec, other), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END))::BIGINT AS dist FROM w", PAIRED))
def codes_generalized_hamming(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", V.generalized_hamming(X, Y).cast("bigint").alias("dist"))


@query("bits_of_signs", sql("SELECT id, " + joined("bits AS bits", "list_transform(bits, lambda x: 2 * x - 1) AS reals", "list_reverse(bits) AS shuffled") + " FROM b"))
def bits_of_signs(spark, sf_dir):
    words = F.col("words")
    rows = T.bits(spark, sf_dir).select("id", "words", V.shuffled_bits(words, list(range(63, -1, -1))).alias("turned"))
    return texts(rows.select("id", V.unpacked_bits(words, 64).alias("bits"), V.real_of_bits(words, 64).alias("reals"), V.unpacked_bits(F.col("turned"), 64).alias("shuffled")), "bits", "reals", "shuffled")


@query("packed_numbers", sql("SELECT id, " + joined("list_transform(vec[1:10], lambda x: x % 64) AS numbers") + " FROM v"))
def packed_numbers(spark, sf_dir):
    low = F.transform(F.slice("vec", 1, 10), lambda x: x % 64)
    packed = T.integers(spark, sf_dir).select("id", V.packed_numbers(low, 10, 6).alias("words"))
    return texts(packed.select("id", V.unpacked_numbers(F.col("words"), 10, 6).alias("numbers")), "numbers")


@query("vector_checksums", sql("SELECT a.label, count(DISTINCT a.vec)::BIGINT AS distinct_sums FROM v a GROUP BY a.label"))
def vector_checksums(spark, sf_dir):
    return T.integers(spark, sf_dir).groupBy("label").agg(F.countDistinct(V.checksum(X)).alias("distinct_sums"))


@query("packed_places", sql("SELECT id, (label::BIGINT << 32) + id AS place, label::BIGINT AS list_no, id AS offset_no, " + joined("[id % 256, id // 256] AS bytes") + ", id AS decoded FROM v"))
def packed_places(spark, sf_dir):
    place = V.packed_place(F.col("label"), F.col("id"))
    rows = T.integers(spark, sf_dir).select("id", place.alias("place"), V.list_bytes(F.col("id"), 65_536).alias("bytes"))
    out = rows.select("id", "place", V.list_of_place(F.col("place")).alias("list_no"), V.offset_of_place(F.col("place")).alias("offset_no"), "bytes", V.list_of_bytes(F.col("bytes")).alias("decoded"))
    return texts(out, "bytes")


@query("smallest_and_largest", sql("SELECT id, " + joined("list_sort(vec)[1:5] AS smallest", "list_reverse_sort(vec)[1:5] AS largest") + " FROM v"))
def smallest_and_largest(spark, sf_dir):
    return texts(T.integers(spark, sf_dir).select("id", V.smallest(X, 5).alias("smallest"), V.largest(X, 5).alias("largest")), "smallest", "largest")


@query("casts", sql("SELECT id, " + joined("list_transform(vec, lambda x: floor(x::DOUBLE / 2)::BIGINT) AS halves") + " FROM v"))
def casts(spark, sf_dir):
    return texts(T.integers(spark, sf_dir).select("id", F.transform("vec", lambda x: F.floor(x.cast("float").cast("double") / 2)).alias("halves")), "halves")


_STEP = "pow(2.0e0, greatest(floor(log2(abs(x))), -14) - 10)"


@query("half_precision", sql(f"SELECT id, place::INTEGER AS place, CASE WHEN x = 0 THEN 0.0e0 ELSE round_even(x / {_STEP}, 0) * {_STEP} + 0.0e0 END AS value FROM (SELECT id, unnest(range(len(vec))) AS place, unnest(vec) AS x FROM f)"))
def half_precision(spark, sf_dir):
    """id, place, value: a row an element."""
    rounded = T.floats(spark, sf_dir).select("id", F.posexplode(F.transform("vec", V.round_half)).alias("place", "value"))
    return rounded.withColumn("value", F.col("value") + F.lit(0.0))


@query("nan_policy", sql("SELECT id, list_aggregate(list_transform(vec, lambda x: CASE WHEN x = 128 THEN 1 ELSE 0 END), 'max') = 1 AS has_nan FROM v"))
def nan_policy(spark, sf_dir):
    marked = F.transform("vec", lambda x: F.when(x == 128, F.lit(float("nan"))).otherwise(x.cast("double")))
    return T.integers(spark, sf_dir).select("id", V.has_nan(marked).alias("has_nan"))


# Selectors.

_WORDS = [0x5555555555555555, 0x0F0F0F0F0F0F0F0F]


def _selected(name: str, condition: str, choose):
    @query(f"select_{name}", sql(f"SELECT id, label FROM v WHERE {condition}"))
    def run(spark, sf_dir):
        return choose(T.integers(spark, sf_dir)).select("id", "label")


_selected("range", "id >= 100 AND id < 333", lambda d: d.where(selectors.id_range(100, 333)))
_selected("array", "id IN (3, 7, 11, 400)", lambda d: d.where(selectors.id_list([3, 7, 11, 400])))
_selected("batch", "id IN (SELECT id FROM v WHERE label = 3)", lambda d: selectors.in_table(d, d.where("label = 3").select("id")))
_selected("bitmap", "id < 128 AND CASE WHEN id < 64 THEN id % 2 = 0 ELSE (id % 8) < 4 END", lambda d: d.where(selectors.id_bitmap(_WORDS)))
_selected("not", "NOT (id >= 100 AND id < 333)", lambda d: d.where(~selectors.id_range(100, 333)))
_selected("all", "true", lambda d: d.where(selectors.everything()))
_selected("and", "id >= 100 AND id < 333 AND id IN (50, 150, 250)", lambda d: d.where(selectors.id_range(100, 333) & selectors.id_list([50, 150, 250])))
_selected("or", "id < 10 OR id IN (50, 150, 250)", lambda d: d.where(selectors.id_range(0, 10) | selectors.id_list([50, 150, 250])))
_selected("xor", "(id < 200) <> (id >= 100 AND id < 333)", lambda d: d.where(selectors.xor(selectors.id_range(0, 200), selectors.id_range(100, 333))))
_selected("translated", "id * 10 + 5 BETWEEN 500 AND 900", lambda d: selectors.translated(d, d.select("id", (F.col("id") * 10 + 5).alias("external_id")), F.col("external_id").between(500, 900)))
_selected("function", "id % 7 = 3", lambda d: d.where(selectors.by_function(lambda i: i % 7 == 3)))
_selected("without", "NOT (id >= 100 AND id < 333)", lambda d: selectors.without(d, selectors.id_range(100, 333)))
