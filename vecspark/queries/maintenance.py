"""Queries over adding, merging, subsets, updates and id maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.operators import maintain as M
from vecspark.queries.searching import _both, _ivf, _whole
from vecspark.queries.sql import LISTS, PAIRS, hamming, sql, top
from vecspark.registry import query
from vecspark.sources import tables as T


def _table(name: str, body: str, run, *more: str):
    query(name, sql(body, *more))(run)


def _base(spark, sf_dir):
    return T.integers(spark, sf_dir).select("id", F.get("vec", 0).alias("x"), "label")


def _codes(spark, sf_dir):
    return _ivf(T.integers(spark, sf_dir)).codes.select("list_no", "id")


_V = "SELECT id, vec[1] AS x, label FROM v"
_A = "SELECT list_no::INTEGER AS list_no, id FROM a"

_table("add_with_ids", f"{_V} UNION ALL SELECT id + 10000, vec[1], label FROM v", lambda s, d: M.appended(_base(s, d), _base(s, d).withColumn("id", F.col("id") + 10000)))
_table("add_numbered", f"{_V} UNION ALL SELECT (SELECT max(id) FROM v) + row_number() OVER (ORDER BY id), vec[1], label FROM v WHERE id < 50", lambda s, d: M.appended(_base(s, d), _base(s, d).where("id < 50"), "id"))
_table("remove_renumber", "SELECT row_number() OVER (ORDER BY id) - 1 AS id, vec[1] AS x, label FROM v WHERE id % 3 <> 0", lambda s, d: M.renumbered(_base(s, d), F.col("id") % 3 == 0))
_table("remove_keep_ids", f"{_A} WHERE id % 3 <> 0", lambda s, d: _codes(s, d).where(F.col("id") % 3 != 0), LISTS)
_table("merge_from", f"{_A} WHERE id < 100 UNION ALL SELECT list_no::INTEGER, id + 1000 FROM a WHERE id >= 100", lambda s, d: M.merged_from(_codes(s, d).where("id < 100"), _codes(s, d).where("id >= 100"), 1000), LISTS)
_table("subset_ids", f"{_A} WHERE id >= 30 AND id < 90", lambda s, d: M.subset(_codes(s, d), "ids", 30, 90), LISTS)
_table("subset_modulo", f"{_A} WHERE id % 4 = 1", lambda s, d: M.subset(_codes(s, d), "modulo", 4, 1), LISTS)
_table("subset_lists", f"{_A} WHERE list_no >= 2 AND list_no < 5", lambda s, d: M.subset(_codes(s, d), "lists", 2, 5), LISTS)
_table("subset_elements", "SELECT list_no::INTEGER AS list_no, id FROM (SELECT *, row_number() OVER (ORDER BY list_no, id) - 1 AS pos FROM a) WHERE pos >= 100 AND pos < 250", lambda s, d: M.subset(_codes(s, d), "elements", 100, 250), LISTS)
_table("subset_share", "SELECT list_no::INTEGER AS list_no, id FROM (SELECT *, row_number() OVER (PARTITION BY list_no ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY list_no) AS n FROM a) WHERE pos >= floor(n * 1 / 3) AND pos < floor(n * 2 / 3)", lambda s, d: M.subset(_codes(s, d), "share", 1, 3), LISTS)
_table("lists_slice", "SELECT (list_no - 2)::INTEGER AS list_no, id FROM a WHERE list_no >= 2 AND list_no < 5", lambda s, d: M.sliced_lists(_codes(s, d), 2, 5), LISTS)
_table("lists_replaced", f"{_A} WHERE list_no < 2 OR list_no >= 4 UNION ALL SELECT list_no::INTEGER, id + 1000 FROM a WHERE list_no >= 2 AND list_no < 4", lambda s, d: M.replaced_lists(_codes(s, d), _codes(s, d).withColumn("id", F.col("id") + 1000), 2, 4), LISTS)
_table("lists_side_by_side", f"{_A} UNION ALL SELECT list_no::INTEGER, id + 1000 FROM a", lambda s, d: M.side_by_side([_codes(s, d), _codes(s, d).withColumn("id", F.col("id") + 1000)]), LISTS)
_table("lists_stacked", f"{_A} UNION ALL SELECT (list_no + 8)::INTEGER, id + 1000 FROM a", lambda s, d: M.stacked([(_codes(s, d), 8), (_codes(s, d).withColumn("id", F.col("id") + 1000), 8)]), LISTS)
_table("lists_masked", f"{_A} WHERE list_no % 2 = 0 UNION ALL SELECT list_no::INTEGER, id + 1000 FROM a WHERE list_no % 2 = 1", lambda s, d: M.masked(_codes(s, d).where("list_no % 2 = 0"), _codes(s, d).withColumn("id", F.col("id") + 1000)), LISTS)
_table("lists_short", f"{_A} WHERE list_no IN (SELECT list_no FROM a GROUP BY list_no HAVING count(*) < 60)", lambda s, d: M.short_lists(_codes(s, d), 60), LISTS)
_table("update_vectors", "SELECT id, CASE WHEN id % 5 = 0 THEN vec[2] ELSE vec[1] END AS x, label FROM v", lambda s, d: _updated(s, d))
_table("permute_entries", "SELECT (id * 7 + 3) % 500009 AS id, vec[1] AS x, label FROM v", lambda s, d: M.permuted(_base(s, d), _base(s, d).select("id", ((F.col("id") * 7 + 3) % 500009).alias("new_id"))))
_table("reset", f"{_V} WHERE false", lambda s, d: M.emptied(_base(s, d)))
_table("direct_map", "SELECT id, list_no::INTEGER AS list_no, row_number() OVER (PARTITION BY list_no ORDER BY id) - 1 AS at FROM a", lambda s, d: M.direct_map(_codes(s, d)), LISTS)
_table("sliding_slices", "SELECT id, label AS slice_id FROM v WHERE label > 7 - 3 AND label <= 7", lambda s, d: M.window_of_slices(_base(s, d).select("id", F.col("label").alias("slice_id")), 7, 3))
_table("stored_lists", f"{_A} WHERE list_no IN (1, 6)", lambda s, d: _stored(s, d), LISTS)


def _updated(spark, sf_dir):
    """Every fifth row anew; nine rows under ids beyond the base's greatest, which are left out."""
    base = _base(spark, sf_dir)
    top = base.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    unknown = base.where("id < 9").withColumn("id", F.col("id") + top + 1)
    return M.updated(base, T.integers(spark, sf_dir).where("id % 5 = 0").select("id", F.get("vec", 1).alias("x"), "label").unionByName(unknown))


def _stored(spark, sf_dir):
    from vecspark.sources.shared import new_path

    path = new_path(spark, "lists")
    T.save_by_list(_codes(spark, sf_dir), path)
    return T.read_lists(spark, path, [1, 6]).select("list_no", "id")


@query("id_map_search", sql(top(PAIRS.replace("v.id,", "v.id * 10 + 5 AS id,"), 10)))
def id_map_search(spark, sf_dir):
    """External ids are a column of the base, found by a join."""
    from vecspark.operators import search as S
    from vecspark.operators.aggregate import translated

    queries, base = _both(spark, sf_dir)
    ids = base.select("id", (F.col("id") * 10 + 5).alias("external_id"))
    return _whole(translated(S.knn(queries, base, 10, integer=True), ids).select("query_id", "rank", "id", "dist"))


@query("saved_index", sql(top(PAIRS, 10)))
def saved_index(spark, sf_dir):
    """An index written to a folder, read back and searched in all lists."""
    from vecspark.plans.index import load
    from vecspark.sources.shared import new_path

    queries, base = _both(spark, sf_dir)
    path = new_path(spark, "index")
    _ivf(base).save(path)
    return _whole(load(spark, path).search(queries, 10, nprobe=8)).drop("list_no")


@query("saved_binary_index", sql(top(f"SELECT bq.query_id, b.id, {hamming('bq.bits', 'b.bits')} AS dist FROM bq, b", 10)))
def saved_binary_index(spark, sf_dir):
    """A binary inverted file, written, read and searched in all its lists."""
    from vecspark.plans.binary import load_binary
    from vecspark.plans.factory import binary_index
    from vecspark.sources.shared import new_path

    base = T.bits(spark, sf_dir).select("id", "words")
    path = new_path(spark, "binary-index")
    index = binary_index(T.DIM, "BIVF4").train(base).add(base)
    index.nprobe = 4
    index.save(path)
    return load_binary(spark, path).search(T.as_queries(base), 10)


@query("raw_file_round_trip", sql("SELECT id, sum(x)::BIGINT AS total FROM (SELECT id, unnest(vec) AS x FROM v) GROUP BY id"))
def raw_file_round_trip(spark, sf_dir):
    """Rows as headerless little-endian records and back."""
    from vecspark.sources.shared import new_path

    path = new_path(spark, "raw")
    rows = T.integers(spark, sf_dir).select("id", "vec").withColumn("vec", F.concat(F.array("id"), "vec"))
    T.write_raw(rows, path, "int32", ["vec"])
    back = T.raw_vectors(spark, T.raw_files(spark, path), "int32", 65)
    return back.select(F.get("vec", 0).alias("id"), F.aggregate(F.slice("vec", 2, 64), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))
