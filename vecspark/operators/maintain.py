"""Maintenance of vector tables and lists: adding, merging, subsets, updates, id maps, windows of slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.sources.shared import stored


def numbered(df: DataFrame, order: str, start: int = 0, into: str = "id") -> DataFrame:
    """``df`` with numbers from ``start`` on in the order of a column (and of id), without gaps.

    Rows are sorted over partitions and stored; each adds the number of rows before it, of which there is a row a
    partition.
    """
    keys = [order, *(["id"] if "id" in df.columns and order != "id" else [])]
    dealt = stored(df.orderBy(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_f"))
    before = counts.select(F.col("_p").alias("_q"), "_f", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return dealt.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn(into, F.col("_m") - F.col("_f") + F.col("_b") + start).drop("_p", "_m", "_q", "_f", "_b")


def appended(base: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """``new`` behind ``base``: with its own ids, or numbered on in the order of a column."""
    if order is None:
        return base.unionByName(new)
    top = base.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    return base.unionByName(numbered(new.drop("id") if order != "id" else new.withColumnRenamed("id", "_old"), order if order != "id" else "_old", top + 1).select(*base.columns))


def renumbered(base: DataFrame, selector: Column) -> DataFrame:
    """Without the selected rows, ids moved down to stay dense."""
    return numbered(base.where(~selector).withColumnRenamed("id", "_old"), "_old").select(*base.columns)


def merged_from(base: DataFrame, other: DataFrame, add_id: int = 0) -> DataFrame:
    return base.unionByName(other.withColumn("id", F.col("id") + add_id))


def subset(codes: DataFrame, kind: str, a: int, b: int) -> DataFrame:
    """ids: a <= id < b; modulo: id % a = b; elements: the a-th to b-th of all by list and id; lists: a <= list_no < b; share: of each list, the a-th of b parts."""
    if kind == "ids":
        return codes.where((F.col("id") >= a) & (F.col("id") < b))
    if kind == "modulo":
        return codes.where(F.col("id") % a == b)
    if kind == "lists":
        return codes.where((F.col("list_no") >= a) & (F.col("list_no") < b))
    if kind == "elements":
        # places from list sizes: a list's first place, and a window within it
        firsts = offsets(codes.groupBy("list_no").agg(F.count("*").alias("n"))).select(F.col("list_no").alias("_l"), F.col("first").alias("_first"))
        placed = codes.withColumn("_in", F.row_number().over(W.partitionBy("list_no").orderBy("id")) - 1).join(F.broadcast(firsts), F.col("list_no") == F.col("_l"))
        return placed.where((F.col("_first") + F.col("_in") >= a) & (F.col("_first") + F.col("_in") < b)).drop("_l", "_first", "_in")
    if kind == "share":
        w = W.partitionBy("list_no")
        n, at = F.count("*").over(w), F.row_number().over(w.orderBy("id")) - 1
        placed = codes.withColumn("_n", n).withColumn("_at", at)
        return placed.where((F.col("_at") >= F.floor(F.col("_n") * a / b)) & (F.col("_at") < F.floor(F.col("_n") * (a + 1) / b))).drop("_n", "_at")
    raise ValueError(f"no such subset: {kind}")


def offsets(sizes: DataFrame) -> DataFrame:
    """list_no, n, first: how many codes are in the lists before."""
    first = F.coalesce(F.sum("n").over(W.orderBy("list_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("first", first)


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """Lists of several sets, each with the codes of all."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stacked(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Sets of lists (codes, how many lists) one behind the other."""
    out, at = None, 0
    for p, n in parts:
        own = p.withColumn("list_no", (F.col("list_no") + at).cast("int"))
        out, at = own if out is None else out.unionByName(own), at + n
    return out


def sliced_lists(codes: DataFrame, first: int, last: int) -> DataFrame:
    """Lists first <= list_no < last, numbered from 0."""
    return codes.where((F.col("list_no") >= first) & (F.col("list_no") < last)).withColumn("list_no", (F.col("list_no") - first).cast("int"))


def masked(first: DataFrame, second: DataFrame) -> DataFrame:
    """A list from the first set, or where it is empty from the second."""
    own = first.select(F.col("list_no").alias("_l")).distinct()
    return first.unionByName(second.join(own, F.col("list_no") == F.col("_l"), "left_anti"))


def replaced_lists(codes: DataFrame, new: DataFrame, first: int, last: int) -> DataFrame:
    return codes.where((F.col("list_no") < first) | (F.col("list_no") >= last)).unionByName(new.where((F.col("list_no") >= first) & (F.col("list_no") < last)))


def short_lists(codes: DataFrame, max_size: int) -> DataFrame:
    """Lists of ``max_size`` or more codes are as good as empty."""
    small = codes.groupBy(F.col("list_no").alias("_l")).agg(F.count("*").alias("_n")).where(F.col("_n") < max_size).select("_l")
    return codes.join(small, F.col("list_no") == F.col("_l"), "left_semi")


def updated(base: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` take the place of those with their ids; ids that the base hasn't are left out."""
    ids = new.select(F.col("id").alias("_i")).distinct()
    known = new.join(base.select(F.col("id").alias("_b")), F.col("id") == F.col("_b"), "left_semi")
    return base.join(ids, F.col("id") == F.col("_i"), "left_anti").unionByName(known.select(*base.columns))


def permuted(base: DataFrame, order: DataFrame) -> DataFrame:
    """``order`` (id, new_id): rows under new ids."""
    o = order.select(F.col("id").alias("_i"), "new_id")
    return base.join(o, F.col("id") == F.col("_i")).withColumn("id", F.col("new_id")).drop("_i", "new_id")


def emptied(base: DataFrame) -> DataFrame:
    return base.where("false")


def direct_map(codes: DataFrame) -> DataFrame:
    """id, list_no, at: where each code is, its place in the list by id."""
    return codes.select("id", "list_no", (F.row_number().over(W.partitionBy("list_no").orderBy("id")) - 1).cast("bigint").alias("at"))


def looked_up(keys: DataFrame, table: DataFrame) -> DataFrame:
    """key, value: the table's (key, value), -1 for keys that it hasn't."""
    t = table.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    return keys.join(t, F.col("key") == F.col("_k"), "left").select("key", F.coalesce("_v", F.lit(-1)).alias("value"))


def window_of_slices(slices: DataFrame, newest: int, size: int) -> DataFrame:
    """The ``size`` newest slices (slice_id) up to ``newest``: older ones are dropped."""
    return slices.where((F.col("slice_id") > newest - size) & (F.col("slice_id") <= newest))


def sorted_by(df: DataFrame, value: str) -> DataFrame:
    """at, id: the permutation that sorts a column."""
    return numbered(df.select("id", F.col(value).alias("_value")), "_value", into="at").select("at", "id")


def bucketed(df: DataFrame, value: str) -> DataFrame:
    """value, at, id: row ids by bucket, in order."""
    return df.select(F.col(value).alias("value"), (F.row_number().over(W.partitionBy(value).orderBy("id")) - 1).cast("bigint").alias("at"), "id")


def fuzzy_limit(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """A threshold that between ``low`` and ``high`` values are at most, from a mergeable quantile sketch, and how many are."""
    n = df.agg(F.count("*").alias("n"), F.percentile_approx(value, F.lit((low + high) / 2) / F.lit(max(1, df.count())), 100_000).alias("threshold"))
    return df.crossJoin(F.broadcast(n)).where(F.col(value) <= F.col("threshold")).agg(F.max("threshold").alias("threshold"), F.count("*").alias("n"))
