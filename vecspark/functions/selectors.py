"""Selectors: predicates on ids, as columns, that combine by ``&``, ``|``, ``~`` and ``xor``. They reach the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_range(low: int, high: int, column: str = "id") -> Column:
    """low <= id < high; pushed to Parquet's statistics."""
    return (F.col(column) >= low) & (F.col(column) < high)


def id_list(ids: Iterable[int], column: str = "id") -> Column:
    return F.col(column).isin(list(ids))


def id_bitmap(words: list[int], column: str = "id") -> Column:
    """Bit id % 64 of word id / 64; ids beyond the bitmap aren't selected."""
    table = F.array(*[F.lit(w).cast("bigint") for w in words])
    c = F.col(column)
    inside = (c >= 0) & (c < 64 * len(words))
    return F.when(inside, F.getbit(F.get(table, F.floor(c / 64).cast("int")), (c % 64).cast("int")) == 1).otherwise(False)


def everything() -> Column:
    return F.lit(True)


def xor(a: Column, b: Column) -> Column:
    return a != b


def by_function(f: Callable[[int], bool], column: str = "id") -> Column:
    """Any Python predicate, applied to Arrow batches."""
    import pandas as pd

    def own(ids):
        return ids.map(lambda i: bool(f(int(i)))).astype(bool)

    own.__annotations__ = {"ids": pd.Series, "return": pd.Series}
    return F.pandas_udf(own, "boolean")(F.col(column))


def in_table(base: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows of ``base`` whose id is in ``ids``: a semi-join, with Spark's runtime Bloom filter where it pays."""
    return base.join(ids.select(F.col(column).alias("_id")).distinct(), F.col(column) == F.col("_id"), "left_semi")


def translated(base: DataFrame, id_map: DataFrame, selector: Column) -> DataFrame:
    """Selects by external ids (``id_map``: id, external_id): ``selector`` is on external_id."""
    return in_table(base, id_map.where(selector).select("id"))


def without(base: DataFrame, selector: Column) -> DataFrame:
    """Rows that aren't selected; ids stay as they are."""
    return base.where(~F.coalesce(selector, F.lit(False)))
