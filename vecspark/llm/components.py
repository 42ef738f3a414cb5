"""Connected components of a table of links, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import discard, stored

#: Rounds after which the loop gives up; each halves the depth of the trees, so that 40 are enough for any input.
ROUNDS = 40


def _both(links: DataFrame) -> DataFrame:
    return links.union(links.select("b", "a"))


def _towards_least(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = _both(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _to_least_smaller(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these. ``links`` has a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    joined = links.join(least, F.col("a") == F.col("k"))
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("k", "m")).distinct()


def components(links: DataFrame, name: str = "links", rows: int | None = None) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b: bigint, no nulls) but the roots, the least nodes.

    Alternates two star operations until the links don't change. Each has one link for each node and neighbour at
    most, so that the table never grows beyond the first one, and a hub is spread: its least neighbour is found by
    partial sums, and the join that brings it back splits a skewed key. Each round is written to the shared folder, and the one before it deleted.
    rows: the number of links, if known.
    """
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name, rows)
    state = None
    for _ in range(ROUNDS):
        count = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(count) == state or not count[0]:
            break
        state = tuple(count)
        large = _towards_least(now).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        middle = stored(large, name, count[0])
        before, now = now, stored(_to_least_smaller(middle), name, count[0])
        discard(before, middle)
    else:
        raise RuntimeError(f"components: no end after {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
