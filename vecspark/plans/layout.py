"""Data layout plans: where lists lie, from their sizes and how often they are probed.

The plan is made on the table of lists, which is small beside the codes (one row a list), and given back as a table:
``placed`` joins it to the codes as a partition number, so that a hot list's codes lie in several partitions.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYOUT = "unit int, list_no int, first_slice int, last_slice int"


@dataclass(frozen=True)
class Costs:
    """Cycles of each phase: by probe the residual and the tables, by code the distance and the sorting."""

    residual: int
    tables: int
    distance: int
    sorting: int

    @classmethod
    def ideal(cls, d: int, m: int, codewords: int, k: int, clock: float = 350e6, near: float = 1612.56 * 2**20, far: float = 573.79 * 2**20, element: int = 1, centroid: int = 1, book: int = 1, code: int = 1, total: int = 4, size: int = 4) -> Costs:
        """From bytes moved over the near and far memory's bandwidth, and an operation a cycle."""
        cycles = lambda f, n: (f / far + n / near) * clock
        both = element + centroid
        return cls(
            math.ceil(d * (cycles(both, both) + 1)),
            math.ceil(codewords * (d * (cycles(book, centroid + book + element) + 1) + d - m)),
            math.ceil(m * cycles(code, code + total) + m - 1),
            math.ceil((cycles(0, total + size) + 1) * math.log2(k) + cycles(0, total)),
        )

    def of(self, heat: Column, frequency: Column) -> Column:
        """Cost of a list: heat is frequency times size."""
        return heat * (self.distance + self.sorting) + frequency * (self.residual + self.tables)

    def value(self, heat: float, frequency: float) -> float:
        return heat * (self.distance + self.sorting) + frequency * (self.residual + self.tables)


def bands(shares: dict[float, int], lists: DataFrame) -> DataFrame:
    """``lists`` (list_no, heat) with ``copies``: the hottest share of all lists get the most (``{0.05: 5, 0.15: 2}``; shares add up)."""
    from pyspark.sql import Window as W

    n, at = lists.count(), F.row_number().over(W.orderBy(F.desc("heat"), "list_no")) - 1
    expression, upto = F.lit(1), 0.0
    limits = []
    for share, copies in sorted(shares.items()):
        upto += share
        limits.append((math.floor(upto * n), copies))
    for limit, copies in reversed(limits):
        expression = F.when(F.col("_at") < limit, copies).otherwise(expression)
    return lists.withColumn("_at", at).withColumn("copies", expression).drop("_at")


def plan(lists: list[tuple[int, int, float, int]], units: int, costs: Costs, slice_codes: int) -> list[tuple[int, int, int, int]]:
    """(unit, list, first slice, last slice) rows for (list, size, frequency, copies) rows.

    Copies share a list's frequency. Costliest first, each copy goes to the unit of least load that hasn't the list.
    Then units above the mean pass slices of their costliest list on to the units of least load that haven't it, as
    long as this lowers the highest load. Lists that were never probed go to the units of fewest codes.
    """
    hot = [(costs.value(f * n / c, f / c), no, n, c) for no, n, f, c in lists if f > 0 and n > 0]
    load, room = [0.0] * units, [0] * units
    held: list[dict[int, list[float]]] = [{} for _ in range(units)]  # list -> [first slice, last slice, cost]
    for cost, no, n, copies in sorted(hot, key=lambda x: (-x[0], x[1])):
        slices = max(1, math.ceil(n / slice_codes))
        for u in sorted(range(units), key=lambda u: (load[u], u))[: max(1, min(copies, units))]:
            held[u][no] = [0, slices, cost]
            load[u] += cost
            room[u] += n
    mean = sum(load) / units if units else 0
    for _ in range(64 * units):
        top = max(range(units), key=lambda u: (load[u], -u))
        movable = [(cost, no) for no, (a, b, cost) in held[top].items() if b - a > 1]
        if load[top] <= mean or not movable:
            break
        cost, no = max(movable)
        free = [u for u in range(units) if no not in held[u]]
        if not free:
            break
        low = min(free, key=lambda u: (load[u], u))
        a, b, cost = held[top][no]
        each = cost / (b - a)
        n = min(int(b - a) - 1, int(max(0.0, min(load[top] - mean, (load[top] - load[low]) / 2)) // each))
        if n < 1:
            break
        held[top][no], held[low][no] = [a, b - n, cost - n * each], [b - n, b, n * each]
        load[top], load[low] = load[top] - n * each, load[low] + n * each
    spare = [(room[u], u) for u in range(units)]
    heapq.heapify(spare)
    for no, n, f, _ in sorted(lists, key=lambda x: (-x[1], x[0])):
        if f <= 0 or n <= 0:
            size, u = heapq.heappop(spare)
            held[u][no] = [0, max(1, math.ceil(n / slice_codes)), 0.0]
            heapq.heappush(spare, (size + n, u))
    return sorted((u, no, int(a), int(b)) for u in range(units) for no, (a, b, _) in held[u].items())


def layout(lists: DataFrame, units: int, costs: Costs, slice_codes: int) -> DataFrame:
    """The plan for ``lists`` (list_no, n, frequency, copies), a row a list, as a table."""
    rows = [(r["list_no"], r["n"], float(r["frequency"]), r["copies"]) for r in lists.collect()]
    return lists.sparkSession.createDataFrame(plan(rows, units, costs, slice_codes), LAYOUT)


def directory(layout_: DataFrame) -> DataFrame:
    """list_no, unit, at: each list's places, and its number in the unit."""
    from pyspark.sql import Window as W

    return layout_.select("list_no", "unit", (F.row_number().over(W.partitionBy("unit").orderBy("list_no")) - 1).alias("at"))


def placed(codes: DataFrame, layout_: DataFrame, slice_codes: int) -> DataFrame:
    """Codes (list_no, id) with ``unit``: every unit that has the code's slice. Slices are by hash, so that a hot list's codes spread without being sorted."""
    slices = layout_.groupBy("list_no").agg(F.max("last_slice").alias("_n"))
    own = layout_.select(F.col("list_no").alias("_l"), "unit", "first_slice", "last_slice")
    cut = codes.join(F.broadcast(slices.withColumnRenamed("list_no", "_s")), F.col("list_no") == F.col("_s")).withColumn("_slice", F.pmod(F.xxhash64("id"), F.col("_n")))
    return cut.join(F.broadcast(own), (F.col("list_no") == F.col("_l")) & (F.col("_slice") >= F.col("first_slice")) & (F.col("_slice") < F.col("last_slice"))).drop("_s", "_n", "_slice", "_l", "first_slice", "last_slice")


def routed(probes: DataFrame, layout_: DataFrame) -> DataFrame:
    """query_id, list_no, unit, first_slice, last_slice: each probe's slices, each at the place of lowest unit number that has it, in runs."""
    from pyspark.sql import Window as W

    slices = layout_.select(F.col("list_no").alias("_l"), "unit", F.explode(F.sequence("first_slice", F.col("last_slice") - 1)).alias("s"))
    first = slices.groupBy("_l", "s").agg(F.min("unit").alias("unit"))
    runs = first.withColumn("_g", F.col("s") - F.row_number().over(W.partitionBy("_l", "unit").orderBy("s")))
    spans = runs.groupBy("_l", "unit", "_g").agg(F.min("s").alias("first_slice"), (F.max("s") + 1).alias("last_slice")).drop("_g")
    return probes.join(F.broadcast(spans), F.col("list_no") == F.col("_l")).select("query_id", "list_no", "unit", "first_slice", "last_slice")


def by_modulo(list_no: Column, units: int) -> Column:
    return F.pmod(list_no, F.lit(units))


def by_bounds(list_no: Column, bounds: list[int]) -> Column:
    """The unit whose range of lists holds it; ``bounds`` are the ranges' ends."""
    out = F.lit(len(bounds))
    for u in range(len(bounds) - 1, -1, -1):
        out = F.when(list_no < bounds[u], u).otherwise(out)
    return out


