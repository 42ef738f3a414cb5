"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit set where over half of the hashes of its word shingles have it. Two fingerprints link
at ``radius`` or fewer differing bits. Equal fingerprints are one node before anything is compared. Of ``blocks``
parts of the 64 bits, two linked fingerprints agree on all but ``radius`` parts, so that each node goes to one cell for
every choice of ``blocks - radius`` parts; cells hold all links, and each link is found by exact comparison: a cell's
fingerprints, sorted by population count, are cut into tiles, and numpy's exclusive-or and bit counts compare all
pairs of two tiles, unless their population counts differ by more than the radius. Cells larger than ``CELL`` are dealt
to smaller ones in the same way: two linked fingerprints of a cell agree on one of ``radius + 1`` parts of the bits that
the cell leaves open. What is still larger is dealt over tasks by pairs of bands of population counts. A task passes
on a spanning forest of the links it finds, not all pairs; components are joined by ``components``, and named by their least
document id at last.

4 blocks suit up to about 10^11 distinct fingerprints: cells of 10^11 / 2^16 are dealt to parts of 2^12 times less.

Defined results: a null text has no words, like an empty one: fingerprint 0, linked like any other; fewer words than a
shingle make one shingle; rows with equal or null ids each get a row, and null ids name no component unless all of
its ids are null (then it has no name: null); ids may be negative; an empty table gives no rows; other columns of the
input aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import ship, sliced, spread, stored, text_bytes
from vecspark.llm.components import components

SHINGLE, RADIUS, BLOCKS, SEED = 3, 3, 4, 42
#: Fingerprints of a tile, and of a cell that one task compares.
TILE, CELL = 512, 16_384
#: Pairs within the radius that a task holds, beside a spanning forest.
PAIRS = 2_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint, unsigned: majority of the bits of the shingles' XXH64."""
    import xxhash

    words = text.lower().split()  # of bytes: lower() and split() know ASCII only
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n) if shingle != 3 or n == 1 else np.fromiter((digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):  # a very long text isn't spread into bits at once
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed bigint) of every row; no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            fps = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return spread(docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")).mapInArrow(run, "doc_id bigint, fp bigint")


def masks(radius: int, blocks: int) -> list[int]:
    """Bits of each choice of ``blocks - radius`` of the parts, as signed 64-bit numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [signed(sum(part[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def open_parts(mask: int, radius: int) -> list[int]:
    """The bits that ``mask`` leaves open, in ``radius + 1`` parts."""
    bits = [b for b in range(64) if not mask >> b & 1]
    return [signed(sum(1 << b for b in bits[i :: radius + 1])) for i in range(radius + 1)]


class Forest:
    """Union-find over 0..n-1 that takes arrays of links; roots are the least of their trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        at = of
        while True:
            above = self.up[at]
            if np.array_equal(above, at):
                self.up[of] = at
                return at
            at = above

    def link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the links (a, b) joined two trees: a spanning forest of them."""
        used, own = [], np.arange(len(a))
        while len(own):
            x, y = self.roots(a[own]), self.roots(b[own])
            apart = x != y
            own, low, high = own[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            order = np.lexsort((low, high))  # each root of two goes below the least that it is linked to
            own, low, high = own[order], low[order], high[order]
            high, first = np.unique(high, return_index=True)
            self.up[high] = low[first]
            used.append(own[first])
        return np.concatenate(used) if used else own


def near_pairs(cell: np.ndarray, fps: list[np.ndarray], side: np.ndarray | None, radius: int, size: np.ndarray | None = None, share: float = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, second, differing bits) of all pairs of equal cells within the radius, tile by tile.

    Rows are sorted by cell, then population count. fps: the fingerprint's words of 64 bits. side: where given, only
    pairs of a 0 and a 1 count (other pairs have other tasks). share: where given, the smaller ``size`` of a pair is at least that
    share of the larger.
    """
    n = len(cell)
    counts = sum(np.bitwise_count(f).astype(np.int64) for f in fps)
    for i in range(0, n, TILE):
        a = slice(i, min(n, i + TILE))
        for j in range(i, n, TILE):
            b = slice(j, min(n, j + TILE))
            if j > i and cell[j] != cell[a.stop - 1]:
                break
            inside = cell[a.start] == cell[b.stop - 1]
            if inside and (counts[a].min() > counts[b].max() + radius or counts[b].min() > counts[a].max() + radius):
                continue
            bits = np.bitwise_count(fps[0][a, None] ^ fps[0][None, b])
            for f in fps[1:]:
                bits += np.bitwise_count(f[a, None] ^ f[None, b])
            x, y = np.nonzero(bits <= radius)
            d = bits[x, y]
            x, y = x + i, y + j
            own = x < y
            if not inside:
                own &= cell[x] == cell[y]
            if side is not None:
                own &= side[x] != side[y]
            if size is not None:
                own &= np.minimum(size[x], size[y]) >= share * np.maximum(size[x], size[y])
            if own.any():
                yield x[own], y[own], d[own]


def nearest_forest(n: int, pairs: Iterator) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (first, second, distance) over 0..n-1 a spanning forest of least distances."""

    def shortest(rows: list) -> tuple:
        x, y, d = (np.concatenate(c) for c in zip(*rows, strict=True))
        forest, keep = Forest(n), []
        for k in np.unique(d):
            own = np.flatnonzero(d == k)
            keep.append(own[forest.link(x[own], y[own])])
        keep = np.concatenate(keep)
        return x[keep], y[keep], d[keep]

    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
    for p in pairs:
        held.append(p)
        if sum(len(x[0]) for x in held[1:]) > PAIRS:  # links that close a circle of shorter ones aren't needed
            held = [shortest(held)]
    x, y, _ = shortest(held) if len(held) > 1 else held[0]
    return x, y


def _compare(radius: int, words: tuple[str, ...], share: float | None):
    """Of rows (cell, the fingerprint's words, id, side), sorted by cell, links (a, b) of a spanning forest of each run of whole cells.

    With ``share`` rows have a size, and links are pairs of the forest of least distances; without it, of a node and its tree's root.
    """
    names = ("cell", *words, "id", "side", *(("size",) if share else ()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []

        def links(rows: list[tuple]):
            cell, *fps, ids, side, size = (np.concatenate(x) for x in zip(*[(*r, r[0]) if not share else r for r in rows], strict=True))
            fps = [f.view(np.uint64) for f in fps]
            order = np.lexsort((*fps, sum(np.bitwise_count(f).astype(np.int64) for f in fps), cell))
            cell, ids, side, size, fps = cell[order], ids[order], side[order], size[order], [f[order] for f in fps]
            pairs = near_pairs(cell, fps, side if (side >= 0).any() else None, radius, size if share else None, share or 0)
            if share:
                a, b = nearest_forest(len(cell), pairs)
            else:
                forest = Forest(len(cell))
                for x, y, _ in pairs:
                    forest.link(x, y)
                at = np.arange(len(cell))
                roots = forest.roots(at)
                a = np.flatnonzero(roots != at)
                b = roots[a]
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        for batch in batches:
            rows = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in names)
            if not len(rows[0]):
                continue
            held.append(rows)
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # where the batch's last cell begins
            if last and sum(len(x[0]) for x in held) >= 4 * TILE:
                held[-1] = tuple(x[:last] for x in rows)
                yield links(held)
                held = [tuple(x[last:] for x in rows)]
        if held:
            yield links(held)

    return run


def cell_links(nodes: DataFrame, keys: list, radius: int, words: tuple[str, ...] = ("fp",), share: float | None = None, within=None) -> DataFrame:
    """Links (a, b) of ``nodes`` (the fingerprint's words, id, size) that connect all pairs of a cell within the radius, and no others.

    keys: the columns that name a node's cells. within: number of the key and cell -> array of the cells that a node of a large
    cell goes to instead.
    """
    own = [*words, "id", *(("size",) if share else ())]
    least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = F.lit(-1).alias("side")
    out: list[DataFrame] = []

    def compared(rows: DataFrame, parts: int) -> DataFrame:
        return rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_compare(radius, words, share), "a bigint, b bigint")

    def split(keyed: DataFrame) -> DataFrame | None:
        """Has the small cells compared; the rows of the large ones, if there are any."""
        keyed = stored(keyed, "cells")
        large = stored(keyed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select(F.col("cell").alias("large")), "large")
        parts = max(least, keyed.count() // (CELL * 8))
        if not large.count():
            out.append(compared(keyed.select("cell", *own, sides), parts))
            return None
        joined = keyed.join(large, F.col("cell") == F.col("large"), "left")
        out.append(compared(joined.where("large IS NULL").select("cell", *own, sides), parts))
        return joined.where("large IS NOT NULL").drop("large")

    rest = split(nodes.select(F.posexplode(F.array(*keys)).alias("key", "cell"), *own))
    if rest is not None and within is not None:
        rest = split(rest.select("key", F.explode(within(F.col("key"), F.col("cell"))).alias("cell"), *own))
    if rest is not None:
        # A cell's band (population count, part of CELL rows) meets itself and each band whose count is 0 to radius above.
        count = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0])).cast("int")
        rest = rest.select("cell", *own, count.alias("p"))
        sizes = rest.groupBy("cell", "p").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("k"))
        sizes = stored(sizes.groupBy(F.col("cell").alias("large")).agg(F.map_from_entries(F.collect_list(F.struct("p", "k"))).alias("ks"), F.sum("n").alias("n"), F.max("k").alias("most")), "bands")  # a row a cell, an entry a count
        band = rest.join(sizes, F.col("cell") == F.col("large")).withColumn("s", F.pmod(F.xxhash64(*words, F.lit(1)), F.col("ks")[F.col("p")]).cast("int"))

        def half(side: int) -> DataFrame:
            """Rows as the lower (0) or upper (1) count of their pairs of bands."""
            other = F.col("p") + F.col("d") if side == 0 else F.col("p") - F.col("d")
            met = band.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(radius)))).withColumn("q", other).withColumn("k", F.col("ks")[F.col("q")]).where("k IS NOT NULL")
            met = met.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
            pair = ("cell", "p", "q", "s", "t") if side == 0 else ("cell", "q", "p", "t", "s")
            return met.select(F.xxhash64(*pair).alias("cell"), *own, F.lit(side).alias("side"))

        rows = sizes.agg(F.sum(2 * (radius + 1) * F.col("n") * F.col("most"))).first()[0]
        out.append(compared(half(0).unionByName(half(1)), max(least, min(200_000, int(rows) // (CELL * 8)))))
    return reduce(DataFrame.unionByName, out)


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``nodes`` (fp, id) that connect all pairs within the radius, and no others."""
    chosen = masks(radius, blocks)
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(chosen)]
    parts = F.array(*[F.array(*[F.lit(m).cast("long") for m in open_parts(x, radius)]) for x in chosen])
    within = lambda key, cell: F.transform(F.get(parts, key), lambda m, j: F.xxhash64(cell, j, F.col("fp").bitwiseAND(m)))
    return cell_links(nodes, keys, radius, within=within)


def simhash(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least id reachable by links, for every row."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = stored(fingerprint_links(classes.select("fp", F.col("fp").alias("id")), radius, blocks), "links")
    roots = components(links, "simhash")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select(F.col("fp").alias("_fp"), F.col("root").alias("_root")).join(names, F.col("_root") == F.col("root")).select("_fp", "component_id")
    return fps.join(named, F.col("fp") == F.col("_fp"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(spark.read.parquet(f"{sf_dir}/documents.parquet"))
