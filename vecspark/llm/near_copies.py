"""Near copies of whole documents: five-word shingles, Jaccard similarity of ``SIMILAR`` or more.

Texts get SimHash fingerprints of 128 bits of their distinct five-word shingles. Texts of similarity 0.8 differ in 15 %
of the bits, 19 on average; ``RADIUS`` 29 holds 99 % of them. Equal fingerprints are one node. Cells are made of
nodes that agree on a sample of the bits: a cell has ``NEAR`` nodes on average, so that samples grow with the logarithm of the
input, and there are as many samples as it takes for a pair of similarity 0.8 to agree on one of them with
probability ``FOUND``. Within a cell all pairs are compared, tile by tile (``simhash``), and the spanning forest of least
distances goes on. Its pairs are compared once more, exactly, by their sets of shingles; what isn't similar goes. So
no document goes without an exact match of 0.8 or more with another of its group, and a similar pair is lost only where neither it
nor a chain of similar pairs is found: a few in a hundred pairs at similarity 0.8, and fewer above.

Defined results: words are as in ``simhash``, lower-cased; texts of fewer than five words have one shingle, null texts and
texts without words have none and are copies of each other; rows of one doc_id are one document and stay or go together;
rows with a null id can't be told apart, stay and name nothing; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import free, ship, sliced, spread, stored, text_bytes
from vecspark.llm.components import components
from vecspark.llm.simhash import SEED, cell_links, signed

SHINGLE, SIMILAR, RADIUS = 5, 0.8, 29
#: Nodes of a cell on average, and the probability that a pair of similarity SIMILAR shares a cell.
NEAR, FOUND = 1024, 0.99


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    import xxhash

    words = text.lower().split()  # of bytes: lower() and split() know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, SEED, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = mixed(out ^ h[k : k + n])
    return np.unique(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all bits of x."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits: majority of the bits of the shingles' hashes, and of these mixed once more."""
    words = []
    for k in range(2):
        h = hashes if k == 0 else mixed(hashes + np.uint64(0x9E3779B97F4A7C15))
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 14):  # a very long text isn't spread into bits at once
            ones += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        words.append(int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big"))
    return words[0], words[1]


def _fingerprints(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            sets = [shingles(t) for t in text_bytes(batch.column("text"))]
            fps = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array(list(map(len, sets)), pa.int64())], ["doc_id", "f0", "f1", "size"])

    return spread(docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").where("doc_id IS NOT NULL")).mapInArrow(run, "doc_id bigint, f0 bigint, f1 bigint, size bigint")


def samples(nodes: int) -> list[tuple[int, int]]:
    """Bits of each sample, as two words: so many that cells of ``nodes`` fingerprints have about NEAR of them."""
    bits = max(1, ceil(log2(max(2, nodes / NEAR))))
    agree = (1 - acos(2 * SIMILAR / (1 + SIMILAR)) / pi) ** bits
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(ceil(log(1 - FOUND) / log(1 - agree))):
        x = sum(1 << int(b) for b in rng.choice(128, bits, replace=False))
        out.append((signed(x & ((1 << 64) - 1)), signed(x >> 64)))
    return out


def _similar(links: DataFrame, docs: DataFrame) -> DataFrame:
    """The links (a, b) of documents whose sets of shingles have similarity SIMILAR at least."""
    own = free("_node", docs)
    nodes = stored(links.select(F.explode(F.array("a", "b")).alias(own)).distinct(), "nodes", 2 * links.count())

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingles(t).tobytes() for t in text_bytes(batch.column("text"))], pa.binary())], ["doc_id", "set"])

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SIMILAR * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(nodes, F.col("doc_id") == F.col(own), "left_semi")
    held = stored(needed.mapInArrow(sets, "doc_id bigint, set binary").dropDuplicates(), "sets")
    x, y = held.select(F.col("doc_id").alias("_x"), F.col("set").alias("x")), held.select(F.col("doc_id").alias("_y"), F.col("set").alias("y"))
    both = links.join(x, F.col("a") == F.col("_x")).join(y, F.col("b") == F.col("_y")).select("a", "b", "x", "y")
    return both.mapInArrow(compare, "a bigint, b bigint").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and group, the least doc_id of its near copies, of every document with an id; a row for each text of a document."""
    return _groups(docs, stored(_fingerprints(docs), "fingerprints"))


def _groups(docs: DataFrame, fps: DataFrame) -> DataFrame:
    nodes = stored(fps.groupBy("f0", "f1", "size").agg(F.min("doc_id").alias("id")), "classes", fps.count())
    count = nodes.count()
    keys = [F.xxhash64(F.lit(i), F.col("f0").bitwiseAND(F.lit(a).cast("long")), F.col("f1").bitwiseAND(F.lit(b).cast("long"))) for i, (a, b) in enumerate(samples(count))]
    found = cell_links(nodes, keys, RADIUS, ("f0", "f1"), SIMILAR)
    found = stored(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "found", count * len(keys))
    member = fps.alias("f").join(nodes.alias("n"), [F.col(f"f.{c}") == F.col(f"n.{c}") for c in ("f0", "f1", "size")]).select("doc_id", "id")
    links = stored(_similar(found, docs), "links", found.count())
    roots = components(links, "copies", links.count())
    return member.join(roots, F.col("id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "id").alias("group"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their group, with all their columns; only ids travel, to an anti-join."""
    own = free("_copy", docs)
    fps = stored(_fingerprints(docs), "fingerprints")
    copies = _groups(docs, fps).where(F.col("doc_id") != F.col("group")).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(stored(copies, "copies", fps.count()), F.col("doc_id") == F.col(own), "left_anti")
