"""Indexes of bit vectors: inverted files by Hamming distance, and hash tables probed within a few flips."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions import vectors as V
from vecspark.operators import search as S
from vecspark.operators.search import Best, blockwise, hamming_matrix, ranked, word_blocks, words_matrix
from vecspark.sources.shared import ship

#: Probed lists that are named in the scan's filter.
NAMED_LISTS = 10_000


def binary_centroids(base: DataFrame, d: int, nlist: int, seed: int = 1234) -> np.ndarray:
    """Packed centroids: k-means on the bits as +1 and -1, each centroid's signs."""
    from vecspark.plans.kmeans import MAX_POINTS, KMeans, rows_of, sample

    reals = sample(base, MAX_POINTS * nlist, seed).select("id", V.real_of_bits(F.col("words"), d).alias("vec"))
    signs = KMeans(nlist, 10, seed=seed).fit_array(rows_of(reals)).centroids >= 0
    return np.packbits(signs, axis=1, bitorder="little").view(np.uint64)


def ivf_add(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    """list_no, id, words: each row in the list of the nearest centroid, the first of equals."""
    ship(base.sparkSession)
    shared = base.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = hamming_matrix(words_matrix(batch.column("words")), shared.value).argmin(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *batch.columns], ["list_no", "id", "words"])

    return S._words(base).mapInArrow(run, "list_no int, id bigint, words array<bigint>")


def ivf_search(queries: DataFrame, codes: DataFrame, centroids: np.ndarray, k: int, nprobe: int) -> DataFrame:
    """query_id, rank, id, dist among the rows of each query's nearest lists."""

    def blocks():
        for ids, q in word_blocks(queries):
            probes = np.argsort(hamming_matrix(q, centroids), axis=1, kind="stable")[:, :nprobe]
            yield ids, q, {no: np.flatnonzero((probes == no).any(1)) for no in np.unique(probes).tolist()}

    def task(block, batches):
        ids, q, probing = block
        tiles = S.Tiles(len(ids), k, False)
        for batch in batches:
            lists, own_ids, words = batch.column("list_no").to_numpy(), batch.column("id").to_numpy(), words_matrix(batch.column("words"))
            for no in np.unique(lists).tolist():
                own, rows = probing.get(no, np.zeros(0, np.int64)), np.flatnonzero(lists == no)
                for a, b, best, part in tiles.each(len(rows)):
                    some, near = own[slice(*np.searchsorted(own, (a, b)))], rows[part]
                    if len(some):
                        best.add_some(some - a, hamming_matrix(q[some], words[near]).astype(float), own_ids[near])
        yield from tiles.batches(ids)

    found = None
    for block in blocks():  # lists that no query of the block probes aren't read, if the codes are stored by list
        probed = [no for no, own in block[2].items() if len(own)]
        own = codes if len(probed) == len(centroids) or len(probed) > NAMED_LISTS else codes.where(F.col("list_no").isin(probed))
        part = blockwise(own, [block], task, S.FOUND)
        found = part if found is None else found.unionByName(part)
    return ranked(found, k).select("query_id", "rank", "id", F.col("dist").cast("bigint").alias("dist"))


def hash_keys(words, tables: int, b: int, flips: int = 0):
    """(table, key) of each of ``tables`` runs of ``b`` bits from bit 0 on, and of all within ``flips`` flips, as an array column."""
    masks = [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(b), n)]

    def key(t: int):
        own = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.call_function("shiftleft", V.bit(words, i + t * b), i)), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y))
        return [F.struct(F.lit(t).alias("t"), own.bitwiseXOR(F.lit(m).cast("bigint")).alias("key")) for m in masks]

    return F.array(*[k for t in range(tables) for k in key(t)])


def hash_candidates(queries: DataFrame, base: DataFrame, b: int, tables: int = 1, flips: int = 0) -> DataFrame:
    """query_id, id: rows in a bucket within ``flips`` flips of the query's, in any table. The equi-join is by bucket, the queries its small side."""
    buckets = base.select("id", F.explode(hash_keys(F.col("words"), tables, b)).alias("k")).select("id", "k.t", "k.key")
    probes = queries.select("query_id", F.explode(hash_keys(F.col("words"), tables, b, flips)).alias("k")).select("query_id", F.col("k.t").alias("_t"), F.col("k.key").alias("_key"))
    return buckets.join(probes, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key"))).select("query_id", "id").distinct()


def hash_search(queries: DataFrame, base: DataFrame, k: int, b: int, tables: int = 1, flips: int = 0, radius: int | None = None) -> DataFrame:
    """The k nearest of the candidates, or all within a radius."""
    found = hash_candidates(queries, base, b, tables, flips)
    q = queries.select(F.col("query_id").alias("_q"), F.col("words").alias("_qw"))
    r = base.select(F.col("id").alias("_i"), F.col("words").alias("_bw"))
    both = found.join(q, F.col("query_id") == F.col("_q")).join(r, F.col("id") == F.col("_i"))
    both = both.select("query_id", "id", V.hamming(F.col("_qw"), F.col("_bw")).cast("bigint").alias("dist"))
    return both.where(F.col("dist") < radius) if radius is not None else ranked(both, k).select("query_id", "rank", "id", "dist")


@dataclass
class BinaryIndex:
    """An index of ``d`` bits a row (``words``): Flat, IVF (``size`` lists), Hash (``tables`` of ``size`` bits) or HNSW (``size`` links)."""

    d: int
    kind: str = "Flat"
    size: int = 0
    tables: int = 1
    nprobe: int = 1
    flips: int = 0
    ef: int = 64
    centroids: np.ndarray = field(default=None, repr=False)
    rows: DataFrame = field(default=None, repr=False)

    def _reals(self, rows: DataFrame) -> DataFrame:
        """Vectors of 0 and 1, whose squared distance is the Hamming distance."""
        return rows.withColumn("vec", F.transform(V.unpacked_bits(F.col("words"), self.d), lambda x: x.cast("double"))).drop("words")

    def train(self, df: DataFrame) -> BinaryIndex:
        if self.kind == "IVF":
            self.centroids = binary_centroids(df, self.d, self.size)
        return self

    def add(self, df: DataFrame) -> BinaryIndex:
        """Of HNSW, shards are built and written once."""
        from vecspark.plans import graph, graph_index
        from vecspark.sources.shared import stored

        if self.kind == "IVF":
            new = ivf_add(df, self.centroids)
        elif self.kind == "HNSW":
            reals = self._reals(df)
            new = stored(graph_index.packed(reals, graph.build(reals, "hnsw", self.size)), "graph")
        else:
            new = df.select("id", "words")
        self.rows = new if self.rows is None else self.rows.unionByName(new)
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, id, dist (differing bits)."""
        from vecspark.plans import graph_index

        if self.kind == "IVF":
            return ivf_search(queries, self.rows, self.centroids, k, self.nprobe)
        if self.kind == "Hash":
            return hash_search(queries, self.rows, k, self.size, self.tables, self.flips)
        if self.kind == "HNSW":
            found = graph_index.search(self._reals(queries), self.rows, k, max(self.ef, k))
            return found.select("query_id", "rank", "id", F.col("dist").cast("bigint").alias("dist"))
        return S.hamming_knn(queries, self.rows, k)

    def save(self, path: str) -> None:
        """Rows as Parquet, of IVF one folder a list; the rest as one pickled row."""
        import pickle

        from vecspark.sources.tables import save_by_list

        spark = self.rows.sparkSession
        if self.kind == "IVF":
            save_by_list(self.rows, f"{path}/rows")
        else:
            self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        model = bytearray(pickle.dumps(replace(self, rows=None)))
        spark.createDataFrame([(model, self.rows.columns)], "model binary, columns array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_binary(spark: SparkSession, path: str) -> BinaryIndex:
    """What ``BinaryIndex.save`` wrote."""
    import pickle

    row = spark.read.parquet(f"{path}/model").first()
    return replace(pickle.loads(row["model"]), rows=spark.read.parquet(f"{path}/rows").select(*row["columns"]))
