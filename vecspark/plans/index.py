"""Vector indexes: transforms, a coarse quantizer with inverted lists, a codec, and refinement.

An index is a small model (centroids, codebooks, matrices: trained on a bounded sample, broadcast) and a table of codes
(list_no, id, code), one row for each vector of the base. Adding encodes rows where they lie. A search finds each
query's probes among the centroids, then scans the codes of the probed lists where they lie: each task compares the codes of
a list with the queries that probe it and passes on its k best a query. Stored by list, unprobed lists aren't read. Product
codes are compared by tables of distances to the codewords, one for each query, list and part, and never decoded.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.operators import search as S
from vecspark.operators.aggregate import deduplicated
from vecspark.operators.search import Best, Metric, blockwise, distances, matrix, paired, query_blocks, ranked
from vecspark.plans.codecs import Flat, Product, TwoLevel
from vecspark.plans.kmeans import LOCAL_BYTES, MAX_POINTS, KMeans, nearest, rows_of, sample
from vecspark.plans.transforms import chained
from vecspark.sources.shared import ship

#: Rows of the sample that models are trained on, about, beside MAX_POINTS for each centroid.
TRAIN_ROWS = 65_536
#: Probed lists that are named in the scan's filter; more are joined.
NAMED_LISTS = 10_000
#: Found rows (32 bytes each) that are broadcast to the vectors they are rescored with; more are joined by a shuffle.
BROADCAST_FOUND = 1_000_000


@dataclass
class VectorIndex:
    """The parts of an index; ``codes`` has list_no, id, code, and for refinement ``raw`` the vectors (id, vec)."""

    chain: list = field(default_factory=list)
    nlist: int = 0
    codec: object = field(default_factory=Flat)
    metric: Metric = Metric.L2
    by_residual: bool | None = None
    refine: object | None = None
    k_factor: float = 1.0
    nprobe: int = 1
    max_codes: int = 0
    stop_size: int = 0
    centroids: np.ndarray = field(default=None, repr=False)
    coarse: object | None = field(default=None, repr=False)
    spherical: bool | None = None
    seed: int = 1234
    dedup: bool = False
    instances: DataFrame = field(default=None, repr=False)
    codes: DataFrame = field(default=None, repr=False)
    refined: DataFrame = field(default=None, repr=False)

    # Training and adding.

    @property
    def residual(self) -> bool:
        """Codes of an inverted file are of residuals, unless they are the vectors or inner products are asked for."""
        return self.by_residual if self.by_residual is not None else bool(self.nlist) and not isinstance(self.codec, Flat)

    def train(self, df: DataFrame) -> VectorIndex:
        """On rows of low hash of id, MAX_POINTS a centroid or TRAIN_ROWS; every row is indexed by ``add``.

        Where the rows for the centroids have more than LOCAL_BYTES, they stay where they are: centroids are found by passes over
        them, and all else is trained on as many as have LOCAL_BYTES.
        """
        wanted = max(TRAIN_ROWS, MAX_POINTS * self.nlist)
        width = 8 * (df.select(F.size("vec")).where("vec IS NOT NULL").first() or [1])[0]
        if wanted * width <= LOCAL_BYTES or self.coarse is not None or not self.nlist or self.centroids is not None:
            return self.train_array(rows_of(sample(df, min(wanted, LOCAL_BYTES // width + 1), self.seed)))
        x = rows_of(sample(df, LOCAL_BYTES // width, self.seed))
        for t in self.chain:
            t.train(x)
            x = t.apply(x)
        spherical = self.metric == Metric.INNER_PRODUCT if self.spherical is None else self.spherical
        many = transformed(sample(df, wanted, self.seed), self.chain)
        self.centroids = KMeans(self.nlist, 10, seed=self.seed, spherical=spherical).fit(many).centroids
        return self._train_codes(rows_of(sample(df, LOCAL_BYTES // width, self.seed)), x)

    def train_array(self, x: np.ndarray) -> VectorIndex:
        raw = x
        for t in self.chain:
            x = t.train(x).apply(x)
        if self.nlist:
            if self.centroids is None:
                spherical = self.metric == Metric.INNER_PRODUCT if self.spherical is None else self.spherical
                if self.coarse is not None:
                    self.centroids = self.coarse.train(x).all_sums()
                    self.nlist = len(self.centroids)
                else:
                    self.centroids = KMeans(self.nlist, 10, seed=self.seed, spherical=spherical).fit_array(x).centroids
        return self._train_codes(raw, x)

    def _train_codes(self, raw: np.ndarray, x: np.ndarray) -> VectorIndex:
        """The codecs, from vectors and transformed vectors."""
        if self.refine is not None:
            self.refine.train(raw)
        if self.nlist and self.residual:
            x = x - self.centroids[nearest(x, self.centroids, self._coarse_metric)[0]]
        self.codec.train(x)
        return self

    @property
    def code_type(self) -> str:
        """What a code is an array of: two bytes a part for product codes, which Parquet packs to the bits they need."""
        return "smallint" if isinstance(self.codec, (Product, TwoLevel)) and self.codec.bits < 16 else "double"

    @property
    def _coarse_metric(self) -> Metric:
        return Metric.INNER_PRODUCT if self.metric == Metric.INNER_PRODUCT else Metric.L2

    def _encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = chained(x, self.chain)
        lists = nearest(x, self.centroids, self._coarse_metric)[0] if self.nlist else np.zeros(len(x), np.int64)
        return lists, self.codec.encode(x - self.centroids[lists] if self.residual else x)

    def _model(self) -> VectorIndex:
        """The parts without the tables, to be sent."""
        return replace(self, codes=None, refined=None, instances=None)

    def encode(self, df: DataFrame) -> DataFrame:
        """list_no, id, code of each row of ``df`` (id, vec) that has a vector without NaN."""
        ship(df.sparkSession)
        shared, kind = df.sparkSession.sparkContext.broadcast(self._model()), np.int16 if self.code_type == "smallint" else np.float64

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                x = matrix(batch.column("vec"))
                if not len(x):
                    continue
                lists, codes = shared.value._encoded(x)
                w = codes.shape[1]
                code = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, w), pa.int32()), pa.array(np.ascontiguousarray(codes).ravel().astype(kind)))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column("id"), code], ["list_no", "id", "code"])

        rows = df.select(F.col("id").cast("bigint").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
        rows = rows.where("vec IS NOT NULL AND NOT exists(vec, x -> isnan(x))")
        return rows.mapInArrow(run, f"list_no int, id bigint, code array<{self.code_type}>")

    def add(self, df: DataFrame) -> VectorIndex:
        """Codes of every row; with ``dedup`` equal vectors of a call have one code, under their least id, and ``instances`` (first, id)."""
        if self.dedup:
            df, instances = deduplicated(df)
            self.instances = instances if self.instances is None else self.instances.unionByName(instances)
        codes = self.encode(df)
        raw = df.select("id", "vec") if self.refine is not None else None
        self.codes = codes if self.codes is None else self.codes.unionByName(codes)
        self.refined = raw if self.refined is None else self.refined.unionByName(raw)
        return self

    def decode(self, codes: DataFrame) -> DataFrame:
        """id, vec: what codes (list_no, id, code) stand for, transforms taken back where they can be."""
        ship(codes.sparkSession)
        shared = codes.sparkSession.sparkContext.broadcast(self._model())

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    model = shared.value
                    x = model.codec.decode(matrix(batch.column("code")))
                    if model.residual:
                        x = x + model.centroids[batch.column("list_no").to_numpy()]
                    for t in reversed(model.chain):
                        x = t.reverse(x)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))], ["id", "vec"])

        return codes.select("list_no", "id", "code").mapInArrow(run, "id bigint, vec array<double>")

    def reconstruct(self, ids: DataFrame) -> DataFrame:
        """id, vec of the given ids (id)."""
        return self.decode(self.codes.join(ids.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi"))

    # Searching.

    def probe_block(self, q: np.ndarray, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of the nearest lists of each query."""
        if not self.nlist:
            return np.zeros((len(q), 1), np.int64), np.zeros((len(q), 1))
        d = distances(self._coarse_metric, q, self.centroids, integer=self._coarse_metric == Metric.L2)
        order = np.argsort(-d if self._coarse_metric.similarity else d, axis=1, kind="stable")[:, : min(nprobe, self.nlist)]
        return order, np.take_along_axis(d, order, 1)

    def probes(self, queries: DataFrame, nprobe: int | None = None) -> DataFrame:
        """query_id, probe, list_no, cd: the lists that a search visits, in order."""

        def rows():
            for ids, x in query_blocks(queries):
                lists, d = self.probe_block(chained(x, self.chain), nprobe or self.nprobe)
                yield from ((int(i), p, int(no), float(c)) for i, own, cs in zip(ids, lists, d, strict=True) for p, (no, c) in enumerate(zip(own, cs, strict=True)))

        return queries.sparkSession.createDataFrame(list(rows()), "query_id bigint, probe int, list_no int, cd double")

    def _scan(self, queries: DataFrame, nprobe: int, given: DataFrame | None, keep: Column | None, emit, schema: str, limits: dict | None = None) -> DataFrame:
        """``emit(query ids, blocks)`` in each task, over (query rows, distances, ids, lists) blocks of probed lists."""
        model = self._model()
        codes = self.codes if keep is None else self.codes.where(keep)
        if self.stop_size:
            sizes = codes.groupBy("list_no").agg(F.count("*").alias("n")).where(F.col("n") < self.stop_size)
            codes = codes.join(F.broadcast(sizes.select(F.col("list_no").alias("_l"))), F.col("list_no") == F.col("_l"), "left_semi")  # a row a list
        fixed = None if given is None else _grouped(given)

        tabled = isinstance(model.codec, Product) and model.metric in (Metric.L2, Metric.INNER_PRODUCT)

        def compared(y: np.ndarray, no: int, code: np.ndarray) -> np.ndarray:
            """Distances of queries to the codes of a list."""
            center = model.centroids[no] if model.residual else None
            if not tabled:
                x = model.codec.decode(code)
                return distances(model.metric, y, x if center is None else x + center, integer=model.metric == Metric.L2)
            if model.metric == Metric.L2:
                return model.codec.by_tables(model.codec.tables(y if center is None else y - center), code)
            own = model.codec.by_tables(model.codec.tables(y, Metric.INNER_PRODUCT), code)
            return own if center is None else own + (y @ center)[:, None]

        def block(ids, x):
            y = chained(x, model.chain)
            if fixed is not None:
                lists = [np.array([no for no, _ in fixed.get(int(i), [])], np.int64) for i in ids]
            else:
                lists = list(model.probe_block(y, nprobe)[0])
            if limits:  # only so many codes of a list, by id
                lists = [own[: limits["lists"].get(int(i), 0)] for i, own in zip(ids, lists, strict=True)]
            probing: dict[int, list[int]] = {}
            for i, own in enumerate(lists):
                for no in own.tolist():
                    probing.setdefault(no, []).append(i)
            return model, ids, y, {no: np.array(own) for no, own in probing.items()}

        def task(shared, batches):
            model, ids, y, probing = shared

            def found():
                for batch in batches:
                    lists = batch.column("list_no").to_numpy()
                    own_ids, code = batch.column("id").to_numpy(), matrix(batch.column("code"))
                    order = np.argsort(lists, kind="stable")
                    for rows in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1) if len(order) else []:
                        no = int(lists[rows[0]])
                        own = probing.get(no)
                        if own is None:
                            continue
                        step = max(1, S.CELLS // len(own))
                        for a in range(0, len(rows), step):
                            part = rows[a : a + step]
                            yield own, compared(y[own], no, code[part]), own_ids[part], no

            yield from emit(ids, found())

        out = None
        for ids, x in query_blocks(queries):
            one = block(ids, x)
            part = blockwise(self._of_lists(codes, sorted(one[3])), [one], task, schema)
            out = part if out is None else out.unionByName(part)
        return out

    def _of_lists(self, codes: DataFrame, lists: list[int]) -> DataFrame:
        """The codes of some lists. Stored by list, other folders aren't read: a filter for few lists, a join that prunes for many."""
        if not self.nlist or len(lists) >= self.nlist:
            return codes
        if len(lists) <= NAMED_LISTS:
            return codes.where(F.col("list_no").isin(lists))
        named = codes.sparkSession.createDataFrame([(no,) for no in lists], "_no int")  # at most a row a list, as the centroids
        return codes.join(F.broadcast(named), F.col("list_no") == F.col("_no"), "left_semi")

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, probes: DataFrame | None = None, keep: Column | None = None, pad: bool = False) -> DataFrame:
        """query_id, rank, id, dist, and list_no of each neighbour.

        probes: the caller's own (query_id, list_no). keep: a selector on id, applied before anything is compared.
        """
        wanted = max(k, int(round(k * self.k_factor))) if self.refine is not None else k
        similar = self.metric.similarity

        def emit(ids, blocks):
            import pyarrow as pa

            best = Best(len(ids), wanted, similar)
            for own, d, row_ids, no in blocks:
                q, c = np.nonzero((-d if similar else d) <= best.worst[own][:, None])
                best.add_rows(own[q], d[q, c], row_ids[c], no)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.id), pa.array(best.sign * best.dist), pa.array(best.tag, pa.int32())], ["query_id", "id", "dist", "list_no"])

        limits = None
        if self.max_codes and self.nlist:
            limits = {"lists": {r[0]: r[1] for r in visited(self.probes(queries, nprobe), self.list_sizes(), self.max_codes).groupBy("query_id").agg(F.count("*")).collect()}}
        out = ranked(self._scan(queries, nprobe or self.nprobe, probes, keep, emit, "query_id bigint, id bigint, dist double, list_no int", limits), wanted, similar)
        if self.refine is not None:
            out = self.rescored(queries, out, wanted).transform(lambda d: ranked(d, k, similar))
        if self.dedup:
            both = out.select("query_id", F.col("id").alias("_f"), "dist", "list_no").join(self.instances, F.col("_f") == F.col("first"))
            out = ranked(both.select("query_id", "id", "dist", "list_no"), k, similar)
        out = out.select("query_id", "rank", "id", "dist", "list_no")
        return S.padded(out, queries, k, similar) if pad else out

    def rescored(self, queries: DataFrame, found: DataFrame, wanted: int) -> DataFrame:
        """Found rows with their distances by the refining codec's vectors, without transforms: one equi-join by id.

        At most ``wanted`` rows a query are found: where these are few, they go to the vectors, which aren't shuffled then.
        """
        n = queries.count()
        few = lambda d, rows: F.broadcast(d) if rows <= BROADCAST_FOUND else d
        raw = self.refined.select(F.col("id").alias("_i"), "vec")
        got = raw.join(few(found.select("query_id", "id", "list_no"), n * wanted), F.col("id") == F.col("_i")).drop("_i")
        q = queries.select(F.col("query_id").alias("_q"), F.transform("vec", lambda x: x.cast("double")).alias("_qv"))
        both = got.join(few(q, n * len(queries.columns) * 32), F.col("query_id") == F.col("_q"))
        shared = found.sparkSession.sparkContext.broadcast((self.refine, self.metric))

        def run(batches):
            import pyarrow as pa

            refine, metric = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = refine.decode(refine.encode(matrix(batch.column("vec")))), matrix(batch.column("_qv"))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), batch.column("list_no"), pa.array(paired(metric, y, x))], ["query_id", "id", "list_no", "dist"])

        return both.select("query_id", "id", "list_no", F.transform("vec", lambda x: x.cast("double")).alias("vec"), "_qv").mapInArrow(run, "query_id bigint, id bigint, list_no int, dist double")

    def range_search(self, queries: DataFrame, radius: float, nprobe: int | None = None, probes: DataFrame | None = None) -> DataFrame:
        """query_id, id, dist, list_no of all rows of the probed lists nearer than the radius."""
        similar = self.metric.similarity

        def emit(ids, blocks):
            import pyarrow as pa

            for own, d, row_ids, no in blocks:
                q, c = np.nonzero(d > radius if similar else d < radius)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own[q]]), pa.array(row_ids[c]), pa.array(d[q, c]), pa.array(np.full(len(q), no), pa.int32())], ["query_id", "id", "dist", "list_no"])

        return self._scan(queries, nprobe or self.nprobe, probes, None, emit, "query_id bigint, id bigint, dist double, list_no int")

    def search_and_reconstruct(self, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
        """``search`` with vec, the decoded neighbour; the table of results is small beside the codes."""
        found = self.search(queries, k, nprobe)
        vectors = self.decode(self.codes.join(found.select(F.col("id").alias("_i")).distinct(), F.col("id") == F.col("_i"), "left_semi"))
        return found.join(vectors.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left").drop("_i")

    def list_sizes(self) -> DataFrame:
        return self.codes.groupBy("list_no").agg(F.count("*").alias("n"))

    # Whole indexes.

    def compatible(self, other: VectorIndex) -> bool:
        """Same metric, quantizer and codec."""
        import pickle

        own = lambda i: (i.metric, i.nlist, i.residual, None if i.centroids is None else i.centroids.tobytes(), pickle.dumps(i.codec), pickle.dumps(i.chain))
        return own(self) == own(other)

    def merged(self, other: VectorIndex, add_id: int = 0) -> VectorIndex:
        """Both indexes' codes, the other's ids shifted."""
        if not self.compatible(other):
            raise ValueError("the indexes differ in metric, quantizer or codec")
        codes = self.codes.unionByName(other.codes.withColumn("id", F.col("id") + add_id))
        refined = None if self.refined is None else self.refined.unionByName(other.refined.withColumn("id", F.col("id") + add_id))
        instances = None if self.instances is None else self.instances.unionByName(other.instances.select(F.col("first") + add_id, F.col("id") + add_id).toDF("first", "id"))
        return replace(self, codes=codes, refined=refined, instances=instances)

    def removed(self, selector: Column) -> VectorIndex:
        """Without the selected ids; of deduplicated rows the ids go, their code stays for the others."""
        if self.dedup:
            return replace(self, instances=self.instances.where(~selector))
        return replace(self, codes=self.codes.where(~selector), refined=None if self.refined is None else self.refined.where(~selector))

    def empty(self) -> VectorIndex:
        return replace(self, codes=None, refined=None, instances=None)

    def save(self, path: str) -> None:
        """Codes as Parquet, one folder a list; the model as one pickled row."""
        import pickle

        from vecspark.sources.tables import save_by_list

        spark = self.codes.sparkSession
        save_by_list(self.codes, f"{path}/codes")
        kept = {"refined": self.refined, "instances": self.instances}
        for name, df in kept.items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        there = [df is not None for df in kept.values()]
        spark.createDataFrame([(bytearray(pickle.dumps(self._model())), *there)], "model binary, refined boolean, instances boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def transformed(df: DataFrame, chain: list) -> DataFrame:
    """id, vec of the rows after the transforms; no shuffle."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.ascontiguousarray(chained(matrix(batch.column("vec")), shared.value))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], ["id", "vec"])

    rows = df.where("vec IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    return rows.mapInArrow(run, "id bigint, vec array<double>")


def load(spark, path: str) -> VectorIndex:
    import pickle

    row = spark.read.parquet(f"{path}/model").first()
    codes = spark.read.parquet(f"{path}/codes").select("list_no", "id", "code")
    more = {name: spark.read.parquet(f"{path}/{name}") if row[name] else None for name in ("refined", "instances")}
    return replace(pickle.loads(row[0]), codes=codes, **more)


def _grouped(probes: DataFrame) -> dict[int, list[tuple[int, float]]]:
    """A caller's probes, which are as bounded as the queries."""
    out: dict[int, list[tuple[int, float]]] = {}
    columns = ["query_id", "list_no", "probe" if "probe" in probes.columns else "list_no"]
    for r in sorted(probes.select(*columns).collect(), key=lambda r: (r[0], r[2])):
        if r[1] is not None and r[1] >= 0:
            out.setdefault(r[0], []).append((r[1], 0.0))
    return out


def visited(probes: DataFrame, sizes: DataFrame, max_codes: int) -> DataFrame:
    """``probes`` (query_id, probe, list_no) that are begun before ``max_codes`` codes are visited, with ``allowed`` of each."""
    joined = probes.join(sizes.select(F.col("list_no").alias("_l"), "n"), F.col("list_no") == F.col("_l"), "left").drop("_l").fillna(0, ["n"])
    before = F.coalesce(F.sum("n").over(W.partitionBy("query_id").orderBy("probe").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn("before", before).where(F.col("before") < max_codes).withColumn("allowed", F.least("n", F.lit(max_codes) - F.col("before"))).drop("n")


def product_modes(index: VectorIndex, queries: DataFrame, k: int, mode: str, ht: int = 0) -> DataFrame:
    """Search of a flat product index by another rule.

    hamming: differing bits of the codes; generalized: differing code numbers; symmetric: the query decoded from its
    own code; polysemous: only codes of fewer than ``ht`` differing bits, by their tables (generalized: numbers).
    """
    model = index._model()

    def task(block, batches):
        ids, x = block
        yield from best_by_mode(model.codec, ids, chained(x, model.chain), batches, k, mode, ht)

    return ranked(blockwise(index.codes.select("id", "code"), query_blocks(queries), task, S.FOUND), k)


def packed_codes(codes: np.ndarray, bits: int) -> np.ndarray:
    """Code numbers of ``bits`` bits in 64-bit words, none over two words."""
    fields = 64 // bits
    words = np.zeros((len(codes), -(-codes.shape[1] // fields)), np.uint64)
    for i in range(codes.shape[1]):
        words[:, i // fields] |= codes[:, i].astype(np.uint64) << np.uint64(bits * (i % fields))
    return words


def differing_numbers(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """How many numbers of ``packed_codes`` differ, of all rows of x and y: each number's differing bits are folded to its lowest."""
    lowest, out = np.uint64(sum(1 << bits * i for i in range(64 // bits))), np.zeros((len(x), len(y)), np.int64)
    for w in range(x.shape[1]):
        other, width = x[:, w, None] ^ y[None, :, w], 1
        while width < bits:
            step = min(width, bits - width)
            other |= other >> np.uint64(step)
            width += step
        out += np.bitwise_count(other & lowest)
    return out


def best_by_mode(codec: Product, ids: np.ndarray, y: np.ndarray, batches, k: int, mode: str, ht: int):
    """The best of a task's codes (id, code) by a rule of ``product_modes``, for queries by tiles: no more than ``TILE_CELLS`` pairs are held.

    Differing bits and numbers are counted in whole words; by tables only the pairs that a polysemous rule lets through are summed.
    """
    own = codec.encode(y).astype(np.int64)
    own_words, tiles = packed_codes(own, codec.bits), S.Tiles(len(ids), k, False)
    between = codec.code_distances() if mode == "symmetric" else None
    for batch in batches:
        code, row_ids = matrix(batch.column("code")).astype(np.int64), batch.column("id").to_numpy()
        if not len(code):
            continue
        words = packed_codes(code, codec.bits)
        for a, b, best, part in tiles.each(len(code)):
            if mode == "symmetric":
                d = sum(between[i][own[a:b, i, None], code[None, part, i]] for i in range(codec.m))
                best.add(np.where(np.isinf(d), np.nan, d), row_ids[part])
                continue
            n = differing_numbers(own_words[a:b], words[part], codec.bits) if "generalized" in mode else S.hamming_matrix(own_words[a:b], words[part])
            if mode in ("hamming", "generalized"):
                best.add(n.astype(float), row_ids[part])
                continue
            q, c = np.nonzero(n < ht)
            tables, near = codec.tables(y[a:b]), code[part][c]
            d = sum(tables[q, i, near[:, i]] for i in range(codec.m))
            left = np.flatnonzero((d <= best.worst[q]) & ~np.isinf(d))
            if len(left):
                best.add_rows(q[left], d[left], row_ids[part][c[left]])
    yield from tiles.batches(ids)
