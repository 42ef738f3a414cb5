"""Vector tables: those of the test data, raw binary files, generators, and indexes at rest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions import vectors as V

DIM = 64
#: Little-endian types of raw files, their numpy names and bytes.
TYPES = {"uint8": 1, "int8": 1, "int16": 2, "uint16": 2, "int32": 4, "uint32": 4, "int64": 8, "float32": 4, "float64": 8}


def floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec (double), label of the ``embeddings`` table."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as whole numbers 0..255: floor(128 x) + 128, in which all sums are exact."""
    return floats(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: F.floor(x * 128) + 128))


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, words: one bit for each element that isn't negative, label."""
    return floats(spark, sf_dir).select("id", V.packed_signs(F.col("vec"), DIM).alias("words"), "label")


def as_queries(base: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return base.where("id % 20 = 0").withColumnRenamed("id", "query_id")


def record_count(spark: SparkSession, path: str, record: int) -> int:
    """Rows of headerless binary files: their bytes by the record's."""
    return spark.sparkContext.binaryRecords(path, record).count()


def raw_vectors(spark: SparkSession, path: str, dtype: str, dim: int, start: int = 0, count: int | None = None) -> DataFrame:
    """id, vec of a headerless file of ``dim`` numbers a row; optionally ``count`` rows from row ``start`` on."""
    width = TYPES[dtype] * dim
    kind = "double" if dtype.startswith("float") else "bigint"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            data = np.frombuffer(b"".join(batch.column("record").to_pylist()), np.dtype(dtype).newbyteorder("<")).astype(np.float64 if kind == "double" else np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(data) + 1, dim), pa.int32()), pa.array(data))], ["id", "vec"])

    rows = spark.sparkContext.binaryRecords(path, width).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    frame = spark.createDataFrame(rows, "id bigint, record binary").where(F.col("id") >= start)
    if count is not None:
        frame = frame.where(F.col("id") < start + count)
    return frame.mapInArrow(run, f"id bigint, vec array<{kind}>")


def strided_vectors(spark: SparkSession, path: str, dtype: str, stride: int, sizes: DataFrame) -> DataFrame:
    """As ``raw_vectors`` for rows of ``stride`` numbers of which the first ``n`` count; ``sizes`` (id, n)."""
    rows = raw_vectors(spark, path, dtype, stride)
    return rows.join(sizes.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select("id", F.slice("vec", 1, F.col("n")).alias("vec"))


def write_raw(df: DataFrame, path: str, dtype: str, columns: list[str]) -> list[str]:
    """Writes the columns (numbers, or arrays of one length) of each row, in order of the frame, as records without header.

    One file a partition, ``part-000000`` and so on, put together by Arrow batches, whatever its size; ``raw_files`` reads
    the folder in that order. ``path`` is a folder that the executors share; what lies there is deleted. A task writes under a
    name of its own and renames at its end, so that a lost or repeated one leaves no half file. Nulls raise an error; a
    partition without rows gives an empty file, a frame without partitions an empty folder.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, written = TaskContext.get(), 0
        kind = np.dtype(dtype).newbyteorder("<")
        files, at = _arrow_files(path)
        name, own = f"part-{task.partitionId():06d}", f"{at}/_part-{task.taskAttemptId()}"
        with files.open_output_stream(own) as out:
            for batch in batches:
                parts = []
                for c in columns:
                    values = batch.column(c)
                    flat = values.flatten() if pa.types.is_list(values.type) else values
                    if values.null_count or flat.null_count:
                        raise ValueError(f"nulls in {c}")
                    if len(values):
                        parts.append(flat.to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(kind))
                if parts:
                    out.write(np.hstack(parts).tobytes())
                    written += len(batch)
        files.move(own, f"{at}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written])], ["name", "n"])

    folder, files = _hadoop_files(df.sparkSession, path)
    files.delete(folder, True)
    files.mkdirs(folder)
    return sorted(r.name for r in df.select(*columns).mapInArrow(run, "name string, n bigint").collect())  # a row a partition


def raw_files(spark: SparkSession, path: str) -> str:
    """The files of a folder in order of their names, as ``raw_vectors`` and ``record_count`` take them."""
    folder, files = _hadoop_files(spark, path)
    return ",".join(sorted(f.getPath().toString() for f in files.listStatus(folder) if not f.getPath().getName().startswith("_")))


def _hadoop_files(spark: SparkSession, path: str):
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(sc._jsc.hadoopConfiguration())


def _arrow_files(path: str):
    """Arrow's file system for a path as Hadoop writes it, where ``file:/x`` is a local one."""
    from pyarrow import fs

    local = path.removeprefix("file:")
    if "://" in local:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + local.lstrip("/")


def uniform(spark: SparkSession, n: int, d: int, seed: int = 1234) -> DataFrame:
    """Random vectors in [0, 1)."""
    return spark.range(n).select("id", F.array(*[F.rand(seed + i) for i in range(d)]).alias("vec"))


def gaussian(spark: SparkSession, n: int, d: int, seed: int = 1234) -> DataFrame:
    return spark.range(n).select("id", F.array(*[F.randn(seed + i) for i in range(d)]).alias("vec"))


def whole_numbers(spark: SparkSession, n: int, d: int, top: int, seed: int = 1234) -> DataFrame:
    """Random whole numbers in [0, top)."""
    return spark.range(n).select("id", F.array(*[F.floor(F.rand(seed + i) * top) for i in range(d)]).alias("vec"))


def smooth(spark: SparkSession, n: int, d: int, seed: int = 1234, inner: int = 8) -> DataFrame:
    """Vectors on a curved surface of few dimensions: sines of random mixes of ``inner`` random numbers."""
    import numpy as np

    mix = np.random.default_rng(seed).random((d, inner)) * 4
    low = gaussian(spark, n, inner, seed)
    rows = F.array(*[F.sin(sum((F.get("vec", j) * float(mix[i, j]) for j in range(inner)), F.lit(0.0))) for i in range(d)])
    return low.select("id", rows.alias("vec"))


def save_tables(path: str, tables: dict[str, DataFrame], meta: dict) -> None:
    """An index at rest: a folder of Parquet tables and their description."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(meta | {"tables": sorted(tables)}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_tables(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads("".join(r[0] for r in spark.read.text(f"{path}/meta").collect()))
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta.pop("tables")}, meta


def save_by_list(codes: DataFrame, path: str) -> None:
    """Codes in one folder a list: a search reads the lists that it probes (partition pruning). Adaptive execution splits hot lists over tasks."""
    codes.hint("rebalance", F.col("list_no")).write.mode("overwrite").partitionBy("list_no").parquet(path)


def read_lists(spark: SparkSession, path: str, lists: list[int] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if lists is None else rows.where(F.col("list_no").isin(lists))


