"""Structured Streaming: incremental adding, searching in micro-batches, and windows of slices.

A micro-batch that is run again after a failure writes to its own folder, by its number, and overwrites it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.operators import search as S
from vecspark.plans.index import VectorIndex
from vecspark.sources.shared import new_path


def _drained(stream: DataFrame, each, name: str) -> str:
    """Runs ``each(batch)`` -> table on all that is there and returns the folder of what was written, a folder a batch."""
    spark = stream.sparkSession
    path = new_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{path}/data"


def add_stream(index: VectorIndex, vectors: DataFrame) -> DataFrame:
    """Encodes a stream of (id, vec) and returns the codes so far: list_no, id, code, batch."""
    spark = vectors.sparkSession
    return spark.read.parquet(_drained(vectors, index.encode, "added"))


def search_stream(queries: DataFrame, base: DataFrame, k: int, integer: bool = False) -> DataFrame:
    """Answers a stream of queries (query_id, vec) batch by batch: each is the bounded query set of one search."""
    spark = queries.sparkSession
    return spark.read.parquet(_drained(queries, lambda b: S.knn(b, base, k, integer=integer), "answers"))


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of windows of event time, of a stream or a table; late events beyond the watermark are dropped."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", late) if events.isStreaming else own
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return own.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def windowed_stream(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """The counts of a stream's windows, as of its end."""
    spark, name = events.sparkSession, "windowed_" + new_path(events.sparkSession, "w").rpartition("-")[2]
    query = windowed_counts(events, size, slide).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def sliding_index(slices: DataFrame, index: VectorIndex, size: int) -> DataFrame:
    """Codes of the ``size`` newest slices of a stream of (id, vec, slice_id): each batch adds, and what is older is dropped when read."""
    spark = slices.sparkSession

    def encode(batch: DataFrame) -> DataFrame:
        return index.encode(batch).join(batch.select(F.col("id").alias("_i"), "slice_id"), F.col("id") == F.col("_i")).drop("_i")

    codes = spark.read.parquet(_drained(slices, encode, "slices"))
    newest = codes.agg(F.max("slice_id").alias("_newest"))
    return codes.crossJoin(F.broadcast(newest)).where(F.col("slice_id") > F.col("_newest") - size).drop("_newest", "batch")
