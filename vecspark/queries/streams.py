"""Queries over streams, run until all that is there is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.queries.searching import _ivf, _whole
from vecspark.queries.sql import LISTS, PAIRS, sql, top
from vecspark.registry import query
from vecspark.sources import tables as T
from vecspark.streaming import incremental as N


def _stream(spark, sf_dir, table: str):
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")


def _vectors(spark, sf_dir):
    rows = _stream(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 128) + 128).alias("vec"), "label")


@query("stream_add", sql("SELECT list_no::INTEGER AS list_no, id FROM a", LISTS))
def stream_add(spark, sf_dir):
    return N.add_stream(_ivf(T.integers(spark, sf_dir)), _vectors(spark, sf_dir)).select("list_no", "id")


@query("stream_search", sql(top(PAIRS, 10)))
def stream_search(spark, sf_dir):
    queries = _vectors(spark, sf_dir).where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return _whole(N.search_stream(queries, T.integers(spark, sf_dir), 10, True)).select("query_id", "rank", "id", "dist")


@query("stream_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    return N.windowed_stream(_stream(spark, sf_dir, "events"), "1 day").withColumns({"total": F.round("total", 4), "start": F.date_format("start", "yyyy-MM-dd")})


@query("sliding_windows", "SELECT strftime(w, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY ALL")
def sliding_windows(spark, sf_dir):
    return N.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "2 days", "1 day").withColumns({"total": F.round("total", 4), "start": F.date_format("start", "yyyy-MM-dd")})


@query("stream_sliding_index", sql("SELECT list_no::INTEGER AS list_no, id, label::INTEGER AS slice_id FROM a WHERE label > (SELECT max(label) FROM a) - 3", LISTS))
def stream_sliding_index(spark, sf_dir):
    slices = _vectors(spark, sf_dir).withColumnRenamed("label", "slice_id")
    return N.sliding_index(slices, _ivf(T.integers(spark, sf_dir)), 3).select("list_no", "id", "slice_id")
