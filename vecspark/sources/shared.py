"""What the driver and the executors share: a folder of tables, and this package's sources."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and all runs in one process, as in tests, a new local folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vecspark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vecspark/{name}-{uuid.uuid4().hex}"


#: Rows of a few numbers that are worth a file, where it is known how many there are.
FILE_ROWS = 1 << 16


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: its lineage ends there, and any executor can be lost afterwards.

    rows: about how many rows there are at most, if known; they go to no more files than it takes, as Hadoop without its native library
    forks the executor three times for each file on a local disk, to run chmod. Only for plans that end in a shuffle.
    """
    path = new_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(rows // FILE_ROWS + 1)).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors once a context, for workers that lack the repository on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_vecspark_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for at, _, names in os.walk(os.path.join(top, "vecspark")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), top))
    path = os.path.join(tempfile.mkdtemp(prefix="vecspark-"), "vecspark_sources.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    sc._vecspark_shipped = True
