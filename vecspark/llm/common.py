"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.sources.shared import discard, new_path, shared_dir, ship, stored

__all__ = ["SPACE", "discard", "free", "input_bytes", "new_path", "parts_for", "shared_dir", "ship", "sliced", "spread", "stored", "text_bytes"]

#: Bytes of input for each partition of a shuffle that carries whole texts.
PART_BYTES = 8 << 20

#: Bytes of a file from which it is worth while to deal its rows over more tasks.
SPREAD_BYTES = 4 << 20

#: Code points that separate words: space and 0x09 to 0x0D. ``bytes.split()`` splits at just these.
SPACE = " \t\n\x0b\x0c\r"


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads. Where it reads anything else, whose size Spark doesn't know, its texts are measured."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if all(x < 1 << 60 for x in sizes):
        return sum(sizes)
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    row = df.agg(F.count("*"), *[F.sum(F.octet_length(c)) for c in texts]).first()
    return 8 * row[0] + sum(x or 0 for x in row[1:])


def parts_for(df: DataFrame, each: int = PART_BYTES) -> int:
    """Partitions for a shuffle of whole rows of ``df``; grows with the input, no less than the session's setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, input_bytes(df) // each + 1))


def spread(df: DataFrame) -> DataFrame:
    """A table of a few files, which make fewer tasks than there are cores, dealt over all of them. Larger ones stay as they are."""
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, len(df.inputFiles())
    if not 0 < files < cores:
        return df
    size = input_bytes(df)
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(2 * cores) if size > files * SPREAD_BYTES and size // most < cores else df


def free(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterable, rows: int = 512, most: int = 8 << 20) -> Iterator:
    """Arrow batches of at most ``rows`` rows and about ``most`` bytes, so that very long texts don't meet in one."""
    for batch in batches:
        step = max(1, min(rows, int(most * batch.num_rows / max(1, batch.nbytes))))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
