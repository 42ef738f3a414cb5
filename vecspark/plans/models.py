"""Analytic models of a search: latency by phase, arithmetic intensity, roofs; and the reading of run logs.

All are expressions over a table of configurations. Phases: CL (nearest lists), RC (residuals), LC (tables), DC
(distances), TS (sorting).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the model: bytes of a centroid's, query's, residual's, codeword's element, a code, an entry of the
#: squares' table, of the distance table, a distance; alignment; random access over sequential; overheads of LC and DC.
BYTES = {"c": 1, "q": 1, "r": 2, "cb": 1, "a": 1, "sqt": 2, "l": 4, "d": 4}
ALIGN, RANDOM, LC_MORE, DC_MORE = 4, 484.051 / 112.368, 1.6, 1.34
#: Clocks in Hz, memory in bytes a second of a unit and of the host.
HOST_CLOCK, UNIT_CLOCK, NEAR, FAR, HOST_MEMORY = 2.4e9, 450e6, 1612.56 * 2**20, 573.79 * 2**20, 19.2 * 2**30


def latency(units: Column, threads: Column, bytes_: dict[str, int] = BYTES) -> dict[str, Column]:
    """Seconds of each phase and in total, over columns N (base), D, K, P (probes), C (codes a list), M, CB, Q, P_unit (probes a unit)."""
    n, d, k, p, c, m, cb, q, pu = (F.col(x).cast("double") for x in ("N", "D", "K", "P", "C", "M", "CB", "Q", "P_unit"))
    b = bytes_
    lists, vector, record = F.ceil(n / c), F.ceil(d * b["q"] * 4 * 8 / 256), -(-(b["l"] + b["a"]) // ALIGN) * ALIGN
    near, far = units * NEAR / RANDOM, units * FAR
    pairs, codes = q * pu, q * pu * c
    coarse_work = q * lists * ((3 * vector - 1 + F.ln(p) - 1) + (2 * vector + F.ln(p) + 1))
    coarse_bytes = q * lists * ((b["c"] + b["q"]) * d + (b["q"] * 4 + b["a"]) * (F.ln(p) + 1))
    unit = lambda work, close, distant: F.greatest(work / (UNIT_CLOCK * units), close / near + distant / far)
    out = {"CL": F.greatest(coarse_work / (HOST_CLOCK * threads), F.least(n * m * b["a"], coarse_bytes) / HOST_MEMORY)}
    out["RC"] = unit(4 * pairs * d, b["r"] * pairs * d, (b["c"] + b["q"]) * pairs * d)
    out["LC"] = LC_MORE * unit(pairs * cb * ((d / m * 3 - 1) * m + (m + 2 * d) * b["l"] / b["r"]), pairs * cb * (b["l"] * m + (b["r"] + b["sqt"]) * d), pairs * cb * b["cb"] * d)
    out["DC"] = DC_MORE * unit(codes * (3 * m), codes * (m * b["l"] + b["d"]), codes * m * b["a"])
    out["TS"] = unit(codes * 2 * F.ln(k) + q * k, codes * (F.ln(k) + 1) * record, q * k * record)
    out["total"] = F.greatest(out["CL"], out["RC"] + out["LC"] + out["DC"] + out["TS"])
    return out


def performance(configs: DataFrame, units: int = 2543, threads: int = 64) -> DataFrame:
    """``configs`` with the latency of each phase and the queries a second."""
    found = latency(F.lit(units), F.lit(threads))
    return configs.select("*", *[v.alias(f"t_{k}") for k, v in found.items()]).withColumn("qps", F.col("Q") / F.col("t_total"))


def intensity(configs: DataFrame) -> DataFrame:
    """``configs`` (name, dim, nlist, nprobe, M, query_batch_size, K, N, CB) with operations, bytes and their ratio."""
    dim, nlist, nprobe, m, q, k, n, cb = (F.col(x).cast("double") for x in ("dim", "nlist", "nprobe", "M", "query_batch_size", "K", "N", "CB"))
    codes, pairs = F.ceil(n / nlist), q * nprobe
    work = q * nlist * ((3 * dim - 1) + F.ceil(F.log2(nprobe + 1))) + pairs * dim + pairs * cb * m * (3 * F.ceil(dim / m) - 1) + pairs * codes * (2 * m - 1) + pairs * codes * F.ceil(F.log2(k + 1))
    moved = (
        q * (nlist * dim * 8 + 8 * nprobe) + pairs * dim * 12 + pairs * cb * (dim * 8 + m * 4)
        + F.least(n, pairs * codes) * (m * F.ceil(F.log2(cb) / 8)) + pairs * (m * cb * 4 + codes * 4) + q * k * 8
    )
    return configs.select("*", work.alias("operations"), moved.alias("bytes")).withColumn("intensity", F.col("operations") / F.col("bytes"))


def scaled(platforms: DataFrame, factors: dict[str, list[int]]) -> DataFrame:
    """``platforms`` (name, computing_power, bandwidth) and their multiples, named like ``GPUx2``; those of several multiples lose themselves."""
    out = platforms.where(~F.col("name").isin([n for n, f in factors.items() if len(f) > 1]))
    for name, own in factors.items():
        for f in own:
            more = platforms.where(F.col("name") == name).select(F.concat(F.col("name"), F.lit(f"x{f}")).alias("name"), (F.col("computing_power") * f).alias("computing_power"), (F.col("bandwidth") * f).alias("bandwidth"))
            out = out.unionByName(more)
    return out


def roofs(intensities: DataFrame, platforms: DataFrame) -> DataFrame:
    """Every data set (name, intensity) on every platform: the reachable operations, and whether memory bounds them. Both are short lists."""
    p = platforms.select(F.col("name").alias("platform"), "computing_power", "bandwidth")
    both = intensities.select("name", "intensity").join(F.broadcast(p), F.lit(True))
    reach = F.col("bandwidth") * F.col("intensity")
    return both.select("name", "platform", F.least("computing_power", reach).alias("reachable"), (reach < F.col("computing_power")).alias("memory_bound"))


def configs_of(spark: SparkSession, path: str) -> DataFrame:
    """name and fields of a JSON object of objects."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("name", "v"))
    keys = sorted({k for r in rows.select(F.map_keys("v")).collect() for k in r[0]})  # a file of a few lines
    return rows.select("name", *[F.col("v")[k].alias(k) for k in keys])


def run_log(lines: DataFrame) -> DataFrame:
    """dataset, nlist, nprobe, seconds of a log's runs: ``lines`` (value, at) in order of ``at``.

    A line of a run's configuration is followed by one of its time; of configurations without a time before the next
    one nothing is said. Logs are a file a run, so that one window over a file's lines is bounded by it.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("file").orderBy("at") if "file" in lines.columns else W.orderBy("at")
    config = F.col("value").contains("Config: ")
    time = F.regexp_extract("value", r"\[Host\]\s+Total time for query searching: ([0-9.eE+-]+)s", 1)
    marked = lines.withColumn("config", F.when(config, F.col("value"))).withColumn("seconds", F.when(time != "", time.cast("double")))
    runs = marked.withColumn("run", F.sum(config.cast("int")).over(w)).where("run > 0")
    group = ["file", "run"] if "file" in lines.columns else ["run"]
    found = runs.groupBy(*group).agg(F.first("config", ignorenulls=True).alias("config"), F.min_by("seconds", F.when(F.col("seconds").isNotNull(), F.col("at"))).alias("seconds")).where("seconds IS NOT NULL")
    name = r"clustersFileName = .*[^a-zA-Z0-9]([a-zA-Z0-9]*?)C(\d+)M.*\.clusters,"
    return found.select(
        F.regexp_extract("config", name, 1).alias("dataset"), F.regexp_extract("config", name, 2).cast("int").alias("nlist"),
        F.regexp_extract("config", r"nprobe = (\d+),", 1).cast("int").alias("nprobe"), "seconds",
    )


def throughput(runs: DataFrame, queries: int, fixed: dict[str, object], varied: str) -> DataFrame:
    """Queries a second by one parameter, the others fixed; of repeated runs the slowest holds. For ``write.csv``."""
    for k, v in fixed.items():
        runs = runs.where(F.col(k) == v)
    return runs.groupBy(varied).agg((queries / F.max("seconds")).alias("qps"))
