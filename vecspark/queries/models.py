"""Queries over layout plans and analytic models."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.plans import layout as L
from vecspark.plans import models
from vecspark.queries.searching import _both, _ivf
from vecspark.queries.sql import LISTS, sql
from vecspark.registry import query
from vecspark.sources import tables as T

COSTS = L.Costs(10, 100, 5, 2)
SLICE = 8
_HEAT = "h AS (SELECT s.list_no, s.n, coalesce(f.frequency, 0) AS frequency, coalesce(f.frequency, 0) * s.n AS heat FROM (SELECT list_no, count(*) AS n FROM a GROUP BY list_no) s LEFT JOIN (SELECT list_no, count(*) AS frequency FROM p GROUP BY list_no) f USING (list_no))"


def _heat(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    index = _ivf(base)
    freq = index.probes(queries).groupBy(F.col("list_no").alias("_l")).agg(F.count("*").alias("frequency"))
    rows = index.list_sizes().join(freq, F.col("list_no") == F.col("_l"), "left").drop("_l").fillna(0, ["frequency"])
    return index, rows.withColumn("heat", F.col("frequency") * F.col("n"))


@query("list_costs", sql("SELECT list_no::INTEGER AS list_no, (heat * 7 + frequency * 110)::BIGINT AS cost FROM h", LISTS, _HEAT))
def list_costs(spark, sf_dir):
    return _heat(spark, sf_dir)[1].select("list_no", COSTS.of(F.col("heat"), F.col("frequency")).alias("cost"))


@query("hot_copies", sql("SELECT list_no::INTEGER AS list_no, (CASE WHEN row_number() OVER (ORDER BY heat DESC, list_no) <= floor(0.25 * 8) THEN 3 WHEN row_number() OVER (ORDER BY heat DESC, list_no) <= floor(0.75 * 8) THEN 2 ELSE 1 END)::INTEGER AS copies FROM h", LISTS, _HEAT))
def hot_copies(spark, sf_dir):
    return L.bands({0.25: 3, 0.5: 2}, _heat(spark, sf_dir)[1]).select("list_no", "copies")


@query("unit_layout")
def unit_layout(spark, sf_dir):
    return L.layout(L.bands({0.25: 2}, _heat(spark, sf_dir)[1]), 6, COSTS, SLICE)


@query("unit_directory")
def unit_directory(spark, sf_dir):
    return L.directory(unit_layout(spark, sf_dir))


@query("placed_codes")
def placed_codes(spark, sf_dir):
    """unit, n: codes of each unit, copies included."""
    index, _ = _heat(spark, sf_dir)
    return L.placed(index.codes, unit_layout(spark, sf_dir), SLICE).groupBy("unit").agg(F.count("*").alias("n"))


@query("routed_probes")
def routed_probes(spark, sf_dir):
    queries, base = _both(spark, sf_dir)
    return L.routed(_ivf(base).probes(queries), unit_layout(spark, sf_dir))


@query("modulo_routing", sql("SELECT list_no::INTEGER AS list_no, id, (list_no % 3)::INTEGER AS unit, (CASE WHEN list_no < 2 THEN 0 WHEN list_no < 5 THEN 1 ELSE 2 END)::INTEGER AS by_bounds FROM a", LISTS))
def modulo_routing(spark, sf_dir):
    codes = _ivf(T.integers(spark, sf_dir)).codes
    return codes.select("list_no", "id", L.by_modulo(F.col("list_no"), 3).alias("unit"), L.by_bounds(F.col("list_no"), [2, 5]).alias("by_bounds"))


#: The configurations and platforms that the models are stated for.
SETS = [("SIFT1B", 128, 10**9), ("DEEP1B", 96, 10**9), ("SPACEV1B", 100, 10**9), ("T2I1B", 200, 10**9), ("SIFT100M", 128, 10**8), ("DEEP100M", 96, 10**8)]
PLATFORMS = [("PIM", 43.8, 80.4), ("GPU", 156000.0, 1935.0), ("CPU", 288.0, 19.2)]
FACTORS = {"PIM": [16, 24, 32], "GPU": [2]}


def _sets(spark):
    rows = [(name, d, 16384, 32, 16, 10000, 10, n, 256) for name, d, n in SETS]
    return spark.createDataFrame(rows, "name string, dim int, nlist int, nprobe int, M int, query_batch_size int, K int, N bigint, CB int")


_SETS = "s(name, dim, n) AS (VALUES " + ", ".join(f"('{name}', {d}::DOUBLE, {n}::DOUBLE)" for name, d, n in SETS) + ")"
_INTENSITY = """i AS (SELECT name, (10000.0 * 16384 * (3 * dim - 1 + 6) + 320000.0 * dim + 320000.0 * 256 * 16 * (3 * ceil(dim / 16) - 1) + 320000.0 * ceil(n / 16384) * 31 + 320000.0 * ceil(n / 16384) * 4)
 / (10000.0 * (16384 * dim * 8 + 256) + 320000.0 * dim * 12 + 320000.0 * 256 * (dim * 8 + 64) + least(n, 320000.0 * ceil(n / 16384)) * 16 + 320000.0 * (16384 + ceil(n / 16384) * 4) + 800000) AS intensity FROM s)"""


@query("arithmetic_intensity", f"WITH {_SETS}, {_INTENSITY} SELECT name, round(intensity, 6) AS intensity FROM i")
def arithmetic_intensity(spark, sf_dir):
    return models.intensity(_sets(spark)).select("name", F.round("intensity", 6).alias("intensity"))


_ROOFS = "p(platform, power, bandwidth) AS (VALUES " + ", ".join([f"('PIMx{f}', 43.8::DOUBLE * {f}, 80.4::DOUBLE * {f})" for f in FACTORS["PIM"]] + ["('GPU', 156000::DOUBLE, 1935::DOUBLE)", "('GPUx2', 312000::DOUBLE, 3870::DOUBLE)", "('CPU', 288::DOUBLE, 19.2::DOUBLE)"]) + ")"


@query("platform_roofs", f"WITH {_SETS}, {_INTENSITY}, {_ROOFS} SELECT name, platform, round(least(power, bandwidth * intensity), 4) AS reachable, bandwidth * intensity < power AS memory_bound FROM i, p")
def platform_roofs(spark, sf_dir):
    platforms = spark.createDataFrame(PLATFORMS, "name string, computing_power double, bandwidth double")
    out = models.roofs(models.intensity(_sets(spark)), models.scaled(platforms, FACTORS))
    return out.withColumn("reachable", F.round("reachable", 4))


def _unit(work: str, close: str, distant: str) -> str:
    """Seconds of a phase on 2543 units: its operations, or its bytes in near and far memory."""
    near, far = "(2543 * 1612.56e0 * 1048576 / (484.051e0 / 112.368e0))", "(2543 * 573.79e0 * 1048576)"
    return f"greatest(({work}) / (450.0e6 * 2543), ({close}) / {near} + ({distant}) / {far})"


_PHASES = f"""c AS (SELECT name, n::BIGINT AS n, dim AS d, 10.0e0 AS k, p, n / l AS c, 16.0e0 AS m, 256.0e0 AS cb, 10000.0e0 AS q, p / 2543 AS pu, l, ceil(dim / 8) AS vector
 FROM s, (VALUES (8192e0, 96e0), (16384e0, 32e0), (16384e0, 64e0), (16384e0, 96e0), (16384e0, 128e0), (32768e0, 96e0), (65536e0, 96e0)) w(l, p) WHERE name IN ('SIFT100M', 'DEEP100M')),
t AS (SELECT *, greatest(q * ceil(n / c) * (5 * vector + 2 * ln(p) - 1) / (2.4e9 * 64), least(n * m, q * ceil(n / c) * (2 * d + 5 * (ln(p) + 1))) / (19.2e0 * 1073741824)) AS cl,
 {_unit("4 * q * pu * d", "2 * q * pu * d", "2 * q * pu * d")} AS rc,
 1.6e0 * {_unit("q * pu * cb * (3 * d - m + 2 * m + 4 * d)", "q * pu * cb * 4 * (m + d)", "q * pu * cb * d")} AS lc,
 1.34e0 * {_unit("q * pu * c * 3 * m", "q * pu * c * 4 * (m + 1)", "q * pu * c * m")} AS dc,
 {_unit("q * pu * c * 2 * ln(k) + q * k", "q * pu * c * (ln(k) + 1) * 8", "q * k * 8")} AS ts FROM c)"""
_LATENCY = f"""WITH {_SETS}, {_PHASES} SELECT name, n AS "N", d::INTEGER AS "D", k::INTEGER AS "K", p::INTEGER AS "P", round(c, 6) AS "C", m::INTEGER AS "M", cb::INTEGER AS "CB", q::INTEGER AS "Q", round(pu, 6) AS "P_unit", l::INTEGER AS nlist,
 round(cl, 6) AS "t_CL", round(rc, 6) AS "t_RC", round(lc, 6) AS "t_LC", round(dc, 6) AS "t_DC", round(ts, 6) AS "t_TS", round(greatest(cl, rc + lc + dc + ts), 6) AS t_total, round(q / greatest(cl, rc + lc + dc + ts), 3) AS qps FROM t"""


@query("phase_latency", _LATENCY)
def phase_latency(spark, sf_dir):
    """The model over the stated sweeps: lists at 96 probes, probes at 16,384 lists."""
    rows = [(name, n, d, 10, p, n / lists, 16, 256, 10000, p / 2543, lists) for name, d, n in SETS[4:] for lists, p in ((8192, 96), (16384, 32), (16384, 64), (16384, 96), (16384, 128), (32768, 96), (65536, 96))]
    configs = spark.createDataFrame([(a, b, c, k, p, float(s), m, cb, q, float(u), l) for a, b, c, k, p, s, m, cb, q, u, l in rows], "name string, N bigint, D int, K int, P int, C double, M int, CB int, Q int, P_unit double, nlist int")
    out = models.performance(configs)
    return out.withColumns({c: F.round(c, 3 if c == "qps" else 6) for c in out.columns if c in ("C", "P_unit", "qps") or c.startswith("t_")})


_LOG = [
    "Config: dimAmt = 128, nprobe = 96, DPUGroupSize = 1, clustersFileName = index/sift100mC16384M16.clusters, rest",
    "loading", "[Host]  Total time for query searching: 2.5s",
    "Config: dimAmt = 128, nprobe = 64, DPUGroupSize = 1, clustersFileName = index/sift100mC16384M16.clusters, rest",
    "Config: dimAmt = 96, nprobe = 32, DPUGroupSize = 1, clustersFileName = index/deep100mC8192M16.clusters, rest",
    "[Host]  Total time for query searching: 1.25s",
]


def _log(spark):
    return spark.createDataFrame(list(enumerate(_LOG)), "at int, value string")


@query("run_log", "SELECT * FROM (VALUES ('sift100m', 16384, 96, 2.5::DOUBLE), ('deep100m', 8192, 32, 1.25::DOUBLE)) t(dataset, nlist, nprobe, seconds)")
def run_log(spark, sf_dir):
    return models.run_log(_log(spark))


@query("run_throughput", "SELECT 16384 AS nlist, 4000::DOUBLE AS qps")
def run_throughput(spark, sf_dir):
    return models.throughput(models.run_log(_log(spark)), 10000, {"dataset": "sift100m", "nprobe": 96}, "nlist")


_CYCLES = lambda far, near: f"(({far} / (573.79e0 * 1048576) + {near} / (1612.56e0 * 1048576)) * 350.0e6)"


@query("phase_cycles", f"""SELECT d::INTEGER AS d, ceil(d * ({_CYCLES(2, 2)} + 1))::BIGINT AS residual, ceil(256 * (d * ({_CYCLES(1, 3)} + 1) + d - 16))::BIGINT AS tables,
 ceil(16 * {_CYCLES(1, 5)} + 15)::BIGINT AS distance, ceil(({_CYCLES(0, 8)} + 1) * log2(10) + {_CYCLES(0, 4)})::BIGINT AS sorting FROM (VALUES (96), (128)) t(d)""")
def phase_cycles(spark, sf_dir):
    """Cycles of each phase by the ideal cost model, for the two stated dimensions."""
    rows = [(d, c.residual, c.tables, c.distance, c.sorting) for d in (96, 128) for c in [L.Costs.ideal(d, 16, 256, 10)]]
    return spark.createDataFrame(rows, "d int, residual bigint, tables bigint, distance bigint, sorting bigint")
