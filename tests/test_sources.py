"""Sources and sinks, sweeps, and what streams share with tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.operators import maintain as M
from vecspark.operators import search as S
from vecspark.plans import models, tuning
from vecspark.plans.factory import vector_index
from vecspark.plans.index import load
from vecspark.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32", "int64"])
def test_raw_files(spark, tmp_path, dtype):
    x = np.arange(60).reshape(12, 5).astype(dtype)
    x.tofile(f"{tmp_path}/raw.bin")
    path = f"file://{tmp_path}/raw.bin"
    assert T.record_count(spark, path, x[0].nbytes) == 12
    rows = {r.id: r.vec for r in T.raw_vectors(spark, path, dtype, 5).collect()}
    assert rows == {i: v.tolist() for i, v in enumerate(x)}
    assert {r.id for r in T.raw_vectors(spark, path, dtype, 5, start=3, count=4).collect()} == {3, 4, 5, 6}
    sizes = spark.createDataFrame([(1, 2), (2, 5)], "id bigint, n int")
    assert {r.id: len(r.vec) for r in T.strided_vectors(spark, path, dtype, 5, sizes).collect()} == {1: 2, 2: 5}


@pytest.mark.parametrize("dtype", ["uint8", "int32", "int64", "float32"])
def test_written_raw_files(spark, tmp_path, dtype):
    """The files' bytes are the rows' and nothing else, in order, also for partitions without rows; nulls raise."""
    big = 2**60 + 1 if dtype == "int64" else 100
    rows = [(i, [float(i), float(i % 7)], big) for i in range(50)]
    frame = spark.createDataFrame(rows, "n int, vec array<double>, big bigint").repartitionByRange(5, "n").sortWithinPartitions("n")
    path = f"file:{tmp_path}/raw"
    names = T.write_raw(frame.where("n > 12"), path, dtype, ["n", "vec", "big"])
    want = [np.array([r[0], *r[1], 0]).astype(dtype) for r in rows[13:]]
    for w in want:
        w[3] = big
    assert b"".join((tmp_path / "raw" / n).read_bytes() for n in names) == b"".join(w.tobytes() for w in want)
    files = T.raw_files(spark, path)
    assert T.record_count(spark, files, want[0].nbytes) == 37
    assert {r.id: r.vec for r in T.raw_vectors(spark, files, dtype, 4).collect()} == {i: w.tolist() for i, w in enumerate(want)}
    with pytest.raises(Exception, match="nulls in n"):
        T.write_raw(spark.createDataFrame([(None,)], "n int"), path, dtype, ["n"])


def test_saved_tables(spark, tmp_path):
    base = T.floats(spark, SF)
    T.save_tables(str(tmp_path), {"base": base, "few": base.limit(3)}, {"d": 64})
    tables, meta = T.load_tables(spark, str(tmp_path))
    assert meta == {"d": 64} and tables["base"].count() == base.count() and tables["few"].count() == 3


def test_saved_index_prunes_lists(spark, tmp_path):
    base = T.floats(spark, SF)
    vector_index(64, "IVF8,SQ8,RFlat").train(base).add(base).save(f"{tmp_path}/index")
    index = load(spark, f"{tmp_path}/index")
    assert index.refined.count() == base.count()
    plan = T.read_lists(spark, f"{tmp_path}/index/codes", [2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list_no" in plan.split("PartitionFilters: [")[1][:200]


def test_generators_repeat(spark):
    for make in (T.uniform, T.gaussian, T.smooth):
        assert make(spark, 20, 4).collect() == make(spark, 20, 4).collect()
    assert all(0 <= x < 9 for r in T.whole_numbers(spark, 20, 4, 9).collect() for x in r.vec)


def test_configs(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"computing_power": 2, "bandwidth": 4}, "b": {"computing_power": 1, "bandwidth": 1}}, indent=1))
    rows = {r.name: (r.computing_power, r.bandwidth) for r in models.configs_of(spark, f"file://{tmp_path}/c.json").collect()}
    assert rows == {"a": (2.0, 4.0), "b": (1.0, 1.0)}


def test_numbers_have_no_gaps(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i) for i in range(100)], "x int, id bigint").repartition(7)
    got = sorted((r.at, r.x) for r in M.numbered(rows, "x", into="at").collect())
    assert [a for a, _ in got] == list(range(100)) and [x for _, x in got] == sorted(x for _, x in got)


def test_sweep_rises_to_the_truth(spark):
    base = T.floats(spark, SF)
    queries = T.as_queries(base)
    index = vector_index(64, "IVF8,Flat").train(base).add(base)
    points = {r.key: r.perf for r in tuning.explore(index, queries, S.knn(queries, base, 5), 5, {"nprobe": [1, 4, 8]}).collect()}
    assert points["nprobe=1"] <= points["nprobe=4"] <= points["nprobe=8"] == 1.0


def test_searches_shuffle_only_their_results(spark):
    """The base is scanned where it lies: the one exchange is by query."""
    base = T.floats(spark, SF)
    plan = S.knn(T.as_queries(base), base, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") == 1 and "WindowGroupLimit" in plan and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def test_selectors_reach_the_scan(spark):
    plan = T.floats(spark, SF).where((F.col("id") >= 3) & (F.col("id") < 9))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,3)" in plan and "LessThan(vec_id,9)" in plan
