"""The stored inverted file against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import vectors
from lakeloom.operators.cells import CellIndex
from lakeloom.sources.formats import work_dir


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(11)
    return rng.normal(size=(40, 16))[rng.integers(0, 40, 1600)] * 4 + rng.normal(size=(1600, 16)) * 0.5


@pytest.fixture(scope="module")
def table(spark, points):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>").cache()


@pytest.fixture(scope="module")
def root(spark, table):
    root = work_dir(spark) + "/index"
    CellIndex(spark, root).build(table, parts=8)
    return root


def test_prunes_and_finds(spark, points, table, root):
    index = CellIndex(spark, root)  # opened from the folder alone
    q = table.filter("vec_id % 50 = 0")
    brute = {(i, int(j)) for i in range(0, 1600, 50) for j in np.argsort(((points - points[i]) ** 2).sum(1))[1:11]}
    for found in (index.search(q), index.search_codes(q)):
        rows = found.collect()
        assert len({(r["query_id"], r["vec_id"]) for r in rows} & brute) >= 0.9 * len(brute) and len(rows) == len(brute)
        assert np.mean([r["share"] for r in rows]) <= 0.25
        assert all(abs(((points[r["query_id"]] - points[r["vec_id"]]) ** 2).sum() - r["distance"]) < 1e-6 for r in rows)


def test_all_cells_give_the_exact_result(spark, table, root):
    index = CellIndex(spark, root)
    q = table.filter("vec_id % 100 = 0")
    everything = index.search(q, probes=10**6)
    key = ["query_id", "rank", "vec_id"]
    assert sorted(everything.select(*key).collect()) == sorted(vectors.nearest(spark, q, table, 10).select(*key).collect())
    assert {r["share"] for r in everything.select("share").collect()} == {1.0}


def test_scan_reads_probed_folders_and_needed_columns(spark, table, root):
    plan = CellIndex(spark, root).search(table.filter("vec_id = 0"), probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "code" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_odd_rows(spark, points):
    rows = [(i, points[i].tolist()) for i in range(60)]
    odd = [(100, None), (101, [None] * 16), (102, [float("nan")] * 16), (103, [float("inf")] * 16), (5, points[5].tolist())]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).withColumn("code", F.lit(1))
    index = CellIndex(spark, work_dir(spark) + "/index").build(table, parts=4)
    found = index.search(table, 3, probes=99).collect()
    assert {r["query_id"] for r in found} == set(range(60)) and not {r["vec_id"] for r in found} & {100, 101, 102, 103}
    near = [r["vec_id"] for r in found if r["query_id"] == int(np.argsort(((points[:60] - points[5]) ** 2).sum(1))[1])]
    assert near.count(5) == 2  # repeated rows are all kept
    empty = CellIndex(spark, work_dir(spark) + "/index").build(table.limit(0), parts=4)
    assert empty.search(table).count() == 0
    assert index.search(table.limit(0)).count() == 0


def test_many_equal_vectors(spark):
    table = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.when(F.col("id") % 3 > 0, 1.0).otherwise(F.col("id") * j % 7) for j in range(1, 5)]).alias("embedding"))
    found = CellIndex(spark, work_dir(spark) + "/index").build(table).search(table.filter("vec_id = 1"), 5).collect()
    assert sorted(r["vec_id"] for r in found) == [2, 4, 5, 7, 8] and all(r["distance"] == 0 for r in found)
