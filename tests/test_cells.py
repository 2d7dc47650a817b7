import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import cells, search


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in middles[i % 20] + 0.08 * rng.normal(size=16)], "ab"[i % 2]) for i in range(1500)]
    rows += [(2000 + i, rows[7][1], "a") for i in range(4)] + [(3000, None, "a"), (3001, [None] * 16, "a"), (3002, [float("nan")] * 16, "b"), (3003, [0.0] * 16, "b")]
    return spark.createDataFrame(rows, "id long, v array<float>, kind string").repartition(3)


def test_cells_find_what_a_full_scan_finds_and_read_few(points, tmp_path):
    held = cells.Cells.write(points, str(tmp_path), "v", "id", 24)
    whole = points.filter(cells.usable("v"))
    assert sum(n for *_, n in held.known.values()) == whole.count() == 1504
    for asked, where in ((7, None), (8, F.col("kind") == "a"), (9, F.col("id") >= 2000)):
        q = [float(x) for x in points.filter(F.col("id") == asked).first()["v"]]
        want = search.dense(whole.filter(F.lit(True) if where is None else where), "v", q, 10, "id")
        got, read = held.nearest(q, 10, "v", "id", where)
        assert [(r.id, round(r.score, 9)) for r in got.collect()] == [(r.id, round(r.score, 9)) for r in want.collect()]
        assert where is not None or len(read) <= 4
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_bounds_hold_for_every_vector(points, tmp_path):
    held = cells.Cells.write(points, str(tmp_path), "v", "id", 12)
    q = [1.0, -0.5] * 8
    bound = {i: s for s, i in held.bounds(q)}
    for r in held.rows(list(held.known)).withColumn("s", search.cosine(F.col("v"), F.array(*[F.lit(x) for x in q]))).collect():
        assert r.s <= bound[r.cell] + 1e-12


def test_no_rows(spark, tmp_path):
    held = cells.Cells.write(spark.createDataFrame([], "id long, v array<float>"), str(tmp_path), "v", "id")
    got, read = held.nearest([1.0, 0.0], 5, "v", "id")
    assert got.collect() == [] and read == []
