import numpy as np
import pytest

from quillmesh.operators import neighbours as N
from quillmesh.operators import resolve


def brute(asked, points, top):
    """{position of the asked row: [(key, score)]}: every cosine, the best by score and key."""
    def unit(v):
        v = np.array(v, float)
        return v / np.linalg.norm(v)

    out = []
    for a, q in asked:
        s = sorted(((-round(float(unit(q) @ unit(v)), 6), k) for k, v in points))[:top]
        out += [(a, k, -x + 0.0) for x, k in s]
    return sorted(out)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(12, 16))
    size = [600] + [30] * 11  # one cluster holds most rows
    rows = [(c, middles[c] + 0.08 * rng.normal(size=16)) for c, n in enumerate(size) for _ in range(n)]
    out = [(i, np.round(v, 3).tolist()) for i, (_, v) in enumerate(rows)]
    return out + [(5000 + i, out[3][1]) for i in range(8)]  # ties


def test_neighbours_are_those_of_brute_force_and_few_blocks_meet(spark, clustered, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 512)  # 32 vectors a block
    monkeypatch.setattr(N, "PART", 2)
    monkeypatch.setattr(N, "LEAST", 3)
    monkeypatch.setattr(N, "SHARE", 200)  # the vector that nine rows have is joined in pieces
    df = spark.createDataFrame(clustered, "id long, v array<double>").repartition(3)
    told = {}
    got = N.neighbours(df, df, "v", "id", 5, cells=12, told=told)
    assert sorted(map(tuple, got.collect())) == brute(clustered, clustered, 5)
    assert told["met"] < told["all"] / 2


def test_asked_apart_from_points_with_keys_of_text_and_rows_without_a_direction(spark, clustered):
    points = [(f"p{i % 200:03d}", v) for i, v in clustered[:400]]  # each key twice
    asked = [(f"q{i}", v) for i, v in clustered[100:900:20]]
    odd = [("n", None), ("z", [0.0] * 16), ("i", [float("inf")] * 16), ("h", [None] * 16)]
    schema = "id string, v array<double>"
    got = N.neighbours(spark.createDataFrame(asked + odd, schema), spark.createDataFrame(points + odd, schema), "v", "id", 4, cells=6)
    assert sorted(map(tuple, got.collect())) == brute(asked, points, 4)


def test_few_points_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6])], schema)
    none = two.limit(0)
    assert N.neighbours(two, none, "embedding", "vec_id", 5).collect() == []
    assert N.neighbours(none, two, "embedding", "vec_id", 5).collect() == []
    assert sorted(map(tuple, N.neighbours(two, two, "embedding", "vec_id", 5).collect())) == [(1, 1, 1.0), (1, 2, 0.8), (2, 1, 0.8), (2, 2, 1.0)]
    assert [tuple(r) for r in resolve.embedding_band(two).collect()] == [(1, 2, 0.8)]
