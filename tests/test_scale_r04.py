"""Rows of similar titles are told without Python, and a task holds few of them at once."""

from __future__ import annotations

import re

from quillmesh.operators import resolve


def test_rows_of_a_title_are_told_by_spark_alone(spark):
    ids = [*(f"id {i}" for i in range(2 * resolve.STEP + 5)), "id 7", None]
    df = spark.createDataFrame([*((i, "Red widget") for i in ids), ("x", "red widgets"), ("y", "blue bolt"), ("z", None)], "id string, name string")
    made = resolve.similar(df, df, digits=6)
    same = [(a, b, 1.0) for a in ids for b in ids] + [("x", "x", 1.0), ("y", "y", 1.0)]
    near = [p for a in ids for p in ((a, "x", 0.952381), ("x", a, 0.952381))]
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, same + near))
    dealt = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    steps = re.findall(r"(?m)^\W*(?:\(\d+\) )?(Generate|Coalesce|Exchange|MapInArrow|ShuffleQueryStage)", dealt)
    # What Spark explodes in one piece of generated code it holds whole; Coalesce stands between two such pieces.
    assert steps[:4] == ["Generate", "Coalesce", "Generate", "Generate"] and "MapInArrow" not in steps, dealt
