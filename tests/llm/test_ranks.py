"""Ranks by sorted pairs against a plain sort."""

import random
from collections import Counter

import pytest

from quillmesh.llm import common, ranks


@pytest.mark.parametrize("seed", range(4))
def test_ranks_are_those_of_a_plain_sort(spark, seed):
    rng = random.Random(seed)
    hot = [(7, 7, 7)] * 400 if seed % 2 else []
    rows = [(*p, i) for i, p in enumerate(hot + [(rng.randrange(-20, 20), rng.randrange(8), rng.randrange(3)) for _ in range(300)])]
    rng.shuffle(rows)
    df = common.stash(spark.createDataFrame(rows, "a long, b long, c long, at long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str([10000, 7, 1, 50][seed]))
    try:
        got = ranks.rerank(df, [["a", "b"], ["c"]], ["at"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    two, three = Counter(r[:2] for r in rows), Counter(r[:3] for r in rows)
    rank2, rank3 = {p: i for i, p in enumerate(sorted(two))}, {p: i for i, p in enumerate(sorted(three))}
    want = {(*r, rank2[r[:2]], rank3[r[:3]], two[r[:2]] > 1, three[r[:3]] > 1) for r in rows if two[r[:2]] > 1}
    assert {(r.a, r.b, r.c, r["at"], r.rank0, r.rank1, r.many0, r.many1) for r in got} == want and len(got) == len(want)
    assert {r.rank1 for r in got if r["head"]} == {r.rank1 for r in got}
    assert ranks.rerank(df.limit(0), [["a", "b"], ["c"]], ["at"]).collect() == []
