"""Ranks of rows by sorted pairs, the step of prefix doubling: Spark sorts by the pairs, and a row's rank is the number of its pair in that order.

Equal pairs are split over parts like others, as ties are sorted by place; what parts know of each other is a row for each
end of a part, so a pair that all rows have is no more for a task than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import lean, stash


def rerank(rows: DataFrame, levels: list[list[str]], tie: list[str]) -> DataFrame:
    """rows, a written table, with rank0, many0 and so on for each of levels: columns of longs that are sorted by, one level after the other.

    A rank numbers what all columns up to its level hold, and many tells whether another row holds the same. head marks the
    first row of each last rank in a part, at least one of each. Rows whose first rank is theirs alone are left out.
    """
    keys, names = [c for x in levels for c in x], rows.columns
    upto = np.cumsum([len(x) for x in levels]).tolist()
    depth = range(len(levels))

    def told(b: pa.RecordBatch, run: list[np.ndarray], many: list[np.ndarray], head: np.ndarray, edge: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
        use = np.flatnonzero(many[0] | (edge > 0))
        if len(use):
            made = [pa.array(np.full(len(use), part, np.int32)), pa.array(edge[use].astype(np.int32)), pa.array(head[use]), *[pa.array(x[use]) for x in (*run, *many)]]
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(use)).columns, *made], names=[*names, "part", "edge", "head", *[f"run{i}" for i in depth], *[f"many{i}" for i in depth]])

    @lean
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, None
        count = [-1 for _ in depth]
        for b in batches:
            if not b.num_rows:
                continue
            values = [b.column(names.index(c)).to_numpy() for c in keys]
            differ = np.empty((len(keys), b.num_rows), bool)
            for d, v, before in zip(differ, values, last or [None] * len(keys), strict=True):
                d[1:] = v[1:] != v[:-1]
                d[0] = before is None or v[0] != before
            new = [differ[:u].any(axis=0) for u in upto]
            run = [n + np.cumsum(x) for n, x in zip(count, new, strict=True)]
            if held is not None:
                old, of, as_before, head, edge = held
                yield from told(old, of, [a | ~x[:1] for a, x in zip(as_before, new, strict=True)], head, edge, part)
            edge = np.zeros(b.num_rows, np.int64)
            edge[0] = int(held is None)
            many = [~x[:-1] | ~x[1:] for x in new]
            yield from told(b.slice(0, b.num_rows - 1), [x[:-1] for x in run], many, new[-1][:-1], edge[:-1], part)
            held = (b.slice(b.num_rows - 1), [x[-1:] for x in run], [~x[-1:] for x in new], new[-1][-1:], edge[-1:])
            count, last = [int(x[-1]) for x in run], [v[-1] for v in values]
        if held is not None:
            old, of, as_before, head, edge = held
            yield from told(old, of, as_before, head, edge + 2, part)

    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + ["part int, edge int, head boolean"] + [f"run{i} long" for i in depth] + [f"many{i} boolean" for i in depth])
    order = [*keys, *tie]
    found = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, schema))

    ends: dict[int, dict[int, tuple]] = {}
    for r in found.filter("edge > 0").select("part", "edge", *[f"run{i}" for i in depth], *keys).collect():  # two rows a part
        for side in (1, 2):
            if r["edge"] & side:
                ends.setdefault(r["part"], {})[side] = tuple(r)[2:]
    goal, before = [], None
    base, joined = [0 for _ in depth], {}
    for p in sorted(ends):
        first, end = ends[p][1], ends[p][2]
        same = [before is not None and before[len(levels) :][: upto[i]] == first[len(levels) :][: upto[i]] for i in depth]
        base = [0 if before is None else b + before[i] + (not same[i]) for i, b in zip(depth, base, strict=True)]
        joined[p] = same
        goal.append([p, *base, *same, *end[: len(levels)]])
        before = end
    after = [joined[p] for p in sorted(ends)][1:] + [[False for _ in depth]]
    rows_ = [[*g, *a] for g, a in zip(goal, after, strict=True)] if goal else []
    kinds = ["_part int"] + [f"base{i} long" for i in depth] + [f"first{i} boolean" for i in depth] + [f"last{i} long" for i in depth] + [f"next{i} boolean" for i in depth]
    sides = F.broadcast(rows.sparkSession.createDataFrame(rows_, ", ".join(kinds)))
    many = [F.col(f"many{i}") | ((F.col(f"run{i}") == 0) & F.col(f"first{i}")) | ((F.col(f"run{i}") == F.col(f"last{i}")) & F.col(f"next{i}")) for i in depth]
    both = found.join(sides, F.col("part") == F.col("_part")).filter(many[0])
    out = both.select(*[F.col(f"`{c}`") for c in names], "head", *[(F.col(f"base{i}") + F.col(f"run{i}")).alias(f"rank{i}") for i in depth], *[m.alias(f"many{i}") for i, m in enumerate(many)])
    out._stash = found._stash
    return out
