"""Nearest vectors from cells: exact, and reading only the cells that can hold one.

Vectors go to the nearest of a fixed number of centres and are written by cell. A cell knows the least and the greatest
angle of its vectors to the centre; by the triangle inequality no vector of it is nearer to a query than the query's own
angle to the centre leaves. A search reads the nearest cells first, until they hold enough rows that pass its filter; the
worst of the best so far is a bound, and of the other cells only those are read whose own bound reaches it. Cells are
partitions of the files, so what is left out is not opened, and the filter is pushed into the scan of the rest.

How much is left out depends on the vectors: where they lie in clusters, most cells; where they point everywhere alike, none.

Edge cases: null vectors, and those with null or non-finite components or of length 0, are in no cell and never found; ties
go to the smaller key; fewer rows than asked for are all there are; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.search import dense

#: Centres, and so rows that the driver and each task hold of them.
CELLS = 64
#: Slack for rounding, in radians.
SLACK = 1e-6


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(vector: str) -> Column:
    """Whether a vector has a direction."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def centres(points: DataFrame, vector: str, key: str, cells: int = CELLS, rounds: int = 3) -> np.ndarray:
    """Unit centres: a sample of 16 rows for each, the same for the same rows, made better by a few rounds of means."""
    rows = points.filter(usable(vector)).orderBy(F.xxhash64(key), key).select(vector).limit(16 * cells).collect()
    if not rows:
        return np.zeros((0, 0))
    sample = _unit(np.array([r[0] for r in rows], float))
    c = sample[:cells]
    for _ in range(rounds):
        of = (sample @ c.T).argmax(axis=1)
        sums = np.array([sample[of == i].sum(axis=0) for i in range(len(c))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def celled(points: DataFrame, vector: str, c: np.ndarray) -> DataFrame:
    """points with a direction, with their cell and angle to its centre."""
    columns = points.columns
    at = columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _unit(np.array(b.column(at).to_pylist(), float))
                near = np.clip(v @ c.T, -1, 1)
                cell = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(np.arccos(near[np.arange(len(v)), cell]))], names=[*columns, "cell", "angle"])

    schema = ", ".join(f"`{n}` {t}" for n, t in points.dtypes) + ", cell int, angle double"
    return points.filter(usable(vector)).mapInArrow(run, schema)


@dataclass
class Cells:
    """A table written by cell: where it is, its centres, and for each cell its least and greatest angle and its rows."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    known: dict[int, tuple[float, float, int]]
    schema: str

    @classmethod
    def write(cls, points: DataFrame, path: str, vector: str, key: str, cells: int = CELLS) -> Cells:
        spark = points.sparkSession
        c = centres(points, vector, key, cells)
        made = celled(points, vector, c) if len(c) else points.limit(0).withColumns({"cell": F.lit(0), "angle": F.lit(0.0)})
        made.repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        schema = ", ".join(f"`{n}` {t}" for n, t in made.dtypes)
        rows = spark.read.schema(schema).parquet(f"{path}/rows")
        found = rows.groupBy("cell").agg(F.min("angle"), F.max("angle"), F.count("*")).collect()  # a row a cell
        return cls(spark, path, c, {r[0]: (r[1], r[2], r[3]) for r in found}, schema)

    def rows(self, cells: list[int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").filter(F.col("cell").isin(cells))

    def bounds(self, query: list[float]) -> list[tuple[float, int]]:
        """(cosine, cell): what no vector of the cell can pass, best first."""
        q = np.array(query, float)
        theta = np.arccos(np.clip(self.centres @ (q / np.linalg.norm(q)), -1, 1)) if len(self.centres) else []
        out = [(math.cos(max(0.0, theta[i] - hi - SLACK, lo - theta[i] - SLACK)), i) for i, (lo, hi, _) in self.known.items()]
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def nearest(self, query: list[float], depth: int, vector: str, key: str, where: Column | None = None) -> tuple[DataFrame, list[int]]:
        """(all columns, score) of the depth rows nearest by cosine that pass `where`, and the cells that were read."""
        where = F.lit(True) if where is None else where
        ranked, read, best = self.bounds(query), [], -2.0
        while len(read) < len(ranked):
            # Twice as many cells at a time while there are too few rows, then all that can still hold one.
            more = [i for s, i in ranked[len(read) : max(1, 2 * len(read))]] if best == -2.0 else [i for s, i in ranked[len(read) :] if s >= best]
            if not more:
                break
            final = best != -2.0
            read += more
            top = dense(self.rows(read).filter(where).select(key, vector), vector, query, depth, key).select("score").collect() if not final else None
            if final:
                break
            if len(top) == depth:
                best = min(r[0] for r in top)
        return dense(self.rows(read).filter(where), vector, query, depth, key).drop("cell", "angle"), read
