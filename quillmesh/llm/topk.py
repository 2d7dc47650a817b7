"""Operator 5, exact top-k search by distributed histogram selection.

Every candidate is scored against every query in blocks. Histograms of the scores, each finer than the one before, locate
the k-th best score of each query; a last pass keeps the scores at or above it and breaks ties by the smaller id.

Edge cases: rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part; components
missing from a shorter vector count as 0; a candidate with the query's id is the query's own row and is left out; of
several query rows with one id the least vector is taken; other repeated rows stay apart; with fewer candidates than k all
are returned; no queries or an empty table give no rows. Scores are exact integers, by doubles where no sum can pass 2**53,
by longs where none can pass 2**63, else by integers without bounds; a score beyond the range of a long is the nearest long
(so are components), and equal ones are ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import lean, shared_dir, small_batches, stash, table

SCALE = 1024
BINS = 256
#: Queries searched at once: the bound of what is broadcast (16384 * 64 components of 8 bytes are 8 MB) and of a task's histograms (32 MB).
QUERIES = 16384
#: Queries of one matrix product.
TILE = 256
#: Long scores as unsigned ones in the same order, whose differences can't overflow.
_FLIP = np.uint64(1 << 63)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) for each component x."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    sizes, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return values.reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = values
    return out


class Block:
    """Queries that are searched together: ids, vectors as rows of longs, and the kind of numbers that holds their scores exactly."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float):
        """most: the largest square of a candidate's length."""
        self.ids = ids
        reach = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1) * most) * (1 + 1e-9) + 1
        bound = float(reach.max(initial=1.0))
        self.kind = np.float64 if bound < 2.0**53 else np.int64 if bound < 2.0**63 else object
        self.vectors = vectors.astype(self.kind)
        ends = [max(_LEAST, -int(r)) for r in reach]
        #: The least score that each query may have, and how many values from there on.
        self.low = np.array(ends, np.int64).view(np.uint64) ^ _FLIP
        self.span = max(min(_MOST, int(r)) - low + 1 for r, low in zip(reach, ends, strict=True)) if len(ids) else 1

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each tile of queries: its first row, the scores, and where a score counts."""
        own, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1), self.vectors.shape[1]).astype(self.kind)
        for i in range(0, len(self.ids), TILE):
            made = self.vectors[i : i + TILE] @ vectors.T
            made = np.clip(made, _LEAST, _MOST) if self.kind is object else np.rint(made) if self.kind is np.float64 else made
            yield i, made.astype(np.int64), own[None, :] != self.ids[i : i + TILE, None]


def _histograms(rows: DataFrame, block: Block, low: np.ndarray, width: int, span: int, k: int, above: np.ndarray) -> DataFrame:
    """(q, bin, n): how many scores of query q lie in each bin of that width of [low, low + span), BINS bins at most. Of each task only the bins that can hold the k-th best."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(block.ids), BINS), np.int64)
        for b in batches:
            for i, scores, other in block.scores(b):
                at, first = scores.view(np.uint64) ^ _FLIP, low[i : i + TILE, None]
                other &= at >= first
                at = at - first
                if span < 1 << 64:
                    other &= at < np.uint64(span)
                q, c = np.nonzero(other)
                counts[i : i + TILE] += np.bincount(q * BINS + (at[q, c] // np.uint64(width)).astype(np.int64), minlength=len(scores) * BINS).reshape(-1, BINS)
        from_top = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        q, c = np.nonzero((counts > 0) & (from_top < (k - above)[:, None]))
        yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "bin": pa.array(c, pa.int32()), "n": pa.array(counts[q, c], pa.int64())})

    return rows.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kept(rows: DataFrame, block: Block, least: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score) with scores of at least least; of each batch each query's k best, as no more can count."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy()
            for i, scores, other in block.scores(b):
                q, c = np.nonzero((scores >= least[i : i + TILE, None]) & other)
                order = np.lexsort((own[c], ~scores[q, c], q))
                q, c = q[order], c[order]
                first = np.searchsorted(q, q)
                use = np.arange(len(q)) - first < k
                q, c = q[use], c[use]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(block.ids[i + q], pa.int64()), "vec_id": pa.array(own[c], pa.int64()), "score": pa.array(scores[q, c], pa.int64())})

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, at_once: int = QUERIES) -> DataFrame:
    """The k best of candidates (vec_id, vector of long) by inner product for each of queries (same columns).

    Queries go in chunks of at_once, so what is broadcast is bounded; each chunk takes one pass over the candidates for
    each histogram (three or four) and one to collect, and writes its results, so no plan grows with the chunks. Nothing
    but counts and kept rows is shuffled.
    """
    spark = candidates.sparkSession
    small_batches(spark)
    shared_dir(spark)
    rows = candidates.select("vec_id", "vector")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    most, dim = rows.agg(F.max(norm), F.max(F.size("vector"))).first()
    unique = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    out, done = [], None
    while most is not None:
        part = (unique if done is None else unique.filter(F.col("vec_id") > done)).orderBy("vec_id").limit(at_once).collect()
        if not part:
            break
        done = part[-1]["vec_id"]
        vectors = np.zeros((len(part), max([dim, *(len(r["vector"]) for r in part)])), np.int64)
        for row, r in zip(vectors, part, strict=True):
            row[: len(r["vector"])] = r["vector"]
        block = Block(np.array([r["vec_id"] for r in part], np.int64), vectors, most)
        out.append(_best(_kept(rows, block, _select(rows, block, k), k), k))
        if len(part) < at_once and len(out) == 1:
            return out[0]
        out[-1] = stash(out[-1])
    if not out:
        return _best(rows.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")), k)
    return spark.read.schema(out[0].schema).parquet(*[x._stash for x in out])


def _select(rows: DataFrame, block: Block, k: int) -> np.ndarray:
    """Each query's k-th best score, or the least possible one if there are fewer scores."""
    low, above, span = block.low.copy(), np.zeros(len(block.ids), np.int64), block.span
    while True:
        width, by = -(-span // BINS), Window.partitionBy("q").orderBy(F.desc("bin"))
        counted = _histograms(rows, block, low, width, span, k, above)
        run = counted.withColumn("upto", F.sum("n").over(by))
        goal = counted.sparkSession.createDataFrame([(i, int(k - a)) for i, a in enumerate(above)], "q int, goal long")
        hit = run.join(F.broadcast(goal), "q").filter((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("n") < F.col("goal")))
        for q, at, before in hit.select("q", "bin", F.col("upto") - F.col("n")).collect():
            low[q], above[q] = low[q] + np.uint64(at * width), above[q] + before
        if width == 1:
            return (low ^ _FLIP).view(np.int64)
        span = width


def op5_exact_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Queries: vec_id divisible by 100; candidates: every row but the query's own."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.filter(F.col("vec_id") % 100 == 0), k)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
