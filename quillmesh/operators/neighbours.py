"""Nearest neighbours of many vectors at once: an exact join of blocks of vectors that leaves out what cannot hold a neighbour.

The points are in cells (see `cells`), and the asked vectors are put to the same centres. A block is one row with a bounded
number of vectors of one cell. In a first round each asked block meets one block of its own cell; the worst of a vector's best
there is a bound. In the second round a block meets only blocks of those cells that one of its vectors may still reach, and there
a vector is compared only with blocks that it may reach itself. All blocks are dealt to parts, whatever their cell, and the asked
ones to lanes; a part goes to each lane and an asked block to each part, once, so what is shuffled is a copy a part and not a
cell. There are eight parts of eight lanes until a part would pass the numbers of PART full blocks, however many blocks cells cut
them into. Vectors travel as they are given, those of floats as floats, and get length 1 where they are met. A task keeps the
best of each asked vector, and a ranked window the best of those. Nothing that grows is broadcast: the first round sends one
block a cell.

Vectors that are the same are asked once: of those with one vector only the `top` smallest keys can be found, and what was found
is joined back to all that ask it, salted for the few vectors that a thousandth of the rows or more have.

How much is left out depends on the vectors: where they lie in clusters, nearly all; where they point everywhere alike, nothing
can be, and every block meets every other, in bounded tasks.

Edge cases: vectors without a direction (null, of length 0, or with null or non-finite components) are neither asked nor found;
ties go to the smaller key; fewer points than asked for are all found; a repeated key is asked once a row and found once a row,
so its `a` then stands for each of them; empty tables give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.cells import CELLS, SLACK, Cells, celled, usable
from quillmesh.sources.kept import shared

#: Numbers in a full block (0.5 MB, or 0.25 MB of floats), full blocks in a part, and pairs of blocks in an Arrow batch.
BLOCK, PART, PAIRS = 65_536, 256, 32
#: Least number of tasks that pairs of blocks are dealt to.
TASKS = 64
#: The least score there is, for vectors that nothing bounds yet; digits of a score, and what rounding to them may add to one.
NONE, DIGITS, HALF = -2.0, 6, 6e-7
#: A vector with more than its part of the rows (at least so many) is joined back in SALTS pieces; at most SHARE vectors are.
SHARE, LEAST, SALTS = 1000, 1000, 64
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _vectors(held: bytes, width: int, number: str) -> np.ndarray:
    """The vectors of a block, of length 1."""
    v = np.frombuffer(held, number).reshape(-1, width).astype(float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _number(points: DataFrame, vector: str) -> str:
    """How a vector's numbers are held: as they are given."""
    return "<f4" if dict(points.dtypes)[vector] == "array<float>" else "<f8"


def _may(q: np.ndarray, least: np.ndarray, centre: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Which of q may score `least` or more with a vector at angles lo to hi from the centre."""
    theta = np.arccos(np.clip(q @ centre, -1, 1))
    return np.cos(np.maximum(0.0, np.maximum(theta - hi, lo - theta) - SLACK)) >= least - SLACK


def _best(q: np.ndarray, v: np.ndarray, least: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of q, places in v, scores) of those rows that find `least` or more: their `top` best, ties by place."""
    s = q @ v.T
    rows, places = np.nonzero(s >= least[:, None] - HALF)
    scores = np.round(s[rows, places], DIGITS)
    some = np.flatnonzero(scores >= least[rows])
    some = some[np.lexsort((places[some], -scores[some], rows[some]))]
    rows, places, scores = rows[some], places[some], scores[some]
    ends = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows))
    for x, z in zip(ends[:-1], np.minimum(ends[:-1] + top, ends[1:]), strict=True):
        yield rows[x], places[x:z], scores[x:z]


def _packed(rows: DataFrame, kind: str, width: int, number: str) -> DataFrame:
    """(block, cell, keys, vectors, lo, hi) of rows (key, vector, cell, angle) sorted by cell within their partitions; a block is in the order of its keys."""
    size = max(16, BLOCK // width)
    schema = pa.schema([("block", pa.string()), ("cell", pa.int32()), ("keys", pa.list_(pa.string() if kind == "string" else pa.int64())), ("vectors", pa.binary()), ("lo", pa.float64()), ("hi", pa.float64())])

    def row(cell: int, held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda x: x[0])
        angles = [x[2] for x in held]
        made = {"block": uuid.uuid4().hex, "cell": cell, "keys": [x[0] for x in held], "vectors": np.array([x[1] for x in held], number).tobytes(), "lo": min(angles), "hi": max(angles)}
        return pa.RecordBatch.from_pylist([made], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for b in batches:
            for k, v, i, a in zip(*(b.column(n).to_pylist() for n in range(4)), strict=True):
                if held and (i != cell or len(held) == size):
                    yield row(cell, held)
                    held = []
                cell = i
                held.append((k, v, a))
        if held:
            yield row(cell, held)

    return rows.mapInArrow(run, f"block string, cell int, keys array<{kind}>, vectors binary, lo double, hi double")


def _same(vector: str) -> Column:
    """128 bits that tell vectors apart."""
    return F.concat_ws(":", F.xxhash64(vector), F.xxhash64(F.lit(1), vector))


def neighbours(asked: DataFrame, points: DataFrame, vector: str, key: str, top: int, cells: int = CELLS, told: dict | None = None) -> DataFrame:
    """(a, b, score): for each vector of asked (key, vector) the `top` points (key, vector) nearest by cosine to six digits.

    Keys are long or string. Asking the points themselves finds each among its own. `told`, if given, gets how many pairs of
    blocks met and how many there are, and the parts and lanes they were dealt to.
    """
    spark = points.sparkSession
    kind = "string" if dict(points.dtypes)[key] == "string" else "long"
    at = f"{shared(spark)}/neighbours-{uuid.uuid4().hex}"
    named = [F.col(key).cast(kind).alias(key), F.col(vector), _same(vector).alias("_same")]
    turn = F.row_number().over(Window.partitionBy("_same").orderBy(key))
    held = Cells.write(points.filter(usable(vector)).select(*named).withColumn("_n", turn).filter(F.col("_n") <= top).select(key, vector), at, vector, key, cells)
    if not held.known:
        return spark.createDataFrame([], f"a {kind}, b {kind}, score double")
    asked = asked.filter(usable(vector)).select(*named)
    asked.groupBy("_same").agg(F.first(vector).alias(vector), F.count("*").alias("_rows")).write.parquet(f"{at}/vectors")
    different = spark.read.parquet(f"{at}/vectors")
    centres, width, known = held.centres, held.centres.shape[1], held.known
    columns = [key, vector, "cell", "angle"]

    def blocks(name: str, rows: DataFrame, kind: str, number: str) -> DataFrame:
        _packed(rows.select(*columns).sortWithinPartitions("cell"), kind, width, number).write.parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    number, number_q = _number(points, vector), _number(asked, vector)
    own = blocks("points", held.rows(list(known)), kind, number)
    asks = blocks("asked", celled(different.select(F.col("_same").alias(key), vector), vector, centres), "string", number_q)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least, reach = [], []
            for i in range(b.num_rows):
                q, some = _vectors(b.column(3)[i].as_py(), width, number_q), b.column(4)[i].as_py()
                v = _vectors(some or b"", width, number)
                worst = np.partition(np.round(q @ v.T, DIGITS), len(v) - top, axis=1)[:, len(v) - top] if len(v) >= top else np.full(len(q), NONE)
                least.append(worst.astype("<f8").tobytes())
                reach.append([c for c, (lo, hi, _) in known.items() if _may(q, worst, centres[c], lo, hi).any()])
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in range(4)], pa.array(least, pa.binary()), pa.array(reach, pa.list_(pa.int32()))], names=["qblock", "qcell", "asked", "q", "least", "reach"])

    one = own.groupBy("cell").agg(F.max_by("block", F.struct(F.octet_length("vectors"), "block")).alias("block"))
    one = own.join(F.broadcast(one.select("block")), "block", "left_semi").select("cell", F.col("vectors").alias("some"))
    met = asks.join(F.broadcast(one), "cell", "left")  # one block a cell
    bounded = met.select("block", "cell", "keys", "vectors", "some").mapInArrow(first, f"qblock string, qcell int, asked array<string>, q binary, least binary, reach array<int>")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's pairs follow each other: the best of its vectors are kept until the next block comes, and bound what is looked at."""
        k = pa.string() if kind == "string" else pa.int64()
        at, keys_q, q, least, held = None, [], None, None, []

        def told() -> pa.RecordBatch:
            a = [x for x, h in zip(keys_q, held, strict=True) for _ in h]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array([b for h in held for _, b in h], k), pa.array([-s for h in held for s, _ in h], pa.float64())], names=["_same", "b", "score"])

        for b in batches:
            for i in range(b.num_rows):
                block, cell, lo, hi = (b.column(n)[i].as_py() for n in (0, 4, 7, 8))
                if block != at:
                    if at is not None:
                        yield told()
                    at, keys_q, q = block, b.column(1)[i].as_py(), _vectors(b.column(2)[i].as_py(), width, number_q)
                    least, held = np.frombuffer(b.column(3)[i].as_py(), "<f8").copy(), [[] for _ in keys_q]
                keys_v, v = b.column(5)[i].values, _vectors(b.column(6)[i].as_py(), width, number)
                asks_ = np.flatnonzero(_may(q, least, centres[cell], lo, hi))
                for x, places, scores in _best(q[asks_], v, least[asks_], top):
                    n = asks_[x]
                    held[n] = sorted([*held[n], *zip((-scores).tolist(), keys_v.take(pa.array(places)).to_pylist(), strict=True)])[:top]
                    if len(held[n]) == top:
                        least[n] = max(least[n], -held[n][-1][0])
        if at is not None:
            yield told()

    n_blocks = own.count()
    numbers = width * sum(n for _, _, n in known.values())
    many = max(-(-numbers // (PART * BLOCK)), min(n_blocks, math.isqrt(TASKS)))
    lanes = max(1, -(-TASKS // many))
    lane = F.pmod(F.xxhash64("qblock"), F.lit(lanes)).cast("int")
    before = spark.conf.get(_BATCH)
    try:
        spark.conf.set(_BATCH, str(PAIRS))  # rows are blocks
        bounded.write.parquet(f"{at}/bounded")
        sent = spark.read.parquet(f"{at}/bounded").select("qblock", "asked", "q", "least", "reach", lane.alias("lane"))
        dealt = own.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(many)).cast("int"))
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
        dealt = dealt.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        pairs = sent.hint("merge").join(dealt, ["part", "lane"]).filter(F.array_contains("reach", F.col("cell")))
        got = pairs.select("qblock", "asked", "q", "least", "cell", "keys", "vectors", "lo", "hi").mapInArrow(best, f"_same string, b {kind}, score double")
        turn = F.row_number().over(Window.partitionBy("_same").orderBy(F.desc("score"), "b"))
        got.withColumn("_n", turn).filter(F.col("_n") <= top).select("_same", "b", "score").write.parquet(f"{at}/best")
    finally:
        spark.conf.set(_BATCH, before)
    if told is not None:
        per = {c: n for c, n in own.groupBy("cell").count().collect()}
        reached = spark.read.parquet(f"{at}/bounded").select(F.explode("reach").alias("cell")).groupBy("cell").count().collect()
        told |= {"met": sum(per[c] * n for c, n in reached), "all": n_blocks * asks.count(), "parts": many, "lanes": lanes}
    rows = different.agg(F.sum("_rows")).first()[0] or 0
    hot = F.broadcast(different.filter(F.col("_rows") > max(LEAST, rows // SHARE)).select("_same", F.lit(SALTS).alias("_salts")))  # fewer than SHARE rows
    salts = F.coalesce("_salts", F.lit(1))
    left = asked.select(F.col(key).alias("a"), "_same").join(hot, "_same", "left").withColumn("_salt", F.pmod(F.xxhash64("a", F.monotonically_increasing_id()), salts).cast("int")).drop("_salts")
    right = spark.read.schema(f"_same string, b {kind}, score double").parquet(f"{at}/best").join(hot, "_same", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, ["_same", "_salt"]).select("a", "b", "score")
