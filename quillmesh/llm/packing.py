"""Operator 8, best-fit packing of token sequences by bin completion.

There are at most `capacity` different lengths, so the packing problem is a histogram of constant size, however many
documents there are. The driver packs the histogram: around the largest length left it enumerates undominated fillings
(branch and bound on waste) and goes on from each of them, depth first; the best-fit decreasing packing is the first
incumbent, and branches that waste too much to beat the incumbent are cut. Spark then numbers the pieces of each length and
joins them to the places of the plan.

Edge cases: a null or empty text is one piece with the id 0 alone; the text of a special token of the vocabulary is that
token, as the tokenizer's own defaults have it; longer documents than a sequence are cut, the first piece being the short
one; equal lengths, null ids and repeated rows get places of their own; an empty table gives no rows; only the columns named
are read, so other columns do not matter.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import lean, numbered, shared_dir, small_batches, stash, table

CAPACITY, END = 2048, 0
#: The tokenizer, and its vocabulary as ranks: the same ids (tests compare both), several times as fast.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Rows a numbering task may hold, and the least number of parts a length is dealt to.
ROWS, PARTS = 1_000_000, 64
#: Bounds of the search, which is exponential: nodes of one enumeration of fillings, and steps in all.
NODES, STEPS = 4000, 20_000
#: Pieces under this part of a sequence are held back while fillings without them waste nothing: they fill what larger ones leave.
SMALL = 16


@lru_cache(maxsize=2)
def encoder(ranks: str, tokenizer: str) -> tiktoken.Encoding:
    """The ranks with the special tokens that the tokenizer's file adds to them."""
    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(tokenizer, encoding="utf-8") as f:
        told = re.split(r'"added_tokens"\s*:\s*', f.read(), maxsplit=1)[1]  # the rest of the file is the vocabulary again
    special = {t["content"]: t["id"] for t in json.JSONDecoder().raw_decode(told)[0]}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special)


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, ended by END and cut into pieces that fit."""
    paths = (ranks or public_tokenizers.path(RANKS), tokenizer or public_tokenizers.path(TOKENIZER))
    kind = dict(df.dtypes)[doc_id]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths).encode
        for b in batches:
            rows = []
            for i, v in enumerate(b.column(1)):
                ids = np.array([*encode(v.as_py() or "", allowed_special="all"), END], "<u4")
                starts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
                rows += [(i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fillings(counts: dict[int, int], sizes: list[int], room: int, most_waste: int, every: bool = False) -> list[tuple[int, ...]]:
    """Undominated fillings of room that waste most_waste at most, least waste first and then fewest and largest pieces.

    A filling is left out if another piece still fits, or if one piece of the sum of two of its pieces is at hand. Without
    every only those count that waste no more than the ones found before, and one that wastes nothing ends the search.
    """
    found: list[tuple[int, int, tuple[int, ...]]] = []
    best, nodes = most_waste, 0
    used: Counter = Counter()
    small = sizes[-1] if sizes else room + 1
    free = sum(1 << s for s, n in counts.items() if n > 0 and s <= room)  # bit s: a piece of that size is at hand
    shown = sum(1 << s for s in sizes)

    def go(left: int, top: int, chosen: tuple[int, ...]) -> bool:
        nonlocal best, nodes, free
        nodes += 1
        fits = False
        if left >= small:
            merged = 0
            for c in set(chosen):
                merged |= free >> c
            some = free & shown & ~merged & ((1 << min(left, top) + 1) - 1)
            while some:
                s = some.bit_length() - 1
                some ^= 1 << s
                fits, before = True, free
                used[s] += 1
                if used[s] >= counts[s]:
                    free ^= 1 << s
                stop = go(left - s, s, (*chosen, s))
                used[s] -= 1
                free = before
                if stop or nodes > NODES:
                    return stop or nodes > NODES
        if not fits and left <= best and not free & ((1 << left + 1) - 1):
            best = best if every else left
            found.append((left, len(chosen), chosen))
            return left == 0 and not every
        return False

    go(room, room, ())
    return [x[2] for x in sorted(found, key=lambda x: (x[0], x[1], [-s for s in x[2]]))]


Plan = list[tuple[tuple[int, ...], int]]


def best_fit(lengths: dict[int, int], capacity: int) -> tuple[Plan, int]:
    """The best-fit decreasing packing, pieces of one length together: (filling, times), and the number of sequences."""
    counts, plan, bins = dict(lengths), [], 0
    while sizes := sorted((s for s, n in counts.items() if n), reverse=True):
        room, filling = capacity, []
        for s in sizes:
            n = min(counts[s], room // s)
            filling += [s] * n
            room -= n * s
        need = Counter(filling)
        times = min(counts[s] // n for s, n in need.items())
        plan.append((tuple(filling), times))
        bins += times
        for s, n in need.items():
            counts[s] -= n * times
    return plan, bins


def pack(lengths: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """Fillings and how often each is used, for pieces of the given lengths and counts.

    Depth first over the fillings of a sequence around the largest piece left, each used as often as the counts allow or
    once, those without small pieces first. A branch ends where it wastes more than a packing with one sequence less than
    the incumbent could. The search ends at the bound that total and large pieces give, when all is tried, or after `steps`
    steps: the incumbent stands.
    """
    total = sum(s * n for s, n in lengths.items())
    least = max(-(-total // capacity), sum(n for s, n in lengths.items() if 2 * s > capacity))
    best, bins = best_fit(lengths, capacity)
    counts, used, lost = dict(lengths), 0, 0
    path: Plan = []

    def spare() -> int:
        return (bins - 1) * capacity - total - lost

    def put(filling: tuple[int, ...], times: int) -> None:
        nonlocal used, lost
        for s in filling:
            counts[s] -= times
        used, lost = used + times, lost + times * (capacity - sum(filling))

    def options() -> Iterator[tuple[tuple[int, ...], int]]:
        """What may be done next; run on only while the counts are those it began with."""
        tried = set()
        for low, every in ((capacity // SMALL, False), (0, False), (0, True)):
            sizes = sorted((s for s, n in counts.items() if n), reverse=True)
            top = sizes[0]
            counts[top] -= 1
            room = capacity - top
            some = {s: n for s, n in counts.items() if s >= low} if low else counts
            made = fillings(some, [s for s in sizes if low <= s <= room and counts[s]], room, 0 if low else min(room, spare()), every)
            counts[top] += 1
            for rest in made:
                if rest not in tried:
                    tried.add(rest)
                    most = min(counts[s] // n for s, n in Counter((top, *rest)).items())
                    yield from ((((top, *rest), times)) for times in sorted({most, 1}, reverse=True))

    stack = [options()] if total else []
    while stack and steps > 0 and bins > least:
        steps -= 1
        move = next(stack[-1], None)
        if move is None:
            stack.pop()
            if path:
                filling, times = path.pop()
                put(filling, -times)
        elif move[1] * (capacity - sum(move[0])) <= spare():
            put(*move)
            path.append(move)
            if any(counts.values()):
                stack.append(options())
            else:
                best, bins = list(path), used
                put(path[-1][0], -path.pop()[1])
    return best


def places(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, first sequence, offset): where the pieces number low to high - 1 of a length go, one to a sequence."""
    out, taken, base = [], Counter(), 0
    for filling, times in plan:
        offset = 0
        for s in filling:
            out.append((s, taken[s], taken[s] + times, base, offset))
            taken[s] += times
            offset += s
        base += times
    return out


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut with sequence_id and offset. cut (rows with length) must be a written table: its rows are told apart by their places in its files."""
    spark = cut.sparkSession
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    parts = max(PARTS, -(-sum(lengths.values()) // ROWS))
    goal = spark.createDataFrame(places(pack(lengths, capacity)) if lengths else [], "_length long, _low long, _high long, _base long, offset long")
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place")]
    dealt = numbered(cut.select("*", *place), ["length"], ["_file", "_place"], parts).withColumnRenamed("n", "_at")
    here = (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high"))
    return dealt.join(F.broadcast(goal), here).select(*cut.columns, (F.col("_base") + F.col("_at") - F.col("_low")).alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    small_batches(df.sparkSession)
    shared_dir(df.sparkSession)
    return packed(stash(pieces(df, capacity=capacity)), capacity)


def op8_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
