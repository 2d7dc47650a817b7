"""Operator 10, suffix-array dedup: the bytes covered by strings of `width` bytes that start anywhere else too.

Distributed prefix doubling over a sparse suffix array. One of all positions of a corpus would be many times its size, so
positions are carried in ranges: of each string of `width` bytes the least of its inner k-grams (by hash, the leftmost of
equals) is its anchor, which depends on the string alone. Strings with one anchor form a range of starts that is carried as
one position. In each round Spark sorts pairs of a position's rank so far and what lies at the next, larger offsets on both
sides of it, and the place of a pair among the sorted ones is the position's new rank (ranks.rerank); positions whose rank is
theirs alone leave. Ranked lengths grow from GRAM bytes at the anchor to the 150 bytes that all strings of a third of the
range share, then to the 250 that they cover together: where these are repeated the range is past the threshold and done.
What is left are the ends of repeats: their single strings of `width` bytes are ranked last.

Edge cases: null and empty texts, and texts shorter than width, lose nothing; matches never cross rows; overlapping
matches inside a text count; repeated rows are copies of each other and lose all if long enough; rows are told apart by
their places, so null and repeated ids do no harm; a removed span may cut a UTF-8 character, whose rest is left out of the
kept text (not of the kept bytes); an empty table gives no rows; extra columns are kept only if asked for, under their own
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import M64, Rolling, bucketed, free, lean, mix64, placed, shared_dir, small_batches, stash, table
from quillmesh.llm.ranks import rerank

WIDTH = 200
#: Length of the k-grams that anchors start with, and how many starts share a block in round 2.
GRAM, BLOCK = 50, 51
#: Bytes worked on at once; an anchor's place must fit 24 bits.
SEGMENT = 1 << 21
#: What tells rows apart.
ROW = ["file", "place"]
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: each anchor's place and rank, and the first and last start of the strings that have it."""
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for s in range(0, len(data) - width + 1, SEGMENT):
        ranks = Rolling(data[s : s + SEGMENT + width - 1]).windows(gram)
        key = (ranks & ~_PLACE) | np.arange(len(ranks), dtype=np.uint64)
        at = (_sliding_min(key, width - gram + 1) & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
        for x, y in zip(out, (at[first] + s, ranks[at[first]], first + s, last + s), strict=True):
            x.append(y)
    place, rank, low, high = (np.concatenate(x) for x in out)
    # An anchor whose strings lie on both sides of a segment's end was found in both: one entry for one place.
    new = np.flatnonzero(np.concatenate([[True], np.diff(place) != 0])[: len(place)])
    return place[new], rank[new], low[new], high[np.append(new[1:], len(place))[: len(new)] - 1]


def blocks(data: np.ndarray, kept: np.ndarray, ranks: np.ndarray, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """For the anchors at the places kept, with their ranks: first and last start of each block of starts, where those of the text begin and end, the rank, and what core and hull hold.

    A block holds the starts that lie between b * block and (b + 1) * block - 1 bytes before the anchor. Its core is what
    all its strings share, its hull what they cover together. A hull that the text's ends cut is given as 0.
    """
    place, _, low, high = anchors(data, width, gram)
    order = np.argsort(kept, kind="stable")
    at = np.searchsorted(kept[order], place)
    use = (at < len(kept)) & (kept[order][np.minimum(at, len(kept) - 1)] == place)
    place, low, high, rank = place[use], low[use], high[use], ranks[order][at[use]]
    found, sums = [], Rolling(data)
    for b in range(-(-(width - gram + 1) // block)):
        near, far = b * block, min((b + 1) * block, width - gram + 1) - 1
        start, end = np.maximum(low, place - far), np.minimum(high, place - near)
        here = start <= end
        i, salt = place[here], np.uint64((b + 1) * 0xA24BAED4963EE407 & M64)
        whole = (i - far >= 0) & (i - near + width <= len(data))
        hull = np.zeros(len(i), np.uint64)
        hull[whole] = mix64(sums.at(i[whole] - far, i[whole] - near + width) + salt)
        found.append((i - far, i - near, start[here], end[here], rank[here], mix64(sums.at(i - near, i - far + width) + salt), hull))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def covered(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs that spans [start, end) of each owner cover, in order; spans that touch make one run. Owners count from 0."""
    start = np.maximum(start, 0)
    use = start < end
    owner, start, end = owner[use], start[use], end[use]
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    far = np.int64(max(int(end.max()), 0) + 2)
    reach = np.maximum.accumulate(end + owner * far)  # a place of one line on which owners follow each other
    first = np.concatenate([[True], (start + owner * far)[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(first)[1:], len(owner)) - 1
    return owner[first], start[first], reach[last] - owner[last] * far


def _packed(docs: DataFrame) -> DataFrame:
    """docs (..., text) with the text as compressed bytes (z, null for null), which halves what later steps write."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = pa.array([tool.compress(v.as_py().encode()) if v.is_valid else None for v in b.column(b.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], z], names=[*b.schema.names[:-1], "z"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(run, f"{schema}, z binary")


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def _grams(docs: DataFrame, width: int) -> DataFrame:
    """(gram, file, place, at) of each anchor of docs (file, place, text)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, found = [], [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
            for v in b.column(2):
                at, r, _, _ = anchors(np.frombuffer((v.as_py() or "").encode(), np.uint8), width)
                count.append(len(at))
                found[0].append(r)
                found[1].append(at)
            gram, at = (np.concatenate(x) for x in found)
            own = [pa.array(np.repeat(b.column(i).to_numpy(), count)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), *own, pa.array(at.astype(np.int32))], names=["gram", *ROW, "at"])

    return docs.select(*ROW, "text").mapInArrow(run, "gram long, file long, place long, at int")


BLOCKS = "array<struct<first:int,last:int,start:int,end:int,rank:long,core:long,hull:long>>"
_BLOCK = ["first", "last", "start", "end", "rank", "core", "hull"]


def _blocked(docs: DataFrame, width: int, whole: bool) -> DataFrame:
    """For docs (..., file, place, z, anchors): n_bytes, the whole text's digest and the blocks; z only where there are blocks, unless whole.

    A last start that the text's end cuts is moved to the last one there is; a cut hull is told from all others.
    """
    names = docs.columns
    rest = [c for c in names if c not in ("z", "anchors")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, sha, z, parts, ends = [], [], [], [[] for _ in _BLOCK], [0]
            for packed, held, file, place in zip(*(b.column(names.index(c)) for c in ("z", "anchors", *ROW)), strict=True):
                data, found = _unpack(packed.as_py()), 0
                size.append(len(data))
                sha.append(hashlib.sha256(data).hexdigest())
                if held.is_valid:
                    first, last, start, end, rank, core, hull = blocks(np.frombuffer(data, np.uint8), *(held.values.field(i).to_numpy() for i in (0, 1)), width)
                    row = np.array([file.as_py() & M64, place.as_py()], np.uint64)
                    own = mix64(mix64(row[:1] + mix64(row[1:])) + (first + (1 << 31) << 32 | start).astype(np.uint64))
                    got = (first, np.minimum(last, len(data) - width), start, end, rank, core.view(np.int64), np.where(hull == 0, own, hull).view(np.int64))
                    found = len(first)
                    for x, y in zip(parts, got, strict=True):
                        x.append(y)
                z.append(packed.as_py() if found or whole else None)
                ends.append(ends[-1] + found)
            made = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts]
            fields = [pa.array(x.astype(np.int32)) for x in made[:4]] + [pa.array(x.astype(np.int64)) for x in made[4:]]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, _BLOCK))
            yield pa.RecordBatch.from_arrays([*[b.column(names.index(c)) for c in rest], pa.array(size, pa.int64()), pa.array(sha), pa.array(z, pa.binary()), listed], names=[*rest, "n_bytes", "sha", "z", "blocks"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + f", n_bytes long, sha string, z binary, blocks {BLOCKS}")


def _single(docs: DataFrame, width: int) -> DataFrame:
    """For docs (file, place, z, ranges): each start in the ranges, with the range's rank and what the string of width bytes holds."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, place, z, ranges in zip(*(b.column(i) for i in range(4)), strict=True):
                sums = Rolling(np.frombuffer(_unpack(z.as_py()), np.uint8))
                start, end, rank = (ranges.values.field(i).to_numpy().astype(np.int64) for i in range(3))
                count = end - start + 1
                p = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                made = [pa.array(np.full(len(p), file.as_py())), pa.array(np.full(len(p), place.as_py())), pa.array(p.astype(np.int32)), pa.array(np.repeat(rank, count)), pa.array(sums.at(p, p + width).view(np.int64))]
                yield pa.RecordBatch.from_arrays(made, names=[*ROW, "start", "rank", "string"])

    return docs.select(*ROW, "z", "ranges").mapInArrow(run, "file long, place long, start int, rank long, string long")


SPANS = "array<struct<s:int,e:int>>"


def _merged(spans: DataFrame) -> DataFrame:
    """spans (file, place, spans) with overlapping and touching spans made one."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column(2)
            flat, sizes = listed.flatten(), np.diff(listed.offsets.to_numpy())
            owner, s, e = covered(np.repeat(np.arange(len(sizes)), sizes), *(flat.field(i).to_numpy().astype(np.int64) for i in (0, 1)))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
            made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["s", "e"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made], names=[*ROW, "spans"])

    return spans.select(*ROW, "spans").mapInArrow(run, f"file long, place long, spans {SPANS}")


def repeated_spans(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH, whole: bool = False) -> DataFrame:
    """(rest: struct<k0, k1, ...> of the columns kept, n_bytes, sha, z, spans): of each row the spans of its bytes that are covered.

    z is the packed text, where there may be spans or, if whole, wherever there is a text. Texts are shuffled once, to lie in
    buckets by row; what later rounds find is shuffled to them.
    """
    small_batches(df.sparkSession)
    shared_dir(df.sparkSession)
    docs = placed(df)
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"c{df.columns.index(c)}").alias(f"k{i}") for i, c in enumerate(keep)])
    docs = docs.select(rest.alias("rest"), *ROW, F.col(f"c{df.columns.index(text)}").cast("string").alias("text"))

    grams = stash(_grams(docs.filter(F.octet_length("text") >= width), width))
    ranked = rerank(grams, [["gram"]], [*ROW, "at"])
    anchored = stash(ranked.groupBy(*ROW).agg(F.collect_list(F.struct("at", F.col("rank0").alias("rank"))).alias("anchors")))
    free(grams, ranked)
    held = bucketed(_blocked(_packed(docs).join(anchored, ROW, "left"), width, whole), ROW)
    free(anchored)

    part = held.select(*ROW, F.explode("blocks").alias("b")).select(*ROW, "b.*")
    part = rerank(part, [["rank", "core"], ["hull"]], [*ROW, "first", "start"])
    done = stash(part.filter("many1").groupBy(*ROW).agg(F.collect_list(F.struct(F.col("first").alias("s"), (F.col("last") + width).alias("e"))).alias("spans")))
    open_ = stash(part.filter("NOT many1 OR head").select(*ROW, "start", "end", F.col("rank0").alias("rank"), F.col("many1").alias("done")))
    free(part)
    ranks = stash(open_.groupBy("rank").agg(F.count("*").alias("n"), F.max(~F.col("done")).alias("any")).filter("n > 1 AND any").select("rank"))
    ranges = stash(open_.join(ranks, "rank").groupBy(*ROW).agg(F.collect_list(F.struct("start", "end", "rank")).alias("ranges")))
    single = stash(_single(held.filter("z IS NOT NULL").select(*ROW, "z").join(ranges.hint("shuffle_hash"), ROW), width))
    free(open_, ranks, ranges)
    last = rerank(single, [["rank", "string"]], [*ROW, "start"])
    ends = last.groupBy(*ROW).agg(F.collect_list(F.struct(F.col("start").alias("s"), (F.col("start") + width).alias("e"))).alias("spans"))
    spans = stash(_merged(done.unionByName(ends).groupBy(*ROW).agg(F.flatten(F.collect_list("spans")).alias("spans"))))
    free(done, single, last)
    return held.drop("blocks").join(spans.hint("shuffle_hash"), ROW, "left").select("rest", "n_bytes", "sha", "z", "spans")


def digests(found: DataFrame) -> DataFrame:
    """What repeated_spans finds with the id as the first column kept, as (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, count, sha = [], [], []
            for whole, z, spans in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                runs = [(x["s"], x["e"]) for x in spans or []]
                count.append(len(runs))
                removed.append(sum(e - s for s, e in runs))
                sha.append(hashlib.sha256(_cut(_unpack(z), runs)).hexdigest() if runs else whole)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.select(F.col("rest.k0").cast("long").alias("id"), "n_bytes", "sha", "z", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    return b"".join(data[s:e] for s, e in zip([0, *[e for _, e in runs]], [*[s for s, _ in runs], len(data)], strict=True))


def strip_repeats(df: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """df with the repeated spans taken out of its texts; all other columns as they are."""
    others = [c for c in df.columns if c != text]
    found = repeated_spans(df, text, tuple(others), width, True).select(*[F.col(f"rest.k{i}") for i in range(len(others))], "z", "spans")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_cut(_unpack(z.as_py()), [(x["s"], x["e"]) for x in spans.as_py() or []]).decode("utf-8", "ignore") if z.is_valid else None for z, spans in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(made, pa.string())], names=[*b.schema.names[:-2], "text"])

    cut = found.mapInArrow(run, ", ".join([f"{c} {t}" for c, t in found.dtypes[:-2]] + ["text string"]))
    return cut.select(*["text" if c == text else f"k{others.index(c)}" for c in df.columns]).toDF(*df.columns)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repeated_spans(table(spark, sf_dir, "documents")))


#: Every string of WIDTH bytes of every text, grouped by what it holds; whole texts, so for small tables only.
OP10_SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), starts AS MATERIALIZED (
  SELECT r, unnest(list_transform(range(1, octet_length(b) - {WIDTH} + 2), lambda p: {{'p': p, 'k': md5(array_slice(b, p, p + {WIDTH - 1}))}}), recursive := true) FROM docs
), twice AS (
  SELECT r, p FROM starts SEMI JOIN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1) AS repeated USING (k)
), told AS (
  SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + {WIDTH} THEN 0 ELSE 1 END AS fresh FROM twice
), runs AS (
  SELECT r, min(p) AS s, max(p) + {WIDTH} AS e
  FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM told) AS n GROUP BY r, run
), gaps AS (
  SELECT r, s, e, lag(e, 1, 1) OVER (PARTITION BY r ORDER BY s) AS since FROM runs
), cut AS (
  SELECT r, count(*) AS n, sum(e - s) AS removed, string_agg(hex(array_slice(b, since, s - 1)), '' ORDER BY s) || hex(array_slice(any_value(b), max(e), octet_length(any_value(b)))) AS kept
  FROM gaps JOIN docs USING (r) GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN n IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)
"""
