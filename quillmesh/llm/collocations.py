"""Operator 13, phrases whose words stand together more often than chance has it, found level by level with hashed buckets.

Each pass over the texts counts n-grams of one length exactly and those of the next length in hashed buckets (PCY, DHP).
An n-gram is counted only if a bitmap of the frequent ones one word shorter has both of its ends (Apriori) and the bitmap
of its own bucket says that the bucket reached the support. Both bitmaps have 2**BITS bits, whatever the input's size, and
are all that is broadcast; where they err, the exact count decides. Exact counts are kept by the words themselves, and are
summed in each task before the shuffle, so a common word or phrase costs one row of each chunk of CHUNK bytes of text.

As the support is fixed, buckets fill up as the corpus grows: with more than about 100 * 2**BITS n-grams the bucket bitmap
lets all through, and Apriori alone prunes. Counts stay exact; BITS is a parameter.

Edge cases: null texts are empty, a null language is `und`; texts without words give nothing; pieces of fewer words than an
n-gram have none; very long texts are whole; ties are broken by count and phrase; repeated rows count each; an empty table
gives no rows; other columns are not read. Words with a null byte are words like any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import few, free, lean, mix64, small_batches, stash, table

SUPPORT, LONGEST, FIRST = 100, 5, 2000
#: Buckets and bits of the bitmaps are 2**BITS (a bitmap has 1 MB), in pages of 2**16.
BITS, PAGE = 23, 16
#: Bytes of text that are counted together; a longer text is counted alone.
CHUNK = 6 << 20
#: Tasks that sum one page of buckets before the last one does.
SALTS = 8
#: Languages (some 20 bytes each) that may be broadcast; beyond that the same join shuffles.
BROADCAST_ROWS = 10_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _PIECE.copy()
_GAP[[32, 9]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


class _Chunk:
    """The words of some texts: code and language of each, and whether it stands in one piece with the next."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        raw = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _GAP[raw], [True]]).view(np.int8)))
        start, end = edges[0::2], edges[1::2]
        inside = ~_GAP[raw]
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())]).dictionary_encode()
        self.words = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.concatenate([[0], np.cumsum(_PIECE[raw])])[start]
        self.joined = np.concatenate([piece[1:] == piece[:-1], [False]])[: len(start)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        named = pa.array(langs, pa.string()).dictionary_encode()
        self.langs, of = named.dictionary.to_pylist(), named.indices.to_numpy(zero_copy_only=False)
        self.lang = of[np.searchsorted(ends, start, "right")].astype(np.int64)
        self._word_hash, self._lang_hash = _hashed([w.as_py() for w in self.words]), _hashed([x.encode() for x in self.langs])

    def valid(self, k: int) -> np.ndarray:
        """Where k words stand in one piece."""
        ok = np.ones(max(0, len(self.code) - k + 1), bool)
        for j in range(k - 1):
            ok &= self.joined[j : j + len(ok)]
        return ok

    def hashes(self, k: int) -> np.ndarray:
        """A hash of language and words of the k-gram at each word; see gram_hash."""
        n = max(0, len(self.code) - k + 1)
        h = self._lang_hash[self.lang[:n]]
        for j in range(k):
            h = h * _STEP + self._word_hash[self.code[j : j + n]]
        return h

    def counted(self, at: np.ndarray, k: int) -> pa.RecordBatch:
        """(lang, phrase, n) of the k-grams at those words; told apart by the words themselves."""
        same = self.lang[at]
        for j in range(k):
            _, same = np.unique(same * len(self.words) + self.code[at + j], return_inverse=True)
        _, first, n = np.unique(same, return_index=True, return_counts=True)
        parts = [self.words.take(pa.array(self.code[at[first] + j])) for j in range(k)]
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, b" ")
        lang = pa.array(self.langs, pa.string()).take(pa.array(self.lang[at[first]]))
        return pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])


def gram_hash(lang: str, phrase: str) -> int:
    """What _Chunk.hashes gives for this phrase, as an integer."""
    h = xxhash.xxh3_64_intdigest(lang.encode())
    for w in phrase.split(" "):
        h = (h * int(_STEP) + xxhash.xxh3_64_intdigest(w.encode())) & ((1 << 64) - 1)
    return h


def _pages(counts: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    """(page, salt, at, n) of the pages of a saturating count that are not zero: places in the page and their counts."""
    for p in range(len(counts) >> PAGE):
        own = counts[p << PAGE : (p + 1) << PAGE]
        if len(at := np.flatnonzero(own)):
            yield pa.RecordBatch.from_pydict({"page": pa.array([p], pa.int32()), "salt": pa.array([salt], pa.int32()), "at": [at.astype("<u2").tobytes()], "n": [own[at].tobytes()]})


def _add(counts: np.ndarray, at: np.ndarray, n: np.ndarray | int = 1) -> None:
    """Adds to uint8 counts, which stay at 255."""
    places, of = np.unique(at, return_inverse=True)
    more = np.bincount(of, None if np.isscalar(n) else n, len(places))
    counts[places] = np.minimum(counts[places] + more, 255).astype(np.uint8)


PAGES = "page int, salt int, at binary, n binary"


def _reached(pages: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bitmap (2**bits booleans) of what the summed pages bring to least (at most 255). Pages are summed as sorted streams, in two levels."""

    def total(final: bool):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, np.zeros(1 << PAGE, np.uint16)

            def done() -> Iterator[pa.RecordBatch]:
                if now is None:
                    return
                if final:
                    yield pa.RecordBatch.from_pydict({"page": pa.array([now[0]], pa.int32()), "salt": pa.array([0], pa.int32()), "at": [np.packbits(held >= least).tobytes()], "n": [b""]})
                elif len(at := np.flatnonzero(held)):
                    yield pa.RecordBatch.from_pydict({"page": pa.array([now[0]], pa.int32()), "salt": pa.array([0], pa.int32()), "at": [at.astype("<u2").tobytes()], "n": [held[at].astype(np.uint8).tobytes()]})

            for b in batches:
                for page, salt, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (page, salt) != now:
                        yield from done()
                        now = (page, salt)
                        held[:] = 0
                    where = np.frombuffer(at, "<u2")
                    held[where] = np.minimum(held[where] + np.frombuffer(n, np.uint8), 255)
            yield from done()

        return run

    some = pages.repartition("page", "salt").sortWithinPartitions("page", "salt").mapInArrow(total(False), PAGES)
    bitmap = np.zeros(1 << bits, bool)
    for r in some.repartition("page").sortWithinPartitions("page", "salt").mapInArrow(total(True), PAGES).select("page", "at").collect():
        bitmap[r["page"] << PAGE : (r["page"] + 1) << PAGE] = np.unpackbits(np.frombuffer(r["at"], np.uint8)).astype(bool)
    return bitmap


def _pass(docs: DataFrame, k: int, last: bool, bits: int, shorter, bucket) -> DataFrame:
    """One pass over (text, lang): rows (lang, phrase, n) of the k-grams that the bitmaps let through, and pages of buckets of the next length."""
    schema = f"lang string, phrase string, n_of long, {PAGES}"
    names = ["lang", "phrase", "n_of", "page", "salt", "at", "n"]

    def bitmap(sent) -> np.ndarray:
        return np.unpackbits(np.frombuffer(sent.value, np.uint8)).view(bool)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, may = (bitmap(shorter), bitmap(bucket)) if k > 1 else (None, None)
        counts = None if last else np.zeros(1 << bits, np.uint8)

        def chunk(texts: list[bytes], langs: list[str]) -> Iterator[pa.RecordBatch]:
            c = _Chunk(texts, langs)
            ok = c.valid(k)
            if k > 1:
                ends = has[_bucket(c.hashes(k - 1), bits)]
                ok = ok & ends[:-1] & ends[1:]
                at = np.flatnonzero(ok)
                ok[at[~may[_bucket(c.hashes(k)[at], bits)]]] = False
            at = np.flatnonzero(ok)
            if len(at):
                g = c.counted(at, k)
                yield pa.RecordBatch.from_arrays([*g.columns, *[pa.nulls(g.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())]], names=names)
            if not last and len(ok) > 1:
                both = np.flatnonzero(ok[:-1] & ok[1:] & c.valid(k + 1))
                _add(counts, _bucket(c.hashes(k + 1)[both], bits))

        texts, langs, held = [], [], 0
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                if held and held + len(data) > CHUNK:
                    yield from chunk(texts, langs)
                    texts, langs, held = [], [], 0
                texts.append(data)
                langs.append(lang)
                held += len(data)
        if held:
            yield from chunk(texts, langs)
        if not last:
            for p in _pages(counts, TaskContext.get().partitionId() % SALTS):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), *p.columns], names=names)

    return docs.mapInArrow(run, schema)


def _bitmap_of(frequent: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the hashes of frequent phrases (lang, phrase)."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for b in batches:
            h = np.array([gram_hash(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], np.uint64)
            counts[_bucket(h, bits)] = 1
        yield from _pages(counts, TaskContext.get().partitionId() % SALTS)

    return _reached(frequent.select("lang", "phrase").mapInArrow(run, PAGES), 1, bits)


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, bits: int = BITS) -> tuple[list[DataFrame], DataFrame]:
    """(lang, phrase, a) of the phrases of 1, 2, ... words with a count of support or more; and (lang, n), all words of each language.

    docs has text and lang. Lists end where no phrase of a length is left. support is at most 255.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent, out, totals = [None, None], [], None
    for k in range(1, longest + 1):
        seen = stash(_pass(docs, k, k == longest, bits, *sent))
        summed = seen.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n_of").alias("a"))
        if k == 1:
            totals = stash(seen.filter("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n_of").alias("n")))
        out.append(stash(summed.filter(F.col("a") >= support)))
        if k == longest or not out[-1].take(1):
            free(seen)
            break
        maps = _bitmap_of(out[-1], bits), _reached(seen.filter("page IS NOT NULL").select("page", "salt", "at", "n"), support, bits)
        free(seen)
        old, sent = sent, [spark.sparkContext.broadcast(np.packbits(m).tobytes()) for m in maps]
        for o in old:
            if o is not None:
                o.unpersist()
    return out, totals


def _part(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, first: int = FIRST, support: int = SUPPORT, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language; see op13's contract for what counts."""
    levels, totals = frequent_phrases(docs, support, longest, bits)
    spark = docs.sparkSession
    every = levels[0]
    for f in levels[1:]:
        every = every.unionByName(f)
    words = F.split("phrase", " ")
    cands = levels[1] if len(levels) > 1 else levels[0].limit(0)
    for f in levels[2:]:
        cands = cands.unionByName(f)
    # What holds a phrase as often as it stands at all: it is enough to look one word further, as counts fall with length.
    whole = cands.withColumn("w", words).withColumn("m", F.size("w"))
    longer = whole.filter("m > 2").select("lang", F.explode(F.array(_part(F.col("w"), 1, F.col("m") - 1), _part(F.col("w"), 2, F.col("m") - 1))).alias("phrase"), F.col("a").alias("held"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = stash(cands.join(longer, ["lang", "phrase"], "left").filter("held IS NULL OR held < a").select("lang", "phrase", "a"))
    cuts = kept.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = stash(cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("head"), _part(F.col("w"), F.col("k") + 1, F.size("w")).alias("tail")))
    l, r = (every.select("lang", F.col("phrase").alias(x), F.col("a").alias(y)) for x, y in (("head", "l"), ("tail", "r")))
    both = cuts.join(l, ["lang", "head"]).join(r, ["lang", "tail"]).join(few(totals, BROADCAST_ROWS), "lang")
    wide = {x: F.col(x).cast("decimal(19,0)") for x in ("a", "n", "l", "r")}
    scored = both.select("lang", "phrase", "a", "n", "k", "l", "r", *[wide[x].alias(f"d{x}") for x in wide])
    scored = scored.withColumn("score", F.expr("(da * dn * cast(1000 AS decimal(4,0))) div (dl * dr)"))
    least = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    best = least.select("lang", "phrase", "a", "n", "s.score", "s.l", "s.r")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for salts in (parts, max(1, int(parts**0.5))):
        inside = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(inside)).filter(F.col("rank") <= first).drop("rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return collocations(docs)


OP13_SQL = """
WITH p AS (SELECT lang, doc_id, row_number() OVER () AS p, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, doc_id,
      unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents)),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS f
  FROM o, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m >= 2 AND f >= 100),
x AS (SELECT lang, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase, max(a) AS held
  FROM c, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS s) WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN x USING (lang, phrase) WHERE x.held IS NULL OR x.held < c.a),
s AS (SELECT k.lang, k.phrase, k.a, u.f AS l, v.f AS r, n.n, i, (CAST(1000 AS HUGEINT) * k.a * n.n) // (CAST(u.f AS HUGEINT) * v.f) AS score
  FROM k, (SELECT unnest(range(1, 5)) AS i), n, g u, g v
  WHERE i < k.m AND n.lang = k.lang AND u.lang = k.lang AND u.phrase = array_to_string(list_slice(w, 1, i), ' ') AND v.lang = k.lang AND v.phrase = array_to_string(list_slice(w, i + 1, k.m), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b QUALIFY rank <= 2000
"""
