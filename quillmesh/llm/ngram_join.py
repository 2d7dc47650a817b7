"""Operator 6, n-gram Jaccard join by vertical partitioning.

All n-grams (hashed to 64 bits) stand in one global order: rare ones first, as a counting sketch over all documents tells,
then by hash. Two documents that link must share an n-gram of their prefixes in that order. The order is cut vertically into
fragments that hold about as many n-grams each, at places that the sketch tells; for candidate pairs the partial overlaps are
counted in each fragment and summed per pair.

Only distinct sets take part, so copies cost nothing, and no group of documents with a common n-gram is expanded into all
its pairs: a first round links members to the centre of their group (the set whose n-grams are the most shared, like the text
that copies were made of), a second one links those still apart to a member of the group's main component; then only members that are still apart are held against the rest of it, where sizes and places in the order leave room for enough common
n-grams. What is skipped is connected already or can't link, so no link between components is lost.

Edge cases: null and empty texts, and texts of white space, have no n-gram (n_shingles 0) and link with nothing; shorter
texts than an n-gram count as one n-gram of their own length; a null id never is the smallest one of a component, and rows
that share an id count as one document; repeated rows link; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import Rolling, few, lean, mix64, placed, shared_dir, small_batches, stash, table, tidy
from quillmesh.llm.graph import components

WORDS, PERCENT = 5, 80
#: Counters of the sketch that tells common n-grams: a constant, so what the driver sums and sends is bounded.
SKETCH_BITS = 16
FRAGMENTS = 8
#: Longs of a set's parity bitmap, a power of two.
PARITY = 16
#: Keys that may be broadcast (8 bytes each); beyond that the same join shuffles.
BROADCAST_KEYS = 1_000_000
#: One round of linking to a centre for each seed.
SEEDS = (17, 71)
#: Bits of the bitmap that tells n-grams of one row: a constant (2 MB).
BITMAP_BITS = 24

#: What tells rows apart that have one id and text.
ROW = "struct<file:long,place:long>"

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct n-grams of a text in UTF-8 as sorted 64-bit hashes; A-Z count as a-z."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]]).view(np.int8)))
    hashed = Rolling(raw).at(edges[0::2], edges[1::2]) if len(edges) else np.zeros(0, np.uint64)
    if not len(hashed):
        return hashed
    n = min(words, len(hashed))
    total = np.full(len(hashed) - n + 1, np.uint64(n))
    for j in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashed[j : len(hashed) - n + 1 + j]
    return np.unique(mix64(total))


def _signature(grams: np.ndarray) -> int:
    """The fingerprint of a set, as a long."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        yield b, [(v.as_py() or "").encode() for v in b.column(column)]


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


@dataclass
class Order:
    """The global order of n-grams: by the class of their bucket, then by hash; and where it is cut into fragments."""

    classes: np.ndarray
    cuts: list[tuple[int, int]]

    def sort(self, grams: np.ndarray) -> np.ndarray:
        """Where the n-grams stand, sorted by the order."""
        return np.lexsort((grams, self.classes[_buckets(grams)]))

    def fragment(self, grams: np.ndarray) -> np.ndarray:
        """The fragment of each n-gram: how many cuts lie at or before it."""
        own, out = self.classes[_buckets(grams)], np.zeros(len(grams), np.int64)
        for c, h in self.cuts:
            out += (own > c) | ((own == c) & (grams >= np.uint64(h)))
        return out


def cut(classes: np.ndarray, counts: np.ndarray, fragments: int = FRAGMENTS) -> list[tuple[int, int]]:
    """Places (class, hash) in the global order that leave each fragment the same share of all n-grams; hashes are even within a class."""
    found, at = np.unique(classes, return_inverse=True)
    weight = np.bincount(at, counts, len(found)) + 1e-9
    upto = np.cumsum(weight)
    out = []
    for share in np.arange(1, fragments) / fragments * upto[-1]:
        i = int(np.searchsorted(upto, share))
        inside = (share - (upto[i] - weight[i])) / weight[i]
        out.append((int(found[i]), min((1 << 64) - 1, int(inside * 2.0**64))))
    return out


def _order(docs: DataFrame, words: int) -> Order:
    """The order that counts over all documents tell: the class is how far a bucket's count stands out, in halves of a standard deviation."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, texts in _texts(batches, 0):
            for data in texts:
                np.add.at(counts, _buckets(shingles(data, words)), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    counts = np.zeros(1 << SKETCH_BITS)
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    usual = np.median(counts)
    classes = np.rint((counts - usual) / (0.5 * np.sqrt(usual) + 1)).clip(-1000, 30000).astype(np.int16)
    return Order(classes, cut(classes, counts))


def _sets(docs: DataFrame, words: int, percent: int, order: Order) -> DataFrame:
    """(id, key, n, sig, parity, prefix, row) of each row: the set's size, fingerprint, parity bitmap and first n-grams in the global order."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _texts(batches, 2):
            size, sig, prefix, parity = [], [], [], []
            for data in texts:
                h = shingles(data, words)
                least = -(-percent * len(h) // 100)
                size.append(len(h))
                sig.append(_signature(h))
                odd = np.bincount((h & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
                parity.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
                prefix.append(h[order.sort(h)[: len(h) - least + 1]].view(np.int64) if len(h) else h.view(np.int64))
            ends = np.cumsum([0, *map(len, prefix)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(sig, pa.int64()), pa.array(parity, pa.list_(pa.int64())), listed, b.column(3)], names=["id", "key", "n", "sig", "parity", "prefix", "row"])

    return docs.select("id", "key", "text", "row").mapInArrow(run, f"id long, key long, n long, sig long, parity array<long>, prefix array<long>, row {ROW}")


def _fragments(docs: DataFrame, words: int, order: Order) -> DataFrame:
    """(sig, fragment, grams): each set of docs (sig, text), cut where the global order is. A text whose set is not that of sig is left out."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _texts(batches, 1):
            sig, part, grams = [], [], []
            for s, data in zip(b.column(0).to_pylist(), texts, strict=True):
                h = shingles(data, words)
                if _signature(h) != s:
                    continue
                own = order.fragment(h)
                for f in range(len(order.cuts) + 1):
                    if len(inside := h[own == f]):
                        sig.append(s)
                        part.append(f)
                        grams.append(inside.view(np.int64))
            ends = np.cumsum([0, *map(len, grams)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(part, pa.int32()), listed], names=["sig", "fragment", "grams"])

    return docs.select("sig", "text").mapInArrow(run, "sig long, fragment int, grams array<long>")


def _near(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, na, b, nb) that their parity bitmaps allow: each bit they differ in is an n-gram that only one set has."""
    sides = [parities.select(F.col("sig").alias(x), F.col("parity").alias(f"p{x}")) for x in ("a", "b")]
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(apart <= F.col("na") + F.col("nb") - 2 * _least(percent)).select("a", "na", "b", "nb")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, parities: DataFrame, words: int, percent: int, order: Order) -> DataFrame:
    """Those of pairs (a, na, b, nb) whose partial overlaps, summed over the fragments, reach the similarity.

    Only the texts of the pairs' sets are read again, one row for each set, told by its place.
    """
    pairs = stash(_near(pairs, parities, percent))
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = stash(nodes.join(ends, "sig").select("sig", "key"))
    fragments = stash(_fragments(docs.join(few(wanted, BROADCAST_KEYS), "key"), words, order))
    left = fragments.select(F.col("sig").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = fragments.select(F.col("sig").alias("b"), "fragment", F.col("grams").alias("gb"))
    part = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "na", "b", "nb", "fragment", F.size(F.array_intersect("ga", "gb")).cast("long").alias("common"))
    part = part.groupBy("a", "na", "b", "nb", "fragment").agg(F.max("common").alias("common"))
    total = part.groupBy("a", "na", "b", "nb").agg(F.sum("common").alias("common"))
    return total.filter(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _least(percent: int) -> Column:
    """The least number of common n-grams of sets of na and nb that reaches the similarity."""
    return F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))


def _possible(percent: int) -> Column:
    """Whether sizes allow a link, and the places of a common n-gram do: what only one set has before it shifts its place there."""
    apart, spare = F.col("pa") - F.col("pb"), {x: F.col(x) - _least(percent) for x in ("na", "nb")}
    return (spare["na"] >= 0) & (spare["nb"] >= 0) & (apart <= spare["na"]) & (-apart <= spare["nb"])


def _shared(percent: int) -> Column:
    """The least number of common n-grams in both prefixes. A set of n has a prefix of n - ceil(n * percent / 100) + 1, of
    which at most n - _least are not in the other; the common ones that both prefixes hold are the first ones of all."""
    prefix = {x: F.col(x) - F.ceil(F.lit(percent) * F.col(x) / F.lit(100)) + 1 for x in ("na", "nb")}
    return F.greatest(F.lit(1), F.least(*[prefix[x] - (F.col(x) - _least(percent)) for x in prefix]))


def _common(sets: DataFrame) -> DataFrame:
    """(gram, sig, n, pos) of the prefixes' n-grams that more than one row has.

    A bitmap of constant size (2**BITMAP_BITS bits in words of 64) keeps most n-grams of one row out of the second shuffle.
    """
    seen = sets.filter("n > 0").select("sig", "n", F.posexplode("prefix").alias("pos", "gram")).select("gram", "sig", (F.shiftleft("n", 32) + F.col("pos")).alias("at"))
    shared = stash(seen.groupBy("gram").agg(F.count("*").alias("rows")).filter("rows > 1").select("gram"))
    place = f"shiftrightunsigned(xxhash64(gram), {64 - BITMAP_BITS})"
    word, bit = F.expr(f"shiftright({place}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({place} & 63 AS int))")
    bitmap = shared.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    likely = seen.withColumn("word", word).join(F.broadcast(bitmap), "word").filter(F.col("bits").bitwiseAND(bit) != 0)
    found = likely.select("gram", "sig", "at").join(shared, "gram").distinct()
    return found.select("gram", "sig", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"))


def _apart(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """shared with each set's component (root) and the largest component of its n-gram's sets (main), where there is more than one."""
    member = shared.drop("rows").join(joined.select(F.col("u").alias("sig"), F.col("v").alias("root")), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    parts = member.groupBy("gram", "root").agg(F.count("*").alias("rows")).groupBy("gram").agg(F.max(F.struct("rows", "root"))["root"].alias("main"), F.count("*").alias("parts"))
    return stash(member.join(stash(parts.filter("parts > 1").select("gram", "main")), "gram"))


def _resolved(df: DataFrame, doc_id: str, text: str, words: int, percent: int, file: str = "file", place: str = "place") -> tuple[DataFrame, DataFrame]:
    """(id, key, n, sig, row) of each row of df, and (sig, root, component_id) of each set that is not empty. key stands for the row's place."""
    spark = df.sparkSession
    small_batches(spark)
    shared_dir(spark)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row = F.struct(F.col(file).alias("file"), F.col(place).alias("place")).cast(ROW)
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), whole.alias("text"), row.alias("row"), F.xxhash64(file, place).alias("key"))
    order = _order(docs, words)
    sets = stash(_sets(docs, words, percent, order))
    nodes = stash(sets.filter("n > 0").groupBy("sig").agg(F.min("id").alias("least"), F.min("key").alias("key")))
    parities = stash(sets.join(nodes.select("sig", "key"), ["sig", "key"]).select("sig", "parity"))
    found = stash(_common(sets))

    often = stash(found.groupBy("gram").agg(F.count("*").alias("rows")).filter("rows > 1"))
    rare = Window.partitionBy("sig").orderBy("rows", "gram")
    shared = stash(found.join(often, "gram").withColumn("rank", F.row_number().over(rare)).withColumn("held", F.count("*").over(Window.partitionBy("sig"))))
    middle = stash(shared.groupBy("sig").agg((F.sum("rows") / F.max("n")).alias("middle")))
    centre = shared.join(middle, "sig").groupBy("gram").agg(F.max(F.struct("middle", F.xxhash64("sig", F.lit(SEEDS[0])), "sig", "n", "pos")).alias("c"))
    centre = stash(centre.select("gram", F.col("c.sig").alias("a"), F.col("c.n").alias("na"), F.col("c.pos").alias("pa")))
    star = shared.select("gram", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")).join(centre, "gram").filter("a <> b").filter(_possible(percent))
    star = star.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("rows")).filter(2 * F.col("rows") >= _shared(percent))
    joined = components(_linked(star.select("a", "na", "b", "nb"), docs, nodes, parities, words, percent, order))

    for seed in SEEDS[1:]:
        tidy(spark)
        member = _apart(shared, joined)
        main = member.filter("root = main").groupBy("gram").agg(F.min(F.struct(F.xxhash64("sig", F.lit(seed)), "sig", "n", "pos")).alias("c"))
        main = stash(main.select("gram", F.col("c.sig").alias("a"), F.col("c.n").alias("na"), F.col("c.pos").alias("pa")))
        star = member.filter("root <> main").select("gram", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")).join(main, "gram").filter(_possible(percent))
        star = star.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("rows")).filter(2 * F.col("rows") >= _shared(percent))
        more = _linked(star.select("a", "na", "b", "nb"), docs, nodes, parities, words, percent, order)
        joined = components(joined.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(more))

    tidy(spark)
    member = _apart(shared, joined)
    a = member.filter("root <> main").select("gram", F.col("sig").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ra"), (F.col("held") - F.col("rank")).alias("ka"))
    b = member.select("gram", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("root").alias("rb"), (F.col("held") - F.col("rank")).alias("kb"), "main")
    # Two sets that link share _shared n-grams at least, so the first of these in order of rarity has as many of either set's from it on.
    early = (F.col("ka") + 1 >= _shared(percent)) & (F.col("kb") + 1 >= _shared(percent))
    rest = a.join(b, (a["gram"] == b["gram"]) & F.expr("ra <> rb AND (rb = main OR a < b)") & early & _possible(percent))
    ordered = [F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("na", "nb"), ("b", "a"), ("nb", "na"))]
    more = _linked(rest.select(*ordered).distinct(), docs, nodes, parities, words, percent, order)
    root = components(joined.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(more))

    own = nodes.join(root.select(F.col("u").alias("sig"), F.col("v").alias("root")), "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), "least")
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return sets, stash(own.join(least, "root").select("sig", "root", "component_id"))


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of df; see the module's text."""
    held = placed(df)
    sets, named = _resolved(held, *(f"c{df.columns.index(c)}" for c in (doc_id, text)), words, percent)
    empty = sets.filter("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return sets.filter("n > 0").join(named.drop("root"), "sig").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def surplus(df: DataFrame, doc_id: str, text: str, file: str = "file", place: str = "place", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(file, place): the rows of df, told apart by these two columns, that go so that each component keeps one row.

    That row has the smallest id, a null one last, and then the first place. Empty sets are components of their own: those
    of one id keep one row, and those without an id all stay.
    """
    sets, named = _resolved(df, doc_id, text, words, percent, file, place)
    member = sets.filter("n > 0").join(named, "sig").select("root", "id", "row")
    alone = sets.filter("n = 0 AND id IS NOT NULL").select(F.xxhash64("id", F.lit("empty")).alias("root"), "id", "row")
    member = stash(member.unionByName(alone))
    best = member.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("kept"), F.count("*").alias("rows"))
    best = stash(best.filter("rows > 1").select("root", "kept"))
    return member.join(few(best, BROADCAST_KEYS), "root").filter("row <> kept").select("row.file", "row.place")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS s, doc_id AS t FROM n UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.t)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT s, min(t) AS m FROM r GROUP BY s) c ON c.s = d.doc_id
"""
