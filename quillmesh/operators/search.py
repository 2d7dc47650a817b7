"""Retrieval: filters, BM25, dense top-k, reciprocal-rank fusion, name tiers and the hybrid ranking.

Ties are part of the contract: equal BM25 scores go by row, fused ones by first appearance (dense before BM25), final ones by
candidate order. Statistics are counted per space, so a query touches one partition of each table.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import name_key, name_keys, tokens

#: Rank constant, tier offsets, bonus of an object's first chunk, hit text length; constants of the public Okapi formula.
RRF_K = 60
TIER_OFFSET = {1: 2.0, 2: 1.0, 0: 0.0}
FIRST_BONUS = 0.5
HIT_CHARS = 500
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Bytes of text in a partition whose words are counted.
PART = 16_000_000


@dataclass(frozen=True)
class Filters:
    """What a search may ask of chunks; an empty list asks nothing."""

    types: tuple[str, ...] = ()
    source_type: tuple[str, ...] = ()
    domain_tags: tuple[str, ...] = ()
    after: str | None = None
    before: str | None = None

    def column(self, dates: bool = True) -> Column:
        out = F.lit(True)
        if self.types:
            out &= F.col("type_key").isin(*self.types)
        if self.source_type:
            out &= F.coalesce(F.col("source_type").isin(*self.source_type), F.lit(False))
        if self.domain_tags:
            out &= F.coalesce(F.arrays_overlap("domain_tags", F.array(*[F.lit(t) for t in self.domain_tags])), F.lit(False))
        if dates and self.after:
            out &= F.coalesce(F.col("last_modified_date") >= F.lit(self.after).cast("timestamp"), F.lit(False))
        if dates and self.before:
            out &= F.coalesce(F.col("last_modified_date") <= F.lit(self.before).cast("timestamp"), F.lit(False))
        return out

    def checked(self) -> Filters:
        """The filters, if lists hold words and bounds are times; else an error that names the argument."""
        for name, value in (("types", self.types), ("source_type", self.source_type), ("domain_tags", self.domain_tags)):
            if isinstance(value, str) or not all(isinstance(x, str) and x for x in value):
                raise ValueError(f"invalid_filter: {name} must hold non-empty strings; got {value!r}")
        for name, value in (("after", self.after), ("before", self.before)):
            if value is not None:
                try:
                    datetime.fromisoformat(value)
                except (TypeError, ValueError):
                    raise ValueError(f"invalid_date_format: {name} is no ISO-8601 time: {value!r}") from None
        return self

    @property
    def dated(self) -> bool:
        return bool(self.after or self.before)


def postings(docs: DataFrame, key: str, words: Column, text: Column | None = None) -> DataFrame:
    """(term, row, tf, size) of docs: a row for each distinct term of a document, with the document's number of tokens, and one with the term '' for the document itself.

    With text (what the words are of), documents are dealt by key to partitions of about PART bytes of it before they are cut
    into words: only texts are shuffled, and a document's words are counted, and may be sorted, where it is, in memory.
    """
    if text is not None:
        parts = (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // PART
        docs = docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, parts), key)
    listed = docs.select(F.col(key).alias("row"), words.alias("_w")).select("row", F.size("_w").alias("size"), F.explode(F.concat(F.array(F.lit("")), "_w")).alias("term"))
    return listed.groupBy("row", "term").agg(F.count("*").alias("tf"), F.max("size").alias("size")).select("term", "row", "tf", "size")


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def corpus(index: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, avgdl, mean) of postings: documents, mean length, mean of the terms' raw idf."""
    total = index.filter("term = ''").groupBy(*by).agg(F.count("*").alias("n"), F.avg("size").alias("avgdl"))
    df = index.filter("term <> ''").groupBy(*by, "term").agg(F.count("*").alias("df"))
    both = df.join(F.broadcast(total), list(by)) if by else df.crossJoin(F.broadcast(total))  # a row, or one for each space
    mean = both.groupBy(*by).agg(F.avg(raw_idf(F.col("n"), F.col("df"))).alias("mean"))
    return total.join(mean, list(by), "left") if by else total.crossJoin(F.broadcast(mean))


@dataclass(frozen=True)
class Index:
    """Postings of one space with what its corpus says; made once for a version of the space and read by each query."""

    postings: DataFrame
    n: int
    avgdl: float
    mean: float

    @classmethod
    def of(cls, docs: DataFrame, key: str, words: Column) -> Index:
        """An index that is not kept: its postings are made anew by each query."""
        made = postings(docs, key, words)
        row = corpus(made).first()
        return cls(made, row["n"], row["avgdl"] or 1.0, row["mean"] or 0.0)

    def stats(self) -> DataFrame:
        """(term, df, idf, n, avgdl). A negative idf becomes EPSILON times the mean."""
        df = self.postings.filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
        raw = raw_idf(F.lit(self.n), F.col("df"))
        return df.select("term", "df", F.when(raw < 0, EPSILON * F.lit(self.mean)).otherwise(raw).alias("idf"), F.lit(self.n).cast("long").alias("n"), F.lit(float(self.avgdl)).alias("avgdl"))

    def scores(self, query: list[str]) -> DataFrame:
        """(row, score) of documents with a score above 0; only the postings of the query's terms are read."""
        asked = {t: query.count(t) for t in query}
        found = self.postings.filter(F.col("term").isin(*asked)) if asked else self.postings.limit(0)
        df = found.groupBy("term").agg(F.count("*").alias("df"))
        raw = raw_idf(F.lit(self.n), F.col("df"))
        times = F.create_map(*[F.lit(x) for pair in asked.items() for x in pair]) if asked else F.lit(None).cast("map<string,int>")
        weight = df.select("term", (times[F.col("term")] * F.when(raw < 0, EPSILON * F.lit(self.mean)).otherwise(raw)).alias("idf"))
        long = K1 * (1 - B + B * F.col("size") / F.lit(float(self.avgdl or 1.0)))
        part = found.join(F.broadcast(weight), "term").select("row", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + long)).alias("s"))  # a row for each term asked
        return part.groupBy("row").agg(F.sum("s").alias("score")).filter("score > 0")


def bm25_stats(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(term, df, idf, n, avgdl) of docs."""
    return Index.of(docs, key, words).stats()


def top(scores: DataFrame, depth: int) -> DataFrame:
    """The depth best of (row, score), ties by row."""
    return scores.orderBy(F.desc("score"), "row").limit(depth)


def bm25(docs: DataFrame, key: str, words: Column, query: list[str], depth: int | None = None) -> DataFrame:
    """(key, score) of documents with a score above 0, best first, ties by key; depth rows at most. With a kept Index nothing is tokenised."""
    if not query:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    scored = Index.of(docs, key, words).scores(query)
    return (top(scored, depth) if depth else scored).withColumnRenamed("row", key)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(points: DataFrame, vector: str, query: list[float], depth: int, key: str) -> DataFrame:
    """(all columns, score): the depth points nearest to a query vector by cosine; a top-k without a full sort."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return points.withColumn("score", cosine(F.col(vector), asked)).orderBy(F.desc("score"), key).limit(depth)


def fuse(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, rrf, ord, hits) of ranked lists (key, rank): the sum of 1 / (k + rank); ord is the place of first appearance."""
    parts = [x.select(key, F.col("rank").cast("long").alias("rank"), F.lit(i).alias("list")) for i, x in enumerate(lists)]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    first = F.min(F.struct("list", "rank"))
    return both.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), first.alias("ord"), F.min("list").alias("first_list"))


def tiers(names: DataFrame, query: str, key: str = "object_id", name: str = "object_name") -> DataFrame:
    """(key, tier) of objects whose name answers the query: 1 if the query's key is one of the name's, 2 if all its words are in the name."""
    asked = names.sparkSession.range(1).select(name_key(F.lit(query)).alias("q")).select("q", F.array_distinct(tokens(F.col("q"), folded=True)).alias("t"))
    held = names.select(key, name).crossJoin(F.broadcast(asked))  # one row
    tier = F.when((F.col("q") != "") & F.array_contains(name_keys(F.col(name)), F.col("q")), 1).when((F.size("t") > 0) & (F.size(F.array_except("t", tokens(F.col(name)))) == 0), 2).otherwise(0)
    return held.select(key, tier.alias("tier")).filter("tier > 0")


def chunk_words() -> Column:
    """The tokens a chunk is found by: its object's name twice, its heading and its text."""
    return F.concat(tokens(F.col("object_name")), tokens(F.col("object_name")), tokens(F.col("heading")), tokens(F.col("text")))


def hybrid_rank(chunks: DataFrame, query: str, dense_hits: DataFrame, limit: int = 10, filters: Filters = Filters(), depth: int | None = None, index: Index | None = None) -> DataFrame:
    """(point_id, object_id, tier, score, rank) of a space's chunks (row, point_id, object_id, object_name, heading, text, type_key ...).

    dense_hits (point_id, rank) are the filtered nearest chunks; index is that of chunk_words by row. Objects whose name is
    the query's enter with their best chunk even if no list has them. Chunks that only BM25 found must pass the filters, and
    none does while a date is asked. Only fused chunks and those of objects with the query's name are joined.
    """
    depth = depth or max(2 * limit, 50)
    asked = [r["t"] for r in chunks.sparkSession.range(1).select(F.explode(tokens(F.lit(query))).alias("t")).collect()]
    scored = (index or Index.of(chunks, "row", chunk_words())).scores(asked)
    rows = chunks.select("row", "point_id", "object_id", "type_key", *[c for c in ("source_type", "domain_tags", "last_modified_date") if c in chunks.columns])
    best = Window.orderBy(F.desc("score"), "row")
    ranked = top(scored, depth).withColumn("rank", F.row_number().over(best)).join(rows.select("row", "point_id"), "row")
    fused = fuse([dense_hits.select("point_id", "rank"), ranked.select("point_id", "rank")], "point_id")
    known = F.broadcast(fused).join(rows, "point_id")  # twice depth rows at most

    named = tiers(chunks.groupBy("object_id").agg(F.min_by("object_name", "row").alias("object_name")), query)
    apart = named.filter("tier = 1").join(known.select("object_id").distinct(), "object_id", "left_anti").select("object_id")
    late = rows.join(apart, "object_id").join(scored, "row", "left").fillna({"score": 0.0})
    late = late.withColumn("_n", F.row_number().over(Window.partitionBy("object_id").orderBy(F.desc("score"), "row"))).filter("_n = 1")
    late = late.withColumn("rrf", F.lit(0.0)).withColumn("first_list", F.lit(2)).withColumn("ord", F.struct(F.lit(2).alias("list"), F.row_number().over(best).cast("long").alias("rank")))

    every = known.unionByName(late.select(*known.columns)).join(named, "object_id", "left").fillna({"tier": 0})
    passed = (F.col("first_list") == 0) | (F.lit(not filters.dated) & filters.column(dates=False))
    place = Window.orderBy(F.desc("rrf"), "ord.list", "ord.rank")
    listed = every.withColumn("place", F.when(F.col("first_list") < 2, F.row_number().over(place)).otherwise(F.lit(1_000_000) + F.col("ord.rank"))).filter(passed)
    offset = F.when(F.col("tier") == 1, TIER_OFFSET[1]).when(F.col("tier") == 2, TIER_OFFSET[2]).otherwise(TIER_OFFSET[0])
    first = F.row_number().over(Window.partitionBy("object_id").orderBy("place")) == 1
    final = listed.withColumn("final", offset + F.col("rrf") + F.when((F.col("tier") > 0) & first, FIRST_BONUS).otherwise(0.0))
    out = final.orderBy(F.desc("final"), "place").limit(limit)
    return out.select("point_id", "object_id", "tier", F.col("final").alias("score"), F.row_number().over(Window.orderBy(F.desc("final"), "place")).alias("rank"))


def candidates(hits_: DataFrame, ranked: bool) -> DataFrame:
    """(object_id, score, pos): hits (object_id, score, rank) once for each object, the best first; those of an unranked listing by id."""
    if ranked:
        once = hits_.groupBy("object_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
        return once.select("object_id", "score", F.row_number().over(Window.orderBy("rank")).alias("pos"))  # as many as a search returns
    return hits_.select("object_id").distinct().select("object_id", F.lit(0.0).alias("score"), F.row_number().over(Window.orderBy("object_id")).alias("pos"))


def hits(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked points with the fields a search returns: text cut, score to four digits."""
    return ranked.join(chunks, "point_id").select("rank", *[c for c in ("object_id",) if c in chunks.columns], "object_name", "type_key", "heading", F.substring("text", 1, HIT_CHARS).alias("text"), F.round("score", 4).alias("score"))
