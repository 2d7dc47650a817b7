"""Entity resolution and duplicates: exact keys, token subsets, similarity of titles, bands of embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import normalize_title, tokens
from quillmesh.operators.extraction import adjudicated
from quillmesh.operators.neighbours import neighbours

#: Least ratio of two titles, band of similar embeddings, neighbours looked at.
RATIO = 0.92
BAND, NEIGHBOURS = (0.70, 0.85), 5
#: Ids in a block, ids of one that are crossed with another at once, and tasks that pairs of blocks are dealt to.
BLOCK, STEP, PARTS = 1000, 100, 256
#: Objects that a judge is offered for one subject.
OFFERED = 10


def exact(candidates: DataFrame, objects: DataFrame, key: list[str]) -> DataFrame:
    """(candidate, object): the first object (by id) with the candidate's type and normalised title; null if none."""
    o = objects.select(*key, F.col("id").alias("object"), normalize_title(F.col("name")).alias("_k")).groupBy(*key, "_k").agg(F.min("object").alias("object"))
    return candidates.withColumn("_k", normalize_title(F.col("name"))).join(o, [*key, "_k"], "left").select(F.col("id").alias("candidate"), "object")


def ambiguous(objects: DataFrame, key: list[str]) -> DataFrame:
    """(key, title_key, ids): titles that more than one object of a type has."""
    k = normalize_title(F.col("name")).alias("title_key")
    return objects.select(*key, k, "id").groupBy(*key, "title_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def _ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ratio = [SequenceMatcher(None, x, y).ratio() for x, y in zip(b["ka"], b["kb"], strict=True)]
        yield b.assign(ratio=ratio)[["a", "b", "ratio"]]


def _blocks(objects: DataFrame, key: str, title: str) -> DataFrame:
    """(title, key): the ids of each normalised title as arrays of at most BLOCK, equal and null ids included."""
    named = objects.select(F.col("id").alias(key), normalize_title(F.col("name")).alias(title))
    run = F.floor(F.monotonically_increasing_id() / BLOCK).alias("_run")
    return named.sortWithinPartitions(title, key).select(title, key, run).groupBy(title, "_run").agg(F.collect_list(F.struct(key)).alias(key)).select(title, F.col(key)[key].alias(key))


def similar(candidates: DataFrame, objects: DataFrame, least: float = RATIO, digits: int | None = None) -> DataFrame:
    """(a, b, ratio) of candidates and objects (id, name) whose normalised titles' matching-block ratio is at least `least`, rounded to `digits` if given.

    Titles meet by a shared run: two strings of ratio r share at least r of their characters in blocks, so lengths are
    within r / (2 - r) of each other, and one of the parts that a title is cut into is found unchanged in the other.
    Distinct titles are compared once. The rows, whose number grows with the square of a title's ids, are made last: blocks of
    ids meet, their pairs are dealt evenly to PARTS tasks, and Spark explodes a pair: into STEP ids of a and all of b, these into
    each id of a, and that with each of b.
    """
    def titles(df: DataFrame, k: str) -> DataFrame:
        return df.select(normalize_title(F.col("name")).alias(k)).distinct()

    scored = similar_titles(titles(candidates, "ka"), titles(objects, "kb"), least)
    if digits is not None:
        scored = scored.withColumn("ratio", F.round("ratio", digits))
    met = scored.join(_blocks(candidates, "a", "ka"), "ka").join(_blocks(objects, "b", "kb"), "kb").select("a", "b", "ratio")
    dealt = met.repartition(PARTS, F.xxhash64("a", "b"))
    # Generated code holds all that it explodes a row into. Coalesce ends such code, so a task holds STEP blocks and BLOCK rows, not a pair's rows.
    few = F.transform(F.sequence(F.lit(0), F.size("a") - 1, F.lit(STEP)), lambda i: F.slice("a", i + 1, STEP))
    each = dealt.select(F.explode(few).alias("a"), "b", "ratio").select(F.explode("a").alias("a"), "b", "ratio")
    return each.coalesce(PARTS).select("a", F.explode("b").alias("b"), "ratio")


def similar_titles(ka: DataFrame, kb: DataFrame, least: float = RATIO) -> DataFrame:
    """(ka, kb, ratio) of distinct normalised titles ka and kb; see similar. They are best read from a table, as each is used often."""
    # Edits allowed in all: (1 - r) of both lengths; so with more parts than edits, one part of ka is left as it is in kb.
    cut = F.floor((1 - least) / least * F.length("ka")) + 2
    size = F.floor(F.length("ka") / cut)
    part = F.transform(F.sequence(F.lit(0), cut - 1), lambda i: F.substring("ka", (i * size + 1).cast("int"), F.greatest(size, F.lit(1)).cast("int")))
    parts = ka.select("ka", F.explode(F.array_distinct(part)).alias("g")).filter("g <> ''")
    lengths = parts.select(F.length("g").alias("n")).distinct()
    grams = kb.crossJoin(F.broadcast(lengths)).filter(F.col("n") <= F.length("kb"))  # few distinct lengths
    grams = grams.select("kb", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("kb") - F.col("n") + 1), lambda i: F.substring("kb", i, F.col("n"))))).alias("g"))
    met = parts.join(grams, "g").filter(2 * F.least(F.length("ka"), F.length("kb")) >= least * (F.length("ka") + F.length("kb"))).select("ka", "kb").distinct()
    scored = met.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "ka", "kb").mapInPandas(_ratios, "a string, b string, ratio double").filter(F.col("ratio") >= least)
    return scored.select(F.col("a").alias("ka"), F.col("b").alias("kb"), "ratio")


def alike(subjects: DataFrame, objects: DataFrame, by: list[str], offered: int = OFFERED) -> DataFrame:
    """(by, n, candidates) of subjects (by, n, name): the objects (by, id, name) that share one of the two rarest words a subject has in common with
    any of them, as an array of (object_id, name): most shared words first, then by id, at most `offered`.

    An inverted index of the objects' words: a word that many names have is met only by subjects without rarer ones.
    """
    word = objects.select(*by, "id", "name", F.explode(F.array_distinct(tokens(F.col("name")))).alias("w"))
    own = subjects.select(*by, "n", F.explode(F.array_distinct(tokens(F.col("name")))).alias("w"))
    df = word.join(own.select(*by, "w").distinct(), [*by, "w"], "left_semi").groupBy(*by, "w").agg(F.count("*").alias("df"))
    rare = own.join(df, [*by, "w"]).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "n").orderBy("df", "w"))).filter("_r <= 2")
    met = rare.select(*by, "n", "w").join(word, [*by, "w"]).groupBy(*by, "n", "id").agg(F.first("name").alias("name"))
    both = met.join(subjects.select(*by, "n", tokens(F.col("name")).alias("_t")), [*by, "n"]).withColumn("_s", F.size(F.array_intersect(tokens(F.col("name")), "_t")))
    best = both.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "n").orderBy(F.desc("_s"), "id"))).filter(F.col("_r") <= offered)
    listed = best.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("_r", "id", "name"))).alias("c"))
    return listed.select(*by, "n", F.transform("c", lambda x: F.struct(x["id"].alias("object_id"), x["name"].alias("name"))).alias("candidates"))


def resolved(subjects: DataFrame, objects: DataFrame, by: list[str], judge=None) -> DataFrame:
    """(by, k, known, how) of subjects (by, k, name, facts), one a normalised title k: the object (by, id, name, k) that each one is.

    `exact` is an object of the same title (the first by id), else `similar` the one of the nearest title, if its ratio is RATIO
    or more, else `alias` the one that a judge takes for the same among those offered; without any, known and how are null.
    """
    same = objects.groupBy(*by, "k").agg(F.min("id").alias("_exact"))
    told = subjects.join(same, [*by, "k"], "left")
    left = told.filter("_exact IS NULL").select(*by, "k", "name", "facts")
    # Titles are compared without their space and type, each distinct one once, and met again with them.
    near = similar_titles(left.select(F.col("k").alias("ka")).distinct(), objects.select(F.col("k").alias("kb")).distinct())
    near = left.select(*by, "k").join(near.select(F.col("ka").alias("k"), F.col("kb").alias("_b"), "ratio"), "k").join(objects.select(*by, F.col("k").alias("_b"), "id"), [*by, "_b"])
    near = near.groupBy(*by, "k").agg(F.min_by("id", F.struct(-F.col("ratio"), "id")).alias("_near"))
    told = told.join(near, [*by, "k"], "left")
    none = F.lit(None).cast("string")
    if judge is None:
        told = told.withColumn("_alias", none)
    else:
        asked = left.join(near, [*by, "k"], "left_anti").withColumnRenamed("k", "n")
        pairs = asked.join(alike(asked.select(*by, "n", "name"), objects, by), [*by, "n"])
        match = adjudicated(pairs, judge, [*by, "n"]).withColumnsRenamed({"n": "k", "match": "_alias"})
        told = told.join(match, [*by, "k"], "left")
    known = F.coalesce("_exact", "_near", "_alias")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_near").isNotNull(), "similar").when(F.col("_alias").isNotNull(), "alias")
    return told.select(*by, "k", known.alias("known"), how.alias("how"))


def title_pairs(objects: DataFrame) -> DataFrame:
    """(a, b, reason): pairs a < b of objects (id, name) whose titles are the same (identical) or whose words one title holds all of (subset).

    Distinct titles meet over an index of their words; objects with one title are chained to the first of them.
    """
    named = objects.select("id", normalize_title(F.col("name")).alias("k"), F.array_sort(F.array_distinct(tokens(F.col("name")))).alias("t")).filter("k <> ''")
    first = named.groupBy("k").agg(F.min("id").alias("head"), F.first("t").alias("t"))
    same = named.join(first.select("k", "head"), "k").filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit("identical").alias("reason"))
    held = first.filter(F.size("t") > 0)
    word = held.select("head", F.size("t").alias("n"), F.explode("t").alias("w"))
    rare = word.groupBy("w").agg(F.count("*").alias("df"))
    key = word.join(rare, "w").groupBy("head").agg(F.min(F.struct("df", "w"))["w"].alias("w"))
    small = held.join(key, "head").select(F.col("head").alias("x"), F.col("t").alias("tx"), "w")
    big = word.join(held.select("head", "t"), "head").select(F.col("head").alias("y"), F.col("t").alias("ty"), "w")
    inside = small.join(big, "w").filter("x <> y").filter(F.size(F.array_except("tx", "ty")) == 0)
    pair = inside.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit("subset").alias("reason")).distinct()
    return same.unionByName(pair)


def embedding_band(points: DataFrame, band: tuple[float, float] = BAND, top: int = NEIGHBOURS, asked: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """(a, b, score): unordered pairs of a key with those among its `top` nearest points (itself among them) whose cosine to four digits lies in the band.

    points and asked (key, embedding); without asked the points are asked themselves. See neighbours.
    """
    near = neighbours(points if asked is None else asked, points, "embedding", key, top)
    kept = near.filter("a <> b").withColumn("score", F.round("score", 4)).filter((F.col("score") >= band[0]) & (F.col("score") < band[1]))
    return kept.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))
