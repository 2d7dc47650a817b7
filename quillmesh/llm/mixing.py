"""Operator 4, mixing sources to target weights by pivotal dependent rounding, with DataFrame functions alone.

Each document of a source is to be taken target / source_size times. The whole part is taken for certain; the fractions
are rounded in pairs: words move at random from one document of the pair to the other until one is taken whole or not at
all, so the words taken stay the same while every fraction is kept in the mean. Groups of about GROUP documents of a
source leave one fraction each, which meet in the next level's groups, and so on: a tree of few levels with bounded nodes. A group
goes from its largest to its smallest document, so that what is left over at the end, one document of a source, is small.

Edge cases: a null or empty text has the size 0 and is not taken; a null source is a source of its own, last in order;
sources without words have the target 0; a null doc_id is a document like others; rows with one id, text and source are
numbered copies, rounded apart and dealt to groups of their own; an empty table gives no rows; other columns are not read.
The choices depend on ids, texts, sources, copy numbers and the seed only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import numbered, shared_dir, stash, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
GROUP, SEED = 200, 20240229
#: Sources that may be broadcast; beyond that the same join shuffles.
BROADCAST_SOURCES = 100_000
#: Parts that sources are sorted in, copies of a row made by one task.
PARTS, COPIES = 32, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of sizes (source, size, n: how many documents have that size).

    A target is weight * level, or most * source_size if that is less. The level starts where all targets would sum to share
    of all sizes and rises by what sources above their limit leave, until none is above: each step is one sum over the sources.
    Sources are sorted in parts, whose sizes tell where each part's numbers begin.
    """
    total = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = F.col("source").asc_nulls_last()
    parts = stash(total.repartitionByRange(PARTS, order).withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").agg(F.count("*").alias("rows"))
    before = before.withColumn("before", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).drop("rows")  # PARTS rows at most
    number = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights) + 1).cast("int"))
    goal = stash(parts.join(F.broadcast(before), "part").select("source", "source_size", weight.cast("long").alias("w")))

    level, over = 0.0, -1
    while True:
        above = F.lit(most) * F.col("source_size") < F.col("w") * F.lit(level)
        all_, count, taken, left = goal.agg(F.sum("source_size"), F.count_if(above), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("w")))).first()
        if count == over or not left:
            break
        over, level = count, (share * all_ - most * (taken or 0)) / left
    limit = F.lit(most) * F.col("source_size")
    return goal.select("source", "source_size", (F.least(limit, F.col("w") * F.lit(level)) if left else limit).alias("target"))


def _fold(items: str, level: int, seed: int) -> Column:
    """(done, left): items (key, id, size, p, ...) rounded one after the other; left is the one that may keep a fraction."""
    # x: the one carried; e: the next; t1: the words x can give e; t2: the words e can give x.
    t1, t2 = "least(s.left.p * s.left.size, (1 - e.p) * e.size)", "least((1 - s.left.p) * s.left.size, e.p * e.size)"
    u = f"((xxhash64(s.left.key, e.key, {level}, {seed}L) & 9007199254740991L) / 9007199254740992D)"
    moved = f"(CASE WHEN {u} * (({t1}) + ({t2})) < ({t2}) THEN ({t1}) ELSE -({t2}) END)"
    clean = "CASE WHEN {0} < 1e-9D THEN 0D WHEN {0} > 1 - 1e-9D THEN 1D ELSE {0} END"
    element = "named_struct('last', {0}.last, 'key', {0}.key, 'id', {0}.id, 'size', {0}.size, 'whole', {0}.whole, 'p', {1})"
    x = element.format("s.left", clean.format("(s.left.p - m / s.left.size)"))
    y = element.format("e", clean.format("(e.p + m / e.size)"))
    both = f"transform(array({moved}), m -> named_struct('x', {x}, 'y', {y}))[0]"
    settled = "b.x.p = 0 OR b.x.p = 1"
    step = (
        f"CASE WHEN s.left IS NULL THEN named_struct('done', s.done, 'left', e) ELSE transform(array({both}), b -> "
        f"CASE WHEN {settled} THEN named_struct('done', array_append(s.done, b.x), 'left', b.y) ELSE named_struct('done', array_append(s.done, b.y), 'left', b.x) END)[0] END"
    )
    kind = "struct<last:bigint,key:bigint,id:struct<id:bigint,k:bigint,tk:bigint>,size:bigint,whole:bigint,p:double>"
    return F.expr(f"aggregate({items}, named_struct('done', CAST(array() AS array<{kind}>), 'left', CAST(NULL AS {kind})), (s, e) -> {step})")


def rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, id, source, size, k, tk) of each row; rows with equal k and tk have one id, text and source."""
    id_, from_, whole = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{source}`").cast("string"), F.col(f"`{text}`").cast("string")
    k = F.xxhash64(id_.isNull(), F.coalesce(id_, F.lit(0)), from_.isNull(), F.coalesce(from_, F.lit("")))
    return df.select(*[F.col(f"`{c}`") for c in keep], id_.alias("id"), from_.alias("source"), words(whole).alias("size"), k.alias("k"), F.xxhash64(F.coalesce(whole, F.lit(""))).alias("tk"))


def mixed(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(id: struct<id, k, tk>, size, source, source_size, target, taken): a row for each of sizes, a written table of rows()."""
    docs = stash(sizes.groupBy("id", "source", "size", "k", "tk").agg(F.count("*").alias("n")))
    goal = stash(targets(docs, weights, share, most))
    count, sources = sizes.count(), goal.limit(BROADCAST_SOURCES + 1).count()
    by = F.broadcast(goal) if sources <= BROADCAST_SOURCES else goal
    part = docs.filter(F.col("n") > COPIES).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))).repartition("k", "tk", "first")
    part = part.withColumn("n", F.least(F.col("n") - F.col("first"), F.lit(COPIES).cast("long"))).unionByName(docs.filter(F.col("n") <= COPIES).withColumn("first", F.lit(0).cast("long")))
    docs = part.withColumn("copy", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).drop("n", "first")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    docs = docs.join(by.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("times", times + 1e-12)
    docs = docs.withColumn("whole", F.floor("times")).withColumn("p", F.col("times") - F.col("whole")).withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))
    key = F.xxhash64("k", "tk", "copy", F.lit(seed))
    docs = docs.select("source", "source_size", "target", "size", "whole", "p", key.alias("key"), F.struct("id", "k", "tk").alias("id"))
    plain = (F.col("p") == 0) | (F.col("size") == 0)
    settled = docs.filter(plain).select("id", "size", "source", "source_size", "target", (F.col("whole") * F.col("size")).alias("taken"))

    groups = max(1, -(-count // GROUP))
    items = docs.filter(~plain).select("source", "source_size", "target", F.pmod("key", F.lit(groups)).alias("g"), F.struct((-F.col("size")).alias("last"), "key", "id", "size", "whole", "p").alias("item"))
    level = 0
    while True:
        node = items.groupBy("source", "source_size", "target", "g").agg(F.array_sort(F.collect_list("item")).alias("items"))
        node = stash(node.select("source", "source_size", "target", "g", _fold("items", level, seed).alias("f")))
        done = node.select("source", "source_size", "target", F.explode("f.done").alias("d"))
        settled = settled.unionByName(_taken(done))
        left = node.filter("f.left IS NOT NULL").select("source", "source_size", "target", "g", F.col("f.left").alias("item"))
        if groups == 1:
            u = (F.xxhash64("item.key", F.lit(level + 1), F.lit(seed)).bitwiseAND(F.lit(9007199254740991))) / F.lit(9007199254740992.0)
            last = left.select("source", "source_size", "target", F.struct("item.id", "item.size", "item.whole", F.when(u < F.col("item.p"), 1.0).otherwise(0.0).alias("p")).alias("d"))
            return settled.unionByName(_taken(last))
        groups, level = max(1, -(-groups // GROUP)), level + 1
        items = left.withColumn("g", F.pmod(F.col("g"), F.lit(groups)))


def _taken(done: DataFrame) -> DataFrame:
    d = done.select("source", "source_size", "target", "d.*")
    return d.select("id", "size", "source", "source_size", "target", ((F.col("whole") + F.col("p").cast("long")) * F.col("size")).alias("taken"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for each row of df; see the module's text."""
    shared_dir(df.sparkSession)
    made = mixed(stash(rows(df, doc_id, text, source)), weights, share, most, seed)
    return made.select(F.col("id.id").alias("doc_id"), "size", "source", "source_size", "target", "taken")


def times(df: DataFrame, places: tuple[str, ...], doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(*places, times) of the rows of df that the mix takes, by the columns places that tell rows apart: equal rows share what they are taken in all."""
    shared_dir(df.sparkSession)
    told = stash(rows(df, doc_id, text, source, places))
    taken = mixed(told).filter("taken > 0").groupBy("id.k", "id.tk").agg(F.sum(F.expr("taken DIV size")).alias("times"))
    copies = told.groupBy("k", "tk").agg(F.count("*").alias("copies"))
    both = stash(copies.join(taken, ["k", "tk"]))
    own = stash(told.filter("size > 0").select(*places, "k", "tk").join(both, ["k", "tk"]))
    many = numbered(own.filter("copies > 1"), ["k", "tk"], list(places))
    part = F.expr("times DIV copies") + F.when(F.col("n") < F.expr("times % copies"), 1).otherwise(0)
    return own.filter("copies = 1").select(*places, "times").unionByName(many.select(*places, part.cast("long").alias("times"))).filter("times > 0")


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
