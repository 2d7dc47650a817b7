"""Judging retrieval: ranks of expected objects, proposals for cases, counts of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import name_key, name_keys, tokens
from quillmesh.operators import search

#: Hits proposed from a ranking, and the rank of what was not found.
DEPTH, MISS = 20, 11


def object_ranks(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, object_id, rank): distinct objects of hits (by, pos, object_id) in the order of their first."""
    first = hits.groupBy(*by, "object_id").agg(F.min("pos").alias("pos"))
    return first.select(*by, "object_id", F.row_number().over(Window.partitionBy(*by).orderBy("pos")).alias("rank"))


def first_ranks(ranks: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """(by, first_rank): the best rank of each case's expected objects (by, object_id); MISS if none is there."""
    found = expected.join(ranks, [*by, "object_id"], "left").groupBy(*by).agg(F.min("rank").alias("r"))
    return found.select(*by, F.least(F.coalesce("r", F.lit(MISS)), F.lit(MISS)).alias("first_rank"))


def proposals(case: str, objects: DataFrame, dense: DataFrame) -> DataFrame:
    """(object_id, name, type_key, sources): objects (object_id, name, type_key) that a case's query may mean, with why: key_equality, name_token, dense_top20 (dense: object_id, pos), name_bm25_top20."""
    q = objects.sparkSession.range(1).select(name_key(F.lit(case)).alias("q"), F.array_distinct(tokens(F.lit(case))).alias("t")).first()
    asked = F.array(*[F.lit(x) for x in q["t"]]) if q["t"] else F.array().cast("array<string>")
    parts = [
        objects.filter(F.array_contains(name_keys(F.col("name")), q["q"]) & F.lit(q["q"] != "")).select("object_id", F.lit(0).alias("o"), F.lit("key_equality").alias("s")),
        objects.filter((F.size(asked) > 0) & (F.size(F.array_except(asked, tokens(F.col("name")))) == 0)).select("object_id", F.lit(1).alias("o"), F.lit("name_token").alias("s")),
        dense.filter(F.col("pos") <= DEPTH).join(objects, "object_id", "left_semi").select("object_id", F.lit(2).alias("o"), F.lit("dense_top20").alias("s")),
        search.bm25(objects, "object_id", tokens(F.col("name")), list(q["t"]), DEPTH).select("object_id", F.lit(3).alias("o"), F.lit("name_bm25_top20").alias("s")),
    ]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    told = every.distinct().groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]).alias("sources"))
    return told.join(objects, "object_id").select("object_id", "name", "type_key", "sources")


def miscounted(cases: DataFrame, wanted: dict[str, int], controls: int = 0) -> DataFrame:
    """(what, found, needed): groups of cases (id, group, space_id) whose count is not the wanted one, and spaces with too few controls."""
    spark = cases.sparkSession
    need = spark.createDataFrame(list(wanted.items()), "group string, needed long")
    per = need.join(cases.groupBy("group").agg(F.count("*").alias("found")), "group", "left").fillna({"found": 0}).filter("found <> needed").select(F.col("group").alias("what"), "found", "needed")
    held = cases.groupBy("space_id").agg(F.count_if(F.col("group") == "control").alias("found")).filter(F.col("found") < controls)
    return per.unionByName(held.select(F.concat(F.lit("control of "), "space_id").alias("what"), "found", F.lit(controls).cast("long").alias("needed")))
