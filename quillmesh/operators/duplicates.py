"""Objects that may be one: pairs by title and by meaning, each once, the likeliest of them put to a judge within a budget.

Pairs by title come first; a pair found so is not found again by meaning. The budget is a number of pairs over all there are, and
pairs beyond it are told as such, never left out.

Edge cases: null and empty names make no pair by title; a pair with an object that is gone isn't judged (its verdict is null);
a judge's failure is a distinct pair; equal ranks go by the smaller ids; no pairs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.extraction import adjudicated

# Verdicts, what is recommended without and with one, and the characters of an object that a judge reads.
SAME, DISTINCT, UNJUDGED = "same", "distinct", "unjudged"
REVIEW = "review for possible merge"
FACTS = 400
#: Reasons of pairs, likeliest first; pairs by meaning have none and go by their score.
REASONS = ("identical", "subset")


def pairs(titles: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b, reason, score): pairs by title (a, b, reason), and those by meaning (a, b, score) that are not among them; a < b, each pair once."""
    named = titles.groupBy("a", "b").agg(F.min("reason").alias("reason")).withColumn("score", F.lit(None).cast("double"))
    rest = near.groupBy("a", "b").agg(F.max("score").alias("score")).join(named.select("a", "b"), ["a", "b"], "left_anti")
    return named.unionByName(rest.select("a", "b", F.lit(None).cast("string").alias("reason"), "score"))


def _order() -> list[Column]:
    rank = F.lit(len(REASONS))
    for i, r in enumerate(REASONS):
        rank = F.when(F.col("reason") == r, i).otherwise(rank)
    return [rank, F.desc_nulls_last("score"), F.col("a"), F.col("b")]


def recommendation() -> Column:
    """What a pair (reason, verdict) comes to for who reviews it."""
    why = F.when(F.col("reason").isNotNull(), F.concat(F.lit(f"{REVIEW} ("), "reason", F.lit(")"))).otherwise(REVIEW)
    return F.when(F.col("verdict") == SAME, F.concat(F.lit("likely the same: "), why)).when(F.col("verdict") == DISTINCT, F.concat(F.lit("likely distinct, keep apart: "), why)).otherwise(why)


def judged(found: DataFrame, objects: DataFrame, judge, budget: int | None = None) -> DataFrame:
    """found (a, b, reason, score) with `verdict` and `recommendation`: the `budget` likeliest pairs (all without one) by the judge, same or distinct, the others unjudged.

    objects (id, name, facts). Nothing is changed by a verdict.
    """
    asked = found if budget is None else found.orderBy(*_order()).limit(max(0, budget))
    side = lambda k: objects.select(F.col("id").alias(k), F.col("name").alias(f"_n{k}"), F.col("facts").alias(f"_f{k}"))
    both = asked.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    offer = F.array(F.struct(F.col("b").cast("string").alias("object_id"), F.col("_nb").alias("name"), F.substring(F.coalesce("_fb", F.lit("")), 1, FACTS).alias("facts")))
    told = adjudicated(both.select("a", "b", F.col("_na").alias("name"), F.col("_fa").alias("facts"), offer.alias("candidates")), judge, ["a", "b"])
    verdict = told.select("a", "b", F.when(F.col("match").isNotNull(), SAME).otherwise(DISTINCT).alias("_v"))
    out = found.join(asked.select("a", "b", F.lit(True).alias("_asked")), ["a", "b"], "left").join(verdict, ["a", "b"], "left")
    return out.withColumn("verdict", F.when(F.col("_asked").isNull(), UNJUDGED).otherwise(F.col("_v"))).drop("_asked", "_v").withColumn("recommendation", recommendation())
