"""Typed edges as objects: reading them, and the pairs they stand behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.schema import prop_text, relation_ids

LINK = "wiki_link"


def _ends() -> tuple[Column, Column, Column]:
    from_, to = relation_ids("wiki_link_from"), relation_ids("wiki_link_to")
    return from_, to, (F.col("type_key") == LINK) & F.col("properties").isNotNull() & (F.size(from_) == 1) & (F.size(to) == 1)


def edges(objects: DataFrame) -> DataFrame:
    """(link_id, from_id, label, to_id, sources) of link objects with one id on each side and a label; others are malformed and left out."""
    from_, to, whole = _ends()
    told = objects.filter(whole & (F.coalesce("id", F.lit("")) != "")).select(F.col("id").alias("link_id"), from_[0].alias("from_id"), prop_text("wiki_link_label").alias("label"), to[0].alias("to_id"), F.array_distinct(relation_ids("wiki_link_sources")).alias("sources"))
    return told.filter("label <> ''")


def pairs(objects: DataFrame) -> DataFrame:
    """(x, y): unordered pairs that link objects join, labelled or not: a malformed link still protects its pair."""
    from_, to, whole = _ends()
    return objects.filter(whole).select(F.least(from_[0], to[0]).alias("x"), F.greatest(from_[0], to[0]).alias("y")).distinct()
