"""Objects to chunks: sections by heading, size split, deterministic point ids. All native; one row a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import strip_controls, uuid5

#: Size of a chunk, and the text properties that stand in for a missing body, with their headings.
CHUNK_CHARS = 1500
PROPERTY_HEADINGS = {
    "wiki_facts": "Facts",
    "wiki_description": "Description",
    "wiki_definition": "Definition",
    "wiki_open_questions": "Open Questions",
    "wiki_dimensions": "Dimensions",
    "wiki_verdict": "Verdict",
    "wiki_question": "Question",
    "wiki_answer": "Answer",
    "wiki_excerpt": "Excerpt",
    "wiki_summary": "Summary",
}
SECTION = "array<struct<heading:string,body:string>>"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sections(markdown: Column) -> Column:
    """array<struct<heading, body>>: the text before the first heading has the heading ''; empty bodies go; without headings the whole text is one section."""
    parts = F.split(markdown, r"(?m)^(?=#{1,4}\s+.)")
    head = r"^#{1,4}\s+(.+)"
    made = F.transform(
        parts,
        lambda p: F.when(p.rlike(r"^#{1,4}\s+."), F.struct(trimmed(F.regexp_extract(p, head, 1)).alias("heading"), trimmed(F.regexp_replace(p, r"^#{1,4}\s+.+", "")).alias("body"))).otherwise(
            F.struct(F.lit("").alias("heading"), trimmed(p).alias("body"))
        ),
    )
    kept = F.filter(made, lambda s: s["body"] != "")
    return F.when(F.size(kept) > 0, kept).when(trimmed(markdown) != "", F.array(F.struct(F.lit("").alias("heading"), trimmed(markdown).alias("body")))).otherwise(F.array().cast(SECTION))


def property_sections(properties: Column) -> Column:
    """The same from an array of (key, text): the known text properties in their order, under fixed headings."""
    headings = F.create_map(*[F.lit(x) for pair in PROPERTY_HEADINGS.items() for x in pair])
    known = F.filter(properties, lambda p: p["key"].isin(*PROPERTY_HEADINGS) & (trimmed(F.coalesce(p["text"], F.lit(""))) != ""))
    return F.transform(known, lambda p: F.struct(headings[p["key"]].alias("heading"), strip_controls(trimmed(p["text"])).alias("body")))


def _cut(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size)), lambda i: F.substring(text, (i * size + 1).cast("int"), F.lit(size)))


def split_large(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Pieces of at most `size` characters: whole paragraphs while they fit; a longer paragraph is cut and stands alone."""
    empty = F.array().cast("array<string>")
    state = F.struct(empty.alias("done"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        flushed = F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"])
        joined = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        return (
            F.when(F.length(p) > size, F.struct(F.concat(flushed, _cut(p, size)).alias("done"), F.lit("").alias("open")))
            .when(F.length(joined) <= size, F.struct(s["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(flushed.alias("done"), p.alias("open")))
        )

    whole = trimmed(text)
    split = F.aggregate(F.split(whole, r"\n\s*\n"), state, step, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    return F.when(whole == "", empty).when(F.length(whole) <= size, F.array(whole)).otherwise(split)


def chunks(objects: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """(space_id, object_id, chunk_idx, point_id, object_name, type_key, heading, text) of objects (space_id, id, name, type_key, markdown[, properties]).

    A body wins; without one the known text properties are used.
    """
    parts = sections(F.coalesce("markdown", F.lit("")))
    if "properties" in objects.columns:
        parts = F.when(trimmed(F.coalesce("markdown", F.lit(""))) != "", parts).otherwise(property_sections(F.col("properties")))
    pieces = F.flatten(F.transform(parts, lambda s: F.transform(split_large(strip_controls(s["body"]), size), lambda t: F.struct(s["heading"].alias("heading"), t.alias("text")))))
    made = objects.select("space_id", F.col("id").cast("string").alias("object_id"), F.col("name").alias("object_name"), "type_key", F.posexplode(pieces).alias("chunk_idx", "_p"))
    point = uuid5(F.concat_ws(":", "object_id", F.col("chunk_idx").cast("string"), F.col("_p.heading")))
    return made.select("space_id", "object_id", "chunk_idx", point.alias("point_id"), "object_name", "type_key", F.col("_p.heading").alias("heading"), F.col("_p.text").alias("text"))
