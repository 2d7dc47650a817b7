"""Schemas of the engine's tables and accessors of property bags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import scrub_url_secrets

PROPERTY = "struct<key:string,text:string,url:string,date:string,number:double,select:struct<id:string,name:string>,multi_select:array<struct<id:string,name:string>>,objects:array<string>>"
OBJECTS = f"space_id string, id string, name string, type_key string, markdown string, archived boolean, created_date timestamp, last_modified string, backlinks array<string>, properties array<{PROPERTY}>"
LINKS = "space_id string, link_id string, from_id string, label string, to_id string, sources array<string>"
POINTS = "space_id string, object_id string, chunk_idx int, point_id string, object_name string, type_key string, heading string, text string, last_modified_date timestamp, source_type string, domain_tags array<string>, wiki_url string, embedding array<float>"
STATE = "space_id string, object_id string, last_modified string"
VERSIONS = "space_id string, version long"
LOG = "space_id string, action string, subject string, created long, updated long, notes string, at timestamp"
QUEUE = "space_id string, work_id string, kind string, subjects array<string>, subject_id string, ord long"
TERMS = "space_id string, version long, term string, row string, tf long, size int"
CORPUS = "space_id string, version long, n long, avgdl double, mean double"
SUBJECTS = "space_id string, work_id string, subject_id string, name string, facts string, label string, source_id string"
#: An addition's rows stand for all before with their keys. A row of points without a chunk says that the object has none left.
KEYS = {"objects": ["space_id", "id"], "links": ["space_id", "link_id"], "corpus": ["space_id"], "points": ["space_id", "object_id"], "subjects": ["space_id", "work_id", "subject_id"]}
#: Rows that only say that what had their keys is gone: readers don't see them.
GONE = {"points": "chunk_idx IS NULL"}
TABLES = {"subjects": SUBJECTS, "terms": TERMS, "corpus": CORPUS, "objects": OBJECTS, "links": LINKS, "points": POINTS, "state": STATE, "versions": VERSIONS, "log": LOG, "queue": QUEUE}

# The declared types with their properties (name: format), the version of the schema, and the select vocabularies.
SCHEMA_VERSION = "0.5.0"
TYPES = {
    "wiki_source": "wiki_url:url wiki_file_path:text wiki_excerpt:text wiki_summary:text wiki_ingested_at:date wiki_domain_tags:multi_select wiki_source_type:select",
    "wiki_entity": "wiki_description:text wiki_facts:text wiki_relations:objects wiki_sources:objects wiki_contradictions:objects wiki_domain_tags:multi_select wiki_status:select wiki_last_reviewed:date",
    "wiki_concept": "wiki_definition:text wiki_open_questions:text wiki_related:objects wiki_sources:objects wiki_contradictions:objects wiki_domain_tags:multi_select wiki_status:select wiki_last_reviewed:date",
    "wiki_comparison": "wiki_subjects:objects wiki_sources:objects wiki_dimensions:text wiki_verdict:text",
    "wiki_query": "wiki_question:text wiki_answer:text wiki_drew_from:objects wiki_asked_at:date",
    "wiki_log": "wiki_action:select wiki_subject:text wiki_notes:text wiki_schema_version:text wiki_objects_created:number wiki_objects_updated:number wiki_timestamp:date",
    "wiki_link": "wiki_link_from:objects wiki_link_to:objects wiki_link_sources:objects wiki_link_label:text",
}
RELATION_KEY = {"wiki_entity": "wiki_relations", "wiki_concept": "wiki_related"}
FACTS_KEY = {"wiki_entity": "wiki_facts", "wiki_concept": "wiki_definition"}
ACTIONS = ("ingest", "query", "lint", "bootstrap", "archive", "remember")
STATUSES = ("needs-review", "reviewed", "archived")
SOURCE_TYPES = ("document", "conversation", "agent")


def prop(key: str, properties: str = "properties") -> Column:
    """The first property of that key, or null."""
    return F.try_element_at(F.filter(properties, lambda p: p["key"] == key), F.lit(1))


def prop_text(key: str) -> Column:
    return F.coalesce(prop(key)["text"], F.lit(""))


def relation_ids(key: str) -> Column:
    return F.filter(F.coalesce(prop(key)["objects"], F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def outbound() -> Column:
    """The ids an object's type keeps its relations in."""
    out = F.array().cast("array<string>")
    for kind, key in RELATION_KEY.items():
        out = F.when(F.col("type_key") == kind, relation_ids(key)).otherwise(out)
    return out


def knowledge() -> Column:
    """What an object says: facts, else its definition."""
    return F.coalesce(F.nullif(prop_text("wiki_facts"), F.lit("")), prop_text("wiki_definition"))


def payload() -> list[Column]:
    """The optional fields of an object's chunks: time of change, source type, tags, scrubbed address. The last tag list stands, an empty one removes."""
    last = F.try_element_at(F.filter("properties", lambda p: p["key"] == "wiki_domain_tags"), F.lit(-1))
    kind = F.try_element_at(F.filter("properties", lambda p: (p["key"] == "wiki_source_type") & p["select"]["name"].isNotNull()), F.lit(-1))
    tags = F.transform(last["multi_select"], lambda t: t["name"])
    url = prop("wiki_url")["url"]
    return [
        F.try_to_timestamp("last_modified").alias("last_modified_date"),
        kind["select"]["name"].alias("source_type"),
        F.when(F.size(tags) > 0, tags).alias("domain_tags"),
        F.when(F.trim(F.coalesce(url, F.lit(""))) != "", scrub_url_secrets(url)).alias("wiki_url"),
    ]


def with_property(key: str, field: str, value: Column) -> Column:
    """properties with that key's property replaced by one that holds value."""
    kinds = {"text": "string", "url": "string", "date": "string", "number": "double", "select": "struct<id:string,name:string>", "multi_select": "array<struct<id:string,name:string>>", "objects": "array<string>"}
    made = F.struct(F.lit(key).alias("key"), *[(value if f == field else F.lit(None)).cast(t).alias(f) for f, t in kinds.items()])
    return F.array_append(F.filter(F.coalesce("properties", F.array().cast(f"array<{PROPERTY}>")), lambda p: p["key"] != key), made)


def missing_properties(live: dict[str, set[str]]) -> dict[str, list[str]]:
    """Declared properties that live types lack: what a reconciliation adds; it never takes any away."""
    return {t: [p.split(":")[0] for p in props.split() if p.split(":")[0] not in live.get(t, set())] for t, props in TYPES.items()}
