"""The relation graph: adjacency, typed edges, one-hop expansion, context budgets and the health checks.

Objects: (id, type_key, name, created, last_modified, archived, status, last_reviewed, description, sources array<string>,
outbound array<string>, backlinks array<string>, contradictions array<string>); links: (link_id, from_id, to_id, label,
sources array<string>). `now` is a parameter everywhere. Each check gives (severity, check, object_id, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import sanitize_name

#: Content types, order of severities, relation kinds by priority, limits and ages of the checks.
CONTENT_TYPES = ("wiki_source", "wiki_entity", "wiki_concept", "wiki_comparison")
SEVERITIES = ("critical", "high", "medium", "low", "informational")
NEIGHBOURS, CONTEXT_OBJECTS = 16, 24
ORPHAN_DAYS, STALE_DAYS, REVIEW_DAYS, OVERSIZED, PIPELINE_SECONDS = 7, 90, 30, 2000, 300
CHARS_PER_TOKEN = 4
#: Estimated tokens of each object's text that a question's context holds.
OBJECT_TOKENS = 1000


def adjacency(objects: DataFrame, column: str = "outbound") -> DataFrame:
    """(src, dst, pos): one row a relation id, empty ids dropped."""
    return objects.select(F.col("id").alias("src"), F.posexplode(column).alias("pos", "dst")).filter("dst IS NOT NULL AND dst <> ''").select("src", "dst", "pos")


def symmetric(links: DataFrame) -> DataFrame:
    """(id, neighbours): both ends of each link list each other."""
    both = links.select(F.col("from_id").alias("id"), F.col("to_id").alias("n")).unionByName(links.select(F.col("to_id").alias("id"), F.col("from_id").alias("n")))
    return both.groupBy("id").agg(F.array_sort(F.collect_set("n")).alias("neighbours"))


def expand(adj: DataFrame, seeds: DataFrame, cap: int = NEIGHBOURS, rank: str = "seed_rank", priority: str = "priority") -> DataFrame:
    """(id, seed, seed_rank, priority): the cap first neighbours of seeds (id, seed_rank) over adj (src, dst, priority), each by its first discovery; seeds are left out."""
    found = adj.join(seeds.select(F.col("id").alias("src"), rank), "src").join(seeds.select(F.col("id").alias("dst")), "dst", "left_anti")
    first = Window.partitionBy("dst").orderBy(rank, priority, "src")
    once = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return once.orderBy(rank, priority, "dst").limit(cap).select(F.col("dst").alias("id"), F.col("src").alias("seed"), rank, priority)


def context(pieces: DataFrame, budget: int, cap: int = CONTEXT_OBJECTS, order: str = "pos", text: str = "text", by: list[str] | None = None) -> DataFrame:
    """The longest run of pieces, in order and cap at most, whose estimated tokens (characters // 4) fit the budget. Dropping from the end until it fits gives the same, as no estimate is negative."""
    cost = F.floor(F.length(text) / CHARS_PER_TOKEN)
    w = Window.partitionBy(*(by or [])).orderBy(order)
    run = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("tokens", cost).withColumn("running", run).withColumn("_n", F.row_number().over(w)).filter((F.col("running") <= budget) & (F.col("_n") <= cap)).drop("_n")


def shortened(objects: DataFrame, keys: tuple[str, ...], tokens: int = OBJECT_TOKENS) -> DataFrame:
    """objects (name, properties: array of structs with key and text) with names made safe, texts of keys cut to the tokens, and `cut`: whether any was."""
    most = tokens * CHARS_PER_TOKEN
    own = lambda p: p["key"].isin(*keys) & p["text"].isNotNull()
    name = F.coalesce(sanitize_name(F.col("name")), F.lit("[REDACTED]"))
    return objects.withColumn("cut", F.exists("properties", lambda p: own(p) & (F.length(p["text"]) > most))).withColumn("name", name).withColumn("properties", F.transform("properties", lambda p: F.when(own(p), p.withField("text", F.substring(p["text"], 1, most))).otherwise(p)))


def rendered(objects: DataFrame, keys: tuple[str, ...], order: str, notes: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, context) of objects (name, properties, and notes: an array of link notes): a block each, in order, with a title, its links and its texts. As many objects as a context holds."""
    texts = F.transform(F.filter("properties", lambda p: p["key"].isin(*keys) & (F.coalesce(p["text"], F.lit("")) != "")), lambda p: F.concat(p["key"], F.lit(": "), p["text"]))
    links = F.transform(F.coalesce(F.col(notes), F.array().cast("array<string>")), lambda x: F.concat(F.lit("Link: "), x)) if notes else F.array().cast("array<string>")
    block = F.array_join(F.concat(F.array(F.concat(F.lit("Title: "), F.coalesce("name", F.lit("")))), links, texts), "\n")
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return objects.groupBy(*(by or [])).agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def merge_links(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(from_id, label, to_id, sources, action): wanted edges (from_id, label, to_id, source_id) merged into stored ones: created, source_added or unchanged. Loops go."""
    new = wanted.filter("from_id <> to_id").groupBy("from_id", "label", "to_id").agg(F.array_sort(F.collect_set("source_id")).alias("add"))
    both = stored.select("from_id", "label", "to_id", "sources").join(new, ["from_id", "label", "to_id"], "full_outer")
    none = F.array().cast("array<string>")
    merged = F.array_union(F.coalesce("sources", none), F.coalesce("add", none))
    action = F.when(F.col("sources").isNull(), "created").when(F.size(F.array_except(F.coalesce("add", none), "sources")) > 0, "source_added").otherwise("unchanged")
    return both.select("from_id", "label", "to_id", merged.alias("sources"), action.alias("action"))


def _finding(df: DataFrame, severity: str, check: str, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.col("id").alias("object_id"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def source_times(objects: DataFrame) -> DataFrame:
    """(id, source_ts): the latest time of an object's sources."""
    stamp = objects.filter("type_key = 'wiki_source'").select(F.col("id").alias("source"), F.coalesce("last_modified", "created").alias("t"))
    return objects.select("id", F.explode("sources").alias("source")).join(stamp, "source").groupBy("id").agg(F.max("t").alias("source_ts"))


def asymmetric(objects: DataFrame) -> DataFrame:
    """Relations with no sign of the way back: neither the source's backlinks, nor the target's relations or backlinks."""
    knows = objects.select("id", F.array_union("outbound", "backlinks").alias("k"))
    edges = adjacency(objects).select("src", "dst").distinct()
    back = knows.select(F.col("id").alias("dst"), F.explode("k").alias("src"))
    own = objects.select(F.col("id").alias("src"), F.explode("backlinks").alias("dst"))
    live = edges.join(objects.select(F.col("id").alias("dst")), "dst", "left_semi")
    return live.join(back, ["src", "dst"], "left_anti").join(own, ["src", "dst"], "left_anti")


def near_in_time(rows: DataFrame, failed: DataFrame, seconds: int = PIPELINE_SECONDS) -> DataFrame:
    """rows (..., ts) once for each time of failed (ts) that lies at most `seconds` away, as `failed`. A range join by slots of that width: each failure stands in three, so the join is on equal slots."""
    width = seconds * 1_000_000
    us = lambda c: F.unix_micros(c)
    near = failed.select(F.col("ts").alias("failed")).withColumn("_slot", F.explode(F.array(*[F.floor(us(F.col("failed")) / width) + d for d in (-1, 0, 1)])))
    return rows.withColumn("_slot", F.floor(us(F.col("ts")) / width)).join(near, "_slot").filter(F.abs(us(F.col("ts")) - us(F.col("failed"))) <= width).drop("_slot")


def lint(objects: DataFrame, links: DataFrame, failed: DataFrame, now: str, duplicates: DataFrame | None = None) -> DataFrame:
    """All findings. failed (ts) are the times of failed ingests; duplicates (a, b, reason) are optional pairs."""
    at = F.lit(now).cast("timestamp")
    ec = F.col("type_key").isin("wiki_entity", "wiki_concept")
    timed = objects.join(source_times(objects), "id", "left")
    types = objects.select("id", "type_key")
    edges = adjacency(objects).select("src", "dst").distinct()
    cited = edges.join(types.filter("type_key = 'wiki_query'").select(F.col("id").alias("dst")), "dst")
    asym = asymmetric(objects).join(types.filter("type_key = 'wiki_query'").select(F.col("id").alias("dst")), "dst", "left_anti")
    linked = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).unionByName(objects.filter(F.size("backlinks") > 0).select("id")).distinct()
    alone = timed.join(linked, "id", "left_anti")
    when = F.coalesce("source_ts", "created")
    pipeline = near_in_time(alone.filter(F.size("outbound") == 0).select("id", when.cast("timestamp").alias("ts")), failed.select(F.col("ts").cast("timestamp").alias("ts"))).select("id").distinct()
    review = F.coalesce(F.col("status") == "needs-review", F.lit(False))
    live = objects.filter("NOT coalesce(archived, false)").select("id")
    ends = links.select("link_id", F.explode(F.array("from_id", "to_id")).alias("id")).join(live, "id", "left_anti").select("link_id")
    bare = links.filter(F.coalesce(F.size("sources") == 0, F.lit(True)) | F.col("label").isNull() | (F.col("label") == "") | F.col("from_id").isNull() | F.col("to_id").isNull()).select("link_id")
    lost = links.select("link_id", F.explode("sources").alias("id")).join(live, "id", "left_anti").select("link_id")
    dangling = ends.unionByName(bare).unionByName(lost).distinct()
    sound = links.join(dangling, "link_id", "left_anti")
    sides = sound.select("link_id", F.col("from_id").alias("src"), F.col("to_id").alias("dst")).unionByName(sound.select("link_id", F.col("to_id").alias("src"), F.col("from_id").alias("dst")))
    missing = sides.join(edges, ["src", "dst"], "left_anti").groupBy("link_id").agg(F.min("src").alias("src"))
    gone = objects.filter(ec).select("id", F.explode("sources").alias("source")).join(live.select(F.col("id").alias("source")), "source", "left_anti").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("d"))
    present = objects.select("type_key").distinct()
    declared = objects.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in CONTENT_TYPES])).alias("type_key"))

    found = [
        _finding(cited.withColumnRenamed("src", "id"), "high", "stale_citation_edge", F.col("dst")),
        _finding(asym.withColumnRenamed("src", "id"), "high", "asymmetric_relation", F.col("dst")),
        _finding(alone.filter(ec & (F.col("source_ts") < at - F.expr(f"INTERVAL {ORPHAN_DAYS} DAYS"))), "high", "orphan"),
        _finding(pipeline, "high", "pipeline_orphan"),
        _finding(objects.filter(ec & (F.size("contradictions") > 0) & F.col("last_reviewed").isNull()), "critical", "contradiction_unresolved", F.size("contradictions")),
        _finding(timed.filter(ec & (F.col("last_modified") < F.col("source_ts") - F.expr(f"INTERVAL {STALE_DAYS} DAYS"))), "medium", "stale"),
        _finding(objects.filter(ec & review), "high", "unreviewed_needs_review"),
        _finding(timed.filter(ec & review & (F.col("source_ts") < at - F.expr(f"INTERVAL {REVIEW_DAYS} DAYS"))), "medium", "stale_needs_review"),
        _finding(objects.filter(F.length("description") > OVERSIZED), "low", "oversized", F.length("description")),
        _finding(dangling.withColumnRenamed("link_id", "id"), "high", "link_dangling"),
        _finding(missing.withColumnRenamed("link_id", "id"), "medium", "link_index_missing", F.col("src")),
        _finding(gone, "high", "source_dangling", F.col("d")),
        _finding(declared.join(present, "type_key", "left_anti").withColumnRenamed("type_key", "id"), "informational", "empty_type"),
    ]
    if duplicates is not None:
        found.append(_finding(duplicates.withColumnRenamed("a", "id"), "informational", "potential_duplicate", F.concat_ws(" ", "b", "reason")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def at_least(findings: DataFrame, threshold: str = "all") -> DataFrame:
    """Findings of a severity or worse; `all`, or anything unknown, keeps every one."""
    kept = SEVERITIES[: SEVERITIES.index(threshold) + 1] if threshold in SEVERITIES else SEVERITIES
    return findings.filter(F.col("severity").isin(*kept))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))
