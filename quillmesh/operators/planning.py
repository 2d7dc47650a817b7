"""Steps around model calls and repairs, as relations: windows of pages, fitting a budget, merging what windows gave, guards on verdicts, repair plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import identifier_like, name_key, norm, normalize_title, same_subject, split_qualifier, strip_title

#: The share of the budget that batched checks may fill; sections and characters an object is compared with itself by.
BATCH_SHARE = 0.75
SELF_SECTIONS, SELF_CHARS = 8, 6000


def windows(pages: DataFrame, by: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """pages with `window`: consecutive pages while they fit the budget; a page beyond it stands alone. One fold a document, as each window starts where the last ended."""
    listed = pages.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), size.cast("long").alias("n")))).alias("a"))
    kind = dict(pages.dtypes)[order]
    start = F.struct(F.lit(0).alias("w"), F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<o:{kind},window:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        fits = (s["used"] == 0) | (s["used"] + p["n"] <= budget)
        w = F.when(fits, s["w"]).otherwise(s["w"] + 1)
        return F.struct(w.cast("int").alias("w"), F.when(fits, s["used"] + p["n"]).otherwise(p["n"]).alias("used"), F.array_append(s["out"], F.struct(p["o"].alias("o"), w.cast("int").alias("window"))).alias("out"))

    placed = listed.select(*by, F.explode(F.aggregate("a", start, step, lambda s: s["out"])).alias("x")).select(*by, F.col("x.o").alias(order), "x.window")
    return pages.join(placed, [*by, order])


def fit(text: Column, budget: int) -> Column:
    """text cut to the budget: at its last blank line, else its last line break, if past half of it."""
    cut = F.substring(text, 1, budget)
    blank = F.length(cut) - F.length(F.regexp_extract(cut, r"(?s)^.*\n\n(.*)$", 1)) - 2
    line = F.length(cut) - F.length(F.regexp_extract(cut, r"(?s)^.*\n(.*)$", 1)) - 1
    at = F.when(cut.contains("\n\n") & (blank > budget / 2), blank).when(cut.contains("\n") & (line > budget / 2), line).otherwise(F.lit(budget))
    return F.when(F.length(text) <= budget, text).otherwise(F.substring(cut, F.lit(1), at))


def page_label(pages: Column) -> Column:
    """`p. 3` or `pp. 3–5, 8` of an array of page numbers."""
    sorted_ = F.array_sort(F.array_distinct(pages))
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def step(s: Column, p: Column) -> Column:
        last = F.try_element_at(s, F.lit(-1))
        grown = F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(last["a"].alias("a"), p.cast("long").alias("b"))))
        return F.when((F.size(s) > 0) & (last["b"] + 1 == p), grown).otherwise(F.concat(s, F.array(F.struct(p.cast("long").alias("a"), p.cast("long").alias("b")))))

    runs = F.aggregate(sorted_, empty, step)
    text = F.array_join(F.transform(runs, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("–", r["a"], r["b"]))), ", ")
    return F.when(F.size(sorted_) == 0, "").when(F.size(sorted_) == 1, F.concat(F.lit("p. "), text)).otherwise(F.concat(F.lit("pp. "), text))


def joined(parts: DataFrame, by: list[str], order: str, text: Column, name: str, count: str) -> DataFrame:
    """(by, name, count): parts joined line by line in their order, as pages or the turns of a conversation; one row a document."""
    made = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("x")))).alias("_a"), F.count("*").alias(count))
    return made.select(*by, F.array_join(F.transform("_a", lambda s: s["x"]), "\n").alias(name), count)


def digest(plan: DataFrame, by: list[str], kind: str, id_: str) -> DataFrame:
    """(by, digest): the SHA-256 of a plan's kind and sorted ids as JSON, by which a confirmed plan is known again."""
    listed = F.array_join(F.array_sort(F.collect_list(id_)), '", "')
    return plan.groupBy(*by).agg(F.sha2(F.concat(F.lit(f'{{"kind": "{kind}", "ids": ["'), listed, F.lit('"]}')), 256).alias("digest"))


def merge_windows(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, name, facts, label) of items (by, kind, name, facts, window, pages): one row a kind and normalised name, first spelling, facts in order of windows."""
    made = items.withColumn("k", normalize_title(F.col("name"))).groupBy(*by, "kind", "k").agg(
        F.min_by("name", "window").alias("name"), F.array_sort(F.collect_list(F.struct("window", "facts"))).alias("f"), F.flatten(F.collect_list("pages")).alias("p")
    )
    return made.select(*by, "kind", "name", F.array_join(F.transform("f", lambda x: x["facts"]), "\n").alias("facts"), page_label(F.col("p")).alias("label"))


def primary_subject(candidates: DataFrame, by: list[str], hint: str, marked: str | None = None) -> DataFrame:
    """candidates (by, ord, name, ...) with the hinted subject named as hinted and flagged primary; its other spellings go.

    A match is the same subject, with or without a leading title; a hint with a qualifier also takes a name without one.
    Without a match the marked name is taken, if there is one.
    """
    h = F.lit(hint)
    base, qualifier = split_qualifier(h)
    bare = strip_title(norm(F.col("name"))) == name_key(h)
    plain = (split_qualifier(F.col("name"))[1] == "") & (qualifier != "") & (same_subject(F.col("name"), base) | (strip_title(norm(F.col("name"))) == norm(base)))
    hit = same_subject(F.col("name"), h) | ((split_qualifier(F.col("name"))[1] == "") & (qualifier == "") & bare) | plain
    w = Window.partitionBy(*by)
    told = candidates.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    told = told.withColumn("_any", F.max("_hit").over(w))
    told = told.withColumn("_hit", F.col("_hit") | (~F.col("_any") & F.lit(marked is not None) & (normalize_title(F.col("name")) == normalize_title(F.lit(marked or "")))))
    told = told.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_hit").orderBy("ord")))
    kept = told.filter(~F.col("_hit") | (F.col("_n") == 1))
    return kept.withColumn("name", F.when(F.col("_hit"), h).otherwise(F.col("name"))).withColumn("primary", F.col("_hit")).drop("_hit", "_any", "_n")


def admissible(candidates: DataFrame) -> DataFrame:
    """candidates without identifier-like names, but for the primary subject's."""
    primary = F.col("primary") if "primary" in candidates.columns else F.lit(False)
    return candidates.filter(primary | ~identifier_like(F.col("name")))


def offered(verdicts: DataFrame, candidates: DataFrame, by: list[str], id_: str) -> DataFrame:
    """Verdicts on ids that were offered."""
    return verdicts.join(candidates.select(*by, id_).distinct(), [*by, id_], "left_semi")


def well_formed(verdicts: DataFrame, checks: DataFrame, by: str = "check_id") -> DataFrame:
    """(by, verdict): checks with exactly one verdict; null where the single check must be asked again."""
    once = verdicts.filter("verdict IS NOT NULL").groupBy(by).agg(F.count("*").alias("n"), F.first("verdict").alias("verdict")).filter("n = 1")
    return checks.select(by).distinct().join(once.select(by, "verdict"), by, "left")


def self_sections(sections: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """The newest sections that an object is compared with: SELF_SECTIONS at most, SELF_CHARS in all, the first one whatever its length (cut)."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    run = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    told = sections.withColumn("_n", F.row_number().over(w)).withColumn("_run", run)
    kept = told.filter((F.col("_n") <= SELF_SECTIONS) & ((F.col("_run") <= SELF_CHARS) | (F.col("_n") == 1)))
    return kept.withColumn(text, F.substring(text, 1, SELF_CHARS)).drop("_n", "_run")


def classify(sources: DataFrame, by: str, confirmed: DataFrame | None = None) -> DataFrame:
    """(by, documents, conversations, agents, untagged, mixed) of sources (by, id, source_type); confirmed ids (id) are not untagged."""
    told = sources
    if confirmed is not None:
        told = told.join(confirmed.select("id", F.lit(True).alias("_ok")), "id", "left")
    else:
        told = told.withColumn("_ok", F.lit(None).cast("boolean"))
    kind = {"documents": "document", "conversations": "conversation", "agents": "agent"}
    made = told.groupBy(by).agg(*[F.count_if(F.col("source_type") == v).alias(k) for k, v in kind.items()], F.count_if(F.col("source_type").isNull() & F.col("_ok").isNull()).alias("untagged"))
    several = F.when(F.col("documents") > 0, 1).otherwise(0) + F.when(F.col("conversations") > 0, 1).otherwise(0) + F.when(F.col("agents") > 0, 1).otherwise(0)
    return made.withColumn("mixed", several > 1)


def missing(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Tags, properties or ids wanted that are not there: what a reconciliation adds."""
    return wanted.select(*on).distinct().join(present.select(*on), on, "left_anti")


def unbacked(adj: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst) of relations that no typed link, either way round, stands behind: what a chain repair clears."""
    pair = links.select(F.least("from_id", "to_id").alias("x"), F.greatest("from_id", "to_id").alias("y")).distinct()
    held = adj.select("src", "dst", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    return held.join(pair, ["x", "y"], "left_anti").select("src", "dst")


def prune(objects: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """objects (id, column array) without the ids of gone (id), order kept; objects that list none are untouched."""
    listed = objects.select("id", F.posexplode(column).alias("pos", "x"))
    hit = listed.join(gone.select(F.col("id").alias("x")).distinct(), "x", "left_semi").select("id").distinct()
    kept = listed.join(hit, "id", "left_semi").join(gone.select(F.col("id").alias("x")).distinct(), "x", "left_anti")
    made = hit.join(kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_k")), "id", "left")
    out = objects.join(made.withColumn("_hit", F.lit(True)), "id", "left")
    value = F.when(F.col("_hit"), F.coalesce(F.transform("_k", lambda s: s["x"]), F.array().cast("array<string>"))).otherwise(F.col(column))
    return out.withColumn(column, value).drop("_k", "_hit")


def mentions(pages: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """(by, page, name) where a page of (by, page, text) holds a name of the same `by`, case aside."""
    return pages.join(names, by).filter(F.lower("text").contains(F.lower("name"))).select(*by, "page", "name")
