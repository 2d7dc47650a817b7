"""Steps around what a model takes out of a text: subjects, candidates, plans of what to remember, aliases, consolidation. A model is a provider; its answers are data to be checked."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import identifier_like, normalize_title, same_subject
from quillmesh.operators import facts as merging
from quillmesh.operators.planning import fit

#: What an item's facts may be called, first wins; kinds with their type, label and property.
FACT_KEYS = ("facts", "wiki_facts", "wiki_definition", "definition", "description")
KINDS = {"concept": ("wiki_concept", "concept", "wiki_definition"), "entity": ("wiki_entity", "entity", "wiki_facts")}
#: What is read of a model's items; any other key is dropped.
ITEM = "struct<name:string," + ",".join(f"{k}:string" for k in FACT_KEYS) + ">"
EXTRACTION = f"struct<entities:array<{ITEM}>,concepts:array<{ITEM}>,summary:string,primary_subject:string>"


def of_kind(kind: Column) -> Column:
    """struct(type_key, label, property) of a kind; what is no concept is an entity."""
    made = {k: F.struct(*[F.lit(v).alias(n) for n, v in zip(("type_key", "label", "property"), x, strict=True)]) for k, x in KINDS.items()}
    return F.when(kind == "concept", made["concept"]).otherwise(made["entity"])


def projected(answers: DataFrame, column: str) -> DataFrame:
    """answers with the model's JSON as columns of the schema asked for: keys beyond it are gone, what is no JSON is empty."""
    return answers.withColumn(column, F.from_json(column, EXTRACTION))


def item_facts(item: Column) -> Column:
    """The first text of an item that is not blank."""
    return F.coalesce(*[F.when(F.trim(F.coalesce(item[k], F.lit(""))) != "", item[k]) for k in FACT_KEYS], F.lit(""))


def subjects(extracted: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, ord, name, kind, facts): entities, then concepts, of extractions (by, column); nameless ones go."""
    def side(key: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(column)[key], F.array().cast(f"array<{ITEM}>")), lambda x: F.struct(x["name"].alias("name"), F.lit(kind).alias("kind"), item_facts(x).alias("facts")))

    told = extracted.select(*by, F.posexplode(F.concat(side("entities", "entity"), side("concepts", "concept"))).alias("ord", "x"))
    return told.select(*by, "ord", "x.*").filter("coalesce(name, '') <> ''")


def with_extracted(candidates: DataFrame, extracted: DataFrame, by: list[str]) -> DataFrame:
    """candidates (by, ord, name, kind, facts) and those subjects whose normalised title is not there yet, the first of each."""
    both = candidates.select(*by, F.lit(0).alias("_late"), "ord", "name", "kind", "facts").unionByName(extracted.select(*by, F.lit(1).alias("_late"), "ord", "name", "kind", "facts"))
    both = both.withColumn("_k", normalize_title(F.col("name")))
    w = Window.partitionBy(*by, "_k")
    told = both.withColumn("_own", F.min("_late").over(w)).withColumn("_n", F.row_number().over(w.orderBy("_late", "ord")))
    kept = told.filter("_late = 0 OR (_own = 1 AND _n = 1)")
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy("_late", "ord")) - 1).drop("_late", "_k", "_own", "_n")


def remember_plan(found: DataFrame, relations: DataFrame, by: list[str], hint: str, knowledge: str, kind: str = "entity", refuse: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subjects, relations, refused names) of a batch: the hinted subject first with all the knowledge, its other spellings folded away, identifiers refused,
    and a `related` edge from it to each other subject that the caller's relations (by, from, to, label) don't join with it either way."""
    h = F.lit(hint)
    others = found.filter(~F.coalesce(same_subject(F.col("name"), h), F.lit(False)))
    bad = identifier_like(F.col("name")) if refuse else F.lit(False)
    kept, refused = others.filter(~bad), others.filter(bad).select(*by, "name")
    first = found.select(*by).distinct().select(*by, F.lit(-1).alias("ord"), h.alias("name"), F.lit("concept" if kind == "concept" else "entity").alias("kind"), F.lit(knowledge).alias("facts"))
    a, b = normalize_title(F.col("from")), normalize_title(F.col("to"))
    linked = relations.select(*by, F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y")).distinct()
    own, other = normalize_title(h), normalize_title(F.col("name"))
    fresh = kept.select(*by, "name", F.least(own, other).alias("_x"), F.greatest(own, other).alias("_y")).dropDuplicates([*by, "_x", "_y"]).join(linked, [*by, "_x", "_y"], "left_anti")
    more = fresh.select(*by, h.alias("from"), F.col("name").alias("to"), F.lit("related").alias("label"))
    return first.unionByName(kept.select(*first.columns)), relations.select(*by, "from", "to", "label").unionByName(more), refused


def extract(texts: DataFrame, judge, by: list[str], text: str = "text", hint: str | None = None, budget: int = 24_000) -> DataFrame:
    """(by, answer, error, kept_chars): a model's extraction of each text, cut to the budget, as JSON; asked once more after a malformed answer; a failure leaves it empty and is told."""
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, errors = [], []
            for value in b["_text"]:
                answer, error = None, "malformed_json"
                for _ in range(2):
                    try:
                        got = judge.extract(value or "", hint)
                    except Exception as e:  # noqa: BLE001 - a provider may fail in any way
                        error = "timeout" if isinstance(e, TimeoutError) else f"http_error: {type(e).__name__}"
                        break
                    if isinstance(got, dict):
                        answer, error = got, None
                        break
                answers.append(json_of(answer or {"entities": [], "concepts": []}))
                errors.append(error and f"extraction_degraded: {error}")
            yield b.drop(columns=["_text"]).assign(answer=answers, error=errors)

    cut = texts.select(*by, fit(F.col(text), budget).alias("_text")).withColumn("kept_chars", F.length("_text"))
    return cut.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", kept_chars int, answer string, error string")


def json_of(value: dict) -> str:
    import json

    return json.dumps(value, ensure_ascii=False, default=str)


def adjudicated(pairs: DataFrame, judge, by: list[str]) -> DataFrame:
    """(by, match) of candidates (by, name, facts, candidates: array of (object_id, name)): the id a model takes for the same, if it is one of those offered; else null. A failure is no match."""
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for name, text, offered in zip(b["name"], b["facts"], b["candidates"], strict=True):
                given = [dict(c) if isinstance(c, dict) else c.asDict() for c in (offered if offered is not None else [])]
                try:
                    got = judge.same_as(name or "", text or "", given) if given else None
                except Exception:  # noqa: BLE001 - merging aliases must not stop anything
                    got = None
                found.append(got if got in {c["object_id"] for c in given} else None)
            yield b[by].assign(match=found)

    return pairs.select(*by, "name", "facts", "candidates").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", match string")


def consolidation(judge):
    """A rewrite for facts.merge_facts: (text, error) of a model's wording of a merge, asked twice if malformed, its new section stamped with the source's id,
    kept only if it is faithful; else new facts are appended by rule, so that nothing is lost."""
    def rewrite(stored: str, label: str, source: str | None, new: str, known: set[str]) -> tuple[str, str | None]:
        error, text = "consolidation_degraded: malformed_json", None
        for _ in range(2):
            try:
                got = judge.consolidate(stored, new, label)
            except Exception as e:  # noqa: BLE001 - a provider may fail in any way
                error = f"consolidation_degraded: {type(e).__name__}"
                break
            if isinstance(got, dict) and isinstance(got.get("consolidated_text"), str):
                error, text = None, got["consolidated_text"]
                break
        if text is not None:
            text = merging.stamp(text, stored, label, source, known)
            fresh = [u for line in new.split("\n") for u in merging.units(line.strip())]
            if not merging.faithful(stored, text, label, source, fresh):
                error, text = "facts_guard_rejected", None
        return (text if text is not None else merging.append(stored, label, source, new).text), error

    return rewrite


def consolidated(rows: DataFrame, judge, by: list[str]) -> DataFrame:
    """(by, text, changed, error) of rows (by, stored, new, label, source_id, known): the model's consolidation of each; see consolidation."""
    kinds, rewrite = dict(rows.dtypes), consolidation(judge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for stored, new, label, source, known in zip(b["stored"].fillna(""), b["new"].fillna(""), b["label"], b["source_id"], b["known"], strict=True):
                text, error = rewrite(stored, label, source if isinstance(source, str) else None, new, set(known if known is not None else ()))
                out.append((text, text != stored, error))
            yield b[by].assign(text=[x[0] for x in out], changed=[x[1] for x in out], error=[x[2] for x in out])

    return rows.select(*by, "stored", "new", "label", "source_id", "known").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", text string, changed boolean, error string")
