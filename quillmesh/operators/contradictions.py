"""Contradictions between new facts and what is stored: judged in batches, checked against what was offered, linked both ways, marked under the merge guard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import facts
from quillmesh.operators.planning import BATCH_SHARE, SELF_CHARS, SELF_SECTIONS, windows

VERDICT = "array<struct<object_id:string,reason:string>>"
SAME = "array<struct<object_id:string,earlier:string,new:string>>"
OFFERED = "array<struct<object_id:string,name:string,facts:string>>"
CHECK = f"check_id string, new_facts string, candidates {OFFERED}"
_OWN = re.compile(r"#s(\d+)$")


def batched(checks: DataFrame, by: list[str], budget: int) -> DataFrame:
    """checks (by, check_id, new_facts, candidates) with `batch`: consecutive ones while their texts fit the share of the budget; one beyond it stands alone."""
    size = F.length("new_facts") + F.aggregate("candidates", F.lit(0), lambda n, c: n + F.length(F.coalesce(c["facts"], F.lit(""))))
    return windows(checks, by, "check_id", size, int(BATCH_SHARE * budget)).withColumnRenamed("window", "batch")


def judged(checks: DataFrame, judge, by: list[str]) -> DataFrame:
    """(by, check_id, contradictions, duplicates, error): one call of the model for each batch, and one for each check whose verdict is missing, malformed or whose batch failed.

    Only ids that a check offered come through, each once, and duplicates only for one new unit each. A check's own failure stays with it.
    """
    kinds = dict(checks.dtypes)

    def ask(some: list[dict]) -> dict:
        got = judge.contradictions(some)
        return got if isinstance(got, dict) else {}

    def proper(v) -> bool:
        return isinstance(v, dict) and isinstance(v.get("contradictions"), list)

    def clean(check: dict, v: dict) -> tuple[list, list]:
        offered = {c["object_id"] for c in check["candidates"]}
        hits: dict[str, dict] = {}
        for x in v["contradictions"]:
            if isinstance(x, dict) and x.get("object_id") in offered:
                hits.setdefault(x["object_id"], {"object_id": x["object_id"], "reason": str(x.get("reason") or "")})
        left = [facts.key(u) for line in check["new_facts"].split("\n") for u in facts.units(line)]
        same = []
        for x in v.get("duplicates") or []:
            if isinstance(x, dict) and x.get("object_id") in offered and _OWN.search(x["object_id"]) and isinstance(x.get("earlier"), str) and isinstance(x.get("new"), str) and facts.key(x["new"]) in left:
                left.remove(facts.key(x["new"]))
                same.append({"object_id": x["object_id"], "earlier": " ".join(x["earlier"].split()), "new": x["new"]})
        return list(hits.values()), same

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        some = [{"check_id": i, "new_facts": n or "", "candidates": [dict(c) if isinstance(c, dict) else c.asDict() for c in (cs if cs is not None else [])]} for i, n, cs in zip(rows["check_id"], rows["new_facts"], rows["candidates"], strict=True)]
        asked = [c for c in some if c["candidates"]]
        try:
            told = ask(asked) if len(asked) > 1 else {}
        except Exception:  # noqa: BLE001 - each check is asked on its own then
            told = {}
        out = []
        for c in some:
            verdict, error = told.get(c["check_id"]), None
            if not c["candidates"]:
                verdict = {"contradictions": []}
            elif not proper(verdict):
                try:
                    verdict = ask([c]).get(c["check_id"])
                except Exception as e:  # noqa: BLE001 - it degrades this check only
                    verdict, error = None, f"contradiction_detection_degraded: {type(e).__name__}"
            hits, same = clean(c, verdict) if proper(verdict) else ([], [])
            out.append((hits, same, error))
        return rows[by + ["check_id"]].assign(contradictions=[x[0] for x in out], duplicates=[x[1] for x in out], error=[x[2] for x in out])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", check_id string, contradictions {VERDICT}, duplicates {SAME}, error string"
    return checks.groupBy(*by, "batch").applyInPandas(lambda rows: run(rows.sort_values("check_id")), schema)


def peers(verdicts: DataFrame, checks: DataFrame) -> DataFrame:
    """(id, contradictions): what is to be added to objects, both ways, by verdicts on other objects (checks: check_id, obj_id)."""
    pair = verdicts.join(checks.select("check_id", "obj_id"), "check_id").select("obj_id", F.explode("contradictions.object_id").alias("peer")).filter(~F.col("peer").rlike(r"#s\d+$") & (F.col("peer") != F.col("obj_id")))
    both = pair.select(F.col("obj_id").alias("id"), F.col("peer").alias("x")).unionByName(pair.select(F.col("peer").alias("id"), F.col("obj_id").alias("x")))
    return both.groupBy("id").agg(F.array_sort(F.collect_set("x")).alias("contradictions"))


def linked(objects: DataFrame, add: DataFrame) -> DataFrame:
    """objects (id, contradictions) with the ids to be added after those there, each once, and `changed`. Both sides of a pair are in one frame, so they are committed together or not at all."""
    old = F.coalesce("contradictions", F.array().cast("array<string>"))
    told = objects.join(add.select("id", F.col("contradictions").alias("_add")), "id", "left")
    made = F.array_union(old, F.coalesce("_add", F.array().cast("array<string>")))
    return told.withColumn("changed", F.size(made) > F.size(F.array_distinct(old))).withColumn("contradictions", made).drop("_add")


def own_candidates(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, own) of rows (by, obj_id, name, label, old, text): the sections of text that a writer of that label is held against, newest first, as candidates `obj_id#sN`.

    N counts the sections of other labels. Those that were in the old text or stand before the writer's own are offered, at
    most SELF_SECTIONS and SELF_CHARS in all, the first one whatever its length (cut): of two sources that come in together the later is held against the earlier.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for obj, name, label, old, text in zip(b["obj_id"], b["name"], b["label"], b["old"].fillna(""), b["text"].fillna(""), strict=True):
                had = {(s.label, s.source_id) for s in facts.parse(old)}
                offered, number, met = [], 0, False
                for s in facts.parse(text):
                    if s.label == label:
                        met = True
                        continue
                    if not met or (s.label, s.source_id) in had:
                        offered.append((f"{obj}#s{number}", f"{name} (earlier source: {s.label})", "\n".join(s.facts())))
                    number += 1
                kept, used = [], 0
                for i, n, told in reversed(offered):
                    if len(kept) == SELF_SECTIONS or (kept and used + len(told) > SELF_CHARS):
                        break
                    kept.append({"object_id": i, "name": n, "facts": told[:SELF_CHARS]})
                    used += len(told)
                out.append(kept)
            yield b[by].assign(own=out)

    return rows.select(*by, "obj_id", "name", "label", "old", "text").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", own {OFFERED}")


def _marked(text: str, label: str, source: str | None, hits: list, same: list) -> tuple[str, int, int, str | None]:
    """One text with a writer's verdicts on its earlier sections, under the guard."""
    others = [s for s in facts.parse(text) if s.label != label]
    number = lambda x: int(m[1]) if (m := _OWN.search(x["object_id"])) else -1
    own = [x for x in hits if 0 <= number(x) < len(others)]
    twice = [(number(x), x["earlier"]) for x in same if 0 <= number(x) < len(others)]
    base = facts.render(facts.parse(text))
    made = base
    for x in own:
        made = facts.flag_conflict(made, label, source, f"{others[number(x)].label}: {x['reason']}")
    made = facts.tag_duplicates(made, label, twice) if twice else made
    fine = made == base or facts.faithful(base, made, label, source, [])
    return made if fine else base, len(own), len(twice) if fine else 0, "needs-review" if own else None


def marked(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, text, flagged, tagged, status) of rows (by, text, label, source_id, contradictions, duplicates): conflicts with an object's own earlier sections as flags in the writer's section,
    judged duplicates as tags, under the guard; any conflict asks for a review, even where the guard keeps the old text.

    Rows of one object (by) are the verdicts of several writers on the same text and are applied in the order of their labels.
    """
    kinds = dict(rows.dtypes)

    def run(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["label", "source_id"])
        text, flagged, tagged, status = some["text"].fillna("").iloc[0], 0, 0, None
        for label, source, hits, same in zip(some["label"], some["source_id"], some["contradictions"], some["duplicates"], strict=True):
            text, f, t, s = _marked(text, label, source if isinstance(source, str) else None, list(hits if hits is not None else []), list(same if same is not None else []))
            flagged, tagged, status = flagged + f, tagged + t, status or s
        return some[by].head(1).assign(text=text, flagged=flagged, tagged=tagged, status=status)

    told = rows.select(*by, "text", "label", "source_id", "contradictions", "duplicates")
    return told.groupBy(*by).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", text string, flagged long, tagged long, status string")
