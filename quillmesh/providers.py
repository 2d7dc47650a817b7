"""What stands for models: an embedder and a synthesizer, deterministic and offline; others may take their place."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import zlib
from pyspark.sql import DataFrame

from quillmesh.functions.text import fold_text
from quillmesh.operators import facts


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str) -> DataFrame: ...

    def vector(self, text: str) -> list[float]: ...


class HashEmbedder:
    """Signed hashes of folded words, of length 1."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def vector(self, text: str) -> list[float]:
        out = np.zeros(self.dim)
        for w in fold_text(text or "").split():
            h = zlib.crc32(w.encode())
            out[h % self.dim] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(out)
        return (out / n if n else out).astype(float).tolist()

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        """df with a column embedding."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(embedding=b[text].map(self.vector))

        columns = [f for f in df.schema.fields if f.name != "embedding"]
        return df.select(*[f.name for f in columns]).mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", embedding array<float>")


class Judge(Protocol):
    """What stands for a model in the steps that ask one. Answers are plain data; anything may be raised or come back malformed."""

    def extract(self, text: str, hint: str | None) -> dict: ...

    def consolidate(self, stored: str, new: str, label: str) -> dict: ...

    def same_as(self, name: str, facts: str, candidates: list[dict]) -> str | None: ...

    def contradictions(self, checks: list[dict]) -> dict[str, dict]: ...


class Rules:
    """A judge without a model: headings are entities, new text is appended, names that hold each other are the same, units that differ only in a number contradict."""

    def extract(self, text: str, hint: str | None) -> dict:
        found = [{"name": m[1].strip(), "description": m[2].strip()} for m in re.finditer(r"(?ms)^#+ +(.+?)$(.*?)(?=^#|\Z)", text)]
        return {"entities": found, "concepts": [], "summary": text.strip().split("\n")[0]} | ({"primary_subject": hint} if hint else {})

    def consolidate(self, stored: str, new: str, label: str) -> dict:
        made = facts.append(stored, label, None, new)
        return {"consolidated_text": made.text, "changed": bool(made.added), "fact_actions": [], "conflicts": []}

    def same_as(self, name: str, facts: str, candidates: list[dict]) -> str | None:
        own = set(fold_text(name).split())
        return next((c["object_id"] for c in candidates if own and (own <= set(fold_text(c["name"]).split()) or set(fold_text(c["name"]).split()) <= own)), None)

    def contradictions(self, checks: list[dict]) -> dict[str, dict]:
        def shape(u: str) -> str:
            return re.sub(r"\d+", "#", facts.key(u))

        out = {}
        for c in checks:
            hits, same = [], []
            new = [u for line in c["new_facts"].split("\n") for u in facts.units(line)]
            for other in c["candidates"]:
                for old in (u for line in other["facts"].split("\n") for u in facts.units(line)):
                    for u in new:
                        if facts.key(u) == facts.key(old):
                            same.append({"object_id": other["object_id"], "earlier": old, "new": u})
                        elif "#" in shape(u) and shape(u) == shape(old):
                            hits.append({"object_id": other["object_id"], "reason": f"{u} / {old}"})
            out[c["check_id"]] = {"contradictions": hits, "duplicates": same}
        return out


# What a stream's failure is called, and the longest part of a model's own error that is told.
STREAM_FAILED, STREAM_BAD, STREAM_CUT, STREAM_CHARS = "stream_error", "invalid chunk", "stream ended before done", 200


def _told(line: str) -> tuple[str, str | None]:
    """A line of a stream as (kind, value): `bad` with why, `last` or `more` with its piece of text."""
    try:
        said = json.loads(line)
    except ValueError:
        said = None
    match said:
        case {"error": error} if error:
            shown = "".join(filter(str.isprintable, str(error)))
            return "bad", re.sub(r"//[^/@ ]*@", "//", shown)[:STREAM_CHARS]
        case {"response": str(text)} if text:
            pass
        case {"message": {"content": str(text)}}:
            pass
        case dict():
            text = ""
        case _:
            return "bad", STREAM_BAD
    return ("last" if said.get("done") else "more"), text


def read_stream(lines: Iterable[str]) -> tuple[str | None, str | None, str | None]:
    """(text, reason of its end, failure) of a model's answer as JSON lines, each with a piece, until one is done; what is no object, tells an error or ends before fails."""
    full = [x for x in lines if x.strip()]
    kinds = [_told(x) for x in full]
    end = next((i for i, (kind, _) in enumerate(kinds) if kind != "more"), None)
    if end is None or kinds[end][0] == "bad":
        return None, None, f"{STREAM_FAILED}: {STREAM_CUT if end is None else kinds[end][1]}"
    return "".join(text for _, text in kinds[: end + 1]), json.loads(full[end]).get("done_reason"), None


class Extractive:
    """An answer made of the context's first sentences, with their objects' names."""

    def answer(self, question: str, context: list[tuple[str, str]]) -> str:
        return "\n".join(f"{name}: {text.split('. ')[0].strip()}" for name, text in context) if context else ""
