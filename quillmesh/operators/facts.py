"""Facts kept by source: sections of lines, lines of units, merged without losing any.

Text form: a heading `## Source: label (id:x)` and the lines under it; lines that start with `>` are flags. The functions work
on one object's text; merge_facts applies them to many objects at once, one run of sorted rows an object, sources in the order given.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of the text form.
HEAD = "## Source: "
LEGACY = "unattributed (before per-source facts)"
_HEAD = re.compile(r"## Source: (.*?)(?: \(id:([^()\s]+)\))?")
_MARK = re.compile(r"\[(also|superseded):([^\]]*)\]", re.IGNORECASE)
_CITE = re.compile(r"\s*\[pp?\. [^\]]*\]\s*$")
_AFTER = re.compile(r"(?:\[(?:also|superseded):[^\]]*\]|\[pp?\.[^\]]*\])(?:\s+(?:\[(?:also|superseded):[^\]]*\]|\[pp?\.[^\]]*\]))*", re.IGNORECASE)
# A bracket, or what ends a sentence with the space before the next one.
_EDGE = re.compile(r"""[\[\]]|[.!?]\s+(?=[0-9"“(\[A-ZÀ-Ý])""")
# Line breaks of all kinds, what new text may not start a line with, and what would pass for a mark.
_BREAK = re.compile("\r\n|[\r\u0085\u2028\u2029]")
_LEAD = re.compile(r"^[\s#>\-]+")
_FORGED = re.compile(r"\[(?=also:|superseded:|conflict)", re.IGNORECASE)
_OPENS = set('"“([')
_PLAIN = re.compile(r"[\n\t\x20-\x7e]*")
#: Characters and rows of merged texts in an Arrow batch; characters of read lines that are kept from one object to the next.
MADE, ROWS, KEPT = 8_000_000, 10_000, 1_000_000


@dataclass
class Section:
    label: str
    source_id: str | None = None
    lines: list[str] = field(default_factory=list)

    def facts(self) -> list[str]:
        return [x for x in self.lines if not x.startswith(">")]


def _starts(c: str) -> bool:
    """Whether a sentence may start with this character."""
    return c.isdigit() and c.isascii() or c in _OPENS or "A" <= c <= "Z" or "À" <= c <= "Ý"


def units(line: str) -> list[str]:
    """The sentences of a line; marks and page cites belong to the sentence before them, and brackets are never split."""
    cuts, depth = [0], 0
    for m in _EDGE.finditer(line):
        c = line[m.start()]
        if c == "[":
            depth += 1
        elif c == "]":
            depth = 0
        elif depth == 0:
            cuts.append(m.end())
    out: list[str] = []
    for piece in (line[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(line)], strict=True)):
        while piece:
            tied = _AFTER.match(piece) if out and piece[0] == "[" else None
            if tied is None:
                out.append(piece)
                break
            out[-1] += " " + tied.group()
            piece = piece[tied.end() :].strip()
            if piece and not _starts(piece[0]):
                out[-1] += " " + piece
                break
    return out


def key(unit: str) -> str:
    """What makes two units the same fact: not case, spacing, marks, trailing cites or a leading dash."""
    text = _MARK.sub("", unicodedata.normalize("NFKC", unit)).rstrip()
    while text.endswith("]") and _CITE.search(text):
        text = _CITE.sub("", text)
    return " ".join(re.sub(r"^\s*-\s+", "", text).lower().split()).rstrip(".;,").strip()


#: Lines read before, each with its units and their keys.
Read = dict[str, tuple[tuple[str, str], ...]]


class Seen(Read):
    """Lines read before, also for other objects: what they are read as hangs on the line alone. Let go of between objects once they have more than KEPT characters."""

    size = 0

    def __setitem__(self, line: str, read: tuple[tuple[str, str], ...]) -> None:
        self.size += len(line)
        super().__setitem__(line, read)

    def bounded(self) -> Seen:
        if self.size > KEPT:
            self.clear()
            self.size = 0
        return self


def _read(line: str, seen: Read | None) -> tuple[tuple[str, str], ...]:
    """(unit, key) of a line's units; seen holds those of lines that were read before."""
    found = None if seen is None else seen.get(line)
    if found is None:
        found = tuple((u, key(u)) for u in units(line))
        if seen is not None:
            seen[line] = found
    return found


def parse(text: str, known: set[str] | None = None) -> list[Section]:
    """Sections of a text. Lines before the first heading are a section of their own; ids that are not known are dropped."""
    out: list[Section] = []
    for line in text.split("\n"):
        at = line.find(HEAD)
        m = _HEAD.fullmatch(line[at:].rstrip()) if at >= 0 else None
        if m:
            if line[:at].strip():
                (out or [out.append(Section(LEGACY)) or out[0]])[-1].lines.append(line[:at].rstrip())
            out.append(Section(m[1], m[2] if known is None or m[2] in known else None))
        elif line.strip():
            if not out:
                out.append(Section(LEGACY))
            out[-1].lines.append(line.rstrip())
    return out


def render(sections: list[Section]) -> str:
    return "\n\n".join("\n".join([HEAD + s.label + (f" (id:{s.source_id})" if s.source_id else ""), *s.lines]) for s in sections)


def _printed(text: str) -> str:
    """text with newlines as its only line breaks, without control and format characters."""
    if _PLAIN.fullmatch(text):
        return text
    text = _BREAK.sub("\n", text)
    bad = [c for c in set(text) if c not in "\n\t" and unicodedata.category(c) in ("Cc", "Cf")]
    return text.translate({ord(c): None for c in bad}) if bad else text


def defused(text: str) -> str:
    """New text that cannot pass for headings, ids, marks or flags: functions.text.defuse for one string."""
    text = _printed(text)
    if "[" in text:
        text = _FORGED.sub("(", text)
    lines = [x if x[:1].isalnum() else _LEAD.sub("", x) for x in text.split("\n")]
    if "##" in text:
        lines = [re.sub("#{2,}", "#", x) for x in lines]
    return "\n".join([x.replace("(id:", "(id :").strip() for x in lines])


@lru_cache(1000)
def clean_label(label: str) -> str:
    """A label of one line that cannot end its heading, list or mark, nor bring an id of its own."""
    flat = " ".join(_printed(label).split()).translate(str.maketrans("[];", "(),")).replace("(id:", "(id :")
    return re.sub("#{2,}", "#", flat).lstrip("#").strip()


def labels(unit: str) -> list[str]:
    return [x.strip() for m in _MARK.finditer(unit) if m[1].lower() == "also" for x in m[2].split(";") if x.strip()]


def mark_also(unit: str, label: str) -> str:
    """unit with label among those that say the same."""
    named = labels(unit)
    if label in named:
        return unit
    bare = re.sub(r"\s*\[also:[^\]]*\]", "", unit, flags=re.IGNORECASE).rstrip()
    return f"{bare} [also: {'; '.join([*named, label])}]"


@dataclass
class Merge:
    text: str
    added: list[str]
    marked: int


def _writer(sections: list[Section], label: str, source_id: str | None) -> Section | None:
    """A source's own section: that with its id, or for a source without one the section of its label that has none."""
    return next((s for s in sections if (s.source_id == source_id if source_id else s.source_id is None and s.label == label)), None)


def append(text: str, label: str, source_id: str | None, new: str, seen: Read | None = None) -> Merge:
    """text with a source's facts: known in its own section or one of its label they are skipped, known elsewhere marked there, else appended before the flags that end its section.

    The label and the facts are defused first, so that neither can bring sections, ids, marks or flags. Lines in seen are not read again.
    """
    label, new = clean_label(label), defused(new)
    sections = parse(text)
    own = _writer(sections, label, source_id)
    have: set[str] = set()
    elsewhere: dict[str, tuple[Section, int, list[str], int]] = {}  # by key: the first unit that says it, with its line
    for s in sections:
        for i, x in enumerate(s.lines):
            if x.startswith(">"):
                continue
            read = _read(x, seen)
            if s is own or s.label == label:
                have.update(k for _, k in read)
                continue
            found = [u for u, _ in read]
            for j, (_, k) in enumerate(read):
                if k not in elsewhere:
                    elsewhere[k] = (s, i, found, j)
    added, marked, lines = [], 0, []
    for line in new.split("\n"):
        fresh = []
        for u, k in _read(line, seen):
            if not k or k in have:
                continue
            have.add(k)
            if k in elsewhere:
                s, i, found, j = elsewhere[k]
                if label in labels(found[j]):
                    continue
                found[j] = mark_also(found[j], label)
                s.lines[i] = " ".join(found)
                marked += 1
            else:
                fresh.append(u)
        added += fresh
        if fresh:
            lines.append(" ".join(fresh))
    if lines:
        if own is None:
            sections.append(own := Section(label, source_id))
        at = len(own.lines)
        while at and own.lines[at - 1].startswith(">"):
            at -= 1
        own.lines[at:at] = lines
    return Merge(render(sections) if added or marked else text, added, marked)


def tag_duplicates(text: str, label: str, judged: list[tuple[int, str]]) -> str:
    """text with label among those that say the same as judged (section number, unit); sections are numbered without those of the label. What is not found is passed over."""
    sections = parse(text)
    others = [s for s in sections if s.label != label]
    for number, unit in judged:
        if not 0 <= number < len(others):
            continue
        spots = [(i, j, found) for i, x in enumerate(others[number].lines) if not x.startswith(">") for found in [units(x)] for j, u in enumerate(found) if key(u) == key(unit)]
        if spots:
            i, j, found = spots[0]
            found[j] = mark_also(found[j], label)
            others[number].lines[i] = " ".join(found)
    return render(sections)


def stamp(candidate: str, stored: str, label: str, source_id: str | None, known: set[str]) -> str:
    """candidate with the source's id on its last section, if that is the one new section, has the label and no known id."""
    sections = parse(candidate)
    if not source_id or len(sections) != len(parse(stored)) + 1 or sections[-1].label != label or sections[-1].source_id in known:
        return candidate
    sections[-1].source_id = source_id
    return render(sections)


def _bare(unit: str, label: str) -> str:
    """unit without label in its list of those that say the same."""
    named = labels(unit)
    if label not in named:
        return " ".join(unit.split())
    rest = [x for x in named if x != label]
    plain = re.sub(r"\s*\[also:[^\]]*\]", "", unit, flags=re.IGNORECASE).rstrip()
    return " ".join((plain + (f" [also: {'; '.join(rest)}]" if rest else "")).split())


def faithful(old: str, new: str, label: str, source_id: str | None, allowed: list[str]) -> bool:
    """Whether a rewrite keeps all sections, units and flags in place and adds only the writer's: units of allowed in its section, its label in tags, flags."""
    before, after = parse(old), parse(new)
    keys, exact = {key(u) for u in allowed}, {" ".join(u.split()) for u in allowed}
    if not len(before) <= len(after) <= len(before) + 1 or any((x.label, x.source_id) != (y.label, y.source_id) for x, y in zip(before, after, strict=False)):
        return False

    def fine(unit: str) -> bool:
        bare = _bare(unit, label)
        return key(unit) in keys and not _MARK.search(bare) and bare in exact

    def split(s: Section) -> tuple[list[str], list[str]]:
        return [u for x in s.facts() for u in units(x)], [x for x in s.lines if x.startswith(">")]

    if len(after) > len(before):
        new_units, _ = split(after[-1])
        if (after[-1].label, after[-1].source_id) != (label, source_id) or _writer(before, label, source_id) or not new_units or not all(map(fine, new_units)):
            return False
    own = _writer(before, label, source_id)
    for x, y in zip(before, after, strict=False):
        (had, flags), (has, now) = split(x), split(y)
        if len(has) < len(had) or any(_bare(u, label) != _bare(v, label) for u, v in zip(had, has, strict=False)) or Counter(flags) - Counter(now):
            return False
        if x is not own and (len(has) > len(had) or len(now) > len(flags)) or not all(map(fine, has[len(had) :])):
            return False
    return _writer(after, label, source_id) is not None or label in {s.label for s in after}


def flag_conflict(text: str, label: str, source_id: str | None, reason: str) -> str:
    """text with a flag line in the writer's section, once."""
    sections = parse(text)
    flag = f"> [conflict: {' '.join(reason.split())[:200]}]"
    own = _writer(sections, label, source_id)
    if own is not None and flag not in own.lines:
        own.lines.append(flag)
    return render(sections)


def nothing_lost(old: str, new: str, seen: Read | None = None) -> bool:
    """The guard of each merge: every section and unit (by key, as often) and every flag of the old text is in the new one, in order. Lines in seen are not read again."""
    before, after = parse(old), parse(new)
    names = [(s.label, s.source_id) for s in after]
    had = [(s.label, s.source_id) for s in before]
    if [n for n in names if n in set(had)] != had:
        return False
    for s in before:
        t = after[names.index((s.label, s.source_id))]
        if s.lines == t.lines:
            continue
        for part in (lambda x: [k for y in x.facts() for _, k in _read(y, seen)], lambda x: [y for y in x.lines if y.startswith(">")]):
            if Counter(part(s)) - Counter(part(t)):
                return False
    return True


def folded(text: str | None, told: list[tuple], seen: Read, rewrite=None) -> tuple:
    """(text, added, marked, degraded) of one object's text with what it is told: (label, source_id, facts) in turn. See merge_facts."""
    text, added, marked, degraded = text or "", 0, 0, None
    for label, source, facts in told:
        facts = facts or ""
        made = append(text, label, source, facts, seen)
        if not made.added and not made.marked:
            continue
        worded = made.text
        if rewrite is not None and text.strip() and made.added:
            known = {s.source_id for s in parse(text) if s.source_id}
            worded, error = rewrite(text, clean_label(label), source, defused(facts), known)
            degraded = degraded or error
        if nothing_lost(text, worded, seen):
            text, added, marked = worded, added + len(made.added), marked + made.marked
    return text, added, marked, degraded


def merge_facts(stored: DataFrame, new: DataFrame, rewrite=None) -> DataFrame:
    """(id, text, added, marked, degraded): new facts (id, ord, label, source_id, facts) merged into stored texts (id, text) in order of ord.

    rewrite(text, label, source_id, facts, known ids) gives (text, error) and may word the merge otherwise where there is a
    text already; by default facts are appended. A merge that would lose anything is left out. degraded is the first error.
    One object's sources meet in one task; they are as few as an object has. Stored texts and new facts are dealt and sorted
    together, so an object's text comes once, before its facts, and its rows are told by their id alone.
    """
    kinds, none = dict(new.dtypes), F.lit(None)
    kind = kinds["id"]
    fresh = new.select("id", F.lit(1).alias("_n"), "ord", F.col("label").cast("string"), F.col("source_id").cast("string"), F.col("facts").cast("string"))
    held = stored.select(F.col("id").cast(kind), F.lit(0).alias("_n"), none.cast(kinds["ord"]).alias("ord"), none.cast("string").alias("label"), none.cast("string").alias("source_id"), F.col("text").cast("string").alias("facts"))
    order = ["id", "_n", *[F.asc_nulls_last(c) for c in ("ord", "label", "source_id", "facts")]]
    rows = fresh.unionByName(held).repartition("id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, text, told, kept, seen = None, None, None, [], Seen()
        columns = ("id", "text", "added", "marked", "degraded")

        def batch(held: pa.DataType) -> pa.RecordBatch:
            types = (held, pa.string(), pa.int64(), pa.int64(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), types, strict=True)], names=list(columns))
            kept.clear()
            return made

        size, held = 0, pa.null()
        for b in batches:
            held = b.schema.field(0).type
            for key_, n, label, source, facts in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if told is None or key_ != at:
                    if told:
                        kept.append((at, *folded(text, told, seen.bounded(), rewrite)))
                        size += len(kept[-1][1])
                    at, text, told = key_, None, []
                    if size > MADE or len(kept) >= ROWS:
                        yield batch(held)
                        size = 0
                if n:
                    told.append((label, source, facts))
                elif text is None:
                    text = facts
        if told:
            kept.append((at, *folded(text, told, seen.bounded(), rewrite)))
        if kept:
            yield batch(held)

    return rows.mapInArrow(run, f"id {kind}, text string, added long, marked long, degraded string")


def distinct_units(lines: DataFrame, line: str, by: list[str], fact_key_column) -> DataFrame:
    """The view of merging for analysis: (by, fact_key, n) of lines, native."""
    return lines.select(*by, fact_key_column(F.col(line)).alias("fact_key")).filter("fact_key <> ''").groupBy(*by, "fact_key").agg(F.count("*").alias("n"))
