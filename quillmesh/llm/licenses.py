"""Operator 11, license scans by ordered signature rules, with DataFrame functions alone.

A text is brought to words in lower case with one space between them. One pattern finds which keywords it has; only the
rules of these keywords are tried (a join with the rules, whose number is fixed), and of them only those whose plain parts
the text has. A rule's places come from splitting the
text at it: what lies between two matches tells how many words one starts after the last. The places of one text are put
in order, and one running scan suppresses what lies within a place of the same or a better tier (the longer one, or with
equal words the one of the earlier rule, stays).

Base phrases are rules of their own, in tier 0: they neither suppress nor are suppressed. The score is the weight of the
best tier left (WEIGHTS), 0 without any.

Edge cases: null texts are empty; texts without words have no places and no labels (empty, not null), first_word and last_word are
null; letters beyond ASCII belong to words, and only A-Z are lower-cased; repeated rows and rows with one id are told apart
by their places in the files; a very long text is one row and stays in one task; an empty table gives no rows; other
columns are not read, and may be called as the operator's own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import placed, table
from quillmesh.llm.license_rules import rules

#: (label, keyword, phrase) of the contract's phrases.
BASE = (("gpl", "general", "gnu general public license"), ("apache", "apache", "apache license"), ("cc-by", "cc", "cc by"), ("mit", "mit", "mit license"))
WEIGHTS = (0.9, 0.99, 0.95, 0.85, 0.4)
#: All that is no part of a word.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def signatures() -> list[dict]:
    """All rules in order: those of the base phrases, then the others. The number of a rule is its place."""
    listed = [(0, label, keyword, phrase) for label, keyword, phrase in BASE] + rules()
    return [{"rule": i, "tier": t, "label": label, "keyword": k, "needs": plain_parts(p), "pattern": f"(?<= )(?:{p})(?= )"} for i, (t, label, k, p) in enumerate(listed)]


def plain_parts(pattern: str) -> list[str]:
    """The runs of letters, digits and spaces outside of groups and classes: each match has them all."""
    bare, depth = [], 0
    for i, c in enumerate(pattern):
        depth += (c in "([") - (c in ")]")
        bare.append(c if not depth and (c.isalnum() or c == " ") and pattern[i + 1 : i + 2] not in ("?", "*", "{") else "|")
    return [x for x in "".join(bare).split("|") if x.strip()]


def keyword_pattern(words: set[str]) -> str:
    """A pattern whose first group is a keyword that stands as a word: told apart by their first letters first."""
    firsts = sorted({w[0] for w in words})
    tails = ["|".join(sorted((w[1:] for w in words if w[0] == f), reverse=True)) for f in firsts]
    return f" (?=[{''.join(firsts)}])({'|'.join(f'{f}(?:{t})' for f, t in zip(firsts, tails, strict=True))})(?= )"


def canonical(text: Column) -> Column:
    """The words of a text in lower case, each between single spaces; two spaces if it has none.

    Lower-casing all letters is much faster than those of ASCII alone and moves no word: but for the two letters whose lower
    case holds one of ASCII, what is not ASCII stays so. Texts with these two have A-Z alone lower-cased.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.contains(whole, F.lit("\u0130")) | F.contains(whole, F.lit("\u212a")), F.translate(whole, UPPER, LOWER)).otherwise(F.lower(whole))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAP, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def license_places(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(file, place, keep, n_words, rule, tier, label, first, last, kept): a row without a rule for each of docs, and one for each place of a rule.

    docs has file and place, which tell its rows apart; first and last are the words where the place begins and ends. Places
    that are suppressed have kept false. The rows of one text are in one partition.
    """
    told = signatures()
    spark = docs.sparkSession
    schema = "array<struct<rule:int,tier:int,label:string,keyword:string,needs:array<string>,pattern:string>>"
    ruled = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(told)), schema)))
    plain = docs.select("file", "place", *keep, canonical(F.col(text)).alias("_canon"))
    plain = plain.withColumn("n_words", F.when(F.col("_canon") == "  ", F.lit(0).cast("long")).otherwise(_spaces(F.col("_canon")) - 1))
    keys = F.array_distinct(F.regexp_extract_all("_canon", F.lit(keyword_pattern({r["keyword"] for r in told})), F.lit(1)))
    # The key '' stands for the text itself and meets no rule.
    asked = plain.withColumn("keyword", F.explode(F.array_append(keys, F.lit(""))))
    tried = asked.join(F.broadcast(ruled), "keyword", "left").filter((F.col("rule").isNotNull() & F.forall("needs", lambda x: F.contains("_canon", x))) | (F.col("keyword") == ""))
    some = F.col("rule").isNotNull()
    gaps, hits = F.split("_canon", F.col("pattern"), -1), F.regexp_extract_all("_canon", F.col("pattern"), F.lit(0))
    sized = F.zip_with(F.transform(hits, lambda h: _spaces(h) + 1), F.transform(gaps, lambda g: _spaces(g) - 1), lambda h, g: F.struct(g.alias("gap"), h.alias("size")))
    found = tried.select("file", "place", *keep, "n_words", "rule", "tier", "label", F.posexplode_outer(F.when(some, F.filter(sized, lambda x: x["size"].isNotNull()))).alias("i", "hit"))
    found = found.filter(F.col("rule").isNull() | F.col("hit").isNotNull()).repartition("file", "place")
    upto = Window.partitionBy("file", "place", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("hit.gap") + F.col("hit.size")).over(upto) - 1
    placed_at = found.withColumn("last", end).withColumn("first", F.col("last") - F.col("hit.size") + 1)
    # In this order whatever a place lies within comes before it.
    before = Window.partitionBy("file", "place").orderBy("first", F.col("last").desc(), "tier", "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = {t: F.max(F.when(F.col("tier").between(1, t), F.col("last"))).over(before) for t in range(1, len(WEIGHTS))}
    within = F.coalesce(*[F.when(F.col("tier") == t, c) for t, c in covered.items()])
    kept = F.col("rule").isNotNull() & ((F.col("tier") == 0) | within.isNull() | (within < F.col("last")))
    return placed_at.select("file", "place", *keep, "n_words", "rule", "tier", "label", "first", "last", kept.alias("kept"))


def license_scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (label, first, last) of all that is kept, in order."""
    held = placed(df)
    ids, texts = (f"c{df.columns.index(c)}" for c in (doc_id, text))
    places = license_places(held, texts, [ids])
    base, joined = F.col("tier") == 0, lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("tier") + 1)
    out = places.groupBy("file", "place", ids, "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("kept"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("kept"), weight)), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("first", "last", "label")))).alias("spans"),
    )
    return out.select(F.col(ids).alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11's columns that SQL can express: its words and the places of the base phrases."""
    return op11_license_scan(spark, sf_dir).drop("labels", "score")


BASE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
f AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z, lead(x, 3) OVER o AS u FROM i WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i, CASE WHEN (x, y, z, u) = ('gnu', 'general', 'public', 'license') THEN 'gpl' WHEN (x, y) = ('apache', 'license') THEN 'apache'
  WHEN (x, y) = ('cc', 'by') THEN 'cc-by' WHEN (x, y) = ('mit', 'license') THEN 'mit' END AS label FROM f),
b AS (SELECT doc_id, count(*) AS n, min(i) AS f, max(i) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM p WHERE label IS NOT NULL GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, f AS first_word, l AS last_word, coalesce(s, '') AS base_labels FROM w LEFT JOIN b USING (doc_id)
"""
