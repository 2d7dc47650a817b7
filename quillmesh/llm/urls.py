"""Operator 2, URL filters: host word segmentation by unigram Viterbi, then multinomial naive Bayes on host and path tokens.

Rules (host and path prefix) decide first: a rule fits its host and all subdomains where the url's path starts with the
rule's path, and the longest rule wins. Urls that rules decide are what naive Bayes learns from; it decides the others.
The words of the unigram model are counted over all pages: those of the prose, and delimited parts of hosts and paths. All of
them count, however rare: each distinct name is joined with the words that lie in it, so no vocabulary is held whole.

Edge cases: a null url, or one without `://`, has an empty host and path, no token and the verdict of the class prior; a
host is A-Z lower-cased only, its tokens are lower-cased in all scripts; names of any length and script are split; a null
html has no words; without urls that rules decide the method allows all; equal urls get equal verdicts; equally long rules
go to the first one given; null and repeated page_ids are rows like others; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import few, lean, shared_dir, small_batches, stash, table

#: (verdict, host, path) of the contract's rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Of the model: the longest word that a name is split into but for runs of unknown characters, and the bits of a token's bucket.
LONGEST, BITS = 32, 16
#: Rows of words, names or urls that may be broadcast; beyond that the same join shuffles.
BROADCAST_ROWS = 200_000
#: Substrings gathered before a batch of them is handed on, and places of a name whose substrings are gathered at once.
SUBSTRINGS, STARTS = 50_000, 2_000
_TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[^\W_]+")
_ADDRESS = re.compile(r"\b[a-z]{2,10}://\S*|\bwww\.\S*")


def after_scheme() -> Column:
    """What follows the first `://` of the column url; empty if there is none."""
    return F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def parts(df: DataFrame) -> DataFrame:
    """df with host and path; a column url is what is read."""
    rest = F.coalesce(after_scheme(), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def ruled(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """df (with host and path) with rule and by_rule: the longest rule that fits and its verdict, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("by_rule", verdict)


@dataclass
class Model:
    cost: dict[str, float] = field(default_factory=dict)
    unknown: float = 12.0
    seen: dict[str, list[str]] = field(default_factory=dict)

    def split(self, name: str) -> list[str]:
        """The cheapest sequence of words: each costs minus the logarithm of its share, an unknown one more with each character."""
        if name in self.seen:
            return self.seen[name]
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        for j in range(1, len(name) + 1):
            for i in range(max(0, j - LONGEST), j):
                c = best[i] + self.cost.get(name[i:j], self.unknown * (j - i))
                if c < best[j]:
                    best[j], back[j] = c, i
        out, j = [], len(name)
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        return out[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        """Segmented words of host (h:) and path (p:)."""
        out = []
        for mark, text in (("h:", host.lower()), ("p:", path.lower())):
            for name in _PART.findall(text):
                if name.isdigit():
                    out.append(f"{mark}#{len(name)}")
                else:
                    out += [mark + w for w in self.split(name)]
        return out


def bucket(token: str) -> int:
    h = 14695981039346656037
    for c in token.encode():
        h = (h ^ c) * 1099511628211 & (1 << 64) - 1
    return h * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - BITS


def named(host: str, path: str) -> list[str]:
    """The names of a url that are split into words."""
    return [x for x in _PART.findall(f"{host} {path}".lower()) if not x.isdigit()]


def words(host: str, path: str, html: str | None) -> list[str]:
    """The words that a page shows to be words: those of its prose without addresses, the parts of hyphenated names, the last label of its host.

    A name that stands alone in a host or path may be a concatenation, so it is no evidence of a word.
    """
    text = unescape(_TAG.sub(" ", html or "")).lower()
    host = host.lower()
    # The host goes where it stands as a name of its own, not where its letters lie within words.
    own = rf"(?<![\w.-]){re.escape(host)}(?![\w-]|\.\w)"
    out = _WORD.findall(_ADDRESS.sub(" ", re.sub(own, " ", text) if host else text))
    labels = host.split(".")
    for x in (*labels, *path.lower().split("/")):
        parts_ = [p for p in re.split("[-_]", x) if p]
        if len(parts_) > 1:
            out += [p for p in parts_ if _PART.fullmatch(p) and not p.isdigit()]
    if len(labels) > 1 and _PART.fullmatch(labels[-1]) and not labels[-1].isdigit():
        out.append(labels[-1])
    return [w for w in out if len(w) <= LONGEST]


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, n): all words of pages (host, path, html), counted over all rows."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter = Counter()
            for host, path, html in zip(*(b.column(i) for i in range(3)), strict=True):
                count.update(words(host.as_py(), path.as_py(), html.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    return pages.select("host", "path", "html").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def split_names(names: DataFrame, vocab: DataFrame) -> DataFrame:
    """(name, words) of distinct names: each is split with the costs of all words of vocab that lie in it, whatever the size of vocab.

    Names meet the words by a 64-bit hash, so long names are not repeated with each of their words.
    """
    total, rarest = vocab.agg(F.sum("n"), F.min("n")).first()
    total = total or 1
    unknown = max(12.0, math.log(total / (rarest or 1)))
    hashed = names.select("name", F.xxhash64("name").alias("at"))

    @lean
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, word = [], []
            for x, h in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                x = x.as_py()
                for s in range(0, len(x), STARTS):
                    found = {x[i:j] for i in range(s, min(len(x), s + STARTS)) for j in range(i + 1, min(len(x), i + LONGEST) + 1)}
                    at += [h] * len(found)
                    word += found
                    if len(word) > SUBSTRINGS:
                        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(word, pa.string())], names=["at", "word"])
                        at, word = [], []
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(word, pa.string())], names=["at", "word"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for name, known in zip(b.column(0), b.column(1), strict=True):
                made.append(Model({w["word"]: -math.log(w["n"] / total) for w in known.as_py() or []}, unknown).split(name.as_py()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.string()))], names=["name", "words"])

    lying = hashed.select("name", "at").mapInArrow(inner, "at long, word string").join(few(vocab, BROADCAST_ROWS), "word")
    known = lying.groupBy("at").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    return hashed.join(known, "at", "left").select("name", "known").mapInArrow(run, "name string, words array<string>")


def tokenised(pages: DataFrame) -> DataFrame:
    """(host, path, by_rule, n, tokens, at) of each distinct url of pages (host, path, by_rule, html): its rows, its tokens and their buckets."""
    urls = stash(pages.groupBy("host", "path").agg(F.first("by_rule").alias("by_rule"), F.count("*").alias("n")))

    @lean
    def split_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sorted(set(named(h, p))) for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.string()))], names=["host", "path", "by_rule", "n", "names"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for h, p, known in zip(*(b.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
                made.append(Model(seen={x["name"]: x["words"] for x in known}).tokens(h, p))
            at = [[bucket(t) for t in x] for x in made]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(made, pa.list_(pa.string())), pa.array(at, pa.list_(pa.int32()))], names=["host", "path", "by_rule", "n", "tokens", "at"])

    listed = urls.select("host", "path", "by_rule", "n").mapInArrow(split_up, "host string, path string, by_rule string, n long, names array<string>")
    one = stash(listed.select("host", "path", "by_rule", "n", F.explode_outer("names").alias("name")))
    split = stash(split_names(stash(one.filter("name IS NOT NULL").select("name").distinct()), stash(vocabulary(pages))))
    held = one.join(few(split, BROADCAST_ROWS), "name", "left").groupBy("host", "path", "by_rule", "n")
    held = held.agg(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "words"))).alias("known"))
    return stash(held.mapInArrow(run, "host string, path string, by_rule string, n long, tokens array<string>, at array<int>"))


def train(urls: DataFrame) -> tuple[np.ndarray, float]:
    """Naive Bayes from tokenised urls: the weight of each bucket and the prior, from token counts over all rows that rules decide."""
    count, weights, prior = np.zeros((2, (1 << BITS) + 1)), np.zeros(1 << BITS), 0.0
    known = urls.filter("by_rule IS NOT NULL").select((F.col("by_rule") == "block").cast("int").alias("block"), "n", "at")
    every = known.select("block", "n", F.explode("at").alias("at")).unionByName(known.select("block", "n", F.lit(1 << BITS).alias("at")))
    for r in every.groupBy("block", "at").agg(F.sum("n").alias("n")).collect():
        count[r["block"], r["at"]] = r["n"]
    if count[:, -1].any():
        used = (count[:, :-1].sum(axis=0) > 0).sum()
        share = (count[:, :-1] + 1) / (count[:, :-1].sum(axis=1, keepdims=True) + max(1, used))
        weights = np.where(count[:, :-1].sum(axis=0) > 0, np.log(share[1] / share[0]), 0.0)
        prior = math.log((count[1, -1] + 1) / (count[0, -1] + 1))
    return weights, prior


def filter_urls(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of df (page_id, url, html); score is the log-odds of block."""
    small_batches(df.sparkSession)
    shared_dir(df.sparkSession)
    pages = ruled(parts(df.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))), rules)
    urls = tokenised(pages)
    sent = df.sparkSession.sparkContext.broadcast(train(urls))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights, prior = sent.value
            score = [prior + sum(weights[x]) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], names=["host", "path", "score"])

    scored = stash(urls.select("host", "path", "at").mapInArrow(run, "host string, path string, score double"))
    verdict = F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict")
    return pages.select("page_id", "host", "path", "rule", "by_rule").join(few(scored, BROADCAST_ROWS), ["host", "path"]).select("page_id", "host", "path", "rule", verdict, "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
