"""Operator 1, language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all rows to learn from. The model is fitted in one task, on a bounded sample of them, by
follow-the-regularised-leader with elastic-net penalties; a part of the sample that is held back sets the temperature.
Every language seen is learned; fitting takes 256 KB for each.

Edge cases: a null text and one without a letter (as Python's isalpha has it: no digits, fractions or Roman numeral signs)
get `und` with the score 0; rows whose language is null teach nothing; without any row to learn from every text is `und`;
equal texts get equal results, however long; ties go to the first language in order; repeated rows and null ids are drawn
like others; an empty table gives no rows; other columns are not read, and keep must not name an output column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import lean, small_batches, table

BITS, ORDERS = 14, (1, 2, 3)
#: Bound of the sample that the model is fitted on: rows in all, dealt evenly to the languages, but no less than FEWEST of each.
SAMPLE, FEWEST = 2400, 5
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.01, 2
#: Characters worked on at once.
SEGMENT = 1 << 20
#: Languages whose counts may be broadcast.
BROADCAST = 100_000


def grams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the hashed n-grams of a whole text in lower case."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(1 << bits, np.int32)
    for s in range(0, len(points), SEGMENT):
        p = points[s : s + SEGMENT + max(ORDERS) - 1].astype(np.uint64)
        own = min(SEGMENT, len(points) - s)
        h = np.zeros(len(p), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            h = (h[: len(p) - n + 1] * np.uint64(0x100000001B3) + p[n - 1 :]) if n > 1 else p + np.uint64(1)
            if n in ORDERS and len(h):
                at = (h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)
                total += np.bincount(at[:own].astype(np.int64), minlength=1 << bits).astype(np.int32)
    at = np.flatnonzero(total)
    return at, total[at]


def tfidf(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear counts times inverse document frequency, with length 1."""
    x = np.log1p(count) * idf[at]
    return x / max(float(np.sqrt((x**2).sum())), 1e-12)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    heat: float = 1.0

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ tfidf(at, count, self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = softmax(self.logits(*grams(text)) / self.heat)
        best = int(p.argmax())
        return self.languages[best], min(1.0, float(p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray) -> Model:
    """Follow the regularised leader, per coordinate: z and n gather gradients, and small sums leave a weight at 0."""
    z, n = np.zeros((len(languages), len(idf))), np.zeros((len(languages), len(idf)))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        part = z[:, at]
        return np.where(np.abs(part) <= L1, 0.0, -(part - np.sign(part) * L1) / ((BETA + np.sqrt(n[:, at])) / ALPHA + L2))

    held, used = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    for _ in range(PASSES):
        for label, at, count in used or rows:
            x, w = tfidf(at, count, idf), weights(at)
            g = softmax(w @ x)
            g[label] -= 1
            step = g[:, None] * x
            more = step**2
            z[:, at] += step - (np.sqrt(n[:, at] + more) - np.sqrt(n[:, at])) / ALPHA * w
            n[:, at] += more
    model = Model(languages, weights(slice(None)), idf)
    logits = [(label, model.logits(at, count)) for label, at, count in held]
    model.heat = min(np.geomspace(0.05, 5, 40), key=lambda t: (-sum(np.log(max(softmax(v / t)[label], 1e-12)) for label, v in logits), t)) if logits else 1.0
    return model


def train(known: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (order, text, lang): document frequencies of all of them, weights from a sample of about `sample` rows in all, dealt evenly to the languages."""

    @lean
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for b in batches:
            for v in b.column(0):
                total[grams(v.as_py())[0]] += 1
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    if not languages:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros(1 << BITS))
    df = np.zeros((1 << BITS) + 1)
    for r in known.select("text").mapInArrow(frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        df[r["at"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    share = max(FEWEST, sample // len(languages))
    part = counts.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), 1.2 * share / F.col("n")).alias("_part"))
    wanted = F.pmod(F.col("order"), F.lit(1 << 30)) < F.floor(F.col("_part") * (1 << 30))

    @lean
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [grams(v.as_py()) for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=["order", "lang", "at", "count"])

    @lean
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(o, lang, at.values.to_numpy(), count.values.to_numpy()) for b in batches for o, lang, at, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))
        index = {x: i for i, x in enumerate(languages)}
        if rows:
            model = fit([(index[lang], at.astype(np.int64), count) for _, lang, at, count in rows], languages, idf)
            for i, w in enumerate(model.weights):
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "heat": pa.array([model.heat]), "weights": pa.array([w.tobytes()], pa.binary())})

    drawn = known.join(F.broadcast(part) if len(languages) <= BROADCAST else part, F.col("lang") == F.col("_lang")).filter(wanted)
    drawn = drawn.select("order", "lang", "text").mapInArrow(features, "order long, lang string, at array<int>, count array<int>")
    made = drawn.orderBy("order", "lang").limit(2 * share * len(languages)).mapInArrow(fitted, "i int, heat double, weights binary").collect()  # one task, as its rows are bounded; a row a language
    if not made:
        return Model([], np.zeros((0, 1 << BITS)), idf)
    return Model(languages, np.stack([np.frombuffer(r["weights"]) for r in sorted(made, key=lambda r: r["i"])]), idf, made[0]["heat"])


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, lang_pred, score) of each row; no shuffle. The model is of constant size."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sent.value.predict(v.as_py()) for v in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = dict(df.dtypes)
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double")


def fold(doc_id: Column, parts: int) -> Column:
    """The CRC-32 of the id's text modulo parts; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    known = docs.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("order"), "text", "lang")
    return identify(docs, train(known), keep=("doc_id", "held_out"))
