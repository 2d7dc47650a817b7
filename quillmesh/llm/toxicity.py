"""Operator 3, toxicity: a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel counts the common subsequences of three characters of two words, gaps allowed up to SPAN characters in all and
each discounted by DECAY a character; so an insult with characters put in between keeps most of its similarity. A word's
features against the landmarks, whitened by the landmarks' own kernel, are linear in its subsequences, so a fitted machine
folds into one weight for each (hashed) subsequence and every word of every text can be scored. Single characters set apart
by spaces are read as one word too.

Labels mark whole texts and the machine learns from their words by multiple instances: a text is as toxic as its worst
word. Words that tell toxic from clean texts by their counts are the first positive cases; in each round the worst words of
toxic texts that also tell by their counts join them, and the worst ones of clean texts are negative ones. Sentences are not told apart. The two worst words and the number of words of a text then give its probability,
by a logistic regression on texts held back from the machine.

Edge cases: null, empty and word-less texts get the score of a text whose words are all harmless; unlabelled rows teach
nothing; without toxic or clean examples every score is 0; equal texts get equal scores; repeated labels count once, the
highest label standing; of rows with one labelled id one text is learned from, by a hash; an empty table gives no rows; columns other than the id, text and keep are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import lean, mix64, small_batches, table, trim
from quillmesh.llm.language import fold

BITS, SPAN, DECAY = 16, 6, 0.75
#: Bounds of what is fitted on: labelled texts of each class, landmarks of each class, negative words of a round, rounds.
TEXTS, LANDMARKS, NEGATIVES, ROUNDS = 1000, 120, 4000, 3
RIDGE, SLACK, SHARP, FLAT = 0.1, 1.0, 4, 0.3
#: Values above this are worked out with the exact norm.
CLOSE = -0.8
THRESHOLD = 0.7
#: From so many texts on every fourth one is held back for the probabilities.
HELD = 300
#: Words worked on at once; bounds memory.
AT_ONCE = 8_000
#: Shorter words have too few subsequences to be a positive case.
SHORTEST, LEAST = 4, -0.4
_EDGE = ".,;:!?\"'()[]{}<>«»“”„…-—–*_~"
_SPACED = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")
_INNER = re.compile(r"[\W_]+")
_GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def segments(text: str) -> set[str]:
    """The distinct words of a whole text in lower case, without punctuation around them, words with signs
    inside also without these, and runs of single characters as one word."""
    low = text.lower()
    found = {w.strip(_EDGE) for w in set(low.split())}
    found |= {_INNER.sub("", w) for w in found if not w.isalpha()}
    found |= {re.sub(r"\s", "", m.group()) for m in _SPACED.finditer(low)}
    found.discard("")
    return found


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, weight) of each subsequence of three characters, and each word's norm."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    hashed = [points * np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    at, bucket, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, j in _GAPS:
        if len(points) > j:
            same = owner[:-j] == owner[j:]
            n = len(points) - j
            h = mix64(hashed[0][:n] + hashed[1][i : n + i] + hashed[2][j : n + j])[same] >> np.uint64(64 - BITS)
            at.append(owner[:-j][same])
            bucket.append(h.astype(np.int64))
            weight.append(np.full(len(h), DECAY ** (j + 1)))
    at, bucket, weight = np.concatenate(at), np.concatenate(bucket), np.concatenate(weight)
    return at, bucket, weight, np.sqrt(np.bincount(at, weight**2, len(words))) + 1e-9


def norms(count: int, at: np.ndarray, bucket: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each word's norm with equal subsequences of a word taken together; subsequences() takes them apart, which is faster and never larger."""
    code, place = np.unique(at << BITS | bucket, return_inverse=True)
    return np.sqrt(np.bincount(code >> BITS, np.bincount(place, weight) ** 2, count)) + 1e-9


def explicit(words: list[str], bits: int = BITS) -> np.ndarray:
    """Rows of normalised subsequence weights; the inner product of two rows is the kernel. For words of a bounded number."""
    out = np.zeros((len(words), 1 << bits), np.float32)
    at, bucket, weight, _ = subsequences(words)
    np.add.at(out, (at, bucket >> (BITS - bits)), weight)
    out /= (np.sqrt(np.einsum("ij,ij->i", out, out)) + 1e-9)[:, None]
    return out


def against(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """The kernel of each word with each landmark (rows of explicit)."""
    if len(words) > AT_ONCE // 8:
        return np.concatenate([against(words[i : i + AT_ONCE // 8], landmarks) for i in range(0, len(words), AT_ONCE // 8)])
    at, bucket, weight, _ = subsequences(words)
    norm = norms(len(words), at, bucket, weight)
    out = np.zeros((len(words), len(landmarks)))
    for s in range(0, len(at), 10_000):
        part = slice(s, s + 10_000)
        rows = landmarks[:, bucket[part]].T * weight[part, None]
        cut = np.flatnonzero(np.diff(at[part], prepend=-1))
        order = np.argsort(at[part], kind="stable") if len(cut) and (np.diff(at[part]) < 0).any() else None
        own = at[part]
        if order is not None:
            own, rows = own[order], rows[order]
            cut = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[cut]] += np.add.reduceat(rows, cut, axis=0)
    return out / norm[:, None]


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    bias: float = 0.0
    link: tuple[float, ...] | None = None

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's value for each word."""
        if len(words) > AT_ONCE:
            return np.concatenate([self.margins(words[i : i + AT_ONCE]) for i in range(0, len(words), AT_ONCE)])
        at, bucket, weight, norm = subsequences(words)
        value = np.bincount(at, self.weights[bucket] * weight, len(words))
        out = value / norm + self.bias
        high = out > CLOSE  # the exact norm can only bring a value nearer to the bias
        use = high[at]
        out[high] = (value / norms(len(words), at[use], bucket[use], weight[use]))[high] + self.bias
        return out

    def worst(self, texts: list[set[str]]) -> np.ndarray:
        """The two highest values of each text's words; a text without words has the bias."""
        words = sorted(set().union(*texts)) if texts else []
        value = dict(zip(words, self.margins(words).tolist(), strict=True))
        out = np.full((len(texts), 2), self.bias)
        for row, text in zip(out, texts, strict=True):
            a = b = self.bias
            for w in text:
                v = value[w]
                if v > b:
                    a, b = (v, a) if v > a else (a, v)
            row[:] = a, b
        return out

    def scores(self, texts: list[set[str]]) -> np.ndarray:
        if self.link is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.signs(texts) @ np.array(self.link), -40, 40)))

    def signs(self, texts: list[set[str]]) -> np.ndarray:
        """What the link sees of each text: its two worst values between LEAST and 1, the logarithm of its number of distinct words, and 1."""
        return np.hstack([np.clip(self.worst(texts), LEAST, 1), np.log1p([[len(t)] for t in texts]).reshape(-1, 1), np.ones((len(texts), 1))])


def machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss, by Newton steps; both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    cost = SLACK * np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()), 1.0)
    def loss(w: np.ndarray) -> float:
        return RIDGE * float(w @ w) / 2 + float((cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()) / 2

    w = np.zeros(x.shape[1])
    for _ in range(40):
        active = y * (x @ w) < 1
        a = x[active] * cost[active, None]
        step = np.linalg.solve(a.T @ x[active] + RIDGE * np.eye(x.shape[1]), a.T @ y[active]) - w
        now, size = loss(w), 1.0
        while loss(w + size * step) > now and size > 1e-4:
            size /= 2
        w = w + size * step
        if now - loss(w) < 1e-6 * now:
            break
    return w


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + FLAT * np.eye(len(w)), x.T @ (weight * (y - p)) - FLAT * w)
        w += step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
    return tuple(float(v) for v in w)


def distinct(texts: list[set[str]]) -> list[int]:
    """The places of the texts that share few of their words' least hashes with an earlier one: near copies would count twice."""
    seen: dict[int, set[int]] = {}
    out = []
    for i, words in enumerate(texts):
        low = sorted(xxhash.xxh3_64_intdigest(w) for w in words)[:8]
        near = Counter(j for h in low for j in seen.get(h, ()))
        if not near or near.most_common(1)[0][1] <= len(low) // 2:
            out.append(i)
            for h in low:
                seen.setdefault(h, set()).add(i)
    return out


def enriched(bad: Counter, good: Counter, n_bad: int, n_good: int, clean: list[str]) -> list[str]:
    """Words of toxic texts that are, with all words like them, more frequent there than in clean texts; most telling first."""
    some = sorted((w for w, n in bad.items() if n / n_bad > 3 * good[w] / n_good), key=lambda w: (-bad[w], w))[:NEGATIVES]
    if not some:
        return []
    own = explicit(some, 12)
    often, seldom = np.array([bad[w] for w in some]), np.array([good[w] for w in clean])
    scale = sum(good.values()) / max(1, seldom.sum())
    inside = np.concatenate([(own[i : i + 500] @ own.T) ** SHARP @ often for i in range(0, len(some), 500)]) / n_bad
    outside = sum((own @ explicit(clean[i : i + 500], 12).T) ** SHARP @ seldom[i : i + 500] for i in range(0, len(clean), 500)) * scale / n_good
    tell = inside * np.log(inside / (outside + 0.5 / n_good))
    clear = n_bad / (n_bad + n_good)  # by chance a word of n toxic texts and no clean one has clear ** n, of len(bad) words
    alone = (clear**often * len(bad) < 0.05) & (often / n_bad > 30 * np.array([good[w] for w in some]) / n_good)
    order = [i for i in np.argsort(-tell, kind="stable") if alone[i] or inside[i] > 8 * outside[i] and inside[i] * n_bad > 4]
    return [some[i] for i in order]


def fit(texts: list[set[str]], toxic: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """A model from the distinct words of texts, 0/1 labels and how many texts each stands for."""
    model, rng = Model(), np.random.default_rng(seed)
    use = distinct(texts)
    texts, toxic, weight = [texts[i] for i in use], toxic[use], weight[use]
    part = np.array([i % 4 == 3 for i in range(len(texts))]) if len(texts) >= HELD else np.zeros(len(texts), bool)
    held, held_toxic, held_weight = ([t for t, h in zip(texts, part, strict=True) if h], toxic[part], weight[part]) if part.any() else (texts, toxic, weight)
    texts, toxic = [t for t, h in zip(texts, part, strict=True) if not h], toxic[~part]
    if toxic.all() or not toxic.any() or not held_toxic.any():
        return model
    bad, good = Counter(), Counter()
    for words, label in zip(texts, toxic, strict=True):
        (bad if label else good).update(w for w in words if len(w) >= (SHORTEST if label else 1))
    clean = sorted(good)
    seeds = enriched(bad, good, int(toxic.sum()), int((~toxic).sum()), [clean[i] for i in rng.permutation(len(clean))[:NEGATIVES]])
    if not seeds or not clean:
        return model
    drawn = [clean[i] for i in rng.permutation(len(clean))[:LANDMARKS]]
    marks = explicit(seeds[:LANDMARKS] + drawn)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    use = value > 1e-3
    white = vector[:, use] / np.sqrt(value[use])
    positive = seeds[: 4 * LANDMARKS]
    for turn in range(ROUNDS):
        if turn:
            margin = dict(zip(clean, model.margins(clean).tolist(), strict=True))
            hard = sorted(clean, key=lambda w: (-margin[w], w))[: NEGATIVES // 2]
            own = [sorted(t) for t, label in zip(texts, toxic, strict=True) if label]
            found = Counter(t[int(model.margins(t).argmax())] for t in own if t)
            found = Counter({w: n for w, n in found.items() if bad[w] > 14 and bad[w] / toxic.sum() > 30 * good[w] / (~toxic).sum()})
            positive = sorted({*seeds[: 4 * LANDMARKS], *found})
        else:
            hard = []
        negative = sorted({*hard, *(clean[i] for i in rng.permutation(len(clean))[: NEGATIVES - len(hard)])} - set(positive))
        both = positive + negative
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        w = machine(against(both, marks) @ white, y)
        model = Model(((white @ w[:-1]).astype(np.float32) @ marks).astype(np.float64), float(w[-1]))
    model.link = calibrate(model.signs(held), held_toxic.astype(float), held_weight)
    return model


def train(docs: DataFrame, labels: DataFrame, texts: int = TEXTS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic): at most about `texts` texts of each class, drawn by a hash of the id, and one text of each id."""
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not count.get(0) or not count.get(1):
        return Model()
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    ids = []
    for label in (0, 1):
        part = known.filter((F.col("toxic") == label) & (order < int((1 << 30) * min(1.0, 1.3 * texts / count[label]))))
        ids += [(r["doc_id"], label) for r in part.orderBy(order, "doc_id").limit(texts).collect()]
    drawn = spark.createDataFrame(ids, "doc_id long, toxic int")  # at most 2 * texts rows

    @lean
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(segments(v.as_py())) for v in b.column(2)], pa.list_(pa.string())), b.column(3)], names=["doc_id", "toxic", "words", "turn"])

    @lean
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared: dict[str, str] = {}
        rows = sorted(((d, t, {shared.setdefault(w, w) for w in ws}) for b in batches for d, t, ws in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)), key=lambda r: (r[0], r[1], len(r[2]), sorted(r[2])[:8]))
        shared.clear()
        trim()
        toxic = np.array([t == 1 for _, t, _ in rows], bool)
        used = {0: max(1, int((~toxic).sum())), 1: max(1, int(toxic.sum()))}
        weight = np.array([count[int(t)] / used[int(t)] for t in toxic])
        model = fit([ws for *_, ws in rows], toxic, weight / weight.mean()) if rows else Model()
        rows.clear()
        trim()
        yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.tolist()], pa.list_(pa.float64())), "bias": pa.array([model.bias]), "link": pa.array([model.link and list(model.link)], pa.list_(pa.float64()))})

    told = docs.filter("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text", F.xxhash64("text").alias("turn"))
    told = told.mapInArrow(words, "doc_id long, toxic int, words array<string>, turn long").groupBy("doc_id", "toxic").agg(F.min_by("words", "turn").alias("words"))  # a labelled id may have any number of rows
    made = told.repartition(1).mapInArrow(fitted, "weights array<double>, bias double, link array<double>").collect()  # one task, as its rows are bounded
    return Model(np.array(made[0]["weights"]), made[0]["bias"], made[0]["link"] and tuple(made[0]["link"])) if made else Model()


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, score, predicted) of each row; no shuffle. The model is of constant size."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = sent.value.scores([segments(v.as_py() or "") for v in b.column(b.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.float64()), pa.array((got >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    kinds = dict(df.dtypes)
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, predicted int")


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the query: labels of ids whose CRC-32 modulo 3 is 1 are held out."""
    small_batches(spark)
    return train(docs.select("doc_id", "text"), labels.filter(fold(F.col("doc_id"), 3) != 1))


def op3_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(spark, docs, table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", fold(F.col("doc_id"), 3) == 1), model, keep=("doc_id", "held_out"))
