import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.llm import graph, language, media, mixing, ngram_join, packing, sharding, suffix_dedup, topk, toxicity, urls

from . import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", "s"), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edit(rng, text, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies of many degrees, shared passages, ties, odd and empty texts."""
    rng = random.Random(5)
    base = [words(rng, n) for n in (3, 5, 12, 60, 120, 300, 800)]
    passage = words(rng, 45)
    out = [None, "", "  \n ", "one", "One", "a b c d", "a b c d e", *base, *base]
    out += [edit(rng, b, s) for b in base[2:] for s in (0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08)]
    out += [words(rng, 30) + " " + passage + " " + words(rng, rng.randrange(20)) for _ in range(25)]
    out += [edit(rng, base[4], 0.03) for _ in range(30)] + ["é" * 150, "é" * 150 + "x", "ab" * 300, "z" * 2500, "Ünï " * 80]
    return out


def test_components_are_those_of_brute_force(spark, corpus):
    got = ngram_join.jaccard_components(docs(spark, corpus)).collect()
    want = brute.components([(i, t) for i, t in enumerate(corpus)])
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_components_of_odd_tables(spark):
    clash = spark.createDataFrame([(7, "a b c d e f", 1), (7, "a b c d e f", 2), (None, "a b c d e f", 3), (None, None, 4)], "doc_id long, text string, sig int").withColumn("gram", F.lit(1))
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.jaccard_components(clash).collect())
    assert got == [(-1, 0, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7)]
    assert ngram_join.jaccard_components(docs(spark, [])).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="aAbB é\t\n\x0b.", max_size=60))
def test_shingle_counts(text):
    assert len(ngram_join.shingles(text.encode())) == len(brute.shingles(text))


def test_fragments_cut_the_global_order_into_even_parts():
    rng = np.random.default_rng(8)
    grams = rng.integers(0, 1 << 63, 40_000).astype(np.uint64) * np.uint64(2)
    counts = np.bincount(ngram_join._buckets(grams), minlength=1 << ngram_join.SKETCH_BITS)
    classes = np.minimum(counts, 3).astype(np.int16)
    order = ngram_join.Order(classes, ngram_join.cut(classes, counts))
    own = order.fragment(grams[order.sort(grams)])
    assert (np.diff(own) >= 0).all() and set(own) == set(range(ngram_join.FRAGMENTS))
    assert np.bincount(own).min() > 0.9 * len(grams) / ngram_join.FRAGMENTS and np.bincount(own).max() < 1.1 * len(grams) / ngram_join.FRAGMENTS
    assert ngram_join.Order(classes * 0, ngram_join.cut(classes * 0, counts * 0)).fragment(grams).max() == ngram_join.FRAGMENTS - 1


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (7, 7), (70, 50)]
    got = {r.u: r.v for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 60: 50, 55: 50, 70: 50}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("width", [200, 120])
def test_spans_are_those_of_brute_force(spark, corpus, width):
    rng = random.Random(9)
    passage = words(rng, 60)
    texts = [*corpus, passage, "x " + passage[:199], "y" + passage[:200], "y" + passage[1:201] + "é", passage[3:203], passage + passage, passage[150:] + "q" + passage[:150]]
    got = suffix_dedup.digests(suffix_dedup.repeated_spans(docs(spark, texts), width=width)).collect()
    want = brute.spans(texts, width)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(got, key=lambda r: r.doc_id)] == want


def test_spans_of_odd_tables(spark):
    a = "abc " * 20 + "".join(chr(97 + i % 26) + str(i) for i in range(200))
    rows = [(1, a, "k"), (1, a, "k"), (1, "other", "k"), (None, a[10:], "k"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumns({c: F.lit(0) for c in ("key", "tk", "file", "place", "rest", "z", "k0", "c1")})
    got = suffix_dedup.strip_repeats(df)
    assert got.columns == df.columns and sorted((r.text or "") for r in got.collect()) == ["", "", "", "", "other"]
    assert suffix_dedup.digests(suffix_dedup.repeated_spans(docs(spark, []))).collect() == []


def test_long_texts_in_segments(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 110, 5000).astype(np.uint8)
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    parts = suffix_dedup.anchors(data)
    assert set(whole[0]) == set(parts[0])
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(parts[2], parts[3], strict=True)])
    assert sorted(covered) == list(range(5000 - 199))


def test_top_k_is_that_of_brute_force(spark):
    rng = np.random.default_rng(3)
    made = [(int(i), rng.normal(size=8).tolist()) for i in range(0, 400)]
    made += [(int(i), [0.5] * 8) for i in range(400, 440)] + [(440, None), (441, [None] * 8), (442, [float("nan")] * 8), (None, [1.0] * 8), (443, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    rows = df.filter(F.col("vec_id").isNotNull() & topk.finite(F.col("embedding"))).select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in made[:440]]
    for k, at_once in ((10, 4096), (3, 2), (10, 4), (1000, 4096)):
        got = topk.top_k(rows, rows.filter("vec_id % 100 = 0"), k, at_once)
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == brute.best(ints, k)
    assert topk.top_k(rows.limit(0), rows.limit(0)).collect() == []
    assert topk.top_k(rows, rows.filter("vec_id = 5000")).collect() == []


@pytest.mark.parametrize("power", [12, 17, 20, 24, 30, 40, 62, 70])
def test_top_k_is_exact_for_large_components(spark, power):
    rng = random.Random(power)
    ints = [(i, [rng.randrange(-(2**power), 2**power) for _ in range(16)]) for i in range(0, 300)] + [(300, [2**power - 1] * 16), (301, [-(2**power) + 1] * 16), (302, [])]
    ints = [(i, [max(-(2**63), min(2**63 - 1, x)) for x in v]) for i, v in ints]
    df = spark.createDataFrame(ints, "vec_id long, vector array<long>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id % 100 = 0"), 7).collect()}
    want = set()
    for q, a in ints[::100]:
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in ints if i != q)
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:7])}
    assert got == want


def test_media_round_trip(spark):
    texts = [None, "", "a" * 64, "é" * 33, "x" * 5000, "x" * 5000]
    clash = docs(spark, texts).withColumn("media", F.lit("x"))
    got = sorted(media.media_columns(clash, keep=("doc_id", "lang"), store=True).collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, texts, strict=True):
        data = (t or "").encode()
        padded = data + b"\0" * (64 if not data else -len(data) % 64)
        assert media.from_wav(bytes(r.media)) == padded
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(r.media), hashlib.sha256(r.media).hexdigest())
    assert got[4].feature == got[5].feature and got[0].feature == got[1].feature
    assert media.media_columns(docs(spark, [])).collect() == []
    tone = (128 + 100 * np.sin(np.arange(4096) * 2 * np.pi * 40 / 512)).astype(np.uint8)
    peaks = media.fingerprint(tone)
    low = peaks[(peaks >> 24 & 255) == 0]
    assert len(low) and set((low >> 16 & 255).tolist()) <= {38, 39, 40}


def test_sharding_table():
    names = [f"n{i}" for i in range(10)]
    table = sharding.fill(names, 1009)
    share = np.bincount(table)
    assert share.min() >= 100 and share.max() <= 102
    fewer = sharding.fill(names[:-1], 1009)
    kept = [a == b for a, b in zip(table, fewer, strict=True) if a != 9]
    assert sum(kept) / len(kept) > 0.9
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)
    assert sharding.fill(["a"], 3) == [0, 0, 0]


def test_sharding_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "doc_id long, shard string")
    got = sharding.shard(df, "doc_id", ["x", "y"], 101).collect()
    owner = sharding.fill(["x", "y"], 101)
    assert len(got) == 4 and all(r.shard == owner[r.slot] for r in got)
    assert all(r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 101 for r in got if r.doc_id is not None)
    assert sharding.shard(df.limit(0)).collect() == []


def test_sharding_by_a_column_named_slot_or_shard(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, None, 6)], "slot long, Shard string, other int")
    owner = sharding.fill(["x", "y", "z"], 101)
    for key in ("slot", "Shard"):
        got = sorted(sharding.shard(df, key, ["x", "y", "z"], 101).collect())
        assert len(got) == 3 and all(r.shard == owner[r.slot] for r in got)
        given_ = [str(r[key]) for r in df.collect() if r[key] is not None]
        assert {r.slot for r in got} >= {int(hashlib.md5(v.encode()).hexdigest()[:15], 16) % 101 for v in given_}


def test_table_is_filled_by_turns_in_order_of_preference():
    names, slots = [f"s{i}" for i in range(7)], 53
    order = []
    for s in names:
        at, skip = (int(hashlib.md5(f"{x}:{s}".encode()).hexdigest()[:15], 16) for x in ("offset", "skip"))
        order.append([(at + j * (skip % (slots - 1) + 1)) % slots for j in range(slots)])
    want, turn = {}, 0
    while len(want) < slots:
        want[next(p for p in order[turn % 7] if p not in want)] = turn % 7
        turn += 1
    assert sharding.fill(names, slots) == [want[i] for i in range(slots)] and all(sorted(o) == list(range(slots)) for o in order)


def test_mix_takes_whole_documents_near_the_target(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3000)] + [(9000, None, "a"), (9001, "", "e"), (None, "one two", "a"), (5, "x y", "a"), (5, "x y", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1))
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    total = sum(r.size for r in got)
    size = {s: sum(r.size for r in got if r.source == s) for s in {r.source for r in got}}
    assert size == {s: sum(len(brute.WORD.findall(t or "")) for _, t, x in rows if x == s) for s in {x for *_, x in rows}}
    weight = dict(zip(sorted(s for s in size if s is not None) + [None], [3, 1, 2, 3, 1, 2], strict=True))
    goal, open_, left = {}, set(size), 1.5 * total
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            break
        for s in over:
            goal[s], left = 2 * size[s], left - 2 * size[s]
        open_ -= over
    goal |= {s: weight[s] * level for s in open_}
    for s in size:
        assert all(abs(r.target - goal[s]) < 1e-6 for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - goal[s]) <= 61
    assert mixing.mix(df.limit(0)).collect() == []


def test_piece_ids_are_those_of_the_tokenizers_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = ["", "Hello  world's\n\n ünï \u200b 日本 🎉🎉", "<|endoftext|> x", "a <|endoftext|> b", "x  \n<|endoftext|><|endoftext|>  <|endoftext", "<|endoftext|>", "a" * 3000, words(rng, 3000), "\t\r\n  x  ", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(4000))]
    got = {}
    for r in packing.pieces(docs(spark, [None, *texts])).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate([None, *texts]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(got[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 2048 for r in parts[1:]) and parts[0].length <= 2048
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=9))
def test_packing_is_the_best_for_few_pieces(lengths):
    plan = packing.pack(dict(Counter(lengths)), 10)
    assert sum(n for _, n in plan) == brute.fits(lengths, 10)
    assert Counter(s for f, n in plan for s in f for _ in range(n)) == Counter(lengths) and all(sum(f) <= 10 for f, _ in plan)


def test_search_for_packings_beats_best_fit():
    lengths = Counter([6, 6, 5, 5, 4, 4, 3, 3, 2, 2] * 3)
    assert packing.best_fit(lengths, 20)[1] >= sum(n for _, n in packing.pack(lengths, 20)) == 6
    hard = Counter([11, 11, 9, 9, 8, 8, 7, 7, 5, 5])
    plan = packing.pack(hard, 20)
    assert Counter(s for f, n in plan for s in f for _ in range(n)) == hard and sum(n for _, n in plan) == brute.fits(list(hard.elements()), 20)
    assert sum(n for _, n in packing.pack(hard, 20, 0)) == packing.best_fit(hard, 20)[1]
    assert packing.pack({}, 20) == []


def test_packing_of_many_equal_rows_without_ids(spark):
    df = spark.range(3000).selectExpr("CAST(NULL AS long) AS doc_id", "IF(id % 3 = 0, 'one two', NULL) AS text", "id AS piece", "'x' AS sequence_id", "1 AS _part")
    got = packing.pack_documents(df).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) == 3000 and len({r.sequence_id for r in got}) == -(-5000 // 2048) and got[0].doc_id is None


def test_packing_rows(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(0, 400)) for _ in range(300)] + ["same text"] * 50 + [words(rng, 3000), None]
    df = docs(spark, texts)
    got = packing.pack_documents(df.unionByName(df.filter("doc_id < 3"))).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))] and sum(r.length for r in rows) <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1 and {r.doc_id for r in got} == set(range(len(texts)))
    assert packing.pack_documents(df.limit(0)).collect() == []


def test_language(spark):
    rng = random.Random(6)
    parts = {"de": ["sch", "ung", "keit", "ein"], "en": ["tion", "the", "ing", "and"], "fr": ["eau", "que", "ment", "ouè"]}

    def text(lang):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(40))

    rows = [(i, text(lang), lang) for i in range(90) for lang in [rng.choice(list(parts))]] + [(100, None, "de"), (101, "123 ...", "de"), (102, text("fr"), None), (None, text("en"), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = language.train(df.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("doc_id").alias("order"), "text", "lang"))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i is not None and i < 100) and got[102].lang_pred == "fr"
    assert (got[100].lang_pred, got[101].lang_pred) == ("und", "und") and all(0 <= r.score <= 1 for r in got.values())
    none = language.train(df.limit(0).select(F.xxhash64("doc_id").alias("order"), "text", "lang"))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}


def test_language_learns_all_languages_from_odd_rows(spark):
    rng = random.Random(16)
    codes = [f"l{i:02}" for i in range(80)]
    sound = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)] for c in codes}
    text = lambda c, n=40: " ".join("".join(rng.choice(sound[c]) for _ in range(3)) for _ in range(n))
    rows = [(None if i % 2 else i, text(c), c) for c in codes for i in range(12)] + [(5, text("l05"), "l05")] * 30
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string").select(F.xxhash64("doc_id", "text").alias("order"), "text", "lang")
    model = language.train(known)
    assert model.languages == codes
    asked = [text(c) for c in codes] + ["½ ² Ⅷ 12", "", text("l07", 60_000), "٣", "ª"]
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in enumerate(asked)], "doc_id long, text string, lang_pred string, score double")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(df, model).collect()]
    said = {i: (p, s) for i, p, s in got}
    assert sum(said[i][0] == c for i, c in enumerate(codes)) >= 78 and said[82][0] == "l07"
    assert said[80] == said[81] == said[83] == ("und", 0.0) and said[84][0] != "und"


def _last(gram):
    """The bucket of a whole gram: what its own grams have and those of its parts have not."""
    parts = Counter()
    for part in (gram[:-1], gram[1:]) if len(gram) > 1 else ():
        parts.update(dict(zip(*(x.tolist() for x in language.grams(part)), strict=True)))
    inner = Counter(dict(zip(*(x.tolist() for x in language.grams(gram[1:-1])), strict=True))) if len(gram) > 2 else Counter()
    whole = Counter(dict(zip(*(x.tolist() for x in language.grams(gram)), strict=True)))
    parts.subtract(inner)
    whole.subtract(parts)
    return +whole


def test_language_probabilities_are_those_of_the_plain_formula():
    rng = np.random.default_rng(3)
    model = language.Model(["a", "b", "c"], rng.normal(size=(3, 1 << language.BITS)), rng.uniform(1, 5, 1 << language.BITS), 0.7)
    text = "Über den Wolken, ab ab!"
    counts = Counter(int(k) for n in language.ORDERS for i in range(len(text) - n + 1) for k in _last(text.lower()[i : i + n]))
    at, count = language.grams(text)
    assert dict(zip(at.tolist(), count.tolist(), strict=True)) == counts
    x = {int(k): np.log1p(c) * model.idf[k] for k, c in zip(at, count, strict=True)}
    length = sum(v * v for v in x.values()) ** 0.5
    z = [sum(w[k] * v / length for k, v in x.items()) / 0.7 for w in model.weights]
    p = np.exp(z) / np.exp(z).sum()
    got = model.predict(text)
    assert got[0] == "abc"[int(p.argmax())] and abs(got[1] - p.max()) < 1e-9


def test_leader_is_that_of_the_plain_rule():
    """Two coordinates followed by hand: z gathers gradients less the proximal term, weights come from z and n alone."""
    rng = random.Random(2)
    rows = [(rng.randrange(2), np.array([0, 1]), np.array([rng.randrange(1, 9), rng.randrange(1, 9)])) for _ in range(4)]
    idf = np.ones(2)
    model = language.fit(rows, ["a", "b"], idf)
    z, n = [[0.0, 0.0], [0.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]]

    def weight(c, j):
        v = z[c][j]
        return 0.0 if abs(v) <= language.L1 else -(v - np.sign(v) * language.L1) / ((language.BETA + n[c][j] ** 0.5) / language.ALPHA + language.L2)

    for _ in range(language.PASSES):
        for label, _, count in rows[1:]:
            x = np.log1p(count) / np.sqrt((np.log1p(count) ** 2).sum())
            w = [[weight(c, j) for j in range(2)] for c in range(2)]
            e = np.exp([w[c][0] * x[0] + w[c][1] * x[1] for c in range(2)])
            for c in range(2):
                for j in range(2):
                    g = (e[c] / e.sum() - (c == label)) * x[j]
                    z[c][j] += g - ((n[c][j] + g * g) ** 0.5 - n[c][j] ** 0.5) / language.ALPHA * w[c][j]
                    n[c][j] += g * g
    assert np.allclose(model.weights, [[weight(c, j) for j in range(2)] for c in range(2)])


def test_toxicity(spark):
    rng = random.Random(8)
    syllables = ["the", "an", "er", "tion", "ou", "re", "st"]

    def text(bad):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(80)]
        for _ in range(3 * bad):
            w[rng.randrange(80)] = rng.choice(["zizzkop", "blurgh", "vlokkie"]) + rng.choice(["", "s", "en"])
        return " ".join(w)

    rows = [(i, text(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, text(False) + " b l u r g h vlokkies"), (1003, text(False) + " zizz.kop blu-rgh")], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    wrong = [i for i, _ in rows if got[i].predicted != int(i % 3 == 0)]
    assert len(wrong) <= 6 and got[1000].score == got[1001].score and got[1000].predicted == 0
    assert got[1002].score > 0.5 and got[1003].score > 0.5
    assert {r.score for r in toxicity.score(df, toxicity.train(df.select("doc_id", "text"), labels.limit(0))).collect()} == {0.0}
    assert toxicity.segments("A, b! (id.iot) i d i o t ") >= {"a", "b", "id.iot", "idiot"}


def test_kernel_norms_agree():
    words_ = ["banana", "abcabc", "xy", "rrrrrr", "ok"]
    at, bucket, weight, cheap = toxicity.subsequences(words_)
    exact = toxicity.norms(len(words_), at, bucket, weight)
    assert (exact >= cheap - 1e-9).all()
    dense = toxicity.explicit(words_)
    assert np.allclose(toxicity.against(words_, dense).diagonal()[[0, 1, 3]], 1, atol=1e-5)


def test_kernel_against_counting_subsequences():
    """The kernel by its definition: all index triples within the span, discounted by their extent, hashed nowhere."""
    def counted(w):
        out = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    words_ = ["idiot", "id.iot", "ixdxixoxt", "banana", "rrrrrr", "überzählig", "blurghs"]
    maps = [counted(w) for w in words_]
    dot = lambda a, b: sum(v * b.get(k, 0) for k, v in a.items())
    want = np.array([[dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 for b in maps] for a in maps])
    assert np.allclose(toxicity.against(words_, toxicity.explicit(words_)), want, atol=1e-4) and want[0, 1] > 0.4 > want[0, 3]


def test_toxicity_learns_one_text_of_a_labelled_id(spark):
    """Bulk rows of one labelled id teach as one of them does."""
    rng = random.Random(3)
    rows = [(i, " ".join(["blurgh" if i % 2 else "the", *("".join(rng.choices("aeioustr", k=6)) for _ in range(12))])) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    once = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    bulk = toxicity.train(spark.createDataFrame(rows + [rows[1]] * 3000 + [(1, None)] * 5, "doc_id long, text string"), labels)
    assert np.array_equal(once.weights, bulk.weights) and (once.bias, once.link) == (bulk.bias, bulk.link) and once.weights.any()


def rule(host, path):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    fit = [(len(r), v, r) for v, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fit)[1:] if fit else (None, None)


def test_urls(spark):
    given_ = ["http://A.Example.COM/en/7x?q", "https://b.com/en/", "x.net/de/", None, "http://net/de/8", "https://a.example.net/de/81#f", "ftp://q.ORG/es/", "http://notcom/en/", "a://b://c/d", "http://host?x=/en/", "http://h#/en/"] + [f"http://s{i}.example.com/fr/{i}" for i in range(20)]
    df = spark.createDataFrame([(i, u, "<p>word other</p>") for i, u in enumerate(given_)], "page_id long, url string, html string").withColumn("host", F.lit(1))
    for r in urls.filter_urls(df).collect():
        u = given_[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        assert (r.host, r.path) == (host, path)
        verdict, name = rule(host, path)
        assert r.rule == name and r.verdict in ((verdict,) if verdict else ("allow", "block"))
    assert urls.filter_urls(df.limit(0)).collect() == []


def test_words_are_split_at_the_least_cost():
    m = urls.Model({"free": 3.0, "casino": 4.0, "fr": 6.0, "ee": 6.0})
    assert m.split("freecasino") == ["free", "casino"] and m.split("xfree") == ["x", "free"] and m.split("") == []
    assert m.tokens("free-casino.example.com", "/Free/12")[:2] == ["h:free", "h:casino"] and "p:#2" in m.tokens("", "/12")


def test_concatenated_hosts_are_split_and_judged_by_their_words(spark):
    rows = [(i, f"http://{w}-x.com/en/{i}", "<p>free casino money garden flower</p>") for i, w in enumerate(["free", "casino"] * 20)]
    rows += [(100 + i, f"http://s{i}.example.com/en/7{i}", "<p>garden flower seeds</p>") for i in range(40)]
    rows += [(200, "http://freecasino.io/a", None), (201, "http://freecasino.io/a", "&copy; freecasino.io http://freecasino.io/"), (202, "http://gardenflower.io/a", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    tokens = {r.host: r.tokens for r in urls.tokenised(urls.ruled(urls.parts(df))).collect()}
    assert tokens["freecasino.io"][:2] == ["h:free", "h:casino"] and tokens["gardenflower.io"][:2] == ["h:garden", "h:flower"]
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert len(got) == len(rows) and got[200].score == got[201].score > got[202].score and got[200].verdict == "block"


def test_long_and_foreign_names_are_split(spark):
    long = "free" * 1500 + "casino"
    rows = [(1, f"http://{long}.com/", "<p>free casino</p>"), (2, "http://MÜNCHENstraße.de/Grüße", "<p>münchen straße und grüße</p>"), (None, None, None), (None, "http://x.com/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    tokens = {r.host: r.tokens for r in urls.tokenised(urls.ruled(urls.parts(df))).collect()}
    assert tokens[f"{long}.com"] == ["h:free"] * 1500 + ["h:casino", "h:com"]
    assert tokens["mÜnchenstraße.de"][:2] == ["h:münchen", "h:straße"] and tokens["mÜnchenstraße.de"][3] == "p:grüße"
    odd = df.withColumns({"verdict": F.lit("x"), "score": F.lit("x"), "at": F.lit(1), "n": F.lit(2), "name": F.lit("x"), "known": F.lit("x")})
    got = urls.filter_urls(odd).collect()
    assert sorted(r.host for r in got) == ["", f"{long}.com", "mÜnchenstraße.de", "x.com"] and {r.verdict for r in got} == {"allow"}


def test_verdicts_are_those_of_plain_naive_bayes(spark):
    """Every step written plainly: words counted over all pages, names split by trying all splits, shares with one added."""
    rng = random.Random(21)
    bad, good = ["casino", "poker", "bet"], ["garden", "rose", "soil"]
    rows = []
    for i in range(60):
        w = bad if i % 2 else good
        host = f"{rng.choice(w)}-{rng.choice(w)}.com" if i % 2 else f"{rng.choice(w)}-{i}.example.com"
        rows.append((i, f"http://{host}/{'en' if i % 2 else 'en/7'}/{rng.choice(w)}", f"<p>{' '.join(rng.choice(w) for _ in range(5))}</p>"))
    rows += [(100 + i, f"http://{a}{b}.io/{c}", None) for i, (a, b, c) in enumerate((rng.choice(x), rng.choice(x), rng.choice(x)) for x in [bad, good] * 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    count = Counter()
    for _, u, h in rows:
        host, _, path = u.removeprefix("http://").partition("/")
        count.update(re.findall("[a-z]+", re.sub("<[^>]*>", " ", h or "")))
        for part in [*host.split("."), *path.split("/")]:
            count.update(x for x in part.split("-") if "-" in part and not x.isdigit())
        count[host.rsplit(".", 1)[1]] += 1
    total = sum(count.values())
    unknown = max(12.0, np.log(total / min(count.values())))

    def split(name):
        best = {0: (0.0, [])}
        for j in range(1, len(name) + 1):
            best[j] = min(((best[i][0] + (np.log(total / count[name[i:j]]) if name[i:j] in count else unknown * (j - i)), [*best[i][1], name[i:j]]) for i in range(j)), key=lambda x: x[0])
        return best[len(name)][1]

    seen, said = {}, {"block": Counter(), "allow": Counter()}
    number = Counter()
    for i, u, _ in rows:
        host, _, path = u.removeprefix("http://").partition("/")
        seen[i] = [f"{m}#{len(x)}" if x.isdigit() else m + w for m, t in (("h:", host), ("p:", path)) for x in re.findall("[a-z0-9]+", t) for w in ([x] if x.isdigit() else split(x))]
        verdict = rule(host, "/" + path)[0]
        if verdict:
            said[verdict].update(seen[i])
            number[verdict] += 1
    both = set(said["block"]) | set(said["allow"])
    share = lambda t, v: (said[v][t] + 1) / (sum(said[v].values()) + len(both))
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    for i, u, _ in rows:
        want = np.log((number["block"] + 1) / (number["allow"] + 1)) + sum(np.log(share(t, "block") / share(t, "allow")) for t in seen[i] if t in both)
        assert abs(got[i].score - want) < 1e-9
        if i >= 100:
            assert got[i].verdict == ("block" if want > 0 else "allow") == ("block" if i % 2 == 0 else "allow")


def test_all_words_count_however_many(spark, monkeypatch):
    many = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(40_000))
    df = spark.createDataFrame([(0, "http://zyxwvutsrq.com/", f"<p>{many} {many} zyxwv utsrq</p>")], "page_id long, url string, html string")
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 1)
    assert urls.tokenised(urls.ruled(urls.parts(df))).first().tokens == ["h:zyxwv", "h:utsrq", "h:com"]


def test_spans_do_not_fill_overlaps():
    owner, start, end = suffix_dedup.covered(np.array([1, 0, 0, 1, 0, 3]), np.array([5, 10, 0, 1, 12, 4]), np.array([9, 20, 5, 5, 15, 4]))
    assert (owner.tolist(), start.tolist(), end.tolist()) == ([0, 0, 1], [0, 10, 1], [5, 20, 9])
    assert all(len(x) == 0 for x in suffix_dedup.covered(*(np.zeros(0, np.int64),) * 3))


def test_segments_do_not_change_anchors(monkeypatch):
    data = np.random.default_rng(2).integers(97, 110, 5000).astype(np.uint8)
    whole = suffix_dedup.anchors(data)
    for size in (1, 151, 700):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", size)
        assert all((a == b).all() for a, b in zip(whole, suffix_dedup.anchors(data), strict=True))
    assert all(len(x) == 0 for x in suffix_dedup.anchors(data[:199]))


def test_spans_over_a_segments_end(spark):
    rng = np.random.default_rng(4)
    long = rng.integers(97, 123, 2 * suffix_dedup.SEGMENT + 5000).astype(np.uint8).tobytes().decode()
    at = suffix_dedup.SEGMENT - 150
    other = "#" + long[at : at + 300] + "#"
    got = {r.doc_id: r for r in suffix_dedup.digests(suffix_dedup.repeated_spans(docs(spark, [long, other, long[:-199][::-1]]))).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in range(3)] == [(300, 1), (300, 1), (0, 0)]
    assert got[0].kept_sha256 == hashlib.sha256((long[:at] + long[at + 300 :]).encode()).hexdigest()


def test_spans_of_repeated_rows_are_those_of_brute_force(spark, corpus):
    rng = random.Random(11)
    texts = [words(rng, n) for n in (37, 40, 45, 90)] + ["é" * 150]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(None, texts[2]), (None, texts[3]), (None, "x" + texts[3][:-1]), (50, words(rng, 50)), (50, words(rng, 60))]
    got = suffix_dedup.digests(suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = [(i, *x) for (i, _), x in zip(rows, brute.spans([t for _, t in rows], 200), strict=True)]
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(doc_id=i, n_bytes=a, n_removed=b, n_spans=c, kept_sha256=d) for i, a, b, c, d in want]))


def test_short_and_last_samples_reach_the_feature(spark):
    rng = random.Random(12)
    texts = [words(rng, n) for n in range(1, 60) for _ in range(3)]
    long = words(rng, 400)
    long = long[: len(long) // 256 * 256 + 190]
    texts += [long, long[:-60] + "".join(rng.choice("xyz !?") for _ in range(60))]
    got = media.media_columns(docs(spark, texts), store=True).collect()
    assert len({r.feature for r in got}) == len(set(texts)) and all(r.peaks for r in got)
    ends = [np.full(n, 128, np.uint8) for n in (64, 704, 1024) for _ in range(2)]
    for quiet, heard in zip(ends[::2], ends[1::2], strict=True):
        heard[-32:] = np.arange(32) * 7 % 251
        assert media.fingerprint(quiet).tolist() != media.fingerprint(heard).tolist()


def test_short_hosts_leave_the_prose_whole():
    assert urls.words("e", "", "<p>the tree here e</p>") == ["the", "tree", "here"]
    assert urls.words("de", "", "model index, de.") == ["model", "index"]
    assert urls.words("rivernorth.io", "", "see rivernorth.io now, rivernorth.io") == ["see", "now", "io"]
