"""The pipeline's stages against brute force on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillmesh.llm import ngram_join, mixing

from . import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    passage = words(60)
    texts = [words(rng.randrange(5, 90)) for _ in range(120)]
    texts += [t + " end" for t in texts[:10] if len(t.split()) > 30] + texts[:5] + [words(20) + " " + passage + " " + words(20) for _ in range(4)]
    bad = ["zizzkop", "blurgh", "vlokkie"]
    toxic = [" ".join([*words(30).split(), *rng.sample(bad, 2)]) for _ in range(90)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts + toxic)] + [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    at = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, DOC).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i >= len(texts))) for i in range(len(texts) + len(toxic))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, len(texts)


def test_stages(spark, folder):
    at, clean = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    a = P.stash(P.toxicity(spark, docs, at))
    ids = {r.doc_id for r in a.collect()}
    assert a.columns == columns and ids >= {900, 901} and len([i for i in range(clean) if i not in ids]) <= 2 and len([i for i in ids if clean <= i < 900]) <= 5
    rows = {r.doc_id: r.text for r in a.collect()}
    b = P.stash(P.near_duplicates(spark, a, at))
    want = {i for i, (_, root) in brute.components(list(rows.items())).items() if root == i}
    assert b.columns == columns and {r.doc_id for r in b.collect()} == want
    c = P.stash(P.repeated_passages(spark, b, at))
    before, after = {r.doc_id: r.text for r in b.collect()}, {r.doc_id: r for r in c.collect()}
    assert c.columns == columns and set(after) == set(before)
    for i, (_, removed, _, _) in zip(before, brute.spans(list(before.values()), 200), strict=True):
        assert len((before[i] or "").encode()) - removed == len((after[i].text or "").encode()) and after[i].n_chars == (None if after[i].text is None else len(after[i].text))
    d = P.stash(P.mixture(spark, c, at))
    assert d.columns == columns and {r["count"] for r in d.groupBy("doc_id").count().collect()} <= {1, 2}
    total = lambda df: df.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert abs(total(d) / total(c.filter("text <> ''")) - 1.5) < 0.1
    e = P.packing(spark, d, at)
    assert {r.doc_id for r in e.collect()} == {r.doc_id for r in d.collect()}


def test_run(spark, folder):
    got = P.run(spark, folder[0])
    assert got.count() > 0 and set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_stages_of_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOC)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in P.STAGES:
        docs = P.stash(stage(spark, docs, str(tmp_path)))
    assert docs.count() == 0


def test_repeated_rows_and_null_ids_stay_once(spark):
    rng = random.Random(7)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, a), (1, a), (None, a), (2, b), (None, b), (None, c), (None, c), (None, c + " end"), (7, d), (7, "other words that are few"), (3, ""), (3, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)
    got = P.stash(P.near_duplicates(spark, docs, ""))
    texts = sorted((r.doc_id or -1, r.text or "") for r in got.collect())
    assert got.columns == docs.columns and len(texts) == 8
    assert [x for x in texts if x[0] > 0] == [(1, a), (2, b), (3, ""), (7, "other words that are few"), (7, d)]
    assert [x[1] for x in texts if x[0] < 0][:2] == ["", ""] and texts[2][1] in (c, c + " end")
    cut = P.stash(P.repeated_passages(spark, got, ""))
    assert sorted((r.doc_id or -1, r.text or "") for r in cut.collect()) == texts
    assert {r.doc_id for r in P.mixture(spark, cut, "").collect()} >= {1, 2, 7}


EXTRA = {"key": "k", "tk": "t", "score": "s", "predicted": "p", "_times": "x", "copy": "c", "file": "f", "place": "q", "size": "z", "_copy": "y"}


def test_repeated_ids_bulk_null_ids_and_clashing_columns(spark, tmp_path):
    """All stages on a table that is written once and holds rows with one id, equal rows without an id, very long texts and every name used inside."""
    rng = random.Random(17)
    text = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    a, b, long = text(50), text(50), text(60_000)
    rows = [(5, a, "s"), (5, b, "s"), (3, a, "s"), (8, long, "t"), (None, long + " end", "t"), (9, None, None), (9, None, None)]
    rows += [(None, None, "s")] * 3 + [(100 + i, text(20), rng.choice(["s", "t", None])) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC).withColumns({c: F.lit(v) for c, v in EXTRA.items()})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = P.stash(P.toxicity(spark, docs, str(tmp_path)))
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    once = P.stash(P.near_duplicates(spark, kept, ""))
    got = [(r.doc_id, r.text) for r in once.collect()]
    assert once.columns == docs.columns and all(r[c] == v for r in once.collect() for c, v in EXTRA.items())
    want = [(5, b), (3, a), (8, long), (9, None)] + [(None, None)] * 3 + [(i, t) for i, t, _ in rows if i and i >= 100]
    assert sorted(got, key=str) == sorted(want, key=str)
    cut = P.stash(P.repeated_passages(spark, once, ""))
    assert cut.columns == docs.columns and sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted(want, key=str)
    last = P.mixture(spark, cut, "")
    assert last.columns == docs.columns and all(r[c] == v for r in last.collect() for c, v in EXTRA.items())


def test_mixture_takes_equal_rows_as_often_as_the_operator(spark):
    rows = [(None, "one two three", "a")] * 100 + [(7, "four five", "b")] * 31 + [(i, f"w{i} x y", "a") for i in range(50)] + [(None, f"z{i} x", "b") for i in range(40)] + [(None, "u v", None)] * 9
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOC)
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    got = P.stash(P.mixture(spark, docs, "")).collect()
    have = {}
    for r in got:
        have[r.source] = have.get(r.source, 0) + len(r.text.split())
    assert have == {s: n for s, n in want.items() if n}
    count = {}
    for r in got:
        count[(r.doc_id, r.text)] = count.get((r.doc_id, r.text), 0) + 1
    assert all(n <= 2 * rows.count((i, t, s)) for (i, t), n in count.items() for s in {x for y, z, x in rows if (y, z) == (i, t)})


def test_one_id_with_two_texts_links_each_by_its_own(spark):
    """Two rows of one id with different texts: what is near one of them isn't linked with what is near the other, though it quotes it."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a, b = [word() for _ in range(300)], [word() for _ in range(300)]
    near_a, near_b = [*a[:-3], word(), word(), word()], [*b[:-9], *a[40:49]]
    for other in (8, 5):
        rows = [(5, " ".join(a)), (other, " ".join(b)), (6, " ".join(near_a)), (7, " ".join(near_b))]
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows] * 2, DOC)
        got = P.near_duplicates(spark, docs, "").collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted([(5, rows[0][1]), (min(other, 7), rows[1][1] if other == 5 else rows[3][1])])
        of = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
        assert {(i, c) for i, _, c in of} == {(5, 5), (6, 5), (7, min(other, 7)), (other, min(other, 7))}
