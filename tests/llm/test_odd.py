"""All operators on tables with nulls in every column, empty and very long texts, ties, repeated rows and clashing names, and on empty ones."""

import random
import zlib
from collections import Counter
from itertools import pairwise

import duckdb
import pytest

from quillmesh.llm import catalogue

from . import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASH = ("score", "predicted", "held_out", "key", "file", "place", "size", "rank", "slot", "shard", "length", "offset", "n_bytes", "gram", "id", "_text", "c0", "k0", "source_size")
WORDS = ["the", "river", "north", "blurghsen", "stone", "ou", "zizzkop", "ñandú", "été", "x"]


def rows():
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    out = [(i, say(rng.randrange(1, 120)), ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], 5) for i in range(60)]
    out += [out[3]] * 3 + [(None, out[4][1], None, None, None)] * 2 + [(None, None, None, None, None)] * 2 + [(70, None, "en", "a", None), (71, "", "en", "a", 0), (72, " \t\n", None, "b", 3)]
    out += [(80, say(150_000), "en", "a", 1), (81, "y" * 300_000, "de", "b", 1), (82, "½ ² 123", "en", "a", 1), (83, "a\0b \x1f c", None, None, None)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(*r, *[7] * len(CLASH)) for r in rows()], f"{DOC}, " + ", ".join(f"`{c}` int" for c in CLASH)).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i % 2)) for i in range(60)] + [(3, None, None), (None, 1, 1), (3, 1, 1), (3, 1, 1)]
    spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, toxic int, text int").write.parquet(f"{at}/labels.parquet")
    pages = [(i, f"https://{h}/en/{i}?q", f"<p>river north stone {i}</p>") for i, h in enumerate(["www.rivernorth.com", "EXAMPLE.com", "x.net", "y.org", "rivernorth.io"] * 4)]
    pages += [pages[0], (None, None, None), (None, "no scheme", None), (5, "http://", ""), (6, "a://" + "river" * 5_000 + ".io/" + "p" * 5_000, "<p>" + "river stone " * 20_000), (6, "://x", None), (7, "z://été.org/ñ", "<")]
    spark.createDataFrame([(*p, "h", 1, 2, 3) for p in pages], "page_id long, url string, html string, host string, rule int, n int, name int").write.parquet(f"{at}/pages.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [float(i % 3), 0.5, -1.0]) for i in range(0, 400, 25)] + [(1, None), (2, [None, 1.0, 1.0]), (3, [nan, 0.0, 0.0]), (4, [inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (100, [1.0, 0.5, -1.0]), (5, [])]
    spark.createDataFrame([(*v, 1, 2, 3) for v in vectors], "vec_id long, embedding array<float>, score int, rank int, query_id int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("nothing"))
    for name, schema in (("documents", DOC), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>"), ("clicks", "click_id long, client_id long, ts timestamp_ntz"), ("sales", "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int")):
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_empty_tables_give_no_rows(spark, nothing, name):
    assert catalogue.queries()[name](spark, nothing).collect() == []


def taken(spark, at, name):
    return catalogue.queries()[name](spark, at).collect()


def same_ids(got):
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())


def test_languages(spark, folder):
    got = taken(spark, folder, "op1_language_id")
    same_ids(got)
    of = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 for r in got) and {of[i].lang_pred for i in (70, 71, 72, 82)} == {"und"}
    assert {r.lang_pred for r in got} <= {"en", "de", "und"} and len({(r.lang_pred, r.score) for r in got if r.doc_id == 3}) == 1
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_urls(spark, folder):
    got = taken(spark, folder, "op2_url_filter")
    assert len(got) == 27 and {r.verdict for r in got} <= {"allow", "block"}
    of = {(r.page_id, r.host[:9]): r for r in got}
    assert of[None, ""].path == "" and of[5, ""].path == "" and of[1, "example.c"].rule == "com/en/" and of[7, "été.org"].path == "/ñ"
    assert {r.verdict for r in got if r.page_id == 0} == {"block"}


def test_toxicity(spark, folder):
    got = taken(spark, folder, "op3_string_kernel_toxicity")
    same_ids(got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and len({r.score for r in got if r.doc_id in (70, 71, 72)}) == 1
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_mix(spark, folder):
    got = taken(spark, folder, "op4_pivotal_mixing")
    same_ids(got)
    sizes = {r[0]: len(brute.WORD.findall(r[1] or "")) for r in rows() if r[0] is not None}
    assert all(r.size == sizes[r.doc_id] and r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size for r in got if r.doc_id is not None)
    assert sorted(map(str, got)) == sorted(map(str, taken(spark, folder, "op4_pivotal_mixing")))


def test_top_k(spark, folder):
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in taken(spark, folder, "op5_exact_topk")}
    assert {q for q, *_ in got} == {0, 100, 200, 300} and not {v for _, _, v, _ in got} & {1, 2, 3, 4, None}
    assert all(sorted(r for q, r, *_ in got if q == k) == list(range(1, 11)) for k in (0, 100, 200, 300))


def test_components(spark, folder):
    got = taken(spark, folder, "op6_ngram_jaccard")
    same_ids(got)
    # A row without an id is known to its group by that of the copy that has one.
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None and r.n_shingles) == [(len(brute.shingles(rows()[4][1])), 4)] * 2
    want = brute.components([(r[0], r[1]) for r in {r[0]: r for r in rows() if r[0] is not None}.values()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want


def test_media(spark, folder):
    got = taken(spark, folder, "op7_media_columns")
    same_ids(got)
    text = {r[0]: (r[1] or "").encode() for r in rows() if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            padded = text[r.doc_id].ljust(max(64, -(-len(text[r.doc_id]) // 64) * 64), b"\0")
            assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(text[r.doc_id]), len(padded), zlib.crc32(padded[-64:]))
    assert len({r.feature for r in got if r.doc_id in (70, 71)}) == 1


def test_packing(spark, folder):
    got = taken(spark, folder, "op8_bin_completion")
    assert {r.doc_id for r in got} == {r[0] for r in rows()} and max(r.length for r in got) <= 2048
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in rows())
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for spans in filled.values():
        assert min(spans)[0] == 0 and all(a[1] == b[0] for a, b in pairwise(sorted(spans))) and max(spans)[1] <= 2048


def test_shards(spark, folder):
    got = taken(spark, folder, "op9_lookup_sharding")
    same_ids(got)
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and all(0 <= r.shard < 64 for r in got)


def told(made):
    """brute.spans, with ids."""
    return Counter((r[0], n, removed, runs, sha) for r, (n, removed, runs, sha) in zip(made, brute.spans([r[1] for r in made], 200), strict=True))


def test_repeats(spark, folder):
    got = taken(spark, folder, "op10_suffix_dedup")
    same_ids(got)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == told(rows())


def test_sql_of_repeats():
    short = [r for r in rows() if len(r[1] or "") < 5_000] + [(90, "ab" * 300, None, None, None), (91, "é" * 150, None, None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in short])
    got = con.execute(f"SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM ({catalogue.oracle_sql()['op10_suffix_dedup']})").fetchall()
    assert Counter(got) == told(short)
