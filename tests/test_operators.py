from pyspark.sql import functions as F

from quillmesh.operators import chunk, facts, graph, resolve, search
from quillmesh.sources import html
from quillmesh.streaming import incremental, worklog


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_sections(spark):
    got = one(spark, chunk.sections(F.col("x")), "intro\n# A\nbody a\n## B\n\n### C\nbody c")
    assert [tuple(s) for s in got] == [("", "intro"), ("A", "body a"), ("C", "body c")]
    assert [tuple(s) for s in one(spark, chunk.sections(F.col("x")), "plain")] == [("", "plain")]
    assert one(spark, chunk.sections(F.col("x")), "  ") == []


def split(text, size):
    """The rule written plainly."""
    if len(text) <= size:
        return [text] if text else []
    out, now = [], ""
    for p in (p.strip() for p in text.split("\n\n")):
        if now and len(now) + len(p) + 2 <= size:
            now += "\n\n" + p
        elif not now and len(p) <= size:
            now = p
        else:
            out += [now] if now else []
            out, now = (out + [p[i : i + size] for i in range(0, len(p), size)], "") if len(p) > size else (out, p)
    return out + ([now] if now else [])


def test_size_split(spark):
    for lengths in ([1499], [1500], [1501], [700, 700, 200], [1600, 10], [10, 1600, 10], [749, 749], [749, 750], []):
        text = "\n\n".join(chr(97 + i) * n for i, n in enumerate(lengths))
        assert one(spark, chunk.split_large(F.col("x")), text) == split(text, 1500), lengths


def test_chunks_use_properties_without_a_body(spark):
    rows = [("s", "o1", "n", "t", " ", [("wiki_facts", "f"), ("other", "x"), ("wiki_summary", "s")]), ("s", "o2", "n", "t", "body", [("wiki_facts", "f")])]
    df = spark.createDataFrame(rows, "space_id string, id string, name string, type_key string, markdown string, properties array<struct<key:string,text:string>>")
    assert sorted((r.object_id, r.heading, r.text) for r in chunk.chunks(df).collect()) == [("o1", "Facts", "f"), ("o1", "Summary", "s"), ("o2", "", "body")]


def corpus(spark, rows):
    return spark.createDataFrame([(i, f"p{i}", o, n, "", x, "t") for i, (o, n, x) in enumerate(rows)], "row long, point_id string, object_id string, object_name string, heading string, text string, type_key string")


def test_hybrid_bands_entrants_and_gate(spark):
    rows = [("o1", "Mestre Pastinha (Salvador)", "words here"), ("o1", "Mestre Pastinha (Salvador)", "more pastinha"), ("o2", "Pastinha School", "pastinha pastinha"), ("o3", "Other", "nothing")] + [(f"f{i}", f"filler {i}", f"filler text {i}") for i in range(12)]
    chunks = corpus(spark, rows)
    dense = spark.createDataFrame([("p3", 1), ("p2", 2)], "point_id string, rank int")
    got = search.hybrid_rank(chunks, "Pastinha", dense, 10).orderBy("rank").collect()
    assert got[0].object_id == "o1" and got[0].tier == 1 and got[0].score > 2.5
    assert [r.object_id for r in got if r.tier == 1].count("o1") == 2 and sum(r.score > 2.5 for r in got) == 1
    assert [r.point_id for r in got if r.tier == 2] == ["p2"]
    assert got[-1].point_id == "p3"
    dated = search.hybrid_rank(chunks, "Pastinha", dense, 10, search.Filters(after="2024-01-01")).collect()
    assert {r.point_id for r in dated} == {"p3", "p2"}
    none = search.hybrid_rank(chunks, "Pastinha", dense, 10, search.Filters(types=("x",))).collect()
    assert {r.point_id for r in none} == {"p3", "p2"}


def test_half_frequent_terms_score_nothing(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "c"]), (2, ["d"]), (3, ["e"])], "id int, w array<string>")
    assert search.bm25(df, "id", F.col("w"), ["a"]).collect() == []
    assert [r.id for r in search.bm25(df, "id", F.col("w"), ["b", "d"]).orderBy(F.desc("score"), "id").collect()] == [2, 0]
    assert search.bm25(df, "id", F.col("w"), []).collect() == []


def test_fuse_is_symmetric_but_for_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    ab = {r.id: (round(r.rrf, 9), r.first_list) for r in search.fuse([a, b], "id").collect()}
    ba = {r.id: round(r.rrf, 9) for r in search.fuse([b, a], "id").collect()}
    assert {k: v[0] for k, v in ab.items()} == ba and ab["y"] == (round(1 / 62 + 1 / 61, 9), 0) and ab["z"][1] == 1


OBJECT = "id string, type_key string, name string, created timestamp, last_modified timestamp, archived boolean, status string, last_reviewed timestamp, description string, sources array<string>, outbound array<string>, backlinks array<string>, contradictions array<string>"


def test_each_health_check_fires_and_rests(spark):
    from datetime import datetime as d

    rows = [
        ("s1", "wiki_source", "s", d(2024, 6, 1), d(2024, 6, 1), False, None, None, "", [], [], [], []),
        ("e1", "wiki_entity", "e", d(2024, 1, 1), d(2024, 1, 1), False, "needs-review", None, "x" * 2001, ["s1", "gone"], ["e2", "q1"], [], ["e2"]),
        ("e2", "wiki_entity", "f", d(2024, 1, 1), d(2024, 6, 1), False, None, d(2024, 1, 1), "", ["s1"], [], [], []),
        ("e3", "wiki_concept", "g", d(2024, 1, 1), d(2024, 6, 1), False, None, None, "", ["s1"], [], [], []),
        ("q1", "wiki_query", "q", d(2024, 1, 1), d(2024, 6, 1), False, None, None, "", [], [], [], []),
        ("a1", "wiki_entity", "a", d(2024, 1, 1), d(2024, 6, 1), True, None, None, "", [], ["e2"], ["e2"], []),
    ]
    links = spark.createDataFrame([("l1", "e1", "e2", "knows", ["s1"]), ("l2", "e1", "a1", "knows", ["s1"]), ("l3", "e1", "e2", "", ["s1"])], "link_id string, from_id string, to_id string, label string, sources array<string>")
    failed = spark.createDataFrame([(d(2024, 6, 1, 0, 4),)], "ts timestamp")
    got = {}
    for r in graph.lint(spark.createDataFrame(rows, OBJECT), links, failed, "2024-12-01").collect():
        got.setdefault(r.check, set()).add((r.object_id, r.severity))
    assert got["asymmetric_relation"] == {("e1", "high")}
    assert got["stale_citation_edge"] == {("e1", "high")}
    assert got["orphan"] == {("e3", "high")}
    assert got["pipeline_orphan"] == {("e3", "high"), ("s1", "high")}
    assert got["contradiction_unresolved"] == {("e1", "critical")}
    assert got["stale"] == {("e1", "medium")}
    assert got["unreviewed_needs_review"] == {("e1", "high")} and got["stale_needs_review"] == {("e1", "medium")}
    assert got["oversized"] == {("e1", "low")}
    assert got["link_dangling"] == {("l2", "high"), ("l3", "high")}
    assert got["link_index_missing"] == {("l1", "medium")}
    assert got["source_dangling"] == {("e1", "high")}
    assert got["empty_type"] == {("wiki_comparison", "informational")}


def test_expand_keeps_first_discovery(spark):
    adj = spark.createDataFrame([("a", "x", 1), ("b", "x", 0), ("a", "b", 0), ("b", "y", 2)], "src string, dst string, priority int")
    seeds = spark.createDataFrame([("a", 0), ("b", 1)], "id string, seed_rank int")
    assert [(r.id, r.seed) for r in graph.expand(adj, seeds).orderBy("seed_rank", "priority").collect()] == [("x", "a"), ("y", "b")]
    assert graph.expand(adj, seeds, cap=1).count() == 1


def test_similar_titles_are_those_of_brute_force(spark):
    from difflib import SequenceMatcher

    names = ["capoeira angola", "capoeira angolas", "capoera angola", "other thing", "another thing", "a", "ab", "", "mestre joao grande", "mestre joão grande"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if a and b and SequenceMatcher(None, a, b).ratio() >= 0.92}
    assert {(r.a, r.b) for r in resolve.similar(df, df).collect()} == want


def test_title_pairs(spark):
    df = spark.createDataFrame([(1, "Red Ring"), (2, "red ring"), (3, "big red ring"), (4, "blue"), (5, "of the")], "id long, name string")
    assert {(r.a, r.b, r.reason) for r in resolve.title_pairs(df).collect()} == {(1, 2, "identical"), (1, 3, "subset")}


def test_units_and_keys():
    assert facts.units("One is. Two is! [p. 3] [also: a. B] three. (Four) five? six") == ["One is.", "Two is! [p. 3] [also: a. B] three.", "(Four) five? six"]
    assert facts.units("") == [] and facts.units("no end") == ["no end"]
    assert facts.key("- A  b. [also: x] [p. 3]") == "a b"


def test_merge_keeps_every_line():
    one = facts.append("", "first", "s1", "Founded in 1932. Lives in Bahia.")
    two = facts.append(one.text, "second", "s2", "founded in 1932\nHas a school.")
    assert two.added == ["Has a school."] and two.marked == 1 and "[also: second]" in two.text
    again = facts.append(two.text, "second", "s2", "Has a school.")
    assert again.added == [] and again.text == two.text
    assert facts.nothing_lost(one.text, two.text) and not facts.nothing_lost(two.text, one.text)
    assert not facts.nothing_lost(two.text, two.text.replace("Lives in Bahia.", ""))
    flagged = facts.flag_conflict(two.text, "second", "s2", "who  founded")
    assert facts.nothing_lost(two.text, flagged) and not facts.nothing_lost(flagged, two.text)
    assert facts.render(facts.parse(flagged)) == flagged
    assert facts.parse("old line\n## Source: x (id:9)\nnew", {"8"})[1].source_id is None


def test_merge_facts_folds_in_order(spark):
    new = spark.createDataFrame([("o", 1, "a", "s1", "X is."), ("o", 0, "b", "s2", "Y is."), ("p", 0, "b", None, None)], "id string, ord long, label string, source_id string, facts string")
    got = {r.id: r for r in facts.merge_facts(spark.createDataFrame([("o", "Old.")], "id string, text string"), new).collect()}
    assert got["o"].text.index("Y is.") < got["o"].text.index("X is.") and got["o"].added == 2 and got["p"].added == 0


PAGE = "<html><head><title>T</title><script>x</script></head><body><nav>menu</nav><header>top</header><article><header><h1>Head</h1></header><p>Body <b>bold</b> <a href='u'>l</a></p><footer>by</footer></article><form>f</form><footer>foot</footer></body></html>"


def test_main_content():
    md = html.markdown(html.main_content(PAGE))
    assert md == "# Head\n\nBody **bold** [l](u)\n\nby"
    assert html.markdown(html.main_content("<div><p>a</p>")) == "a"
    assert html.markdown(html.main_content("<body><article>t</article><p>" + "long " * 50 + "</p></body>")).startswith("t")
    assert html.markdown(html.main_content("<form><p>all text</p></form>")) == "all text"
    assert html.js_shell("<div id=root></div><script>1</script>") and not html.js_shell("<div id=root>x</div><script></script>")
    assert html.markdown(html.main_content("")) == ""


def test_extract_verdicts(spark):
    df = spark.createDataFrame([(1, None), (2, "<div id=app></div><script></script>"), (3, "<body><p>" + "word " * 200)], "page_id long, html string")
    assert {r.page_id: r.verdict for r in html.extract(df).collect()} == {1: "empty", 2: "js_shell", 3: None}


def test_recover_lines(spark):
    a = spark.createDataFrame([(1, "one two\nthree")], "page_id long, markdown string")
    b = spark.createDataFrame([(1, "Two\nfour five\nfour five\n# three")], "page_id long, markdown string")
    assert [(r.line_no, r.line) for r in html.recover_lines(a, b).collect()] == [(1, "four five")]


def test_snapshot_and_points(spark):
    s = spark.createDataFrame([("s", "a", "1"), ("s", "b", None), ("s", "c", "1")], "space_id string, object_id string, last_modified string")
    c = spark.createDataFrame([("s", "a", "2"), ("s", "b", None), ("s", "d", "1")], "space_id string, object_id string, last_modified string")
    changes = incremental.snapshot_diff(s, c)
    assert {r.object_id: r.change for r in changes.collect()} == {"a": "changed", "b": "unchanged", "c": "removed", "d": "new"}
    points = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "c", 3)], "space_id string, object_id string, v int")
    fresh = spark.createDataFrame([("s", "d", 9)], points.schema)
    assert {(r.object_id, r.v) for r in incremental.replace_points(points, changes, fresh).collect()} == {("b", 2), ("d", 9)}
    v = spark.createDataFrame([("s", 3), ("t", 1)], "space_id string, version long")
    bumped = incremental.bump(v, changes)
    assert {(r.space_id, r.version) for r in bumped.collect()} == {("s", 4), ("t", 1)}
    assert [r.space_id for r in incremental.stale(bumped, v).collect()] == ["s"]


EVENTS = [("s", "w1", "begin", ["a", "b"], None, 1), ("s", "w1", "done", None, "a", 2), ("s", "w2", "done", None, "x", 3), ("s", "w2", "begin", ["x", "y"], None, 4), ("s", "w3", "begin", ["z"], None, 5), ("s", "w3", "clear", None, None, 6)]


def test_pending_in_batch_and_stream(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, worklog.EVENT)
    want = {("w1", "b"), ("w2", "y")}
    assert {(r.work_id, r.subject_id) for r in worklog.pending(events).collect()} == want
    log = tmp_path / "log"
    for part in (events.filter("ord <= 3"), events.filter("ord > 3")):
        part.coalesce(1).write.mode("append").json(str(log))
    (log / "torn.json").write_text('{"space_id": "s", "work_id": "w1", "kind": "do')
    assert {(r.work_id, r.subject_id) for r in worklog.pending(worklog.read_log(spark, str(log))).collect()} == want
    left = {}
    q = worklog.drain(worklog.log_stream(spark, str(log)), lambda df, _: left.update({r.work_id: list(r.pending) for r in df.collect()}), str(tmp_path / "check"))
    assert q.awaitTermination(60) and left == {"w1": ["b"], "w2": ["y"], "w3": []}


def test_fuzzy_resolve_takes_all_parts(spark, tmp_path):
    from difflib import SequenceMatcher

    from quillmesh.plans import catalogue

    names = [(1, "large polished red widget"), (2, "large polished red widgets"), (3, "small blue bolt"), (4, "a" * 60 + "one end"), (5, "a" * 60 + "1 other tail"), (6, "small blue bolt")]
    spark.createDataFrame(names, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    want = {(i, j) for i, x in names for j, y in names if SequenceMatcher(None, x, y).ratio() >= 0.92}
    got = {(r.a, r.b) for r in catalogue.fuzzy_resolve(spark, str(tmp_path)).collect()}
    assert got == want and (1, 2) in got and (4, 5) not in got


def test_lint_findings_are_given_all_failures(spark, monkeypatch):
    from quillmesh.plans import catalogue

    at, seen = "/root/testdata/sf0.001", []
    monkeypatch.setattr(catalogue.graph, "lint", lambda objects, links, failed, when: seen.append(failed.count()))
    catalogue.lint_findings(spark, at)
    assert seen == [spark.read.parquet(f"{at}/events.parquet").filter("event_type = 'error'").count()]
