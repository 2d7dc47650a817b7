from pyspark.sql import functions as F

from quillmesh.operators import planning as P


def test_windows(spark):
    rows = [("d", i, n) for i, n in enumerate([4, 5, 2, 20, 1, 1])]
    df = spark.createDataFrame(rows, "doc string, page long, n long")
    got = {r.page: r.window for r in P.windows(df, ["doc"], "page", F.col("n"), 10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3}


def test_fit_and_labels(spark):
    one = spark.range(1)
    texts = {"a" * 8 + "\n\n" + "b" * 9: "a" * 8, "ab\n\n" + "c" * 20: "ab\n\n" + "c" * 8, "short": "short", "a" * 9 + "\n" + "b" * 9: "a" * 9}
    for text, want in texts.items():
        assert one.select(P.fit(F.lit(text), 12)).first()[0] == want
    labels = {(3,): "p. 3", (8, 3, 4, 5, 3): "pp. 3–5, 8", (): ""}
    for pages, want in labels.items():
        assert one.select(P.page_label(F.lit(list(pages)).cast("array<int>"))).first()[0] == want


def test_merge_windows(spark):
    rows = [("d", "e", "Bimba", "two", 1, [4]), ("d", "e", "bimba", "one", 0, [2, 3]), ("d", "c", "bimba", "x", 0, [1])]
    df = spark.createDataFrame(rows, "doc string, kind string, name string, facts string, window int, pages array<int>")
    got = {(r.kind, r.name): (r.facts, r.label) for r in P.merge_windows(df, ["doc"]).collect()}
    assert got == {("e", "bimba"): ("one\ntwo", "pp. 2–4"), ("c", "bimba"): ("x", "p. 1")}


def test_primary_subject(spark):
    df = spark.createDataFrame([("r", 0, "Other"), ("r", 1, "Mestre Onça"), ("r", 2, "onca"), ("r", 3, "Onça (Rio)")], "run string, ord int, name string")
    got = [(r.name, r.primary) for r in P.primary_subject(df, ["run"], "Onça (São Paulo)").orderBy("ord").collect()]
    assert got == [("Other", False), ("Onça (São Paulo)", True), ("Onça (Rio)", False)]
    assert [r.primary for r in P.primary_subject(df, ["run"], "Bimba", "other").orderBy("ord").collect()] == [True, False, False, False]
    assert not any(r.primary for r in P.primary_subject(df, ["run"], "Bimba").collect())
    names = spark.createDataFrame([("a_b_c", True), ("a_b_c", False), ("Ana", False)], "name string, primary boolean")
    assert P.admissible(names).count() == 2


def test_verdict_guards(spark):
    v = spark.createDataFrame([(1, "a", "yes"), (1, "b", "no"), (2, "a", None), (3, "z", "yes")], "check_id int, id string, verdict string")
    c = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "check_id int, id string")
    assert {(r.check_id, r.id) for r in P.offered(v, c, ["check_id"], "id").collect()} == {(1, "a"), (2, "a")}
    assert {(r.check_id, r.verdict) for r in P.well_formed(v, c).collect()} == {(1, None), (2, None), (3, "yes")}
    s = spark.createDataFrame([("o", i, "x" * n) for i, n in enumerate([10, 3000, 2000, 2000, 7000])], "id string, ord int, text string")
    assert [(r.ord, len(r.text)) for r in P.self_sections(s, ["id"], "ord", "text").collect()] == [(4, 6000)]
    assert {r.ord for r in P.self_sections(s.filter("ord < 4"), ["id"], "ord", "text").collect()} == {3, 2}


def test_repairs(spark):
    adj = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "src string, dst string")
    links = spark.createDataFrame([("b", "a")], "from_id string, to_id string")
    assert {tuple(r) for r in P.unbacked(adj, links).collect()} == {("a", "c")}
    o = spark.createDataFrame([("1", ["x", "q", "y", "q"]), ("2", ["x"]), ("3", ["q"]), ("4", None)], "id string, ids array<string>")
    gone = spark.createDataFrame([("q",)], "id string")
    assert {r.id: r.ids for r in P.prune(o, gone, "ids").collect()} == {"1": ["x", "y"], "2": ["x"], "3": [], "4": None}
    src = spark.createDataFrame([("s", "1", "document"), ("s", "2", None), ("s", "3", "agent"), ("t", "4", None)], "space string, id string, source_type string")
    got = {r.space: (r.documents, r.agents, r.untagged, r.mixed) for r in P.classify(src, "space", spark.createDataFrame([("2",)], "id string")).collect()}
    assert got == {"s": (1, 1, 0, True), "t": (0, 0, 1, False)}
    assert P.missing(src, src.filter("space = 't'"), ["space"]).first()[0] == "s"
    pages = spark.createDataFrame([(1, 1, "Here is BIMBA"), (1, 2, "none")], "doc int, page int, text string")
    assert [(r.page, r.name) for r in P.mentions(pages, spark.createDataFrame([(1, "Bimba")], "doc int, name string"), ["doc"]).collect()] == [(1, "Bimba")]
