import json

import pytest
from pyspark.sql import functions as F

from quillmesh import cli
from quillmesh import schema as S
from quillmesh.engine import Engine
from quillmesh.operators import duplicates, repair
from quillmesh.providers import Rules

RECORDS = "space_id string, id string, name string, what string, tag string"
OBJECTS = "space_id string, id string, outbound array<string>"
LINKED = "space_id string, x string, y string"


def log(tag, name="x", i="l", space="s"):
    return (space, i, name, "log", tag)


def source(tag, i="d", space="s"):
    return (space, i, "a source", "source", tag)


@pytest.mark.parametrize(
    ("records", "confirmed", "kind"),
    [
        ([log("ingest"), source("document")], [], "ingest-only"),
        ([log("lint"), source("document")], [], "unknown"),
        ([log("ingest"), source("agent")], [], "mixed"),
        ([log("ingest"), source("conversation"), source(None, "e")], [], "mixed"),
        ([log("ingest"), log("remember", i="m")], [], "mixed"),
        ([log("remember")], [], "mixed"),
        ([log("ingest", "  Remember this")], [], "mixed"),
        ([log(None, "remember a")], ["l"], "mixed"),
        ([log("ingest", "remembered")], [], "ingest-only"),
        ([log("ingest"), source(None)], [], "unknown"),
        ([log("ingest"), source("")], ["d"], "ingest-only"),
        ([log("ingest"), source(None), source(None, "e")], ["d"], "unknown"),
        ([log("ingest"), log(None, None, "m")], [], "unknown"),
        ([log(None), source("document")], ["l"], "unknown"),
        ([source("document")], [], "unknown"),
    ],
)
def test_kinds_of_spaces(spark, records, confirmed, kind):
    named = spark.createDataFrame([("s", i) for i in confirmed], "space_id string, id string")
    got = repair.classified(spark.createDataFrame(records, RECORDS), named).collect()
    assert [r.kind for r in got] == [kind]


def test_evidence_is_counted_by_space(spark):
    rows = [log("ingest"), log("ingest", i="m"), log("lint", i="n"), source("document"), log(None, space="t"), source("agent", space="t")]
    got = {r.space_id: r for r in repair.classified(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got["s"].actions == {"ingest": 2, "lint": 1} and got["s"].source_types == {"document": 1} and got["s"].untagged == 0
    assert got["t"].kind == "mixed" and got["t"].actions == {} and got["t"].untagged == 1
    assert repair.classified(spark.createDataFrame([], RECORDS)).collect() == []


def test_only_ids_of_the_space_without_a_link_are_cleared(spark):
    objects = [("s", "a", ["b", "c", "gone", "b", None]), ("s", "b", ["a", "b"]), ("s", "c", ["a"]), ("s", "d", None), ("t", "z", ["a"]), ("t", "a", ["z"])]
    linked = [("s", "a", "c"), ("t", "a", "b")]
    got = {(r.space_id, r.object_id): (r.clear, r.keep) for r in repair.items(spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(linked, LINKED)).collect()}
    assert got == {("s", "a"): (["b", "b"], ["c", "gone", None]), ("s", "b"): (["a", "b"], []), ("t", "z"): (["a"], []), ("t", "a"): (["z"], [])}


def test_a_digest_follows_the_plan_the_kind_and_the_confirmed(spark):
    def of(rows, kind="ingest-only", confirmed=()):
        plan = spark.createDataFrame([("s", *r) for r in rows], "space_id string, object_id string, clear array<string>")
        named = spark.createDataFrame([("s", i) for i in confirmed], "space_id string, id string")
        return repair.digest(spark.createDataFrame([("s", kind)], "space_id string, kind string"), plan, named).first()

    base = of([("a", ["b", "c"]), ("b", ["a"])])
    assert base.cleared == 3 and len(base.digest) == 64
    assert of([("b", ["a"]), ("a", ["c", "b"])]).digest == base.digest  # in whatever order
    others = [of([("a", ["b"]), ("b", ["a"])]), of([("a", ["b", "c"]), ("b", ["a"])], "mixed"), of([("a", ["b", "c"]), ("b", ["a"])], confirmed=["x"]), of([('a","b', ["c"]), ("b", ["a"])]), of([("a", ["b", "b", "c"]), ("b", ["a"])]), of([])]
    assert len({base.digest, *(o.digest for o in others)}) == 7 and others[-1].cleared == 0


def prop(**given):
    names = ["key", "text", "url", "date", "number", "select", "multi_select", "objects"]
    return tuple(given.get(n) for n in names)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine.at(spark, str(tmp_path / "kb"))
    e._log("s", "ingest", "sources", "2024-01-01")

    def row(i, kind, properties):
        return ("s", i, f"name {i}", kind, "", False, None, "2024-01-01", [], properties)

    related = lambda *ids: prop(key="wiki_relations", objects=list(ids))
    rows = [
        row("a", "wiki_entity", [prop(key="wiki_facts", text="kept"), related("b", "c", "q", "gone")]),
        row("b", "wiki_entity", [related("a")]),
        row("c", "wiki_concept", [prop(key="wiki_related", objects=["a", "b"])]),
        row("q", "wiki_query", []),
        row("src", "wiki_source", [prop(key="wiki_source_type", select=("document", "document"))]),
    ]
    e.store.append("objects", spark.createDataFrame(rows, S.OBJECTS))
    e.relate("s", spark.createDataFrame([("c", "taught", "a", "src")], "from_id string, label string, to_id string, source_id string"))
    return e


def listed(e):
    return {r.id: r.o for r in e.store.read("objects").filter("type_key IN ('wiki_entity', 'wiki_concept')").select("id", S.outbound().alias("o")).collect()}


BEFORE = {"a": ["b", "c", "q", "gone"], "b": ["a"], "c": ["a", "b"]}


def test_a_repair_is_planned_confirmed_backed_up_and_applied(spark, engine, tmp_path):
    rows, report = engine.plan_repair("s")
    assert {r.object_id: r.clear for r in rows.collect()} == {"a": ["b"], "b": ["a"], "c": ["b"]} and report["ids_to_clear"] == 3
    assert report["kind"] == "ingest-only" and report["evidence"]["source_types"] == {"document": 1} and listed(engine) == BEFORE
    place = str(tmp_path / "backup")
    with pytest.raises(repair.Refused) as refused:
        engine.apply_repair("s", "0" * 64, place, "2024-02-01")
    assert refused.value.reason == "digest_mismatch" and refused.value.exit_code == 3 and refused.value.digest == report["digest"]
    assert listed(engine) == BEFORE and not (tmp_path / "backup").exists()
    done = engine.apply_repair("s", report["digest"], place, "2024-02-01")
    assert (done["objects_modified"], done["ids_cleared"]) == (3, 3)
    assert listed(engine) == {"a": ["c", "q", "gone"], "b": [], "c": ["a"]}
    a = engine.store.read("objects").filter("id = 'a'").select(S.knowledge().alias("k"), "last_modified").first()
    assert a.k == "kept" and a.last_modified == "2024-02-01"
    assert {r.object_id: r.prior_ids for r in spark.read.json(place).collect()} == BEFORE
    again, report = engine.plan_repair("s")
    assert again.isEmpty() and report["ids_to_clear"] == 0
    with pytest.raises(repair.Refused) as refused:
        engine.apply_repair("s", report["digest"], place, "2024-02-02")
    assert refused.value.reason == "backup_exists"


def test_untagged_and_remembered_spaces_are_refused(spark, engine, tmp_path):
    old = ("s", "old", "old", "wiki_source", "", False, None, "2024-01-01", [], [])
    engine.store.append("objects", spark.createDataFrame([old], S.OBJECTS))
    place = str(tmp_path / "backup")

    def refusal(confirmed):
        digest = engine.plan_repair("s", confirmed)[1]["digest"]
        with pytest.raises(repair.Refused) as refused:
            engine.apply_repair("s", digest, place, "2024-02-01", confirmed)
        return refused.value.reason

    assert refusal([]) == "confirm_list" and refusal(["old", "src"]) == "confirm_list"
    named = engine.plan_repair("s", ["old"])[1]
    assert named["kind"] == "ingest-only" and named["digest"] != engine.plan_repair("s")[1]["digest"]
    engine._log("s", "remember", "by hand", "2024-01-03")
    assert refusal(["old"]) == "kind" and listed(engine) == BEFORE and not (tmp_path / "backup").exists()


def test_commands_of_repair(spark, engine, tmp_path, capsys):
    def run(*args):
        code = cli.main(["--root", engine.store.root, "--now", "2024-03-01", *args], spark)
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    code, out = run("repair", "--space", "s")
    assert code == 0 and len(out) == 4 and listed(engine) == BEFORE
    digest = out[-1]["digest"]
    assert run("repair", "--space", "s", "--apply", "--backup", "x")[0] == 2
    code, told = run("repair", "--space", "s", "--apply", "--expect-digest", "f" * 64, "--backup", str(tmp_path / "b"))
    assert code == 3 and told[0]["digest"] == digest and listed(engine) == BEFORE
    assert run("prune-citations", "--space", "s") == (0, [{"objects_modified": 1}]) and listed(engine)["a"] == ["b", "c", "gone"]
    code, told = run("repair", "--space", "s", "--apply", "--expect-digest", digest, "--backup", str(tmp_path / "b"))
    assert code == 0 and told[0]["ids_cleared"] == 3 and listed(engine) == {"a": ["c", "gone"], "b": [], "c": ["a"]}
    assert run("prune-citations", "--space", "s") == (0, [{"objects_modified": 0}])


class Failing(Rules):
    def same_as(self, name, facts, candidates):
        if name == "red":
            raise RuntimeError("no answer")
        return super().same_as(name, facts, candidates)


def test_pairs_once_and_the_likeliest_judged(spark):
    titles = spark.createDataFrame([(1, 2, "subset"), (3, 4, "identical"), (1, 2, "subset")], "a long, b long, reason string")
    near = spark.createDataFrame([(1, 2, 0.8), (5, 6, 0.71), (1, 6, 0.8), (5, 99, 0.9)], "a long, b long, score double")
    found = duplicates.pairs(titles, near)
    assert sorted((r.a, r.b, r.reason, r.score) for r in found.collect()) == [(1, 2, "subset", None), (1, 6, None, 0.8), (3, 4, "identical", None), (5, 6, None, 0.71), (5, 99, None, 0.9)]
    objects = spark.createDataFrame([(1, "blue house", ""), (2, "blue", None), (3, "red", ""), (4, "red", ""), (5, "x y", ""), (6, "house blue", "")], "id long, name string, facts string")
    got = {(r.a, r.b): (r.verdict, r.recommendation) for r in duplicates.judged(found, objects, Failing(), 4).collect()}
    assert {k: v[0] for k, v in got.items()} == {(3, 4): "distinct", (1, 2): "same", (5, 99): None, (1, 6): "same", (5, 6): "unjudged"}
    assert got[1, 2][1] == "likely the same: review for possible merge (subset)" and got[5, 6][1] == "review for possible merge"
    every = {(r.a, r.b): r.verdict for r in duplicates.judged(found, objects, Rules()).collect()}
    assert every[5, 6] == "distinct" and every[3, 4] == "same"
    assert {r.verdict for r in duplicates.judged(found, objects, Rules(), 0).collect()} == {"unjudged"}
    assert duplicates.judged(found.limit(0), objects, Rules()).collect() == []


def test_lint_tells_pairs_by_title_and_by_meaning(spark, tmp_path):
    e = Engine.at(spark, str(tmp_path / "kb"))
    text = "# Old school\nIt taught angola in the old town of Salvador.\n# School\nIt taught regional.\n# Night market\nFish and rice are sold there.\n# Ribeira fair\nFish and rice are sold there daily."
    e.ingest(spark.createDataFrame([("s", "n", text)], "space_id string, source string, content string"), "2024-01-01")
    e.reindex()
    ids = {r.name: r.id for r in e.store.read("objects").filter("type_key = 'wiki_entity'").collect()}
    rows = e.duplicates("s", adjudicate=True).collect()
    by = {frozenset((r.a, r.b)): r for r in rows}
    assert len(by) == len(rows) and by[frozenset((ids["Old school"], ids["School"]))].reason == "subset"
    assert by[frozenset((ids["Old school"], ids["School"]))].verdict == "same"
    for r in rows:
        assert (r.reason is None) == (r.score is not None) and (r.score is None or 0.7 <= r.score < 0.85)
    told = [r.detail for r in e.lint("s", "2024-01-02", duplicates=True, adjudicate=True).filter(F.col("check") == "potential_duplicate").collect()]
    assert len(told) == len(rows) and any("likely the same" in x for x in told)
