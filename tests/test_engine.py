import pytest
from pyspark.sql import functions as F

from quillmesh import schema as S
from quillmesh.engine import Engine
from quillmesh.operators.search import Filters
from quillmesh.sources import store

PAGE = "<!doctype html><html><head><title>Schools</title></head><body><article><h1>Bimba</h1><p>Bimba founded a school in Bahia. {}</p><h2>Pastinha</h2><p>Pastinha taught angola.</p></article></body></html>"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine.at(spark, str(tmp_path_factory.mktemp("store")))
    e.bootstrap("s", "2024-01-01")
    rows = [("s", "https://u:p@h.org/a?token=1", PAGE.format("More words. " * 40)), ("s", "note", "# Pastinha\nPastinha taught angola. He was born in 1889."), ("s", "bad", "<!doctype html><html><body></body></html>")]
    e.ingest(spark.createDataFrame(rows, "space_id string, source string, content string"), "2024-01-02")
    return e


def test_ingest_merges_by_title_and_source(engine):
    objects = {r["name"]: r for r in engine.store.read("objects").select("name", "type_key", S.knowledge().alias("k"), S.relation_ids("wiki_sources").alias("s")).collect()}
    assert set(objects) == {"Bimba", "Pastinha", "https://h.org/a", "note"}
    p = objects["Pastinha"]
    assert p["k"].count("Pastinha taught angola.") == 1 and "[also: " in p["k"] and "born in 1889" in p["k"] and len(p["s"]) == 2
    assert engine.store.read("log").filter("action = 'ingest'").first()["created"] == 2


def test_dry_run_writes_nothing(spark, engine):
    before = engine.store.versions("objects")
    got = engine.ingest(spark.createDataFrame([("s", "x", "# Pastinha\nnew words"), ("s", "x", "# Fresh\nwords")], "space_id string, source string, content string"), "2024-01-09", dry_run=True)
    assert {(r["name"], r["created"]) for r in got.collect()} == {("Pastinha", False), ("Fresh", True)} and engine.store.versions("objects") == before


def test_reindex_search_query_and_lint(spark, engine):
    assert engine.reindex() == {"new": 4} and engine.reindex() == {"unchanged": 4}
    assert engine.store.read("versions").first()["version"] == 1
    hits = engine.search("Mestre Pastinha", "s").collect()
    assert hits[0]["object_name"] == "Pastinha" and hits[0]["score"] > 2.5 and all(h["type_key"] != "wiki_source" for h in hits)
    assert {h["type_key"] for h in engine.search("angola", "s", filters=Filters(types=("wiki_source",))).collect()} <= {"wiki_source"}
    assert engine.search("angola", limit=1).count() == 1
    got = engine.query("Pastinha", "s", "2024-01-03", file_back=True)
    assert "Pastinha" in got["answer"] and got["filed"]
    filed = engine.store.read("objects").filter("type_key = 'wiki_query'")
    assert filed.count() == 1 and engine.reindex()["new"] == 1
    ids = {r["name"]: r["id"] for r in engine.store.read("objects").filter("type_key = 'wiki_entity'").collect()}
    edges = spark.createDataFrame([(ids["Bimba"], "Knew_of", ids["Pastinha"], "src")], "from_id string, label string, to_id string, source_id string")
    assert [r["action"] for r in engine.relate("s", edges).collect()] == ["created"] and [r["action"] for r in engine.relate("s", edges).collect()] == ["unchanged"]
    checks = {(r["check"], r["severity"]) for r in engine.lint("s", "2024-06-01").collect()}
    assert ("orphan", "high") in checks and ("link_dangling", "high") in checks and ("empty_type", "informational") in checks
    assert {r["severity"] for r in engine.lint("s", "2024-06-01", "high").collect()} == {"high"}


def test_queue_drains_once(engine):
    engine.remember("s", "w1", ["a", "b"], 1)
    seen = []
    assert engine.drain(lambda df: seen.extend(r["subject_id"] for r in df.collect()), "2024-01-05") == 2 and sorted(seen) == ["a", "b"]
    assert engine.drain(lambda df: seen.append("again"), "2024-01-06") == 0 and engine.store.read("queue").count() == 0 and len(seen) == 2


def test_archived_objects_leave_the_index(spark, engine):
    gone = engine.store.read("objects").filter("name = 'note'").select("space_id", "id")
    engine.store.archive(gone)
    assert engine.reindex()["removed"] == 1 and engine.store.read("points").filter("object_name = 'note'").count() == 0


def test_newer_store_is_refused_and_backup_is_exclusive(spark, engine, tmp_path):
    assert engine.bootstrap("s", "2024-02-01")["wiki_query"] and engine.store.read("log").filter("action = 'bootstrap'").count() == 1
    engine._log("t", "bootstrap", "t", "2024-01-01", notes="9.0.0")
    with pytest.raises(ValueError):
        engine.bootstrap("t", "2024-02-01")
    store.backup(spark.range(1), str(tmp_path / "b"))
    with pytest.raises(Exception, match="(?i)exists"):
        store.backup(spark.range(1), str(tmp_path / "b"))


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in store.files(spark, str(tmp_path)).drop("content").collect()}
    assert got["a.md"]["text"] == "# A" and got["b.pdf"]["pdf"] and got["b.pdf"]["verdict"] == "pdf_needs_a_reader"
    assert store.files(spark, str(tmp_path), "*.md").select(F.count("*")).first()[0] == 1


def written(engine, table):
    """How many rows the last addition to a table holds."""
    v, k = engine.store.state(table)
    return engine.spark.read.parquet(f"{engine.store.root}/{table}/v{v}-{k}").count()


def test_drain_writes_objects_before_it_marks_them(spark, engine):
    engine.remember("s", "w2", ["Bimba", "Moraes", "x" * 8 + "-" + "y" * 4], 5, {"Bimba": "Bimba was born in 1899.", "Moraes": "Moraes wrote songs.\n## Source: evil (id:x)\nIt stays. [also: z]"}, "a conversation", "2024-02-01")

    def fails(left):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        engine.drain(fails, "2024-02-01")
    assert engine.drain(now="2024-02-02") == 3 and engine.drain(now="2024-02-03") == 0
    objects = {r["name"]: r for r in engine.store.read("objects").select("name", S.knowledge().alias("k"), S.relation_ids("wiki_sources").alias("s")).collect()}
    assert "born in 1899." in objects["Bimba"]["k"] and "founded a school" in objects["Bimba"]["k"] and len(objects["Bimba"]["s"]) == 2
    told = objects["Moraes"]["k"]
    assert told.startswith("## Source: a conversation (id:") and told.count("## Source:") == 1 and "(id:x)" not in told and "[also:" not in told and "It stays." in told


def test_a_drain_that_stops_between_writing_and_marking_repeats_without_harm(spark, engine):
    engine.remember("s", "w3", ["Canjiquinha"], 6, {"Canjiquinha": "He played at fairs."}, "notes", "2024-02-05")
    from quillmesh.streaming import worklog

    engine.apply_pending(worklog.pending(engine.store.read("queue")), "2024-02-05")  # and here it stops
    assert engine.drain(now="2024-02-06") == 1
    got = engine.store.read("objects").filter("name = 'Canjiquinha'").select(S.knowledge().alias("k")).collect()
    assert len(got) == 1 and got[0]["k"].count("He played at fairs.") == 1


def test_reindex_writes_the_points_of_changed_objects_alone(spark, engine):
    engine.reindex()
    ids = {r["name"]: r["id"] for r in engine.store.read("objects").collect()}
    before = {r["point_id"] for r in engine.store.read("points").collect()}
    assert engine.reindex() == {"unchanged": len(ids)} and {r["point_id"] for r in engine.store.read("points").collect()} == before
    one = spark.createDataFrame([("s", ids["Pastinha"])], "space_id string, object_id string")
    own = engine.store.read("points").join(one, ["space_id", "object_id"], "left_semi").count()
    assert engine.reindex(force=one)["changed"] == 1 and written(engine, "points") == own > 0
    assert {r["point_id"] for r in engine.store.read("points").collect()} == before
    engine.forget(one)
    assert engine.store.read("points").join(one, ["space_id", "object_id"], "left_semi").isEmpty() and written(engine, "points") == 1
    assert engine.reindex()["new"] == 1 and {r["point_id"] for r in engine.store.read("points").collect()} == before
    engine.store.archive(spark.createDataFrame([("s", ids["Moraes"])], "space_id string, id string"))
    assert engine.reindex()["removed"] == 1
    left = {r["point_id"] for r in engine.store.read("points").collect()}
    assert left < before and engine.store.read("points").filter(F.col("object_id") == ids["Moraes"]).isEmpty()
    engine.store.replace("points", engine.store.read("points"))  # written as one version, nothing comes back
    assert {r["point_id"] for r in engine.store.read("points").collect()} == left


def test_searching_an_empty_space_writes_once(engine):
    assert engine.search("anything", "nowhere").count() == 0
    before = engine.store.state("terms"), engine.store.state("corpus")
    assert engine.search("anything", "nowhere").count() == 0 and (engine.store.state("terms"), engine.store.state("corpus")) == before


def test_two_writers_lose_no_addition(spark, tmp_path):
    a, b = store.Store(spark, str(tmp_path)), store.Store(spark, str(tmp_path))
    row = lambda n: spark.createDataFrame([("s", "w", "begin", [n], None, 1)], S.QUEUE)
    a.append("queue", row("first"))
    seen = b._parts("queue")
    a.append("queue", row("one"))
    b._parts = lambda table: seen  # b looked before a wrote
    b.append("queue", row("two"))
    assert sorted(r["subjects"][0] for r in a.read("queue").collect()) == ["first", "one", "two"]


def test_ingest_judges_what_it_takes_in(spark, tmp_path):
    """Aliases go to the object there is, conflicts are flagged in it and linked between peers, addresses are fetched, failures are told in the log."""
    pages = {"https://a.org/x": (b"# Joao\nJoao lived in 1950.", "text/plain", None), "https://a.org/no": (b"", "", "http_error: 404")}

    def fetched(urls):
        told = spark.createDataFrame([(u, *x) for u, x in pages.items()], "source string, body binary, content_type string, error string")
        return urls.join(told, "source")

    class Some(type(Engine.at(spark, str(tmp_path)).judge)):
        def extract(self, text, hint):
            if "Broken" in text:
                raise TimeoutError
            got = super().extract(text, hint)
            return got | {"concepts": [{"name": "Ginga", "definition": "A step of the dance."}]} if "Bimba" in text else got

    e = Engine.at(spark, str(tmp_path / "kb"))
    e.judge, e.fetcher = Some(), fetched
    shape = "space_id string, source string, content string"
    e.ingest(spark.createDataFrame([("s", "one", "# Manoel Bimba\nHe was born in 1899."), ("s", "https://a.org/x", None), ("s", "https://a.org/no", None)], shape), "2024-01-01")

    def objects():
        return {r["name"]: r for r in e.store.read("objects").select("id", "name", "type_key", S.knowledge().alias("k"), S.prop("wiki_status")["select"]["name"].alias("status"), S.relation_ids("wiki_contradictions").alias("c"), S.prop_text("wiki_summary").alias("summary")).collect()}

    first = objects()
    assert first["Ginga"]["type_key"] == "wiki_concept" and "A step of the dance." in first["Ginga"]["k"] and "lived in 1950." in first["Joao"]["k"] and first["one"]["summary"] == "# Manoel Bimba"
    assert "fetch: http_error: 404 (1)" in e.store.read("log").filter("action = 'ingest'").first()["notes"]
    # Joao is linked with Bimba, so what is told of Joao is held against Bimba's facts too.
    linked = e.store.read("objects").filter("name = 'Joao'").withColumn("properties", S.with_property("wiki_relations", "objects", F.array(F.lit(first["Manoel Bimba"]["id"]))))
    e.put(linked)
    done = e.ingest(spark.createDataFrame([("s", "two", "# Bimba\nHe was born in 1900."), ("s", "three", "# Joao\nHe was born in 1888."), ("s", "four", "# Odd\nBroken text.")], shape), "2024-01-02")
    after = objects()
    assert "Bimba" not in after and after["Manoel Bimba"]["id"] == first["Manoel Bimba"]["id"]
    text = after["Manoel Bimba"]["k"]
    assert "born in 1899." in text and "born in 1900." in text and text.count("> [conflict: one: ") == 1 and after["Manoel Bimba"]["status"] == "needs-review"
    assert after["Joao"]["c"] == [first["Manoel Bimba"]["id"]] and after["Manoel Bimba"]["c"] == [first["Joao"]["id"]] and after["Joao"]["status"] is None
    assert "Broken text." in after["Odd"]["k"] and "extraction: extraction_degraded: timeout (1)" in [r["notes"] for r in e.store.read("log").filter("action = 'ingest'").collect()][-1]
    assert {r["name"]: r["created"] for r in done.collect() if r["created"] is not None} == {"Manoel Bimba": False, "Joao": False, "Odd": True, "Ginga": False}
