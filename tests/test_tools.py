import json

import pytest
from pyspark.sql import functions as F

from quillmesh import cli, doctor, runtime, settings
from quillmesh.engine import Engine
from quillmesh.operators import search
from quillmesh.sources import fetch, html
from quillmesh.sources.store import Store


def test_addresses_that_may_not_be_asked():
    to = {"ok.org": ["93.184.216.34"], "in.org": ["93.184.216.34", "10.0.0.1"], "six.org": ["::ffff:127.0.0.1"], "none.org": []}
    why = lambda u: fetch.refusal(u, lambda h: to[h])
    assert why("https://ok.org/a") is None and why("ftp://ok.org") and why("http://u:p@ok.org") and why("http://ok.org:81") and why("http://") and why("http://ok.org:x")
    assert why("http://in.org") == why("http://six.org") == "private or reserved address" and why("http://none.org") == "host did not resolve"
    assert all(fetch.blocked(a) for a in ("192.168.1.1", "100.64.0.1", "fe80::1%eth0", "0.0.0.0", "224.0.0.1", "64:ff9b::1")) and not fetch.blocked("8.8.8.8")


def test_fetching_follows_checked_redirects(spark):
    pages = {"http://a.org/": (302, {"location": "/b"}, b""), "http://a.org/b": (200, {"content-type": "text/html"}, b"x" * 20), "http://a.org/loop": (301, {"location": "/loop"}, b""), "http://a.org/in": (302, {"location": "http://in.org/"}, b""), "http://a.org/pdf": (200, {}, b"%PDF-1.7"), "http://a.org/no": (404, {}, b""), "http://a.org/lost": (302, {}, b"")}
    to = {"a.org": ["8.8.8.8"], "in.org": ["127.0.0.1"]}
    got = {r.url: (bytes(r.body), r.content_type, r.error) for r in fetch.fetch(spark.createDataFrame([(u,) for u in [*pages, None]], "url string"), "url", lambda u: pages[u], lambda h: to[h]).collect()}
    assert got["http://a.org/"] == (b"x" * 20, "text/html", None) and got["http://a.org/pdf"][1:] == ("application/pdf", None)
    assert [got[f"http://a.org/{x}"][2] for x in ("loop", "in", "no", "lost")] == ["too many redirects", "private or reserved address", "http_error: 404", "redirect without a location"] and got[None][2]


def test_pdf_pages(spark):
    def reader(data):
        if data == b"locked":
            raise PermissionError
        if data == b"broken":
            raise ValueError
        for n, x in enumerate(data.decode().split("|")):
            yield ValueError() if x == "!" else x

    long = "words that can be seen in a page " * 12
    rows = [("a", f"{long}| |!|{long}".encode()), ("b", b"locked"), ("c", b"broken"), ("d", b" | "), ("e", f"{long}|{long}|{long}|{long}|{long}".encode()), ("f", ("�" * 30 + long[:60] + "|" + long).encode())]
    got = {r.id: r for r in fetch.pdf_result(fetch.pdf_pages(spark.createDataFrame(rows, "id string, content binary"), ["id"], reader, 4)).collect()}
    assert [p.page for p in got["a"].kept] == [1, 4] and got["a"].warnings == ["pdf_pages_unreadable: p. 3", "pdf_pages_without_text: p. 2"] and got["a"].verdict is None and got["a"].markdown.startswith("[p. 1]\nwords")
    assert (got["b"].verdict, got["c"].verdict, got["d"].verdict) == ("pdf_encrypted", "pdf_unreadable: ValueError", "image_only_pdf")
    assert got["e"].warnings == ["pdf_pages_capped: of 5"] and got["f"].warnings == ["pdf_text_degraded: p. 1"]


def test_settings(tmp_path):
    at = tmp_path / "s.toml"
    assert settings.load(at) == {} and settings.spaces_with("strip_name_titles", at, {}) == frozenset()
    at.write_text("[spaces.a]\nstrip_name_titles = true\nfile_back = false\n[spaces.b]\nother = 1\n")
    assert settings.spaces_with("strip_name_titles", at, {}) == {"a"} and settings.file_back("a", at) is False and settings.file_back("b", at) is None
    assert settings.spaces_with("strip_name_titles", at, {"QUILLMESH_STRIP_NAME_TITLES": "x, y"}) == {"x", "y"}
    for bad in ("[spaces.a]\nstrip_name_titles = 1", "spaces = 3", "[", "[spaces.a]\nfile_back = 0"):
        at.write_text(bad)
        assert settings.load(at) == {}
    assert settings.local_endpoint("http://localhost:1") and not settings.local_endpoint("http://x.org") and settings.vetted("m:7b", ("m:",)) and settings.vetted("q1", (), "z, q") and not settings.vetted("q1", ("m",))


def test_locks_and_spans(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    with runtime.lock(spark, at, "x"):
        assert runtime.only_one(spark, at, "x", lambda: 1)["status"] == "skipped" and runtime.only_one(spark, at, "y", lambda: 1) == 1
        with pytest.raises(runtime.Busy):
            runtime.retried(spark, at, "x", lambda: 1, 2, 0.01)
    assert runtime.retried(spark, at, "x", lambda: 2) == 2
    monkeypatch.setenv("QUILLMESH_PROFILE", f"{at}/spans")
    with runtime.span("work", a=1) as m:
        m["b"] = 2
    told = json.loads((tmp_path / "spans").read_text())
    assert (told["span"], told["a"], told["b"]) == ("work", 1, 2) and told["seconds"] >= 0 and runtime.target("off") is None and runtime.target("YES") == "stderr"


def test_additions_stand_for_rows_with_their_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quillmesh.sources.store.ADDITIONS", 3)
    s = Store(spark, str(tmp_path))
    row = lambda i, x: spark.createDataFrame([("s", i, "a", x, "b", ["q"])], "space_id string, link_id string, from_id string, label string, to_id string, sources array<string>")
    for i, x in (("1", "one"), ("2", "two"), ("1", "three"), ("1", "four"), ("3", "five")):
        s.upsert("links", row(i, x), ["space_id", "link_id"])
    assert {r.link_id: r.label for r in s.read("links").collect()} == {"1": "four", "2": "two", "3": "five"} and s.state("links") == (2, 1)
    with pytest.raises(ValueError):
        s.upsert("links", row("1", "x"), ["link_id"])


def test_postings_are_made_anew_for_changed_spaces_only(spark, tmp_path, monkeypatch):
    e = Engine.at(spark, str(tmp_path))
    pages = [(s, f"n{s}", f"# Name {s}\nwords about angola and {s}\n# Other {s}\nmore about berimbau") for s in ("x", "y")]
    e.ingest(spark.createDataFrame(pages, "space_id string, source string, content string"), "2024-01-02")
    e.reindex()
    made = []
    old = search.postings
    monkeypatch.setattr(search, "postings", lambda *a: made.append(1) or old(*a))
    first = [tuple(r) for r in e.search("berimbau", "x").collect()]
    assert first and len(made) == 1 and [tuple(r) for r in e.search("berimbau", "x").collect()] == first and len(made) == 1
    e.search("berimbau", "y").collect()
    assert len(made) == 2
    e.ingest(spark.createDataFrame([("x", "later", "# Third\nberimbau berimbau")], "space_id string, source string, content string"), "2024-01-03")
    e.reindex()
    assert "Third" in {r.object_name for r in e.search("berimbau", "x").collect()} and len(made) == 3
    e.search("berimbau", "y").collect()
    assert len(made) == 3
    before = e.store.read("terms").count()
    e.tidy()
    assert e.store.read("terms").count() < before and {r.object_name for r in e.search("berimbau", "x").collect()} >= {"Third"} and len(made) == 3
    note = e.narrate("x", "a conversation at http://u:p@h.org/?q=1", "2024-01-04").first()
    assert note["name"] == "a conversation at http://h.org/" and e.narrate("x", None, "2024-01-04").first()["name"] == "agent 2024-01-04"
    assert e.backfill("2024-01-05") and not e.backfill("2024-01-06")
    with pytest.raises(ValueError, match="invalid_date_format: after"):
        e.search("x", "x", filters=search.Filters(after="yesterday"))
    with pytest.raises(ValueError, match="invalid_filter: types"):
        e.search("x", "x", filters=search.Filters(types=("",)))


def test_commands(spark, tmp_path, capsys):
    root, page = str(tmp_path / "kb"), tmp_path / "p.md"
    page.write_text("# Bimba\nfounded a school\n# Pastinha\ntaught angola")
    run = lambda *a: (cli.main(["--root", root, "--now", "2024-01-02", *a], spark), [json.loads(x) for x in capsys.readouterr().out.splitlines()])
    assert run("bootstrap", "--space", "s")[1][0]["space"] == "s"
    assert {x["name"] for x in run("ingest", "--space", "s", "--files", str(page))[1]} >= {"Bimba", "Pastinha"}
    assert run("reindex")[1][0]["new"] == 3 and run("search", "--text", "angola", "--space", "s")[1][0]["object_name"] == "Pastinha"
    assert run("search", "--text", "x", "--after", "never")[0] == 1 and "answer" in run("query", "--space", "s", "--text", "angola")[1][0]
    assert run("remember", "--space", "s", "--work", "w", "--subjects", "a, b")[1] == [{"status": "ok", "queued": 2}] and run("drain")[1][-1] == {"done": 2}
    assert {x["check"] for x in run("lint", "--space", "s", "--severity", "informational")[1]} >= {"empty_type"} and run("prune-links", "--space", "s")[1] == []
    code, report = run("doctor")
    assert code in (0, 2) and {c["name"] for c in report[0]["checks"] if c["status"] == "FAIL"} == set() and len(report[0]["checks"]) == 13
    assert doctor.examine(spark, root, 32)["exit_code"] == 1 and cli.printable("a\x1b[0m‮") == "a\\x1b[0m\\u202e"


def test_titles_go_first(spark):
    one = lambda m, t: spark.range(1).select(html.titled(F.lit(m), F.lit(t))).first()[0]
    assert one("text", "T") == "# T\n\ntext" and one("# *The*  Title\nx", "the title") == "# *The*  Title\nx" and one("x", "") == "x"
