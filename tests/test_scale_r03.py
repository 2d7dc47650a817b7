"""Steps whose cost once grew faster than their input: what they are made of, and that their results stay."""

from quillmesh.operators import facts


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_each_line_of_an_object_is_read_once(monkeypatch):
    read, units = [], facts.units
    monkeypatch.setattr(facts, "units", lambda line: read.append(line) or units(line))
    text, seen = "", {}
    for i in range(6):
        made = facts.append(text, f"src {i}", f"s{i}", f"Fact {i} is. It was.\nOnly {i}.", seen)
        assert facts.nothing_lost(text, made.text, seen)
        text = made.text
    assert len(read) == len(set(read)) and text.count("It was. [also:") == 1


def test_merge_facts_goes_over_sorted_rows_in_batches(spark):
    new = [(i, j, f"l{j}", f"s{j}", f"Fact {i}. Shared.") for i in range(50) for j in (2, 0, 1)]
    df = spark.createDataFrame([*new, (None, 0, "l", "s", "Null id.")], "id long, ord long, label string, source_id string, facts string")
    stored = spark.createDataFrame([(7, "Old."), (999, "Nothing new.")], "id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # objects lie across batches
        made = facts.merge_facts(stored, df)
        got = {r.id: r for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroupsInPandas" not in plan(made)  # a pandas frame an object
    assert set(got) == {None, *range(50)} and len(got) == made.count()
    assert all((got[i].added, got[i].marked) == (2, 4) for i in range(50))
    assert got[3].text.startswith("## Source: l0 (id:s0)\nFact 3. [also: l1; l2] Shared. [also: l1; l2]") and got[7].text.index("Old.") < got[7].text.index("Fact 7.")


def test_postings_shuffle_texts_not_words(spark):
    from pyspark.sql import functions as F

    from quillmesh.functions import text as X
    from quillmesh.operators import search

    docs = spark.createDataFrame([(1, "red ring red"), (2, "ring"), (1, "red bolt"), (3, None), (None, "bolt")], "id long, text string")
    words = X.tokens(F.col("text"))
    made = search.postings(docs, "id", words, F.col("text")).sortWithinPartitions("term")
    dealt = plan(made).split("== Physical Plan ==")[1]
    assert dealt.count("Exchange ") == dealt.count("Exchange hashpartitioning") == 1
    got = sorted(map(repr, made.collect()))
    assert got == sorted(map(repr, search.postings(docs, "id", words).collect())) and len(got) == 9


def test_bracket_at_the_end_is_found_by_a_pattern(spark):
    import random

    from pyspark.sql import functions as F

    from quillmesh.functions import text as X

    def walked(name: str) -> int:
        text, depth = name.rstrip(), 0
        for i in range(len(text) - 1, -1, -1):
            depth += {")": 1, "(": -1}.get(text[i], 0)
            if not text.endswith(")") or depth == 0:
                return i if text.endswith(")") else -1
        return -1

    rng = random.Random(3)
    names = ["".join(rng.choice("(()) ab\n") for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["a ((((x))))", "a (b (c (d)))", "a (😀 (b)) ", "a)", "((a)", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.at for r in df.select(X._tail(F.col("n")).alias("at")).collect()][: len(names) - 1] == [walked(n) for n in names[:-1]]
    assert X._GROUP in plan(df.select(X._tail(F.col("n"))))


def test_blocks_are_dealt_to_parts_and_lanes(spark, monkeypatch):
    import numpy as np

    from quillmesh.operators import neighbours as N

    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "PART", 2)
    monkeypatch.setattr(N, "TASKS", 12)
    v = np.random.default_rng(4).integers(-2, 3, (150, 4)).astype(float) + 0.5
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, int(j)) for i, s in enumerate(np.round(u @ u.T, 6)) for j in np.lexsort((np.arange(len(v)), -s))[:3]}
    assert {(r.a, r.b) for r in N.neighbours(df, df, "embedding", "vec_id", 3, cells=4).collect()} == want


def test_small_pieces_are_held_back_for_what_larger_ones_leave():
    import random
    from collections import Counter

    from quillmesh.llm import packing

    for seed in (0, 5, 7, 8, 9):
        rng = random.Random(seed)
        lengths = Counter(rng.choice((rng.randint(320, 340), rng.randint(170, 190), rng.randint(2, 700), 330)) for _ in range(500))
        plan = packing.pack(dict(lengths), 2048, 150)
        assert sum(n for _, n in plan) == -(-sum(s * n for s, n in lengths.items()) // 2048)  # one more before
        assert Counter(s for f, n in plan for s in f for _ in range(n)) == lengths and all(sum(f) <= 2048 for f, _ in plan)


def test_pairs_of_one_title_are_dealt_to_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillmesh.operators import resolve

    monkeypatch.setattr(resolve, "BLOCK", 8)
    monkeypatch.setattr(resolve, "STEP", 3)
    ids = [*range(40), 7, None]
    df = spark.createDataFrame([*((i, "Red widget") for i in ids), (50, "blue bolt"), (51, None)], "id long, name string")
    got = resolve.similar(df, df).withColumn("task", F.spark_partition_id()).collect()
    want = [(a, b, 1.0) for a in ids for b in ids] + [(50, 50, 1.0)]
    assert sorted(map(repr, ((r.a, r.b, r.ratio) for r in got))) == sorted(map(repr, want))
    assert len({r.task for r in got if r.a != 50}) > 4  # one task a title before


def test_visible_text_of_a_page_is_worked_out_once(spark):
    from quillmesh.plans import catalogue
    from quillmesh.sources import html

    made = html.extract(catalogue.t(spark, "/root/testdata/sf0.001", "pages").select("page_id", "html"))
    dealt = plan(made).split("== Physical Plan ==")[1]
    assert dealt.count("https?://") == 1 and made.columns == ["page_id", "html", "markdown", "title", "js_shell", "verdict"]


def test_each_stage_begins_by_giving_memory_back(spark, monkeypatch):
    import corpus_pipeline as P
    import pytest

    class Work(Exception):
        pass

    def work(*_, **__):
        raise Work

    for name in ("learned", "placed", "strip_repeats", "pack_documents"):
        monkeypatch.setattr(P, name, work)
    heap, docs = spark.sparkContext._jvm.java.lang.Runtime.getRuntime(), spark.createDataFrame([(1, "a")], "doc_id long, text string")
    used = lambda: heap.totalMemory() - heap.freeMemory()
    monkeypatch.setattr(P, "table", lambda *_: docs)
    for _, stage in P.STAGES:
        spark.sparkContext._jvm.java.lang.System.gc()
        held = [spark.sparkContext._jvm.java.util.ArrayList(4_000_000) for _ in range(8)]  # 16 MB each
        before = used()
        for x in held:
            x.trimToSize()  # their arrays are garbage now
        with pytest.raises(Work):
            stage(spark, docs, "")
        assert used() < before - 64_000_000


def test_parts_go_by_numbers_and_floats_travel_as_floats(spark, monkeypatch):
    from pathlib import Path

    import numpy as np
    from pyspark.sql import functions as F

    from quillmesh.operators import neighbours as N
    from quillmesh.sources.kept import shared

    monkeypatch.setattr(N, "PART", 1)
    v = np.random.default_rng(6).normal(size=(600, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    before, told = set(Path(shared(spark)).glob("neighbours-*")), {}
    got = {(r.a, r.b) for r in N.neighbours(df, df, "embedding", "vec_id", 3, cells=40, told=told).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    assert got == {(i, int(j)) for i, s in enumerate(np.round(u @ u.T, 6)) for j in np.lexsort((np.arange(len(v)), -s))[:3]}
    (at,) = set(Path(shared(spark)).glob("neighbours-*")) - before
    for name in ("points", "asked"):
        held = spark.read.parquet(f"{at}/{name}").agg(F.count("*"), F.sum(F.size("keys")), F.sum(F.octet_length("vectors"))).first()
        assert held[0] > 20 and tuple(held)[1:] == (600, 600 * 16 * 4)  # a part a block, and 8 bytes a number, before
    assert (told["parts"], told["lanes"]) == (8, 8)


def test_a_line_is_read_once_for_all_objects_of_a_task(monkeypatch):
    read, units = [], facts.units
    monkeypatch.setattr(facts, "units", lambda line: read.append(line) or units(line))
    told, seen = [("a", "s1", "Fact is. It was.\nOnly."), ("b", "s2", "Fact is.")], facts.Seen()
    made = [facts.folded(None, told, seen.bounded()) for _ in range(5)]
    assert set(made) == {("## Source: a (id:s1)\nFact is. [also: b] It was.\nOnly.", 3, 1, None)}
    assert len(read) == len(set(read)) == 4  # anew for each object before
    monkeypatch.setattr(facts, "KEPT", seen.size)
    assert len(seen.bounded()) == 4
    facts.folded(None, [("a", None, "A new line.")], seen)
    assert len(seen.bounded()) == seen.size == 0


def test_what_is_defused_is_what_each_line_comes_to():
    import random
    import re

    def slow(text: str) -> str:
        lines = (re.sub(r"^[\s#>\-]+", "", re.sub(r"\[(?=also:|superseded:|conflict)", "(", x, flags=re.IGNORECASE)) for x in facts._printed(text).split("\n"))
        return "\n".join(re.sub("#{2,}", "#", x).replace("(id:", "(id :").strip() for x in lines)

    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "B.", " ", "\n", "#", "##", ">", "[ALSO:", "[conflict", "(id:", "\t", "​", "\r\n", " ", "é", "\x00", "²"]) for _ in range(rng.randint(0, 10)))
        assert facts.defused(text) == slow(text)
