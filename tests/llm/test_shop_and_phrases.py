"""Operators 11 to 13 against plain versions, on small tables with nulls, ties, repeated rows, very long texts and clashing names."""

import datetime
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import asof, catalogue, collocations, licenses

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scanned(text):
    """All rules on the whole text, without gates; places are held against each other one by one."""
    words = WORD.findall(low(text))
    canon = " " + " ".join(words) + " "
    places = []
    for r in licenses.signatures():
        for m in re.finditer(r["pattern"], canon):
            first = canon[: m.start()].count(" ") - 1
            places.append((first, first + m.group().count(" "), r["tier"], r["rule"], r["label"]))
    base = [p for p in places if p[2] == 0]

    def hidden(p):
        return p[2] and any(q is not p and 1 <= q[2] <= p[2] and q[0] <= p[0] and q[1] >= p[1] and ((q[0], q[1]) != (p[0], p[1]) or q[2:] < p[2:]) for q in places)

    kept = [p for p in places if not hidden(p)]
    joined = lambda x: ",".join(sorted({p[4] for p in x}))
    starts = [p[0] for p in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), joined(base), joined(kept), max((licenses.WEIGHTS[p[2]] for p in kept), default=0.0)


def license_texts():
    rng = random.Random(5)
    bits = sorted({w for _, _, _, p in licenses.rules() for w in re.findall("[a-z0-9]+", p)} - {"fuck"})
    samples = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "GNU General Public License, version 3 or later", "Apache License, Version 2.0", "CC BY, CC BY; cc by cc by",
               "SPDX-License-Identifier: GPL-2.0-only", "gpl v2 only, GPLv3; LGPL v2.1", "Creative Commons Attribution-ShareAlike 4.0 International", "été ñ gnu\x00general public license",
               "Permission is hereby granted, free of charge, to any person obtaining a copy", "Kpache İ MIT LICENSE İ", "BSD 3-Clause License (c) Copyright 2020. All rights reserved."]
    # Words of the rules in any order, so that rules match in part, within and across one another.
    mixed = [" ".join(rng.choice([rng.choice(bits), "license", "by", "2", "0", rng.choice(samples), "the"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    said = []
    for _, _, _, p in licenses.rules():
        p = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\(\?=[^)]*\)", "", p))
        said.append(re.sub(r"\s+", " ", re.sub(r"\[cs\]", "s", p).replace("?", "").replace("[0-9]", "4").replace("[^ ]+", "x")))
    return [*samples, *mixed, *said, None, "", " ,.;", "MIT license " * 4_000, "x" * 200_000, "mit licence and the mit license"]


def test_license_scan_against_all_rules(spark, tmp_path):
    texts = license_texts()
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(1, texts[1], None, None, None), (None, texts[2], None, None, None), (1, texts[3], None, None, None)]
    clash = ("rule", "tier", "label", "first", "last", "kept", "file", "place", "keyword", "n_words", "_canon", "i", "hit")
    spark.createDataFrame([(*r, *[7] * len(clash)) for r in rows], f"{DOC}, " + ", ".join(f"`{c}` int" for c in clash)).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.queries()["op11_license_scan"](spark, str(tmp_path)).collect()
    want = Counter((r[0], *scanned(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got) == want
    assert len({x for r in got for x in r.labels.split(",")}) > 80


def test_spans_say_where(spark):
    df = spark.createDataFrame([(1, "Foo. Licensed under CC BY-NC 4.0 or the MIT License!")], "doc_id long, text string")
    (r,) = licenses.license_scan(df).collect()
    assert [(x.first, x.last, x.label) for x in r.spans] == [(1, 2, "license-reference"), (3, 4, "cc-by"), (3, 7, "cc-by-nc-4.0"), (9, 11, "mit"), (10, 11, "mit")]


def test_gates_lose_nothing():
    for r in licenses.signatures():
        assert r["needs"] and re.search(licenses.keyword_pattern({r["keyword"]}), f" {r['keyword']} ")
    assert licenses.plain_parts("(?:gnu )?general public licen[cs]e (?:v )?2(?: 0)?") == ["general public licen", "e ", "2"]
    assert licenses.plain_parts("abc? d") == ["ab", " d"]


# As-of join

EPOCH = datetime.datetime(1970, 1, 1)


def us(t):
    return None if t is None else (t - EPOCH) // datetime.timedelta(microseconds=1)


def crc(x):
    return zlib.crc32(str(x).encode())


def used(i, t):
    u = us(t)
    return u if u is None or i is None or crc(i) % 2 == 0 else u - u % asof.DAY


def matched(clicks, sales):
    orders = defaultdict(list)
    for sale, client, total, sold, priority in sales:
        at, cents = used(sale, sold), None if total is None else int((100 * total + 0.5) // 1)
        if client is None or at is None:
            continue
        orders[client].append((at, sale, priority, cents))
        if sale is not None and crc(sale) % 3:
            orders[client].append((at, -1 - sale, None if priority is None else 6 - priority, cents))
    out = []
    for click, client, ts in set(clicks):
        u = used(click, ts)
        near = [o for o in orders[client] if u is not None and client is not None and o[0] <= u]
        top = max((o[0] for o in near), default=None)
        if top is None or u - top > asof.TOLERANCE:
            out.append((click, client, u, None, None, None, 0))
            continue
        tied = [o for o in near if o[0] == top]
        best = min(tied, key=lambda o: (o[2] is None, -(o[2] or 0), o[1] is None, o[1] or 0))
        out.append((click, client, u, best[1], u - top, best[3], len(tied)))
    return Counter(out)


@pytest.fixture(scope="module")
def shop():
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    moment = lambda: start + datetime.timedelta(hours=rng.randrange(0, 400), microseconds=rng.choice([0, 0, 1, 999_999]))
    clients = [7] * 6 + [1, 2, 3, None, -4]
    clicks = [(i, rng.choice(clients), rng.choice([moment(), moment(), None]) if i % 9 == 0 else moment()) for i in range(600)]
    sales = [(i, rng.choice(clients), rng.choice([0.0, 12.345, 99.995, None]), moment() if i % 11 else None, rng.choice([1, 2, 3, 4, 5, None])) for i in range(300)]
    # One order row very often, before the epoch, and without an id.
    sales += [(900, 7, 5.0, start, 3)] * 400 + [(None, 7, 1.0, start, None), (None, None, None, None, None), (901, 2, 1.0, datetime.datetime(1969, 12, 30, 5), 1)]
    clicks += clicks[:50] + [(None, 7, start), (700, 2, datetime.datetime(1969, 12, 31, 1, 2, 3)), (701, None, None)]
    return clicks, sales


def test_asof_join_in_any_number_of_parts(spark, shop, tmp_path, monkeypatch):
    clicks, sales = shop
    spark.createDataFrame([(*c, 1, 2) for c in clicks], "click_id long, client_id long, ts timestamp_ntz, part int, `last` int").write.parquet(str(tmp_path / "clicks.parquet"))
    spark.createDataFrame([(*s, 1, 2) for s in sales], "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int, `key` int, t int").write.parquet(str(tmp_path / "sales.parquet"))
    want = matched(clicks, sales)
    names = ("click_id", "client_id", "ts_us", "sale_id", "lag_us", "total_cents", "n_tied")
    query = catalogue.queries()["op12_asof_join"]
    assert Counter(tuple(r[n] for n in names) for r in query(spark, str(tmp_path)).collect()) == want
    # Few summaries a block: the prefix scan runs over blocks of blocks; and the carries are joined by a shuffle.
    monkeypatch.setattr(asof, "BLOCK", 3)
    monkeypatch.setattr(asof, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert Counter(tuple(r[n] for n in names) for r in query(spark, str(tmp_path)).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_asof_of_copies_that_differ(spark):
    t = datetime.datetime(2024, 1, 1, 3)
    rows = [(5, None, t), (5, 3, None), (5, 4, t), (5, 2, t), (5, 1, t + datetime.timedelta(hours=1))]
    (r,) = asof.clicks_of(spark.createDataFrame(rows, "click_id long, client_id long, ts timestamp_ntz")).collect()
    assert (r.client_id, r.ts_us) == (2, used(5, t))


# Collocations


def mined(rows, support, longest, first):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        held = {p[i:j] for p, a in cands.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= cands[p[i:j]]}
        scored = []
        for p, a in cands.items():
            if p not in held:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:first])]
    return Counter(out)


def phrase_rows():
    rng = random.Random(9)
    words = ["the", "North", "river", "été", "ñ", "a\x00b", "x", "stone", "𝔘"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", "\n", "! "]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "en\x00"]), say(rng.randrange(0, 60))) for _ in range(120)] + [("en", None), (None, ""), ("de", " ,.;")]
    return rows + [("en", "the north river runs by. " * 3)] * 40 + [("de", "x " * 30_000), ("en", "y" * 100_000)]


def test_collocations_against_counts(spark, monkeypatch):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").select("text", F.coalesce("lang", F.lit("und")).alias("lang")).repartition(5)
    plain = [(lang or "und", text) for lang, text in rows]
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    monkeypatch.setattr(collocations, "CHUNK", 2_000)
    for first, support, bits in ((2000, 5, 18), (7, 12, 16)):
        got = collocations.collocations(df, first=first, support=support, bits=bits).collect()
        assert Counter(tuple(r[n] for n in names) for r in got) == mined(plain, support, 5, first)


def test_collocations_are_exact_beyond_64_bits(spark):
    expr = "(cast(a AS decimal(19,0)) * cast(n AS decimal(19,0)) * cast(1000 AS decimal(4,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"
    for a, n, l, r in ((10**12 + 7, 10**14 + 9, 10**13 + 3, 10**12 + 11), (10**11 + 1, 10**15 + 1, 10**11 + 3, 10**11 + 5)):
        row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr(f"{expr} AS s").first()
        assert row.s == 1000 * a * n // (l * r)


def test_buckets_of_phrases_agree():
    c = collocations._Chunk(["the ñ, river the".encode()], ["en"])
    assert int(c.hashes(2)[0]) == collocations.gram_hash("en", "the ñ") and list(c.valid(2)) == [True, False, True]
