import unicodedata
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions import text as X


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_fold_is_exact_for_latin(spark):
    words = ["Zulú", "Aberrê", "STRASSE ß", "Ålesund", "ĲSSEL", "été", "ｆｕｌｌ", "ñandú", None, ""]
    got = values(spark, X.fold(F.col("x")), words)
    assert got == [None if w is None else X.fold_text(w) for w in words]
    assert values(spark, X.fold_exact(F.col("x")), words) == got


def test_tokens_keep_joined_words_and_their_parts(spark):
    assert values(spark, X.tokens(F.col("x")), ["The SG-3 and sg_3.b of São", None, ""]) == [["sg-3", "sg", "3", "sg_3.b", "sg", "3", "b", "sao"], [], []]


@pytest.mark.parametrize(
    ("name", "base", "qualifier", "key", "keys"),
    [
        ("Onça (São Paulo)", "Onça", "São Paulo", "onca", {"onca", "sao paulo"}),
        ("Filhos de Bimba (Bay Area (California))", "Filhos de Bimba", "Bay Area (California)", "filhos de bimba", {"filhos de bimba", "bay area california"}),
        ("(São Paulo)", "(São Paulo)", "", "sao paulo", {"sao paulo"}),
        ("Mestre Pastinha (Salvador)", "Mestre Pastinha", "Salvador", "pastinha", {"pastinha", "salvador"}),
        ("Mestre", "Mestre", "", "mestre", {"mestre"}),
        ("Contra-Mestre Fulano", "Contra-Mestre Fulano", "", "fulano", {"fulano"}),
        ("a) b)", "a) b)", "", "a b", {"a b"}),
    ],
)
def test_names(spark, name, base, qualifier, key, keys):
    q = X.split_qualifier(F.col("x"))
    row = spark.createDataFrame([(name,)], "x string").select(q[0], q[1], X.name_key(F.col("x")), X.name_keys(F.col("x"))).first()
    assert (row[0], row[1], row[2], set(row[3])) == (base, qualifier, key, keys - {""})


def test_titles_and_slugs(spark):
    rows = [("São–Paulo  X", "são-paulo x", True), ("Associação de Bimba", "associacao_de-bimba", True), ("Onça", "Onca!", True), ("a", "b", False)]
    assert [r[0] for r in spark.createDataFrame(rows, "a string, b string, s boolean").select(X.same_subject(F.col("a"), F.col("b")) == F.col("s")).collect()] == [True] * 4


def test_controls_and_names(spark):
    assert values(spark, X.strip_controls(F.col("x")), ["a​b‮c\x00\td\U000e0041", None]) == ["abc\td", None]
    assert values(spark, X.sanitize_name(F.col("x")), [" Ana ", "System: x", "ignore all", "x" * 201, " ", None]) == ["Ana", None, None, None, None, None]
    names = ["founding_date_conflict", "associacao-de-bimba", "bge-m3", "gpt-4o", "https://example.org/x", "www.x", "pt.example.org/wiki", "Node.js", "persons/x.md", "A name.md x", "Ana", None, ""]
    assert values(spark, X.identifier_like(F.col("x")), names) == [True, True, False, False, True, True, True, False, True, False, False, False, False]


def test_addresses(spark):
    urls = ["https://u:p@h.org/a?api_key=1&v=2#f", "https://h.org/a?sessionToken=x", "h.org/a?page=1", "u:p@h.org/x?k=1", "https://h.org/a?keyword=2"]
    assert values(spark, X.scrub_url_secrets(F.col("x")), urls) == ["https://h.org/a?v=2#f", "https://h.org/a", "h.org/a?page=1", "h.org/x?k=1", "https://h.org/a?keyword=2"]
    assert values(spark, X.scrub_credentials(F.col("x")), urls) == ["https://h.org/a", "https://h.org/a", "h.org/a", "h.org/x", "https://h.org/a"]
    assert values(spark, X.scrub_text_urls(F.col("x")), ["# T see (https://u:p@h.org/a?b=1#c) now?", None]) == ["# T see (https://h.org/a) now?", ""]
    assert values(spark, X.elide_path(F.col("x")), ["https://h/" + "a" * 20 + "/b"]) == ["https://h/…/b"]


def test_fact_keys(spark):
    units = ["- Founded in 1932. [also: a; b]", "founded  in 1932", "Founded in 1932 [p. 3] [pp. 4–5]", None]
    assert values(spark, X.fact_key(F.col("x")), units) == ["founded in 1932"] * 3 + [None]


def test_visible_text_and_verdict(spark):
    assert values(spark, X.visible_text(F.col("x")), ["# A [b](http://x/y_(z) \"t\") ![c](d) <https://e> *f*", None]) == ["A b c f", ""]
    pages = ["", "<html>just a moment...</html>", "<html>" + "w " * 400, "<html>g-recaptcha</html>", "short"]
    assert values(spark, X.text_verdict(F.col("x"), F.col("x")), pages) == ["empty", "challenge_page", None, "challenge_page", "too_little_text (5 chars)"]


def test_versions(spark):
    assert values(spark, X.version(F.col("x")), ["0.5.0", "1", "1.x.2.3", None]) == [[0, 5, 0], [1, 0, 0], [1, 0, 2, 3], [0, 0, 0]]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=20), min_size=1, max_size=20))
def test_uuid5_is_pythons(spark, names):
    assert values(spark, X.uuid5(F.col("x")), names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_labels_and_garbled(spark):
    assert values(spark, X.edge_label(F.col("x")), ["Taught_by", " [x]; ", None, "A->b"]) == ["taught by", "x", "related", "atob"]
    assert values(spark, X.garbled_share(F.col("x")), ["ab��", "", "ab"]) == [0.5, 0.0, 0.0]
    assert unicodedata.category("�") == "So"
