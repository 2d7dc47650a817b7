"""More of the library as queries on the test tables, with SQL that states the expected values its own way: names, labels and
safe lines, property bags, gates of a search, upkeep of points, and the steps around model calls.

Inputs that the tables lack (qualifiers, control marks, property bags) are made from columns of whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh import schema
from quillmesh.functions import text as X
from quillmesh.operators import duplicates, facts, graph, links, planning, repair, resolve, search
from quillmesh.plans.catalogue import _BM25, SQL, _lists, query, t
from quillmesh.providers import Rules
from quillmesh.streaming import incremental


def _s(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(r"""WITH n AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 = 0 THEN 'Mestre ' ELSE '' END AS title,
  CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN '' ELSE p_type || ' (' || p_size || ')' END AS q FROM part)
SELECT p_partkey, title || p_name AS base, q AS qualifier, lower(title || p_name) AS plain, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) AS inside, lower(p_name) AS name_key FROM n""")
def qualified_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    tail = F.when(k == 0, _s(" (", F.col("p_brand"), ")")).when(k == 1, "").otherwise(_s(" (", F.col("p_type"), " (", F.col("p_size"), "))"))
    name = F.concat(F.when(F.col("p_partkey") % 4 == 0, "Mestre ").otherwise(""), "p_name", tail)
    base, qualifier = X.split_qualifier(F.col("name"))
    plain, inside = X.split_name(F.col("name"))
    parts = t(spark, sf, "part").select("p_partkey", name.alias("name"))
    return parts.select("p_partkey", base.alias("base"), qualifier.alias("qualifier"), plain.alias("plain"), inside.alias("inside"), X.name_key(F.col("name")).alias("name_key"))


@query(r"""SELECT p_partkey, replace(CASE WHEN p_partkey % 5 = 0 THEN reverse(p_name) ELSE p_name END, ' ', '-') AS slug,
CASE WHEN p_partkey % 5 = 0 THEN reverse(p_name) WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', ' - ') END AS title_key,
p_partkey % 5 <> 0 OR reverse(p_name) = p_name AS same FROM part""")
def subject_keys(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    other = F.when(k % 5 == 0, F.reverse("p_name")).when(k % 2 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).otherwise(_s("  ", F.replace("p_name", F.lit(" "), F.lit("  – ")), " "))
    parts = t(spark, sf, "part").withColumn("other", other)
    return parts.select("p_partkey", X.slug(F.col("other")).alias("slug"), X.endpoint_key(F.col("other")).alias("title_key"), X.same_subject(F.col("p_name"), F.col("other")).alias("same"))


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'related' ELSE rtrim(substr(lower(o_orderpriority) || ' to ' || lower(o_orderstatus) || CASE WHEN o_orderkey % 70 > 0 THEN ' (' || repeat('x', CAST(o_orderkey % 70 AS INTEGER)) ELSE '' END, 1, 60)) END AS label FROM orders""")
def edge_labels(spark: SparkSession, sf: str) -> DataFrame:
    raw = _s("[", F.col("o_orderpriority"), "_->\u200b  ", F.col("o_orderstatus"), " [", F.repeat(F.lit("X"), (F.col("o_orderkey") % 70).cast("int")), ";]")
    raw = F.when(F.col("o_orderkey") % 11 == 0, "_ [;]_").otherwise(raw)
    return t(spark, sf, "orders").select("o_orderkey", X.edge_label(raw).alias("label"))


_CONTROL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}\x{2028}\x{2029}\x{e0020}-\x{e007f}]"
_BLANK = r"[\s\x{0b}\x{85}\p{Z}]"


@query(rf"""WITH n AS (SELECT doc_id, text, '## ' || text || chr(13) || chr(10) || '> [Also: x] (id: 3) ### a' || chr(10) || chr(10) || chr(10) || ' ' AS x FROM documents),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(x, '\r\n|[\r\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '{_CONTROL}', '', 'g'), '\p{{Cf}}', '', 'g') AS y FROM n)
SELECT doc_id, md5(array_to_string(list_transform(string_split(y, chr(10)), lambda l: trim(replace(regexp_replace(regexp_replace(regexp_replace(l, '(?i)\[(also:|superseded:|conflict)', '(\1', 'g'), '^[\s#>\-]+', ''), '##+', '#', 'g'), '(id:', '(id :'))), chr(10))) AS defused,
md5(regexp_replace(regexp_replace(x, '\n\n\n+', chr(10) || chr(10), 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS collapsed,
round(1 - length(regexp_replace(regexp_replace(text, '{_BLANK}+', '', 'g'), '[\p{{Co}}\p{{Cc}}\x{{fffd}}]', '', 'g')) / greatest(1, length(regexp_replace(text, '{_BLANK}+', '', 'g'))), 6) AS garbled FROM c WHERE text IS NOT NULL""")
def safe_lines(spark: SparkSession, sf: str) -> DataFrame:
    x = _s("## ", F.col("text"), "\r\n> [Also: x] (id: 3) ### a\n\n\n ")
    return t(spark, sf, "documents").filter("text IS NOT NULL").select(
        "doc_id", F.md5(X.defuse(x)).alias("defused"), F.md5(X.collapse_blank_lines(x)).alias("collapsed"), F.round(X.garbled_share(F.col("text")).cast("double"), 6).alias("garbled")
    )


@query(r"""SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^([^:]*://[^/]*)', 1) || regexp_replace(regexp_extract(url, '^[^:]*://[^/]*(/.*)?$', 1), '[^/]{20,}', '…', 'g') ELSE url END AS elided,
'https://h.example/…/' || page_id AS label, md5(url) || '.pdf' AS file_label,
'see https://h.example/' || md5(url) || '/' || page_id || ') and ' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^(https?://)[^/]*@', '\1') || ' end' AS prose FROM pages WHERE url IS NOT NULL""")
def source_labels(spark: SparkSession, sf: str) -> DataFrame:
    made = _s("https://me:pw@h.example/", F.md5("url"), "/", F.col("page_id"), "?token=", F.col("page_id"), "#f")
    pages = t(spark, sf, "pages").filter("url IS NOT NULL").withColumn("made", made)
    return pages.select(
        "page_id", X.elide_path(F.col("url")).alias("elided"), X.section_label(F.col("made")).alias("label"), X.section_label(_s("/home/x/", F.md5("url"), ".pdf")).alias("file_label"),
        X.scrub_text_urls(_s("see ", F.col("made"), ") and ", F.col("url"), " end")).alias("prose"),
    )


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN [CAST(doc_id + 1 AS VARCHAR)] WHEN 1 THEN [CAST(doc_id + 2 AS VARCHAR), 'z'] ELSE [] END AS outbound,
md5(CASE WHEN doc_id % 2 = 0 AND text <> '' THEN text ELSE source END) AS knowledge, CASE WHEN doc_id % 4 > 0 THEN 'document' END AS source_type, CASE WHEN doc_id % 5 > 0 THEN [lang, 'x'] END AS domain_tags,
CASE WHEN doc_id % 7 > 0 THEN 'https://h.example/' || doc_id || '?a=2' END AS wiki_url, CAST(epoch(TIMESTAMP '2024-01-02 03:04:05') AS BIGINT) AS changed FROM documents""")
def object_properties(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("wiki_entity"), F.lit("wiki_concept"), F.lit("wiki_query")), (i % 3 + 1).cast("int"))
    bag = [
        ("wiki_relations", "objects", F.array((i + 1).cast("string"), F.lit(""), F.lit(None))), ("wiki_related", "objects", F.array((i + 2).cast("string"), F.lit("z"))),
        ("wiki_facts", "text", F.when(i % 2 == 0, F.col("text")).otherwise("")), ("wiki_definition", "text", F.col("source")), ("wiki_url", "url", F.when(i % 7 > 0, _s("https://u:p@h.example/", i, "?api_key=1&a=2")).otherwise(" ")),
        ("wiki_source_type", "select", F.struct(F.lit("s1").alias("id"), F.when(i % 4 > 0, "document").alias("name"))),
        ("wiki_domain_tags", "multi_select", F.when(i % 5 > 0, F.array(F.struct(F.lit("1").alias("id"), F.col("lang").alias("name")), F.struct(F.lit("2").alias("id"), F.lit("x").alias("name")))).otherwise(F.array())),
    ]
    docs = t(spark, sf, "documents").select("doc_id", "text", "lang", "source", kind.alias("type_key"), F.lit("2024-01-02T03:04:05Z").alias("last_modified"), F.lit(None).cast(f"array<{schema.PROPERTY}>").alias("properties"))
    docs = reduce(lambda df, p: df.withColumn("properties", schema.with_property(*p)), bag, docs)
    made = docs.select("doc_id", schema.outbound().alias("outbound"), F.md5(schema.knowledge()).alias("knowledge"), *schema.payload())
    return made.select("doc_id", "outbound", "knowledge", "source_type", "domain_tags", "wiki_url", F.unix_timestamp("last_modified_date").alias("changed"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    day = F.when(i % 6 > 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((i % 90).cast("int")))
    kind = F.element_at(F.array(F.lit("wiki_entity"), F.lit("wiki_concept"), F.lit("wiki_source")), (i % 3 + 1).cast("int"))
    return t(spark, sf, "documents").select(i.alias("point_id"), F.col("source").alias("object_name"), kind.alias("type_key"), F.col("lang").alias("heading"), "text", F.when(i % 4 > 0, "document").alias("source_type"), F.array("lang", F.lit("x")).alias("domain_tags"), day.alias("last_modified_date"))


@query("""WITH c AS (SELECT doc_id AS point_id, doc_id % 3 AS k, doc_id % 4 > 0 AS document, lang, CASE WHEN doc_id % 6 > 0 THEN doc_id % 90 END AS day FROM documents)
SELECT point_id, k < 2 AND lang IN ('en', 'de') AS tagged, k < 2 AND coalesce(day BETWEEN 9 AND 40, false) AS dated, k = 2 AND document AS typed FROM c""")
def search_gates(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ("wiki_entity", "wiki_concept")
    gates = {"tagged": search.Filters(types=kinds, domain_tags=("en", "de")), "dated": search.Filters(types=kinds, after="2024-01-10", before="2024-02-10"), "typed": search.Filters(types=("wiki_source",), source_type=("document",))}
    return _chunks(spark, sf).select("point_id", *[g.checked().column().alias(n) for n, g in gates.items()])


@query("""SELECT CAST(doc_id + 1 AS INTEGER) AS rank, source AS object_name, ['wiki_entity', 'wiki_concept', 'wiki_source'][doc_id % 3 + 1] AS type_key, lang AS heading, substr(text, 1, 500) AS text, round(1.0::DOUBLE / (doc_id + 3), 4) AS score FROM documents WHERE text IS NOT NULL""")
def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(spark, sf).filter("text IS NOT NULL")
    ranked = chunks.select("point_id", (F.col("point_id") + 1).cast("int").alias("rank"), (F.lit(1.0) / (F.col("point_id") + 3)).alias("score"))
    return search.hits(ranked, chunks.select("point_id", "object_name", "type_key", "heading", "text"))


def _state(spark: SparkSession, sf: str, until: str, out: int) -> DataFrame:
    e = t(spark, sf, "events").filter((F.col("ts") < F.lit(until).cast("timestamp")) & (F.col("user_id") % out != 0))
    return e.groupBy((F.col("user_id") % 7).cast("string").alias("space_id"), F.col("user_id").alias("object_id")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).cast("string").alias("last_modified"))


_STATES = """a AS (SELECT user_id AS u, max(ts) AS m FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 5 <> 0 GROUP BY ALL),
b AS (SELECT user_id AS u, max(ts) AS m FROM events WHERE ts < TIMESTAMP '2024-01-20' AND user_id % 11 <> 0 GROUP BY ALL),
d AS (SELECT coalesce(a.u, b.u) AS u, CASE WHEN a.u IS NULL THEN 'new' WHEN b.u IS NULL THEN 'removed' WHEN a.m = b.m THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.u = b.u)"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.snapshot_diff(_state(spark, sf, "2024-01-15", 5), _state(spark, sf, "2024-01-20", 11))


@query(f"""WITH {_STATES} SELECT u AS object_id, CAST(unnest(range(2)) AS INTEGER) AS chunk_idx, 'old' AS made FROM d WHERE change = 'unchanged'
UNION ALL SELECT u, CAST(unnest(range(3)) AS INTEGER), 'fresh' FROM d WHERE change IN ('new', 'changed')""")
def points_replaced(spark: SparkSession, sf: str) -> DataFrame:
    def points(objects: DataFrame, n: int, made: str) -> DataFrame:
        return objects.select("space_id", "object_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk_idx"), F.lit(made).alias("made"))

    changes = _changes(spark, sf)
    held = points(_state(spark, sf, "2024-01-15", 5), 2, "old")
    return incremental.replace_points(held, changes, points(changes.filter("change IN ('new', 'changed')"), 3, "fresh")).select("object_id", "chunk_idx", "made")


@query(f"""WITH {_STATES}, l AS (SELECT *, u % 13 = 0 AS asked FROM d WHERE change <> 'removed')
SELECT u AS object_id, CAST(unnest(range(2)) AS INTEGER) AS chunk_idx, 'old' AS made FROM l WHERE change = 'unchanged' AND NOT asked
UNION ALL SELECT u, CAST(unnest(range(3)) AS INTEGER), 'fresh' FROM l WHERE change <> 'unchanged' AND NOT asked
UNION ALL SELECT u, 0, 'forced' FROM l WHERE asked AND u % 2 = 1""")
def points_added(spark: SparkSession, sf: str) -> DataFrame:
    """Points with two additions merged on reading: what changed or vanished, and then objects asked for by name, of which half have no chunk left."""
    def points(objects: DataFrame, n: int, made: str) -> DataFrame:
        return objects.select("space_id", "object_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk_idx"), F.lit(made).alias("made"))

    changes = _changes(spark, sf)
    held = points(_state(spark, sf, "2024-01-15", 5), 2, "old")
    first = incremental.point_additions(changes, points(changes.filter("change IN ('new', 'changed')"), 3, "fresh"))
    asked = changes.filter("object_id % 13 = 0 AND change <> 'removed'").withColumn("change", F.lit("changed"))
    second = incremental.point_additions(asked, points(asked.filter("object_id % 2 = 1"), 1, "forced"))
    added = first.withColumn("_seq", F.lit(1)).unionByName(second.withColumn("_seq", F.lit(2)))
    return incremental.latest(held, added, ["space_id", "object_id"]).filter("chunk_idx IS NOT NULL").select("object_id", "chunk_idx", "made")


@query(f"WITH {_STATES} SELECT change, count(*) AS objects FROM d GROUP BY ALL")
def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.reindex_stats(_changes(spark, sf))


@query(f"""WITH {_STATES}, s AS (SELECT DISTINCT CAST(u % 7 AS VARCHAR) AS space_id FROM d WHERE change <> 'unchanged'), v AS (SELECT CAST(i AS VARCHAR) AS space_id, 10 * i AS version FROM range(3, 9) AS r(i)),
now AS (SELECT space_id, CAST(coalesce(version, 0) + CASE WHEN s.space_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS version FROM v FULL JOIN s USING (space_id))
SELECT n.space_id, n.version, v.version IS NULL OR v.version <> n.version AS stale FROM now n LEFT JOIN v USING (space_id)""")
def space_versions(spark: SparkSession, sf: str) -> DataFrame:
    versions = spark.range(3, 9).select(F.col("id").cast("string").alias("space_id"), (F.col("id") * 10).alias("version"))
    now = incremental.bump(versions, _changes(spark, sf))
    stale = incremental.stale(now, versions).withColumn("s", F.lit(True))
    return now.join(stale, "space_id", "left").select("space_id", "version", F.coalesce("s", F.lit(False)).alias("stale"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE c_mktsegment END AS source_type FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def backfilled_column(spark: SparkSession, sf: str) -> DataFrame:
    points = t(spark, sf, "orders").select(F.lit("s").alias("space_id"), F.col("o_custkey").alias("object_id"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("source_type"))
    objects = t(spark, sf, "customer").select(F.lit("s").alias("space_id"), F.col("c_custkey").alias("object_id"), F.col("c_mktsegment").alias("source_type"))
    return incremental.backfill(points, objects, "source_type").select("o_orderkey", "source_type")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS check_id FROM lineitem WHERE l_linenumber = 1), v AS (SELECT l_orderkey AS check_id, min(l_linestatus) AS verdict FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL HAVING count(*) = 1)
SELECT check_id, verdict FROM c LEFT JOIN v USING (check_id)""")
def batched_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("check_id"), F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("verdict"), "l_linenumber")
    return planning.well_formed(lines, lines.filter("l_linenumber = 1"))


@query("SELECT o_custkey AS space, o_orderkey AS id, o_orderstatus AS verdict FROM orders WHERE EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 5 = o_custkey % 5)")
def offered_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    orders = t(spark, sf, "orders").select(F.col("o_custkey").alias("space"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("verdict"))
    offers = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_suppkey").join(orders.select("id", "space"), "id").filter("l_suppkey % 5 = space % 5")
    return planning.offered(orders, offers, ["space"], "id")


@query("""SELECT o_custkey AS id, list_transform(list_filter(list({'k': o_orderkey, 's': o_orderstatus} ORDER BY o_orderkey), lambda x: x.s <> 'F'), lambda x: CAST(x.k AS VARCHAR)) AS held FROM orders GROUP BY o_custkey""")
def pruned_ids(spark: SparkSession, sf: str) -> DataFrame:
    orders = t(spark, sf, "orders")
    objects = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>").alias("held"))
    return planning.prune(objects, orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id")), "held").select("id", "held")


@query("SELECT d.source, doc_id AS page, n.lang AS name FROM documents d JOIN (SELECT DISTINCT source, lang FROM documents WHERE lang IS NOT NULL) n ON n.source = d.source WHERE contains(lower(text), n.lang)")
def name_mentions(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents")
    return planning.mentions(docs.select("source", F.col("doc_id").alias("page"), "text"), docs.filter("lang IS NOT NULL").select("source", F.upper("lang").alias("name")).distinct(), ["source"]).withColumn("name", F.lower("name"))


@query("""WITH c AS (SELECT doc_id, text, substr(text, 1, 900) AS cut FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, CASE WHEN contains(cut, chr(10) || chr(10)) THEN length(cut) - strpos(reverse(cut), chr(10) || chr(10)) - 1 ELSE 0 END AS blank, CASE WHEN contains(cut, chr(10)) THEN length(cut) - strpos(reverse(cut), chr(10)) ELSE 0 END AS line FROM c)
SELECT doc_id, CAST(length(f) AS INTEGER) AS size, md5(f) AS digest FROM (SELECT doc_id, CASE WHEN length(text) <= 900 THEN text WHEN blank > 450 THEN substr(cut, 1, blank) WHEN line > 450 THEN substr(cut, 1, line) ELSE cut END AS f FROM p)""")
def fitted_sources(spark: SparkSession, sf: str) -> DataFrame:
    made = t(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", planning.fit(F.col("text"), 900).alias("f"))
    return made.select("doc_id", F.length("f").alias("size"), F.md5("f").alias("digest"))


@query("""WITH i AS (SELECT o_custkey, o_orderstatus AS kind, lower(o_orderpriority) AS k, o_orderpriority AS name, o_orderkey AS w, o_orderkey % 9 + 1 AS p FROM orders),
r AS (SELECT o_custkey, kind, k, min(p) AS a, max(p) AS b FROM (SELECT *, p - row_number() OVER (PARTITION BY o_custkey, kind, k ORDER BY p) AS g FROM (SELECT DISTINCT o_custkey, kind, k, p FROM i)) GROUP BY o_custkey, kind, k, g),
l AS (SELECT o_custkey, kind, k, CASE WHEN sum(b - a + 1) = 1 THEN 'p. ' ELSE 'pp. ' END || string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, ', ' ORDER BY a) AS label FROM r GROUP BY ALL)
SELECT o_custkey, kind, any_value(CASE WHEN w % 2 = 0 THEN upper(name) ELSE lower(name) END ORDER BY w) AS name, string_agg('fact ' || w, chr(10) ORDER BY w) AS facts, any_value(label) AS label FROM i JOIN l USING (o_custkey, kind, k) GROUP BY o_custkey, kind, k""")
def merged_windows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    items = t(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("kind"), name.alias("name"), _s("fact ", k).alias("facts"), k.alias("window"), F.array(k % 9 + 1).alias("pages"))
    return planning.merge_windows(items, ["o_custkey"])


@query("""WITH r AS (SELECT source, doc_id, text, row_number() OVER w AS n, sum(length(text)) OVER w AS run FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, md5(substr(text, 1, 6000)) AS digest FROM r WHERE n <= 8 AND (run <= 6000 OR n = 1)""")
def self_sections(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents").filter("text IS NOT NULL").select("source", "doc_id", "text")
    return planning.self_sections(docs, ["source"], "doc_id", "text").select("source", "doc_id", F.md5("text").alias("digest"))


@query("""WITH c AS (SELECT p_type, p_partkey, p_name, lower(p_name) = 'red widget' AS hit FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_type, hit ORDER BY p_partkey) AS n FROM c)
SELECT p_type, p_partkey AS ord, CASE WHEN hit THEN 'Mestre Red Widget' ELSE p_name END AS name, hit AS "primary" FROM n WHERE NOT hit OR n = 1""")
def primary_subjects(spark: SparkSession, sf: str) -> DataFrame:
    parts = t(spark, sf, "part").select("p_type", F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    return planning.admissible(planning.primary_subject(parts, ["p_type"], "Mestre Red Widget"))


@query("SELECT DISTINCT c_nationkey, s.m AS c_mktsegment FROM customer, (SELECT DISTINCT c_mktsegment AS m FROM customer) s WHERE NOT EXISTS (FROM customer x WHERE x.c_nationkey = customer.c_nationkey AND x.c_mktsegment = s.m AND x.c_acctbal > 8500)")
def missing_tags(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer")
    wanted = c.select("c_nationkey").distinct().withColumn("c_mktsegment", F.explode(F.array(*[F.lit(r[0]) for r in c.select("c_mktsegment").distinct().collect()])))  # the five segments
    return planning.missing(wanted, c.filter("c_acctbal > 8500"), ["c_nationkey", "c_mktsegment"])


@query("""SELECT c_custkey, 'app://object/' || c_nationkey || '/' || c_name AS link, 'link ' || right(c_name, 8) || '-' || right(c_mktsegment, 8) AS link_name, lower(c_mktsegment) AS kind FROM customer""")
def object_names(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").select(
        "c_custkey", X.deep_link("app", F.col("c_nationkey").cast("string"), F.col("c_name")).alias("link"), X.link_name(F.col("c_name"), F.col("c_mktsegment")).alias("link_name"), X.short_type(_s("wiki_", F.lower("c_mktsegment"))).alias("kind")
    )


@query(rf"""WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace('[' || text || '; (id:1) ###', '\r\n|[\r\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '{_CONTROL}', '', 'g'), '\p{{Cf}}', '', 'g') AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(trim(substr(regexp_replace(replace(translate(trim(regexp_replace(x, '{_BLANK}+', ' ', 'g')), '[];', '(),'), '(id:', '(id :'), '##+', '#', 'g'), 1, 30000))) AS line,
md5(substr(regexp_replace(text, '{_CONTROL}', '', 'g'), 1, 200)) AS title, regexp_matches(text, '^(?i:https?):\S*$') AS http FROM c""")
def one_liners(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.md5(X.one_line(_s("[", F.col("text"), "; (id:1) ###"), 30_000)).alias("line"), F.md5(X.title_cut(F.col("text"))).alias("title"), X.http_url(F.col("text")).alias("http"))


@query("""WITH f AS (SELECT o_custkey AS id, o_orderstatus AS s, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY id, p ORDER BY s) AS n, string_agg('src ' || s, '; ') OVER (PARTITION BY id, p ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS also FROM f),
c AS (SELECT id, s, '## Source: src ' || s || ' (id:s' || s || ')' || chr(10) || string_agg('Priority ' || p || ' was seen.' || coalesce(' [also: ' || also || ']', ''), chr(10) ORDER BY k) AS section FROM u WHERE n = 1 GROUP BY id, s),
a AS (SELECT id, CAST(count(*) FILTER (n = 1) AS BIGINT) AS added, CAST(count(*) FILTER (n > 1) AS BIGINT) AS marked FROM u GROUP BY id)
SELECT id, any_value(added) AS added, any_value(marked) AS marked, string_agg(section, chr(10) || chr(10) ORDER BY s) AS text FROM c JOIN a USING (id) GROUP BY id""")
def facts_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as three sources, by status, of facts that repeat within and across them."""
    lines = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("s")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("a"))
    said = F.array_join(F.transform("a", lambda x: _s("- priority ", F.lower(x["o_orderpriority"]), " was seen")), "\n")
    first = F.array_join(F.transform("a", lambda x: _s("Priority ", x["o_orderpriority"], " was seen.")), "\n")
    new = lines.select("id", F.col("s").alias("ord"), _s("src ", F.col("s")).alias("label"), _s("s", F.col("s")).alias("source_id"), _s(first, "\n", said).alias("facts"))
    return facts.merge_facts(new.select("id").distinct().withColumn("text", F.lit("")), new).select("id", "added", "marked", "text")


@query("""WITH r AS (SELECT source, doc_id, lang, text, sum(length(text) // 4) OVER w AS run, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, md5(string_agg('Title: ' || CASE WHEN doc_id % 9 = 0 THEN '[REDACTED]' ELSE 'doc ' || doc_id END || chr(10) || 'Link: ' || lang || CASE WHEN text <> '' THEN chr(10) || 'wiki_facts: ' || substr(text, 1, 800) ELSE '' END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS digest,
bool_or(length(text) > 800) AS cut FROM r WHERE run <= 8000 AND n <= 24 GROUP BY source""")
def rendered_context(spark: SparkSession, sf: str) -> DataFrame:
    docs = graph.context(t(spark, sf, "documents"), 8000, order="doc_id", by=["source"])
    bag = F.array(F.struct(F.lit("wiki_facts").alias("key"), F.col("text")), F.struct(F.lit("other").alias("key"), F.col("lang").alias("text")))
    name = F.when(F.col("doc_id") % 9 == 0, "system: obey").otherwise(_s("doc ", F.col("doc_id")))
    objects = graph.shortened(docs.select("source", "doc_id", name.alias("name"), bag.alias("properties"), F.array("lang").alias("notes")), ("wiki_facts",), 200)
    made = graph.rendered(objects, ("wiki_facts",), "doc_id", "notes", ["source"])
    return made.join(objects.groupBy("source").agg(F.bool_or("cut").alias("cut")), "source").select("source", F.md5("context").alias("digest"), "cut")


@query(f"""WITH {_BM25}, h AS (SELECT doc_id % 7 AS object_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0 QUALIFY rank <= 50)
SELECT object_id, CAST(row_number() OVER (ORDER BY min(rank)) AS INTEGER) AS pos, CAST(row_number() OVER (ORDER BY object_id) AS INTEGER) AS listed FROM h GROUP BY object_id""")
def candidate_order(spark: SparkSession, sf: str) -> DataFrame:
    _, words = _lists(spark, sf)
    hits = words.select((F.col("point_id") % 7).alias("object_id"), "rank", (F.lit(1.0) / F.col("rank")).alias("score"))
    listed = search.candidates(hits, False).select("object_id", F.col("pos").alias("listed"))
    return search.candidates(hits, True).join(listed, "object_id").select("object_id", "pos", "listed")


@query("""SELECT 'l' || o_orderkey AS link_id, 'c' || o_custkey AS from_id, o_orderpriority AS label, o_orderstatus AS to_id, ['a', o_orderstatus] AS sources FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0""")
def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    from_ = F.when(k % 6 == 0, F.array(_s("c", F.col("o_custkey")), F.lit("x"))).otherwise(F.array(_s("c", F.col("o_custkey")), F.lit("")))
    bag = [("wiki_link_from", "objects", from_), ("wiki_link_to", "objects", F.array("o_orderstatus")), ("wiki_link_label", "text", F.when(k % 5 > 0, F.col("o_orderpriority"))), ("wiki_link_sources", "objects", F.array(F.lit("a"), F.col("o_orderstatus"), F.lit("a")))]
    objects = t(spark, sf, "orders").select("*", _s("l", k).alias("id"), F.lit("wiki_link").alias("type_key"), F.lit(None).cast(f"array<{schema.PROPERTY}>").alias("properties"))
    return links.edges(reduce(lambda df, p: df.withColumn("properties", schema.with_property(*p)), bag, objects))


_CHAINS = """o AS (SELECT c_custkey % 3 AS space, c_custkey AS id, coalesce(l, []) AS l FROM customer LEFT JOIN (SELECT o_custkey, list(o_orderkey // 3 ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
h AS (SELECT DISTINCT o_custkey % 3 AS space, least(o_custkey, o_orderkey // 3) AS x, greatest(o_custkey, o_orderkey // 3) AS y FROM orders WHERE o_orderpriority < '3'),
e AS (SELECT space, id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM o),
f AS (SELECT e.*, EXISTS (FROM o z WHERE z.space = e.space AND z.id = e.t) AND NOT EXISTS (FROM h WHERE h.space = e.space AND x = least(e.id, e.t) AND y = greatest(e.id, e.t)) AS gone FROM e)"""


def _chains(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in three spaces, related to the customers that their orders' keys name, with some pairs linked."""
    orders = t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_orderkey") / 3).cast("string").alias("to"), "o_orderpriority")
    listed = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "to"))).alias("l"))
    objects = t(spark, sf, "customer").select("c_custkey").join(listed, "c_custkey", "left")
    objects = objects.select((F.col("c_custkey") % 3).alias("space_id"), F.col("c_custkey").cast("string").alias("id"), F.coalesce(F.transform("l", lambda x: x["to"]), F.array().cast("array<string>")).alias("outbound"))
    own = F.col("o_custkey").cast("string")
    linked = orders.filter("o_orderpriority < '3'").select((F.col("o_custkey") % 3).alias("space_id"), F.least(own, "to").alias("x"), F.greatest(own, "to").alias("y"))
    return repair.items(objects, linked)


@query(f"""WITH {_CHAINS} SELECT CAST(space AS BIGINT) AS space_id, CAST(id AS VARCHAR) AS object_id, list_transform(list(t ORDER BY pos) FILTER (gone), lambda x: CAST(x AS VARCHAR)) AS clear,
list_transform(coalesce(list(t ORDER BY pos) FILTER (NOT gone), []), lambda x: CAST(x AS VARCHAR)) AS keep FROM f GROUP BY space, id HAVING bool_or(gone)""")
def chain_repair_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _chains(spark, sf).withColumn("space_id", F.col("space_id").cast("long"))


_KINDS = """r AS (SELECT o_custkey % 3 AS space, 'log' AS what, CASE o_orderstatus WHEN 'F' THEN 'ingest' WHEN 'O' THEN 'lint' ELSE 'query' END AS tag FROM orders
UNION ALL SELECT c_custkey % 3, 'source', CASE WHEN c_custkey % 3 = 1 AND c_mktsegment = 'BUILDING' THEN 'agent' WHEN c_custkey % 3 = 2 AND c_mktsegment = 'MACHINERY' THEN NULL ELSE 'document' END FROM customer),
k AS (SELECT space, CASE WHEN bool_or(what = 'source' AND coalesce(tag, '') IN ('agent', 'conversation')) THEN 'mixed' WHEN bool_or(tag IS NULL) OR NOT bool_or(what = 'log' AND coalesce(tag, '') = 'ingest') THEN 'unknown' ELSE 'ingest-only' END AS kind,
count(*) FILTER (tag IS NULL) AS untagged, count(*) FILTER (tag = 'ingest') AS ingests, count(*) FILTER (tag = 'document') AS documents FROM r GROUP BY space)"""


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    logs = t(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("space_id"), F.col("o_orderkey").alias("id"), F.lit("order").alias("name"), F.lit("log").alias("what"), F.when(status == "F", "ingest").when(status == "O", "lint").otherwise("query").alias("tag"))
    space, segment = F.col("c_custkey") % 3, F.col("c_mktsegment")
    tag = F.when((space == 1) & (segment == "BUILDING"), "agent").when((space == 2) & (segment == "MACHINERY"), F.lit(None).cast("string")).otherwise("document")
    return repair.classified(logs.unionByName(t(spark, sf, "customer").select(space.alias("space_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("source").alias("what"), tag.alias("tag"))))


@query(f"WITH {_KINDS} SELECT CAST(space AS BIGINT) AS space_id, kind, untagged, ingests, documents FROM k")
def space_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return _kinds(spark, sf).select(F.col("space_id").cast("long").alias("space_id"), "kind", "untagged", F.coalesce(F.col("actions")["ingest"], F.lit(0)).alias("ingests"), F.coalesce(F.col("source_types")["document"], F.lit(0)).alias("documents"))


_WORDS_SQL = ", ".join(f"CAST(sum(CAST('0x' || substr(w, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(repair.WORDS))


@query(f"""WITH {_CHAINS}, {_KINDS}, p AS (SELECT space, sha256(CAST(to_json([CAST(id AS VARCHAR), CAST(t AS VARCHAR)]) AS VARCHAR)) AS w FROM f WHERE gone),
s AS (SELECT space, count(*) AS n, concat_ws(',', {_WORDS_SQL}) AS sums FROM p GROUP BY space)
SELECT CAST(space AS BIGINT) AS space_id, kind, coalesce(n, 0) AS cleared, sha256(concat_ws('|', kind, '0', '', CAST(coalesce(n, 0) AS VARCHAR), coalesce(sums, ''))) AS digest FROM k LEFT JOIN s USING (space)""")
def chain_repair_digest(spark: SparkSession, sf: str) -> DataFrame:
    return repair.digest(_kinds(spark, sf), _chains(spark, sf)).withColumn("space_id", F.col("space_id").cast("long"))


#: Pairs that the query below puts to its judge.
BUDGET = 500


@query(f"""WITH tp AS ({SQL["title_pairs"]}), ep AS ({SQL["embedding_band"]}),
u AS (SELECT a, b, min(reason) AS reason, CAST(NULL AS DOUBLE) AS score FROM tp GROUP BY a, b UNION ALL SELECT a, b, NULL, score FROM ep WHERE NOT EXISTS (FROM tp WHERE tp.a = ep.a AND tp.b = ep.b)),
o AS (SELECT *, row_number() OVER (ORDER BY CASE reason WHEN 'identical' THEN 0 WHEN 'subset' THEN 1 ELSE 2 END, score DESC NULLS LAST, a, b) AS n FROM u),
w AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS w FROM part),
v AS (SELECT o.*, CASE WHEN n > {BUDGET} THEN 'unjudged' WHEN x.id IS NULL OR y.id IS NULL THEN NULL WHEN list_has_all(x.w, y.w) OR list_has_all(y.w, x.w) THEN 'same' ELSE 'distinct' END AS verdict FROM o LEFT JOIN w x ON x.id = a LEFT JOIN w y ON y.id = b)
SELECT a, b, reason, score, verdict FROM v""")
def judged_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by their names and by the vectors of the same numbers."""
    parts = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("facts"))
    near = resolve.embedding_band(t(spark, sf, "embeddings"), band=(0.4, 0.85))
    found = duplicates.pairs(resolve.title_pairs(parts), near)
    return duplicates.judged(found, parts, Rules(), BUDGET).drop("recommendation")
