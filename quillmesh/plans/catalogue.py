"""The engine's operators bound to the test tables, and the same in DuckDB's SQL where SQL can express them.

Objects are documents (name: the source, type by doc_id % 4), parts and customers; vectors are embeddings; edges are orders and
line items; the change log and the work log are events.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as X
from quillmesh.operators import cells, chunk, facts, graph, planning, resolve, search
from quillmesh.sources import html as pages_html
from quillmesh.sources import kept as keep
from quillmesh.sources.kept import kept, version
from quillmesh.streaming import incremental, worklog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ASKED = "er ti und les ou thion la en"
NAME = "red widget"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def _sql_fold(x: str) -> str:
    return f"replace(lower(strip_accents({x})), 'ß', 'ss')"


def _sql_tokens(x: str) -> str:
    """Tokens of a folded expression."""
    found = f"regexp_extract_all({x}, '[a-z0-9]+(?:[-_.''][a-z0-9]+)*')"
    pieces = f"flatten(list_transform({found}, lambda t: CASE WHEN regexp_matches(t, '[-_.'']') THEN list_concat([t], string_split_regex(t, '[-_.'']')) ELSE [t] END))"
    return f"list_filter({pieces}, lambda t: NOT list_contains({_STOP}, t))"


_WORDS = f"SELECT doc_id, {_sql_tokens(_sql_fold('text'))} AS w FROM documents"


@query(f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct FROM ({_WORDS})")
def fold_tokens(spark: SparkSession, sf: str) -> DataFrame:
    w = X.tokens(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


_STATS = f"""
w AS MATERIALIZED ({_WORDS}), d AS (SELECT doc_id, len(w) AS size FROM w), u AS (SELECT doc_id, unnest(w) AS term FROM w),
f AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM u GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY term),
c AS (SELECT count(*) AS n, avg(size) AS avgdl FROM d),
r AS MATERIALIZED (SELECT term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM g, c), v AS (SELECT avg(raw) AS mean FROM r),
s AS (SELECT term, df, n, avgdl, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM r, v)"""


def _index(spark: SparkSession, sf: str) -> search.Index:
    """The postings of documents, kept while the table stays as it is."""
    docs, now = t(spark, sf, "documents"), version(spark, f"{sf}/documents.parquet")
    held = kept(spark, "postings", now, lambda: search.postings(docs, "doc_id", X.tokens(F.col("text")), F.col("text")).sortWithinPartitions("term"))
    told = kept(spark, "corpus", now, lambda: search.corpus(held)).first()
    return search.Index(held, told["n"], told["avgdl"] or 1.0, told["mean"] or 0.0)


@query(f"WITH {_STATS} SELECT term, df, round(idf, 6) AS idf, n, round(avgdl, 6) AS avgdl FROM s")
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).stats().select("term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


_ASKED_SQL = "[" + ", ".join(f"'{w}'" for w in ASKED.split() if w not in X.STOPWORDS) + "]"
_BM25 = f"""{_STATS}, b AS (
SELECT f.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avgdl))) AS score
FROM f JOIN s USING (term) JOIN d USING (doc_id) WHERE list_contains({_ASKED_SQL}, term) GROUP BY f.doc_id)"""


def _asked() -> list[str]:
    return [w for w in ASKED.split() if w not in X.STOPWORDS]


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b WHERE score > 0 ORDER BY b.score DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.top(_index(spark, sf).scores(_asked()), 10).select(F.col("row").alias("doc_id"), F.round("score", 6).alias("score"))


def _first_vector(spark: SparkSession, sf: str) -> list[float]:
    return t(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"]


_DENSE = "SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_DENSE}) ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.dense(t(spark, sf, "embeddings"), "embedding", _first_vector(spark, sf), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_DENSE}) JOIN documents ON doc_id = vec_id WHERE lang IN ('de', 'fr') ORDER BY score DESC, vec_id LIMIT 10")
def filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("type_key"))
    points = t(spark, sf, "embeddings").join(docs, "vec_id").filter(search.Filters(types=("de", "fr")).column())
    return search.dense(points, "embedding", _first_vector(spark, sf), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def _celled(spark: SparkSession, sf: str) -> cells.Cells:
    """The vectors by cell, with the language of their documents, written anew for each query that asks."""
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("type_key"))
    points = t(spark, sf, "embeddings").select("vec_id", "embedding").join(docs, "vec_id", "left")
    return cells.Cells.write(points, f"{keep.shared(spark)}/cells-{uuid.uuid4().hex}", "embedding", "vec_id")


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_DENSE}) ORDER BY score DESC, vec_id LIMIT 10")
def celled_topk(spark: SparkSession, sf: str) -> DataFrame:
    got, _ = _celled(spark, sf).nearest(_first_vector(spark, sf), 10, "embedding", "vec_id")
    return got.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_DENSE}) JOIN documents ON doc_id = vec_id WHERE lang IN ('de', 'fr') ORDER BY score DESC, vec_id LIMIT 10")
def celled_filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    got, _ = _celled(spark, sf).nearest(_first_vector(spark, sf), 10, "embedding", "vec_id", search.Filters(types=("de", "fr")).column())
    return got.select("vec_id", F.round("score", 6).alias("score"))


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    near = search.dense(t(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding"), "embedding", _first_vector(spark, sf), 50, "point_id")
    near = near.select("point_id", F.row_number().over(Window.orderBy(F.desc("score"), "point_id")).alias("rank"))
    words = search.top(_index(spark, sf).scores(_asked()), 50)
    return near, words.select(F.col("row").alias("point_id"), F.row_number().over(Window.orderBy(F.desc("score"), "row")).alias("rank"))


_LISTS = f"""{_BM25},
x AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({_DENSE}) QUALIFY rank <= 50),
y AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0 QUALIFY rank <= 50),
z AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(l) AS l, min(l * 1000 + rank) AS o FROM (SELECT *, 0 AS l FROM x UNION ALL SELECT *, 1 AS l FROM y) GROUP BY id)"""


@query(f"WITH {_LISTS} SELECT id AS point_id, round(rrf, 9) AS rrf, CAST(l AS INTEGER) AS first_list FROM z")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuse(list(_lists(spark, sf)), "point_id").select("point_id", F.round("rrf", 9).alias("rrf"), "first_list")


_HYBRID_NAME = "src7"


@query(f"""WITH {_LISTS.replace("FROM documents", "FROM named").replace(_sql_fold("text"), _sql_fold("source || ' ' || source || ' ' || text")).replace("w AS MATERIALIZED (", "named AS (SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)), w AS MATERIALIZED (", 1).replace(_ASKED_SQL, f"['{_HYBRID_NAME}']")},
a AS (SELECT n.doc_id, CASE WHEN source = '{_HYBRID_NAME}' THEN 1 ELSE 0 END AS tier, source, coalesce(b.score, 0) AS s FROM named n LEFT JOIN b USING (doc_id)),
k AS (SELECT z.id FROM z JOIN named ON doc_id = id WHERE source = '{_HYBRID_NAME}'),
e AS (SELECT doc_id AS id, 0.0 AS rrf, 2 AS l, 2001 AS o FROM a WHERE tier = 1 AND NOT EXISTS (FROM k) ORDER BY s DESC, doc_id LIMIT 1),
m AS (SELECT m.*, tier, source FROM (SELECT id, rrf, l, o FROM z UNION ALL FROM e) m JOIN a ON a.doc_id = m.id),
p AS (SELECT *, CASE WHEN l < 2 THEN 0 ELSE 1 END AS late, row_number() OVER (ORDER BY CASE WHEN l < 2 THEN 0 ELSE 1 END, rrf DESC, o) AS place FROM m),
q AS (SELECT *, CASE tier WHEN 1 THEN 2.0 ELSE 0.0 END + rrf + CASE WHEN tier > 0 AND row_number() OVER (PARTITION BY source ORDER BY place) = 1 THEN 0.5 ELSE 0 END AS score FROM p)
SELECT id AS point_id, source AS object_id, CAST(tier AS INTEGER) AS tier, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY q.score DESC, place) AS INTEGER) AS rank FROM q ORDER BY q.score DESC, place LIMIT 10""")
def hybrid_rank(spark: SparkSession, sf: str) -> DataFrame:
    """One document is one chunk, its source the object; documents with a vector are the space."""
    ids = t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    docs = t(spark, sf, "documents").join(ids, "doc_id", "left_semi")
    chunks = docs.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("point_id"), F.col("source").alias("object_id"), F.col("source").alias("object_name"), F.lit("").alias("heading"), "text", F.col("lang").alias("type_key"))
    near = search.dense(t(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding"), "embedding", _first_vector(spark, sf), 50, "point_id")
    near = near.select("point_id", F.row_number().over(Window.orderBy(F.desc("score"), "point_id")).alias("rank"))
    now = version(spark, f"{sf}/documents.parquet", f"{sf}/embeddings.parquet")
    held = kept(spark, "chunk-postings", now, lambda: search.postings(chunks, "row", search.chunk_words(), F.col("text")).sortWithinPartitions("term"))
    told = kept(spark, "chunk-corpus", now, lambda: search.corpus(held)).first()
    index = search.Index(held, told["n"], told["avgdl"] or 1.0, told["mean"] or 0.0)
    return search.hybrid_rank(chunks, _HYBRID_NAME, near, 10, index=index).withColumn("score", F.round("score", 9))


_NORM = f"trim(regexp_replace({_sql_fold('p_name')}, '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT p_partkey, {_NORM} AS name_key, CAST(1 AS INTEGER) AS n_keys FROM part")
def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", X.name_key(F.col("p_name")).alias("name_key"), F.size(X.name_keys(F.col("p_name"))).alias("n_keys"))


@query(f"""SELECT p_partkey, CAST(CASE WHEN k = '{NAME}' THEN 1 ELSE 2 END AS INTEGER) AS tier FROM (SELECT p_partkey, {_NORM} AS k FROM part)
WHERE k = '{NAME}' OR len(list_filter(string_split('{NAME}', ' '), lambda w: NOT list_contains(string_split(k, ' '), w))) = 0""")
def name_tier(spark: SparkSession, sf: str) -> DataFrame:
    parts = t(spark, sf, "part").select(F.col("p_partkey").alias("object_id"), F.col("p_name").alias("object_name"))
    return search.tiers(parts, NAME).withColumnRenamed("object_id", "p_partkey")


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(x) for x in graph.CONTENT_TYPES]), (F.col("doc_id") % 4 + 1).cast("int"))
    return t(spark, sf, "documents").select(F.col("lang").alias("space_id"), F.col("doc_id").alias("id"), F.col("source").alias("name"), kinds.alias("type_key"), F.col("text").alias("markdown"))


_ENDS = r"^[\s\x{0b}\x{85}\p{Z}]+|[\s\x{0b}\x{85}\p{Z}]+$"


@query(rf"""WITH n AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, regexp_matches(line, '^#{{1,4}}\s+.') AS head FROM n), s AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM h),
b AS (SELECT doc_id, sec, coalesce(regexp_replace(max(CASE WHEN head THEN regexp_extract(line, '^#{{1,4}}\s+(.+)', 1) END), '{_ENDS}', '', 'g'), '') AS heading,
  regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), ''), '{_ENDS}', '', 'g') AS body FROM s GROUP BY doc_id, sec),
k AS (SELECT * FROM b WHERE body <> '' UNION ALL SELECT doc_id, 0, '', regexp_replace(text, '{_ENDS}', '', 'g') FROM documents d WHERE regexp_replace(text, '{_ENDS}', '', 'g') <> '' AND NOT EXISTS (FROM b WHERE b.doc_id = d.doc_id AND body <> '')),
c AS (SELECT doc_id, sec, heading, regexp_replace(regexp_replace(body, '[\x{{00}}-\x{{08}}\x{{0b}}\x{{0c}}\x{{0e}}-\x{{1f}}\x{{7f}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}\x{{feff}}\x{{2028}}\x{{2029}}\x{{e0020}}-\x{{e007f}}]', '', 'g'), '{_ENDS}', '', 'g') AS body FROM k),
f AS (SELECT doc_id, sec, heading, body, list_reduce(list_transform(string_split_regex(body, '\n\s*\n'), lambda p: {{'done': []::VARCHAR[], 'open': p}}), lambda a, x: CASE
  WHEN length(x.open) > {chunk.CHUNK_CHARS} THEN {{'done': list_concat(CASE WHEN a.open <> '' THEN list_append(a.done, a.open) ELSE a.done END, list_transform(range(0, (length(x.open) - 1) // {chunk.CHUNK_CHARS} + 1), lambda j: substr(x.open, j * {chunk.CHUNK_CHARS} + 1, {chunk.CHUNK_CHARS}))), 'open': ''}}
  WHEN a.open = '' THEN {{'done': a.done, 'open': x.open}}
  WHEN length(a.open) + 2 + length(x.open) <= {chunk.CHUNK_CHARS} THEN {{'done': a.done, 'open': a.open || chr(10) || chr(10) || x.open}}
  ELSE {{'done': list_append(a.done, a.open), 'open': x.open}} END, {{'done': []::VARCHAR[], 'open': ''}}) AS r FROM c WHERE body <> ''),
g AS (SELECT doc_id, sec, heading, unnest(l) AS text, generate_subscripts(l, 1) AS j FROM (SELECT *, CASE WHEN length(body) <= {chunk.CHUNK_CHARS} THEN [body] WHEN r.open <> '' THEN list_append(r.done, r.open) ELSE r.done END AS l FROM f)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec, j) - 1 AS idx FROM g), u AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || ':' || idx || ':' || heading)) AS h FROM o)
SELECT CAST(doc_id AS VARCHAR) AS object_id, CAST(idx AS INTEGER) AS chunk_idx, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(lpad(to_hex((CAST('0x' || h[17:18] AS INTEGER) & 63) | 128), 2, '0')) || h[19:20] || '-' || h[21:32] AS point_id,
heading, CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest FROM u""")
def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    made = chunk.chunks(_objects(spark, sf))
    return made.select("object_id", "chunk_idx", "point_id", "heading", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || ':0:')) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(lpad(to_hex((CAST('0x' || h[17:18] AS INTEGER) & 63) | 128), 2, '0')) || h[19:20] || '-' || h[21:32] AS point_id FROM h""")
def chunk_point_id(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", X.uuid5(F.concat(F.col("doc_id").cast("string"), F.lit(":0:"))).alias("point_id"))


_TARGET = X.LINK_TARGET.replace("'", "''")
_VISIBLE = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '!\[([^\]]*)\]{_TARGET}', '\1', 'g'), '\[([^\]]*)\]{_TARGET}', '\1', 'g'), '<?https?://\S+>?', ' ', 'g'), '[#*_>`|~=\[\]-]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, CAST(length(v) AS INTEGER) AS chars, md5(v) AS digest FROM (SELECT page_id, {_VISIBLE} AS v FROM pages)")
def visible_text(spark: SparkSession, sf: str) -> DataFrame:
    v = t(spark, sf, "pages").select("page_id", X.visible_text(F.col("html")).alias("v"))
    return v.select("page_id", F.length("v").alias("chars"), F.md5("v").alias("digest"))


@query(f"""SELECT page_id, CASE WHEN trim(html) = '' THEN 'empty'
WHEN html_like AND ((n < 2000 AND (contains(l, 'cf-chl') OR contains(l, 'just a moment...') OR contains(l, 'checking your browser') OR contains(l, 'attention required')))
  OR (n < 300 AND (contains(l, 'g-recaptcha') OR contains(l, 'h-captcha') OR contains(l, 'cf-turnstile')))) THEN 'challenge_page'
WHEN n = 0 THEN 'empty' WHEN n < 300 THEN 'too_little_text (' || n || ' chars)' END AS verdict
FROM (SELECT page_id, html, lower(html) AS l, length({_VISIBLE}) AS n, contains(lower(html), '<body') OR contains(lower(html), '<div') OR contains(lower(html[1:256]), '<html') AS html_like FROM pages)""")
def usable_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", X.text_verdict(F.col("html"), F.col("html")).alias("verdict"))


@query()
def main_content(spark: SparkSession, sf: str) -> DataFrame:
    made = pages_html.extract(t(spark, sf, "pages").select("page_id", "html"))
    return made.select("page_id", "title", F.length("markdown").alias("chars"), F.md5("markdown").alias("digest"), "verdict")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([^:/]+://)[^/]*@', '\1') AS plain,
CASE WHEN regexp_matches(url, '[?&](token|key|secret|sig|auth|pass|pwd)=') THEN NULL ELSE url END AS kept FROM pages""")
def scrub_url(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", X.scrub_credentials(F.col("url")).alias("plain"), X.scrub_url_secrets(F.col("url")).alias("kept"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}\x{2028}\x{2029}\x{e0020}-\x{e007f}]', '', 'g')) AS digest,
CASE WHEN length(trim(text)) <= 200 AND trim(text) <> '' AND NOT regexp_matches(lower(trim(text)), '^(system:|assistant:|ignore|<\||\[inst\])') THEN length(trim(text)) ELSE -1 END AS name_chars FROM documents""")
def strip_controls(spark: SparkSession, sf: str) -> DataFrame:
    name = X.sanitize_name(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.md5(X.strip_controls(F.col("text"))).alias("digest"), F.coalesce(F.length(name), F.lit(-1)).cast("long").alias("name_chars"))


_IDS = [("c", "replace(c_name, '#', '_')"), ("p", "replace(p_name, ' ', '-')")]


@query(r"""SELECT kind, id, regexp_matches(n, '^[A-Za-z0-9]+(_[A-Za-z0-9]+)+$') OR regexp_matches(n, '^[a-z0-9]+(-[a-z0-9]+){2,}$')
OR (NOT regexp_matches(n, '\s') AND (regexp_matches(n, '^[A-Za-z][A-Za-z0-9+.-]*://') OR starts_with(lower(n), 'www.') OR regexp_matches(n, '^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+/')
  OR regexp_matches(lower(n), '\.(md|markdown|json|yaml|yml|toml|txt|csv|sql|py|ts|tsx|html|pdf)$'))) AS identifier
FROM (SELECT 'c' AS kind, c_custkey AS id, replace(c_name, '#', '_') AS n FROM customer UNION ALL SELECT 'p', p_partkey, replace(p_name, ' ', '-') FROM part UNION ALL SELECT 'u', page_id, url FROM pages)""")
def identifier_like(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.replace("c_name", F.lit("#"), F.lit("_")).alias("n"))
    p = t(spark, sf, "part").select(F.lit("p").alias("kind"), F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("n"))
    u = t(spark, sf, "pages").select(F.lit("u").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("n"))
    return c.unionByName(p).unionByName(u).select("kind", "id", X.identifier_like(F.col("n")).alias("identifier"))


@query(r"""SELECT source, k AS fact_key, count(*) AS n FROM (
SELECT source, trim(regexp_replace(trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(line, '\[(?:also|superseded):[^\]]*\]', '', 'gi'), '(\s*\[pp?\. [^\]]*\]\s*)+$', ''), '^\s*-\s+', '')), '\s+', ' ', 'g')), '[.;,]+$', '')) AS k
FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE k <> '' GROUP BY ALL HAVING count(*) > 1""")
def fact_key_dedup(spark: SparkSession, sf: str) -> DataFrame:
    lines = t(spark, sf, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return facts.distinct_units(lines, "line", ["source"], X.fact_key).filter("n > 1")


@query("SELECT p.p_partkey AS candidate, o.first AS object FROM part p JOIN (SELECT p_type, lower(trim(p_name)) AS k, min(p_partkey) AS first FROM part GROUP BY ALL) o ON o.p_type = p.p_type AND o.k = lower(trim(p.p_name))")
def exact_resolve(spark: SparkSession, sf: str) -> DataFrame:
    parts = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_type")
    return resolve.exact(parts, parts, ["p_type"])


@query("SELECT p_type, lower(trim(p_name)) AS title_key, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.ambiguous(t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_type"), ["p_type"])


@query()
def fuzzy_resolve(spark: SparkSession, sf: str) -> DataFrame:
    parts = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return resolve.similar(parts, parts, digits=6)


@query(f"""WITH n AS (SELECT p_partkey AS id, lower(trim(p_name)) AS k, list_sort(list_distinct({_sql_tokens(_sql_fold("p_name"))})) AS t FROM part),
f AS (SELECT k, min(id) AS head, any_value(t) AS t FROM n WHERE k <> '' GROUP BY k)
SELECT head AS a, id AS b, 'identical' AS reason FROM n JOIN f USING (k) WHERE id <> head
UNION ALL SELECT DISTINCT least(x.head, y.head), greatest(x.head, y.head), 'subset' FROM f x JOIN f y ON x.head <> y.head AND len(x.t) > 0 AND len(y.t) > 0 AND list_has_all(y.t, x.t)""")
def title_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.title_pairs(t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("""WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a, embeddings b),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s QUALIFY n <= 5)
SELECT least(a, b) AS a, greatest(a, b) AS b, max(round(s, 4)) AS score FROM k WHERE a <> b AND round(s, 4) >= 0.4 AND round(s, 4) < 0.85 GROUP BY ALL""")
def embedding_band(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.embedding_band(t(spark, sf, "embeddings"), band=(0.4, 0.85))


@query("""WITH adj AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, CASE o_orderpriority[1:1] WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END AS priority FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
seeds AS (SELECT 'c' || c_custkey AS id, c_custkey AS seed_rank FROM customer WHERE c_custkey < 5),
f AS (SELECT dst, src, seed_rank, priority, row_number() OVER (PARTITION BY dst ORDER BY seed_rank, priority, src) AS n FROM adj JOIN seeds ON src = id)
SELECT dst AS id, src AS seed, seed_rank, priority FROM f WHERE n = 1 ORDER BY seed_rank, priority, dst LIMIT 16""")
def neighbour_expand(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    edges = t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    adj = edges.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), rank.alias("priority")).distinct()
    seeds = t(spark, sf, "customer").filter("c_custkey < 5").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_custkey").alias("seed_rank"))
    return graph.expand(adj, seeds)


@query("""WITH r AS (SELECT source, doc_id, length(text) // 4 AS tokens, sum(length(text) // 4) OVER w AS running, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, CAST(tokens AS BIGINT) AS tokens, CAST(running AS BIGINT) AS running FROM r WHERE running <= 8000 AND n <= 24""")
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    made = graph.context(t(spark, sf, "documents"), 8000, order="doc_id", by=["source"])
    return made.select("source", "doc_id", "tokens", "running")


def _lint_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as objects: two relations forward (one of them recorded as a backlink there), sources, and times from the id."""
    i = F.col("doc_id")
    day = F.lit("2024-01-01").cast("timestamp")

    def ids(*x: F.Column) -> F.Column:
        return F.array_compact(F.array(*[v.cast("string") for v in x]))

    return t(spark, sf, "documents").select(
        i.cast("string").alias("id"), F.col("lang").alias("space_id"), F.col("source").alias("name"),
        F.element_at(F.array(F.lit("wiki_source"), F.lit("wiki_entity"), F.lit("wiki_concept"), F.lit("wiki_query")), (i % 4 + 1).cast("int")).alias("type_key"),
        (day + F.make_dt_interval((i % 300).cast("int"))).alias("created"), (day + F.make_dt_interval(((i * 37) % 400).cast("int"))).alias("last_modified"), (i % 17 == 0).alias("archived"),
        F.when(i % 5 == 0, "needs-review").otherwise("reviewed").alias("status"), F.when(i % 3 == 0, day).alias("last_reviewed"), F.col("text").alias("description"),
        ids(i - i % 4, F.when(i % 23 == 0, F.lit(-1))).alias("sources"), ids(F.when(i % 3 != 0, i + 1), F.when(i % 7 == 0, i + 2)).alias("outbound"), ids(F.when(i % 2 == 0, i - 1)).alias("backlinks"),
        ids(F.when(i % 13 == 0, i + 5)).alias("contradictions"),
    )


_LINT_SQL = """o AS (SELECT doc_id AS id, ['wiki_source', 'wiki_entity', 'wiki_concept', 'wiki_query'][doc_id % 4 + 1] AS type_key,
  TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INTEGER)) AS created, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id * 37 % 400 AS INTEGER)) AS last_modified, doc_id % 17 = 0 AS archived, doc_id % 5 = 0 AS review, doc_id % 3 = 0 AS reviewed, text FROM documents),
e AS (SELECT id AS src, id + 1 AS dst FROM o WHERE id % 3 <> 0 UNION SELECT id, id + 2 FROM o WHERE id % 7 = 0),
bl AS (SELECT id, id - 1 AS b FROM o WHERE id % 2 = 0),
st AS (SELECT o.id, s.last_modified AS ts FROM o JOIN o s ON s.id = o.id - o.id % 4 AND s.type_key = 'wiki_source'),
ec AS (SELECT o.*, ts FROM o LEFT JOIN st USING (id) WHERE type_key IN ('wiki_entity', 'wiki_concept')),
ln AS (SELECT src AS id FROM e UNION SELECT dst FROM e UNION SELECT id FROM bl)"""


@query(f"""WITH {_LINT_SQL} SELECT CAST(e.src AS VARCHAR) AS src, CAST(e.dst AS VARCHAR) AS dst FROM e JOIN o t ON t.id = e.dst
WHERE NOT EXISTS (FROM e r WHERE r.src = e.dst AND r.dst = e.src) AND NOT EXISTS (FROM bl WHERE bl.id = e.dst AND bl.b = e.src) AND NOT EXISTS (FROM bl WHERE bl.id = e.src AND bl.b = e.dst)""")
def asymmetric_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.asymmetric(_lint_objects(spark, sf)).select("src", "dst")


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    objects = _lint_objects(spark, sf)
    links = t(spark, sf, "documents").filter("doc_id % 10 = 1").select(
        F.concat(F.lit("l"), "doc_id").alias("link_id"), F.col("doc_id").cast("string").alias("from_id"), (F.col("doc_id") + 1).cast("string").alias("to_id"), F.when(F.col("doc_id") % 30 != 1, "knows").alias("label"), F.array((F.col("doc_id") - 1).cast("string")).alias("sources")
    )
    failed = t(spark, sf, "events").filter("event_type = 'error'").select("ts")
    return graph.lint(objects, links, failed, "2024-12-01")


@query(f"""WITH {_LINT_SQL}, live AS (SELECT id FROM o WHERE NOT archived),
k AS (SELECT doc_id AS f, 'l' || doc_id AS link_id, doc_id % 30 <> 1 AS labelled FROM documents WHERE doc_id % 10 = 1),
dangling AS (SELECT link_id FROM k WHERE NOT labelled OR f NOT IN (SELECT id FROM live) OR f + 1 NOT IN (SELECT id FROM live) OR f - 1 NOT IN (SELECT id FROM live)),
sound AS (SELECT * FROM k WHERE link_id NOT IN (SELECT link_id FROM dangling)),
side AS (SELECT link_id, f AS src, f + 1 AS dst FROM sound UNION ALL SELECT link_id, f + 1, f FROM sound),
alone AS (SELECT o.*, ts FROM o LEFT JOIN st USING (id) WHERE id NOT IN (SELECT id FROM ln)),
lost AS (SELECT id, CAST(id - id % 4 AS VARCHAR) AS source FROM ec WHERE id - id % 4 NOT IN (SELECT id FROM live) UNION ALL SELECT id, '-1' FROM ec WHERE id % 23 = 0),
x AS (
SELECT 'high' AS severity, 'stale_citation_edge' AS c, CAST(src AS VARCHAR) AS object_id, CAST(dst AS VARCHAR) AS detail FROM e JOIN o t ON t.id = dst AND t.type_key = 'wiki_query'
UNION ALL SELECT 'high', 'asymmetric_relation', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM e JOIN o t ON t.id = dst AND t.type_key <> 'wiki_query'
  WHERE NOT EXISTS (FROM e r WHERE r.src = e.dst AND r.dst = e.src) AND NOT EXISTS (FROM bl WHERE bl.id = e.dst AND bl.b = e.src) AND NOT EXISTS (FROM bl WHERE bl.id = e.src AND bl.b = e.dst)
UNION ALL SELECT 'high', 'orphan', CAST(id AS VARCHAR), '' FROM alone WHERE type_key IN ('wiki_entity', 'wiki_concept') AND ts < TIMESTAMP '2024-12-01' - INTERVAL 7 DAY
UNION ALL SELECT 'high', 'pipeline_orphan', CAST(id AS VARCHAR), '' FROM alone a WHERE id % 3 = 0 AND id % 7 <> 0 AND EXISTS (FROM events f WHERE f.event_type = 'error' AND abs(epoch_us(f.ts) - epoch_us(coalesce(a.ts, a.created))) <= 300000000)
UNION ALL SELECT 'critical', 'contradiction_unresolved', CAST(id AS VARCHAR), '1' FROM ec WHERE id % 13 = 0 AND NOT reviewed
UNION ALL SELECT 'medium', 'stale', CAST(id AS VARCHAR), '' FROM ec WHERE last_modified < ts - INTERVAL 90 DAY
UNION ALL SELECT 'high', 'unreviewed_needs_review', CAST(id AS VARCHAR), '' FROM ec WHERE review
UNION ALL SELECT 'medium', 'stale_needs_review', CAST(id AS VARCHAR), '' FROM ec WHERE review AND ts < TIMESTAMP '2024-12-01' - INTERVAL 30 DAY
UNION ALL SELECT 'low', 'oversized', CAST(id AS VARCHAR), CAST(length(text) AS VARCHAR) FROM o WHERE length(text) > 2000
UNION ALL SELECT 'high', 'link_dangling', link_id, '' FROM dangling
UNION ALL SELECT 'medium', 'link_index_missing', link_id, min(CAST(src AS VARCHAR)) FROM side WHERE NOT EXISTS (FROM e WHERE e.src = side.src AND e.dst = side.dst) GROUP BY link_id
UNION ALL SELECT 'high', 'source_dangling', CAST(id AS VARCHAR), string_agg(source, ', ' ORDER BY source) FROM lost GROUP BY id
UNION ALL SELECT 'informational', 'empty_type', 'wiki_comparison', '' WHERE NOT EXISTS (FROM o WHERE type_key = 'wiki_comparison'))
SELECT severity, c AS "check", object_id, detail FROM x""")
def lint_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf)


@query(f"""WITH {_LINT_SQL}, f AS (
SELECT 'critical' AS severity, 'contradiction_unresolved' AS c, id FROM ec WHERE id % 13 = 0 AND NOT reviewed
UNION ALL SELECT 'medium', 'stale', id FROM ec WHERE last_modified < ts - INTERVAL 90 DAY
UNION ALL SELECT 'high', 'unreviewed_needs_review', id FROM ec WHERE review
UNION ALL SELECT 'medium', 'stale_needs_review', id FROM ec WHERE review AND ts < TIMESTAMP '2024-12-01' - INTERVAL 30 DAY
UNION ALL SELECT 'low', 'oversized', id FROM o WHERE length(text) > 2000
UNION ALL SELECT 'high', 'stale_citation_edge', src FROM e JOIN o t ON t.id = dst AND t.type_key = 'wiki_query'
UNION ALL SELECT 'high', 'orphan', id FROM ec WHERE ts < TIMESTAMP '2024-12-01' - INTERVAL 7 DAY AND id NOT IN (SELECT id FROM ln)
UNION ALL SELECT 'informational', 'empty_type', 0 FROM (SELECT 1) WHERE NOT EXISTS (FROM o WHERE type_key = 'wiki_comparison'))
SELECT severity, c AS "check", count(*) AS findings FROM f GROUP BY ALL""")
def severity_summary(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ("contradiction_unresolved", "stale", "unreviewed_needs_review", "stale_needs_review", "oversized", "stale_citation_edge", "orphan", "empty_type")
    return _findings(spark, sf).filter(F.col("check").isin(*kinds)).groupBy("severity", "check").agg(F.count("*").alias("findings"))


@query("SELECT s.event_id, count(*) AS failures FROM events s JOIN events f ON f.event_type = 'error' AND abs(epoch_us(s.ts) - epoch_us(f.ts)) <= 300000000 WHERE s.event_type = 'signup' GROUP BY s.event_id")
def pipeline_band_join(spark: SparkSession, sf: str) -> DataFrame:
    events = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    begun = events.filter("event_type = 'signup'").select("event_id", "ts")
    return graph.near_in_time(begun, events.filter("event_type = 'error'").select("ts"), 300).groupBy("event_id").agg(F.count("*").alias("failures"))


@query(f"WITH {_LINT_SQL} SELECT CAST(id AS VARCHAR) AS id, CAST(date_diff('day', last_modified, ts) AS INTEGER) AS days FROM ec WHERE last_modified < ts - INTERVAL 90 DAY")
def stale_since_source(spark: SparkSession, sf: str) -> DataFrame:
    objects = _lint_objects(spark, sf)
    timed = objects.filter("type_key IN ('wiki_entity', 'wiki_concept')").join(graph.source_times(objects), "id")
    return timed.filter(F.col("last_modified") < F.col("source_ts") - F.expr("INTERVAL 90 DAYS")).select("id", F.datediff("source_ts", "last_modified").alias("days"))


@query("""WITH a AS (SELECT user_id, CAST(max(epoch_us(ts)) AS VARCHAR) AS m FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 5 <> 0 GROUP BY user_id),
b AS (SELECT user_id, CAST(max(epoch_us(ts)) AS VARCHAR) AS m FROM events WHERE ts < TIMESTAMP '2024-01-20' AND user_id % 7 <> 0 GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS object_id, CASE WHEN a.m IS NULL THEN 'new' WHEN b.m IS NULL THEN 'removed' WHEN a.m = b.m THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    def state(until: str, out: int) -> DataFrame:
        e = t(spark, sf, "events").filter((F.col("ts") < F.lit(until).cast("timestamp")) & (F.col("user_id") % out != 0))
        return e.groupBy(F.lit("s").alias("space_id"), F.col("user_id").alias("object_id")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).cast("string").alias("last_modified"))

    return incremental.snapshot_diff(state("2024-01-15", 5), state("2024-01-20", 7)).select("object_id", "change")


def _work(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a work log: a user is a batch of three subjects; signups begin, clicks finish one, rare errors clear."""
    u = F.concat(F.lit("w"), "user_id")
    kind = F.when(F.col("event_type") == "signup", "begin").when(F.col("event_type") == "click", "done").when((F.col("event_type") == "error") & (F.col("event_id") % 97 == 0), "clear")
    e = t(spark, sf, "events").select(F.lit("s").alias("space_id"), u.alias("work_id"), kind.alias("kind"), F.array(*[F.lit(f"s{i}") for i in range(40)]).alias("subjects"), F.concat(F.lit("s"), (F.col("event_id") % 40).cast("string")).alias("subject_id"), F.col("event_id").alias("ord"))
    return e.filter("kind IS NOT NULL")


@query("""WITH e AS (SELECT 'w' || user_id AS work_id, event_type AS k, 's' || (event_id % 40) AS s, event_id FROM events),
b AS (SELECT work_id, max(event_id) AS ord, unnest(range(40)) AS pos FROM e WHERE k = 'signup' GROUP BY work_id)
SELECT work_id, 's' || pos AS subject_id, ord, CAST(pos AS INTEGER) AS pos FROM b
WHERE NOT EXISTS (FROM e WHERE k = 'click' AND e.work_id = b.work_id AND e.s = 's' || pos) AND NOT EXISTS (FROM e WHERE k = 'error' AND event_id % 97 = 0 AND e.work_id = b.work_id)""")
def worklog_pending(spark: SparkSession, sf: str) -> DataFrame:
    return worklog.pending(_work(spark, sf)).select("work_id", "subject_id", "ord", "pos")


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), g AS (SELECT k, n, n - row_number() OVER (PARTITION BY k ORDER BY n) AS i FROM d),
r AS (SELECT k, min(n) AS a, max(n) AS b FROM g GROUP BY k, i)
SELECT k AS l_orderkey, CASE WHEN sum(b - a + 1) = 1 THEN 'p. ' ELSE 'pp. ' END || string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, ', ' ORDER BY a) AS label FROM r GROUP BY k""")
def page_label_islands(spark: SparkSession, sf: str) -> DataFrame:
    held = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("pages"))
    return held.select("l_orderkey", planning.page_label(F.col("pages")).alias("label"))


@query("""SELECT n_regionkey, max(v) AS newest FROM (SELECT n_regionkey, [n_regionkey, n_nationkey, 0] AS v FROM nation) GROUP BY n_regionkey""")
def version_max(spark: SparkSession, sf: str) -> DataFrame:
    v = X.version(F.concat_ws(".", "n_regionkey", "n_nationkey"))
    return t(spark, sf, "nation").groupBy("n_regionkey").agg(F.max(v).alias("newest"))


@query("""SELECT n_regionkey, sha256('{"kind": "plan", "ids": ["' || string_agg(n_name, '", "' ORDER BY n_name) || '"]}') AS digest FROM nation GROUP BY n_regionkey""")
def plan_digest(spark: SparkSession, sf: str) -> DataFrame:
    return planning.digest(t(spark, sf, "nation"), ["n_regionkey"], "plan", "n_name")


@query(f"""WITH {_BM25}, h AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0 QUALIFY rank <= 50)
SELECT quality, CAST(coalesce(min(rank), 11) AS INTEGER) AS first_rank, count(rank) AS hits, count(*) AS labelled FROM labels LEFT JOIN h USING (doc_id) GROUP BY quality""")
def eval_first_rank(spark: SparkSession, sf: str) -> DataFrame:
    _, words = _lists(spark, sf)
    h = words.select(F.col("point_id").alias("doc_id"), "rank")
    return t(spark, sf, "labels").join(h, "doc_id", "left").groupBy("quality").agg(F.coalesce(F.min("rank"), F.lit(11)).alias("first_rank"), F.count("rank").alias("hits"), F.count("*").alias("labelled"))


@query("""WITH s AS (SELECT DISTINCT o_custkey AS f, o_orderpriority AS l, c_nationkey AS x FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'),
w AS (SELECT DISTINCT o_custkey AS f, o_orderpriority AS l, c_nationkey AS x, o_orderstatus AS src FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey <> c_nationkey)
SELECT coalesce(s.f, g.f) AS from_id, coalesce(s.l, g.l) AS label, coalesce(s.x, g.x) AS to_id,
CASE WHEN s.f IS NULL THEN 'created' WHEN len(list_filter(coalesce(g.a, []), lambda v: v <> 'F')) > 0 THEN 'source_added' ELSE 'unchanged' END AS action
FROM s FULL JOIN (SELECT f, l, x, list_sort(list(src)) AS a FROM w GROUP BY ALL) g ON s.f = g.f AND s.l = g.l AND s.x = g.x""")
def merge_links(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    edges = o.select(F.col("o_custkey").alias("from_id"), F.col("o_orderpriority").alias("label"), F.col("c_nationkey").cast("long").alias("to_id"), F.col("o_orderstatus").alias("source_id"))
    stored = edges.filter("source_id = 'F'").select("from_id", "label", "to_id", F.array("source_id").alias("sources")).distinct()
    return graph.merge_links(stored, edges).select("from_id", "label", F.col("to_id").cast("int").alias("to_id"), "action")


@query("SELECT id, list_sort(list(DISTINCT n)) AS neighbours FROM (SELECT o_custkey AS id, l_suppkey AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT l_suppkey, o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY id")
def symmetric_index(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.symmetric(o.select(F.col("o_custkey").alias("from_id"), F.col("l_suppkey").alias("to_id")).distinct())


@query()
def merge_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Each four documents in a row are four sources of one object."""
    docs = t(spark, sf, "documents")
    new = docs.select(F.expr("doc_id DIV 4").alias("id"), F.col("doc_id").alias("ord"), F.concat(F.lit("doc "), F.col("doc_id") % 4).alias("label"), F.concat(F.lit("d"), F.col("doc_id") % 4).alias("source_id"), F.col("text").alias("facts"))
    made = facts.merge_facts(new.select("id").distinct().withColumn("text", F.lit("")), new)
    return made.select("id", "added", "marked", F.length("text").alias("chars"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS narration, count(*) AS turns FROM conversations GROUP BY conv_id""")
def narrations(spark: SparkSession, sf: str) -> DataFrame:
    return planning.joined(t(spark, sf, "conversations"), ["conv_id"], "turn", F.concat(F.col("role"), F.lit(": "), F.col("text")), "narration", "turns")


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n FROM conversations), r AS (
SELECT conv_id, turn, 0 AS w, n AS used FROM c WHERE turn = 0 UNION ALL
SELECT c.conv_id, c.turn, CASE WHEN used = 0 OR used + n <= 2000 THEN w ELSE w + 1 END, CASE WHEN used = 0 OR used + n <= 2000 THEN used + n ELSE n END FROM r JOIN c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1)
SELECT conv_id, turn, CAST(w AS INTEGER) AS "window" FROM r""")
def page_windows(spark: SparkSession, sf: str) -> DataFrame:
    return planning.windows(t(spark, sf, "conversations"), ["conv_id"], "turn", F.length("text"), 2000).select("conv_id", "turn", "window")


@query(f"""WITH {_LINT_SQL} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM e WHERE NOT (src % 10 = 1 AND dst = src + 1) AND NOT (dst % 10 = 1 AND src = dst + 1)""")
def unbacked_edges(spark: SparkSession, sf: str) -> DataFrame:
    links = t(spark, sf, "documents").filter("doc_id % 10 = 1").select(F.col("doc_id").cast("string").alias("from_id"), (F.col("doc_id") + 1).cast("string").alias("to_id"))
    return planning.unbacked(graph.adjacency(_lint_objects(spark, sf)), links)


@query("""SELECT source AS name, count(*) FILTER (doc_id % 5 = 1) AS documents, count(*) FILTER (doc_id % 5 = 2) AS conversations, count(*) FILTER (doc_id % 5 = 3) AS agents,
count(*) FILTER (doc_id % 5 IN (0, 4) AND doc_id % 7 <> 0) AS untagged FROM documents GROUP BY source""")
def classify_sources(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 5 == 1, "document").when(F.col("doc_id") % 5 == 2, "conversation").when(F.col("doc_id") % 5 == 3, "agent")
    docs = t(spark, sf, "documents").select(F.col("source").alias("name"), F.col("doc_id").alias("id"), kind.alias("source_type"))
    return planning.classify(docs, "name", docs.filter("id % 7 = 0").select("id")).drop("mixed")


def queries() -> dict[str, Query]:
    importlib.import_module("quillmesh.plans.rules")  # adds its queries
    return {"hybrid_rank": QUERIES["hybrid_rank"]} | QUERIES


def oracle_sql() -> dict[str, str]:
    importlib.import_module("quillmesh.plans.rules")
    return dict(SQL)
