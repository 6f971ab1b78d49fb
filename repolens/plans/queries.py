"""Queries of the engine's own operators over whole tables, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import calls as J
from ..operators import chunking as T
from ..operators import collections as K
from ..operators import metrics as A
from ..operators import modules as M
from ..operators import search as V
from ..operators import symbols as S
from ..session import table
from ..streaming import events as R
from . import graph as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EXT = "regexp_extract(lower(file_path), '[^/](\\.[^./]+)$', 1)"
LANG = "CASE " + EXT + " " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in X.LANGUAGES.items()) + " END"
B = "[ \\t\\r\\n\\f\\x0B]"
DIR = "regexp_replace(regexp_replace({c}, '[^/]*$', ''), '/$', '')"


def RECURSIVE(sql: str) -> str:  # noqa: N802
    return "WITH RECURSIVE" + sql.removeprefix("WITH")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"


# --- sources --------------------------------------------------------------------------------------------------------
@query(f"""SELECT DISTINCT file_id, file_path, {LANG} AS detected FROM files WHERE {LANG} IS NOT NULL AND size <= 1048576
    AND NOT regexp_matches('/' || file_path, '/(?:node_modules|vendor|__pycache__|venv|env|dist|build|target|\\.[^/]*)/')""")
def s1_repo_walk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").filter(X.is_walked("file_path", "size")).select("file_id", "file_path", X.language("file_path").alias("detected")).distinct()


@query(f"SELECT coalesce({LANG}, 'unknown') AS detected, count(DISTINCT file_id) AS n, sum(size) AS bytes FROM files GROUP BY 1")
def s3_language_detect(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").withColumn("detected", F.coalesce(X.language("file_path"), F.lit("unknown")))
    return f.groupBy("detected").agg(F.countDistinct("file_id").alias("n"), F.sum("size").alias("bytes"))


@query("""SELECT DISTINCT s.symbol_id, md5(array_to_string(string_split(f.content, chr(10))[s.start_line : s.end_line], chr(10))) AS text_md5
    FROM (SELECT DISTINCT symbol_id, file_id, start_line, end_line FROM symbols) s JOIN (SELECT DISTINCT file_id, content FROM files) f USING (file_id)""")
def s5_line_range(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select("symbol_id", "file_id", "start_line", "end_line").distinct()
    f = table(spark, d, "files").select("file_id", "content").distinct()
    return s.join(f, "file_id").select("symbol_id", F.md5(T.line_range(F.col("content"), F.col("start_line"), F.col("end_line"))).alias("text_md5")).distinct()


@query("SELECT chunk_id, start_line FROM code_repo WHERE project_id = (SELECT min(project_id) FROM code_repo) AND file_path = (SELECT min(file_path) FROM code_repo WHERE project_id = (SELECT min(project_id) FROM code_repo))")
def s13_scroll(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_repo")
    p, f = c.agg(F.min(F.struct("project_id", "file_path")).alias("m")).first().m
    return K.scroll(c, f, p).select("chunk_id", "start_line")


@query("""SELECT DISTINCT c.chunk_id, c.point_id FROM code_repo c WHERE c.point_id = (SELECT substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4)
    || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) FROM (SELECT min(chunk_id) AS m FROM code_repo))""")
def s14_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_repo")
    return K.lookup(c, c.agg(F.min("chunk_id")).first()[0]).select("chunk_id", "point_id").distinct()


@query("""SELECT DISTINCT chunk_id, sha256(project_id || ':' || file_path || ':' || coalesce(qualified_name, '') || ':' || content) AS made_id,
    substr(chunk_id, 1, 8) || '-' || substr(chunk_id, 9, 4) || '-' || substr(chunk_id, 13, 4) || '-' || substr(chunk_id, 17, 4) || '-' || substr(chunk_id, 21, 12) AS made_point,
    sha256(content) AS made_hash FROM code_repo""")
def d5_identity(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "code_repo").select(
        "chunk_id", X.chunk_id(c("project_id"), c("file_path"), c("qualified_name"), c("content")).alias("made_id"), X.point_id(c("chunk_id")).alias("made_point"), X.content_hash(c("content")).alias("made_hash")
    ).distinct()


# --- collections ----------------------------------------------------------------------------------------------------
CUT = "TIMESTAMPTZ '2024-07-01 00:00:00+00'"


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "code_repo")
    late = F.col("last_indexed_at") >= F.to_timestamp(F.lit("2024-07-01 00:00:00"))
    return c.filter(~late), c.filter(late)


@query("""SELECT chunk_id, epoch_us(max(last_indexed_at)) AS "at" FROM code_repo GROUP BY chunk_id""")
def k2_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_repo")
    old, new = _old_new(spark, d)
    merged = K.upsert(K.latest(old, ["chunk_id"], F.col("last_indexed_at")), new, ["chunk_id"], F.col("last_indexed_at"))
    return merged.select(*c.columns).select("chunk_id", F.unix_micros("last_indexed_at").alias("at"))


@query("""SELECT project_id, count(*) AS n FROM code_repo c WHERE NOT EXISTS (SELECT 1 FROM (SELECT project_id AS p, unnest(removed) AS f FROM commits) r
    WHERE r.p = c.project_id AND r.f = c.file_path) GROUP BY project_id""")
def k3_delete_files(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "commits").select("project_id", F.explode("removed").alias("file_path"))
    return K.delete(table(spark, d, "code_repo"), gone, ["project_id", "file_path"]).groupBy("project_id").agg(F.count("*").alias("n"))


@query("SELECT project_id, count(*) AS n FROM code_repo WHERE project_id <> (SELECT min(project_id) FROM code_repo) GROUP BY project_id")
def k4_delete_project(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_repo")
    return K.delete(c, c.select(F.min("project_id").alias("project_id")), ["project_id"]).groupBy("project_id").agg(F.count("*").alias("n"))


@query(f"""SELECT project_id, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM (
    SELECT * FROM code_repo o WHERE last_indexed_at < {CUT} AND NOT EXISTS (SELECT 1 FROM code_repo w WHERE w.last_indexed_at >= {CUT} AND w.project_id = o.project_id AND w.file_path = o.file_path)
    UNION ALL SELECT * FROM code_repo WHERE last_indexed_at >= {CUT}) GROUP BY project_id""")
def k5_replace_files(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return K.replace(old, new, new, ["project_id", "file_path"]).groupBy("project_id").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("chunks"))


@query(f"""WITH h AS (SELECT sha256(content) AS h, last_indexed_at AS t FROM code_repo), cache AS (SELECT DISTINCT h FROM h WHERE t < {CUT}), wanted AS (SELECT h FROM h WHERE t >= {CUT})
    SELECT 'hit' AS kind, count(*) AS n FROM wanted WHERE h IN (SELECT h FROM cache) UNION ALL SELECT 'miss', count(DISTINCT h) FROM wanted WHERE h NOT IN (SELECT h FROM cache)""")
def k6_embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    named = lambda c: c.select(X.content_hash(F.col("content")).alias("content_hash"))
    hits, misses = K.cache_split(named(new), named(old).distinct())
    return hits.agg(F.lit("hit").alias("kind"), F.count("*").alias("n")).unionByName(misses.agg(F.lit("miss").alias("kind"), F.count("*").alias("n")))


@query("""SELECT n.c AS collection, count(r.chunk_id) AS points, count(r.chunk_id) > 0 AS populated FROM (VALUES ('code_repo'), ('app_docs'), ('incident_reports')) n(c)
    LEFT JOIN code_repo r ON r.source_collection = n.c GROUP BY 1""")
def k9_collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.statistics(table(spark, d, "code_repo"))


@query("""WITH f AS (SELECT DISTINCT project_id, file_path FROM files), s AS (SELECT project_id, file_path, count(DISTINCT symbol_id) AS k FROM symbols GROUP BY 1, 2)
    SELECT f.project_id, count(*) AS files, count(*) FILTER (s.k IS NULL) AS files_without_symbols, coalesce(sum(s.k), 0)::BIGINT AS symbols FROM f LEFT JOIN s USING (project_id, file_path) GROUP BY 1""")
def a1_run_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.run_statistics(table(spark, d, "files"), table(spark, d, "symbols"))


# --- chunking -------------------------------------------------------------------------------------------------------
@query()
def t1_symbols(spark: SparkSession, d: str) -> DataFrame:
    return S.extract(table(spark, d, "files")).drop("body")


@query("""WITH f AS (SELECT DISTINCT file_id, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls FROM files WHERE (language IS NULL OR language = 'unknown') AND length(content) > 0)
    SELECT file_id, 'chunk_' || i AS name, i * 50 + 1 AS start_line, least((i + 1) * 50, len(ls)) AS end_line, md5(array_to_string(ls[i * 50 + 1 : (i + 1) * 50], chr(10))) AS body_md5
    FROM f, LATERAL (SELECT unnest(range(0, ceil(len(ls) / 50.0)::BIGINT)) AS i)""")
def t2_windows(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").filter("language IS NULL OR language = 'unknown'").select("file_id", "content").distinct()
    return T.windows(f).select("file_id", "name", F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint"), F.md5("body").alias("body_md5"))


@query(f"""WITH own AS (SELECT DISTINCT project_id, file_path, coalesce(qualified_name, name) AS qualified_name, symbol_type, {strip_sql('''CASE WHEN coalesce(docstring, '') = '' THEN body
        WHEN language = 'python' THEN '"""' || docstring || '"""' || chr(10) || body ELSE '/* ' || docstring || ' */' || chr(10) || body END''')} AS content, start_line, end_line
        FROM symbols WHERE {strip_sql("coalesce(body, '')")} <> ''),
    module AS (SELECT DISTINCT f.project_id, f.file_path, '__module__', 'module', f.content, 1, len(string_split(regexp_replace(f.content, '\\n$', ''), chr(10)))::INT FROM files f
        WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.project_id = f.project_id AND s.file_path = f.file_path) AND {strip_sql('f.content')} <> '')
    SELECT sha256(project_id || ':' || file_path || ':' || qualified_name || ':' || content) AS chunk_id, symbol_type, start_line, end_line FROM (SELECT * FROM own UNION ALL SELECT * FROM module)""")
def t3_symbol_chunks(spark: SparkSession, d: str) -> DataFrame:
    return T.symbol_chunks(table(spark, d, "symbols"), table(spark, d, "files")).select("chunk_id", "symbol_type", "start_line", "end_line")


@query("""SELECT DISTINCT chunk_id, CASE WHEN coalesce(repo_url, '') = '' THEN '' ELSE regexp_replace(repo_url, '/+$', '') || CASE scm_provider WHEN 'gitlab' THEN '/-/blob/' ELSE '/blob/' END
    || CASE WHEN coalesce(commit_sha, '') IN ('', 'HEAD') THEN coalesce(branch, '') ELSE commit_sha END || '/' || file_path || '#L' || start_line
    || CASE WHEN start_line = end_line THEN '' WHEN scm_provider = 'gitlab' THEN '-' || end_line ELSE '-L' || end_line END END AS link FROM code_repo WHERE scm_provider IS NOT NULL""")
def t5_permalink(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    link = X.permalink(c("scm_provider"), c("repo_url"), c("file_path"), c("branch"), c("commit_sha"), c("start_line"), c("end_line"))
    return table(spark, d, "code_repo").filter("scm_provider IS NOT NULL").select("chunk_id", link.alias("link")).distinct()


SECTIONS = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
    h AS (SELECT *, regexp_matches(line, '^#{{1,6}}[ \\t]+(.+)$') AS is_h FROM l), g AS (SELECT *, sum(is_h::INT) OVER (PARTITION BY doc_id ORDER BY n) AS i FROM h),
    s AS (SELECT doc_id, i, max(CASE WHEN is_h THEN length(regexp_extract(line, '^(#{{1,6}})[ \\t]', 1)) ELSE 0 END) AS level,
        max(CASE WHEN is_h THEN {strip_sql("regexp_extract(line, '^#{1,6}[ \\t]+(.+)$', 1)".replace("{", "{").replace("}", "}"))} ELSE '' END) AS heading,
        coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT is_h), '') AS body FROM g GROUP BY doc_id, i),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section_no FROM s WHERE i > 0 OR {strip_sql('body')} <> ''),
    p AS (SELECT a.doc_id, a.i, string_agg(b.heading, ' / ' ORDER BY b.i) AS section_path FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.i <= a.i AND b.i > 0
        AND NOT EXISTS (SELECT 1 FROM k c WHERE c.doc_id = a.doc_id AND c.i > b.i AND c.i <= a.i AND c.level <= b.level) WHERE a.i > 0 GROUP BY 1, 2)"""


@query(SECTIONS + " SELECT k.doc_id, k.section_no, k.level, k.heading, coalesce(p.section_path, '') AS section_path, md5(k.body) AS body_md5 FROM k LEFT JOIN p USING (doc_id, i)")
def t6_sections(spark: SparkSession, d: str) -> DataFrame:
    s = T.sections(table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", F.col("section_no").cast("bigint"), F.col("level").cast("bigint"), "heading", "section_path", F.md5("body").alias("body_md5"))


@query(f"""SELECT doc_id, 'Paragraph ' || i AS heading, md5({strip_sql('body')}) AS body_md5 FROM (SELECT doc_id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS body,
    generate_subscripts(string_split_regex(text, '\\n\\s*\\n'), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE {strip_sql('body')} <> ''""")
def t7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return T.paragraphs(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "heading", F.md5("body").alias("body_md5"))


@query(SECTIONS.replace("WITH l AS", "WITH RECURSIVE l AS") + f""", q AS (SELECT k.doc_id, k.section_no, k.heading, coalesce(p.section_path, '') AS section_path, k.body, CASE WHEN k.heading = '' THEN {strip_sql('k.body')}
        ELSE {strip_sql("repeat('#', greatest(k.level, 1)::INT) || ' ' || k.heading || chr(10) || chr(10) || " + strip_sql('k.body'))} END AS text FROM k LEFT JOIN p USING (doc_id, i)),
    ps AS (SELECT *, list_filter(list_transform(string_split_regex(body, '\\n\\s*\\n'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS ps FROM q WHERE length(text) > 4000),
    r AS (SELECT doc_id, section_no, heading, ps, 0 AS n, CASE WHEN heading = '' THEN '' ELSE '# ' || heading || chr(10) || chr(10) END AS cur, 0 AS j, NULL::VARCHAR AS done FROM ps
        UNION ALL SELECT doc_id, section_no, heading, ps, n + 1, CASE WHEN full_ THEN '# ' || heading || ' (continued)' || chr(10) || chr(10) || x || chr(10) || chr(10) ELSE cur || x || chr(10) || chr(10) END, CASE WHEN full_ THEN j + 1 ELSE j END, CASE WHEN full_ THEN {strip_sql('cur')} END
        FROM (SELECT *, ps[n + 1] AS x, length(cur) + length(ps[n + 1]) > 4000 AND {strip_sql('cur')} <> '' AS full_ FROM r WHERE n < len(ps))),
    pieces AS (SELECT doc_id, section_no, j - 1 AS j, done AS content FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, section_no, j, {strip_sql('cur')} FROM r WHERE n = len(ps) AND {strip_sql('cur')} <> ''
        UNION ALL SELECT doc_id, section_no, 0, text FROM q WHERE length(text) BETWEEN 50 AND 4000)
    SELECT doc_id, (section_no * 100 + j)::INT AS chunk_index, section_path, heading, content, sha256('application_docs:' || doc_id || ':' || (section_no * 100 + j)::INT || ':' || content) AS chunk_id FROM pieces JOIN q USING (doc_id, section_no)""".replace("JOIN q USING (doc_id, section_no)", "JOIN (SELECT doc_id, section_no, section_path, heading FROM q) USING (doc_id, section_no)"))
def t9_section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return T.section_chunks(table(spark, d, "documents"), "doc_id", "text", F.lit("application_docs"))


@query(SECTIONS + """ SELECT doc_id, section_no, nullif(upper(regexp_extract(heading, '(?i)\\b(P[1-4])\\b', 1)), '') AS severity, nullif(regexp_extract(heading, '\\b(\\d{4}-\\d{2}-\\d{2})\\b', 1), '') AS incident_date,
    array_to_string(regexp_extract_all(heading, '\\b([A-Z][a-z]+(?:Service|Api|Worker|Queue|Handler))\\b', 1), ',') AS affected FROM k WHERE heading <> ''""")
def t11_incident_fields(spark: SparkSession, d: str) -> DataFrame:
    s = T.sections(table(spark, d, "documents"), "doc_id", "text").filter("heading <> ''")
    s = s.select("doc_id", F.col("section_no").cast("bigint"), *T.incident_fields(F.col("heading")))
    return s.withColumn("affected", F.array_join("affected_services", ",")).drop("affected_services")


@query(f"""WITH d AS (SELECT doc_id, project_id, text, string_split_regex(text, '\\n\\s*\\n') AS ps FROM documents WHERE text IS NOT NULL AND doc_kind = 'issues'),
    m AS (SELECT doc_id, -1 AS comment_no, '# Issue Report #' || doc_id || ': ' || substr(text, 1, 40) || chr(10) || chr(10) || '**State:** open' || chr(10) || chr(10) || CASE WHEN text = '' THEN '(no description)' ELSE text END AS content FROM d),
    c AS (SELECT doc_id, i - 1 AS comment_no, {strip_sql('b')} AS b FROM (SELECT doc_id, unnest(ps) AS b, generate_subscripts(ps, 1) AS i FROM d))
    SELECT doc_id, comment_no, md5(content) AS content_md5 FROM m UNION ALL
    SELECT doc_id, comment_no, md5('## Comment by unknown on Issue Report #' || doc_id || chr(10) || chr(10) || b) FROM c WHERE length(b) >= 10""")
def t13_discussions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL AND doc_kind = 'issues'")
    said = F.transform(F.split("text", r"\n\s*\n"), lambda p: F.struct(F.lit(None).cast("string").alias("author"), p.alias("body")))
    threads = docs.select("project_id", F.lit("issue_report").alias("context_type"), F.col("doc_id").alias("context_id"), F.substring("text", 1, 40).alias("title"), F.lit("open").alias("state"),
                          F.lit("").alias("author"), F.col("text").alias("body"), said.alias("comments"))
    return T.discussion_chunks(threads).select(F.col("context_id").alias("doc_id"), F.col("comment_no").cast("bigint"), F.md5("content").alias("content_md5"))


@query()
def t14_imports(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").withColumn("language", F.coalesce("language", X.language("file_path")))
    return T.import_entries(f).distinct()


@query("SELECT DISTINCT symbol_id, " + strip_sql("""regexp_replace(regexp_replace(docstring, '(?m)^```\\w*[ \\t]*$', '', 'g'), '^\\s*(?:\"\"\"|'''''')|(?:\"\"\"|'''''')\\s*$', '', 'g')""") + " AS doc FROM symbols WHERE docstring <> ''")
def t19_clean_docstring(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").filter("docstring <> ''").select("symbol_id", T.clean_docstring(F.col("docstring")).alias("doc")).distinct()


# --- filters --------------------------------------------------------------------------------------------------------
@query("SELECT language, count(*) AS n FROM code_repo WHERE source_collection = 'code_repo' AND language IN ('python', 'go') GROUP BY 1")
def f1_payload_filter(spark: SparkSession, d: str) -> DataFrame:
    return V.matches(table(spark, d, "code_repo"), {"source_collection": "code_repo", "language": ["python", "go"]}).groupBy("language").agg(F.count("*").alias("n"))


TOKENS = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9_]+'), lambda t: length(t) BETWEEN 2 AND 40)"


@query(f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND list_has_all({TOKENS.format(c='text')}, ['retry', 'budget'])")
def f4_text_match(spark: SparkSession, d: str) -> DataFrame:
    return V.lexical_match(table(spark, d, "documents"), ["Retry", "budget"], "text").select("doc_id")


@query("SELECT DISTINCT chunk_id, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '…' ELSE content END AS content FROM code_repo")
def f6_hit_view(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_repo").select("chunk_id", X.cut("content", 500).alias("content")).distinct()


@query("SELECT DISTINCT chunk_id, coalesce(nullif(scm_permalink, ''), nullif(repo_url, ''), '') AS link FROM code_repo")
def f8_link_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_repo").select("chunk_id", X.first_filled(F.col("scm_permalink"), F.col("repo_url")).alias("link")).distinct()


HMAC_KEY = b"hook-signing".ljust(64, b"\0")
HMAC = f"sha256(from_hex('{bytes(x ^ 0x5C for x in HMAC_KEY).hex()}') || from_hex(sha256(from_hex('{bytes(x ^ 0x36 for x in HMAC_KEY).hex()}') || encode(message))))"


@query(f"SELECT DISTINCT sha, {HMAC} AS signature FROM commits")
def f12_signature(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits").select("sha", X.hmac_sha256("hook-signing", F.col("message")).alias("signature")).distinct()


@query("SELECT DISTINCT project_id, string_split(project_id, '/')[-1] AS short FROM projects")
def f13_project_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").select("project_id", F.element_at(F.split("project_id", "/"), -1).alias("short")).distinct()


# --- search ---------------------------------------------------------------------------------------------------------
DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
DENSE = f"""WITH dense AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
    (SELECT a.vec_id AS query_id, b.vec_id, {DOT} AS score FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 50 = 0) QUALIFY rank <= 20)"""


def _dense(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.dense(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


@query(DENSE + " SELECT query_id, vec_id, round(score, 6) AS score, rank FROM dense")
def v4_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@query(f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND list_has_all({TOKENS.format(c='text')}, ['call', 'graph']) ORDER BY doc_id LIMIT 20")
def v5_lexical_match(spark: SparkSession, d: str) -> DataFrame:
    return V.lexical_match(table(spark, d, "documents"), ["call", "graph"], "text").select("doc_id").orderBy("doc_id").limit(20)


BM25 = f"""WITH d AS (SELECT doc_id, {TOKENS.format(c="coalesce(text, '')")} AS t FROM documents), s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d),
    tf AS (SELECT doc_id, w, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, unnest(t) AS w, len(t) AS n FROM d) WHERE w IN ('retry', 'budget', 'nightly') GROUP BY 1, 2),
    df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
    bm AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM tf JOIN df USING (w), s GROUP BY 1)"""


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return V.bm25(table(spark, d, "documents"), ["retry", "budget", "nightly"], "doc_id", "text")


@query(BM25 + " SELECT doc_id, round(score, 6) AS score FROM bm")
def v5_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("doc_id", F.round("score", 6).alias("score"))


@query(DENSE + """, lex AS (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label
        WHERE a.vec_id % 50 = 0 QUALIFY rank <= 20), u AS (SELECT query_id, vec_id, rank AS dr, NULL::BIGINT AS tr FROM dense UNION ALL SELECT query_id, vec_id, NULL, rank FROM lex),
    o AS (SELECT query_id, vec_id, min(dr) AS dr, min(tr) AS tr FROM u GROUP BY 1, 2), z AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + tr), 0) AS score FROM o)
    SELECT query_id, vec_id, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, tr NULLS LAST, vec_id) AS rank FROM z QUALIFY rank <= 20""")
def v7_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # the keyword arm gives the first 20 of a label in the order of ids: they are taken before queries meet them
    text = K.top_per_group(e.select("vec_id", "label"), ["label"], 20, F.asc("vec_id")).join(q, "label").drop("label")
    fused = V.fuse(_dense(spark, d), text, "vec_id", 20, ["query_id"])
    return fused.select("query_id", "vec_id", F.round("score", 8).alias("score"), F.col("rank").cast("bigint"))


@query(BM25 + """, a AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20), b AS (SELECT doc_id, score * 1.5 AS score FROM bm ORDER BY score DESC, doc_id LIMIT 10),
    u AS (SELECT *, 'code_repo' AS collection FROM a UNION ALL SELECT *, 'app_docs' FROM b) SELECT doc_id, round(max(score), 6) AS score FROM u GROUP BY 1""")
def v9_fan_out(spark: SparkSession, d: str) -> DataFrame:
    b = _bm25(spark, d)
    out = V.fan_out({"code_repo": b, "app_docs": b.withColumn("score", F.col("score") * 1.5)}, 10, "doc_id")
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT DISTINCT chunk_id, symbol_name, qualified_name FROM code_repo), r AS (SELECT *, row_number() OVER (ORDER BY chunk_id) AS rank FROM c),
    w AS (SELECT symbol_name AS s FROM r WHERE rank = 7), m AS (SELECT r.*, CASE WHEN symbol_name = s OR qualified_name = s THEN 0 WHEN contains(lower(symbol_name), lower(s)) THEN 1 END AS match FROM r, w WHERE rank <= 10)
    SELECT chunk_id, match FROM m WHERE match IS NOT NULL ORDER BY match, rank LIMIT 1""")
def v12_entity(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    c = table(spark, d, "code_repo").select("chunk_id", "symbol_name", "qualified_name").distinct().orderBy("chunk_id").limit(10)
    hits = c.withColumn("rank", F.row_number().over(W.orderBy("chunk_id")))
    wanted = hits.filter("rank = 7").first().symbol_name
    return V.find_entity(hits, wanted).select("chunk_id", "match")


@query("""WITH m AS (SELECT doc_id, text, lower(text) AS low, instr(lower(text), 'call graph') AS pos FROM documents WHERE contains(lower(text), 'call graph'))
    SELECT doc_id, ((length(low) - length(replace(low, 'call graph', ''))) / 10)::INT AS score, CASE WHEN pos > 81 THEN '...' ELSE '' END
    || replace(substr(text, greatest(pos - 81, 0) + 1, least(pos + 129, length(text)) - greatest(pos - 81, 0)), chr(10), ' ') || CASE WHEN pos + 129 < length(text) THEN '...' ELSE '' END AS snippet
    FROM m ORDER BY score DESC, doc_id LIMIT 20""")
def v14_wiki_search(spark: SparkSession, d: str) -> DataFrame:
    return V.wiki_search(table(spark, d, "documents"), " Call graph", "doc_id", "text")


@query(f"""WITH q AS (SELECT ['retry', 'budget', 'nightly', 'index'] AS q), s AS (SELECT doc_id, len(list_intersect(q, {TOKENS.format(c="substr(coalesce(text, ''), 1, 2048)")})) / 4.0::DOUBLE * 20 - 10 AS score FROM documents, q)
    SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 50""")
def v15_rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.col("doc_id").alias("rank"), F.lit(0.0).alias("score"))
    return V.rerank(hits, "retry budget nightly index", 50).select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@query(BM25 + """, h AS (SELECT bm.doc_id, bm.score, source FROM bm JOIN documents USING (doc_id)), g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM h)
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM g WHERE n <= 2 ORDER BY score DESC, doc_id LIMIT 25""")
def v17_diversity(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "documents").select("doc_id", F.col("source").alias("file_path"))
    hits = _bm25(spark, d).join(src, "doc_id").withColumn("rank", F.col("doc_id"))
    return V.diverse(hits, 25).select("doc_id", F.col("rank").cast("bigint"))


@query(BM25 + " SELECT doc_id, round(greatest(least((score * 3 - 5 + 10) / 20, 1.0), 0.0), 6) AS confidence FROM bm")
def v18_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("doc_id", F.round(X.confidence(F.col("score") * 3 - 5), 6).alias("confidence"))


@query("""SELECT n.c AS collection, count(t.doc_id) AS hits FROM (VALUES ('code_repo'), ('app_docs'), ('incident_reports')) n(c)
    LEFT JOIN (SELECT doc_id, CASE doc_kind WHEN 'incidents' THEN 'incident_reports' WHEN 'wiki' THEN 'app_docs' ELSE 'other' END AS c FROM documents) t ON t.c = n.c GROUP BY 1""")
def v20_collection_hits(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_kind") == "incidents", "incident_reports").when(F.col("doc_kind") == "wiki", "app_docs").otherwise("other")
    return V.collection_hits(table(spark, d, "documents").select(kind.alias("collection")))


@query("""WITH h AS (SELECT chunk_id, file_path, symbol_name, start_line, end_line, content, row_number() OVER (ORDER BY chunk_id, last_indexed_at) AS rank FROM (SELECT DISTINCT chunk_id, file_path, symbol_name, start_line, end_line, content, 0 AS last_indexed_at FROM code_repo) QUALIFY rank <= 5)
    SELECT string_agg('[' || rank || '] ' || file_path || ' | ' || symbol_name || ' | ' || start_line || '-' || end_line || chr(10) || content, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM h""")
def v21_context(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    h = table(spark, d, "code_repo").select("chunk_id", "file_path", "symbol_name", "start_line", "end_line", "content").distinct().orderBy("chunk_id").limit(5)
    return V.context(h.withColumn("rank", F.row_number().over(W.orderBy("chunk_id"))))


# --- joins ----------------------------------------------------------------------------------------------------------
def comps_sql(symbols: str = "symbols", imports: str = "imports", before: str = "") -> str:
    place = "{'f': file_path, 's': start_line, 'c': component_id}"
    return f"""WITH {before}c AS (SELECT project_id, coalesce(qualified_name, name) AS component_id, name, file_path, {DIR.format(c='file_path')} AS directory, min(start_line) AS start_line FROM {symbols} GROUP BY 1, 2, 3, 4),
    p AS (SELECT *, {place} AS "at" FROM c), calls AS (SELECT DISTINCT project_id, coalesce(qualified_name, name) AS caller_id, file_path AS caller_file, unnest(calls) AS call FROM {symbols}),
    im AS (SELECT DISTINCT project_id, source_file, imported_name, qualified_name FROM {imports} WHERE NOT is_wildcard AND qualified_name IS NOT NULL),
    t AS (SELECT k.project_id, k.caller_file, k.call, 1 AS tier, '' AS pos, 0 AS kind, p."at" FROM calls k JOIN p ON p.project_id = k.project_id AND p.component_id = k.call
    UNION ALL SELECT k.project_id, k.caller_file, k.call, 2, im.qualified_name, 0, p."at" FROM calls k JOIN im ON im.project_id = k.project_id AND im.source_file = k.caller_file AND im.imported_name = k.call JOIN p ON p.project_id = k.project_id AND p.component_id = im.qualified_name
    UNION ALL SELECT k.project_id, k.caller_file, k.call, 2, im.qualified_name, 1, p."at" FROM calls k JOIN im ON im.project_id = k.project_id AND im.source_file = k.caller_file AND im.imported_name = k.call
        JOIN p ON p.project_id = k.project_id AND ends_with(p.component_id, '.' || k.call) AND contains(p.component_id, im.qualified_name)
    UNION ALL SELECT k.project_id, k.caller_file, k.call, 3, '', 0, p."at" FROM calls k JOIN p ON p.project_id = k.project_id AND p.file_path = k.caller_file AND ends_with(p.component_id, '.' || k.call)
    UNION ALL SELECT k.project_id, k.caller_file, k.call, 4, '', CASE WHEN p.directory = {DIR.format(c='k.caller_file')} THEN 0 ELSE 1 END, p."at" FROM calls k JOIN p ON p.project_id = k.project_id AND p.name = k.call),
    best AS (SELECT project_id, caller_file, call, min({{'tier': tier, 'pos': pos, 'kind': kind, 'at': "at"}}) AS b FROM t GROUP BY 1, 2, 3),
    resolved AS (SELECT k.*, b.b.tier AS tier, b.b.at.c AS callee_id FROM calls k LEFT JOIN best b USING (project_id, caller_file, call)),
    edges AS (SELECT DISTINCT project_id, caller_id AS src, callee_id AS dst FROM resolved WHERE callee_id IS NOT NULL AND callee_id <> caller_id)"""


COMPS = comps_sql()


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols")
    return J.resolve(J.calls_of(s), J.components(s), table(spark, d, "imports"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return J.edges(_resolved(spark, d))


@query(COMPS + " SELECT project_id, caller_id, caller_file, call, tier, callee_id FROM resolved WHERE call IS NOT NULL")
def j3_call_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)


@query(COMPS + " SELECT project_id, src, dst FROM edges")
def j4_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(COMPS + """, o AS (SELECT project_id, src AS node, count(*) AS callees, array_to_string(list_sort(list(dst))[1:20], ',') AS first_callees FROM edges GROUP BY 1, 2), i AS (SELECT project_id, dst AS node, count(*) AS callers FROM edges GROUP BY 1, 2)
    SELECT project_id, node, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(first_callees, '') AS first_callees FROM o FULL JOIN i USING (project_id, node)""")
def j5_callers_callees(spark: SparkSession, d: str) -> DataFrame:
    return J.callers_and_callees(_edges(spark, d))


@query("""WITH k AS (SELECT DISTINCT file_id, start_line AS a, end_line AS e, name FROM symbols WHERE symbol_type = 'class'), f AS (SELECT DISTINCT symbol_id, file_id, start_line, end_line FROM symbols WHERE symbol_type IN ('function', 'method'))
    SELECT symbol_id, name AS class_name FROM f JOIN k ON f.file_id = k.file_id AND f.start_line >= k.a AND f.end_line <= k.e QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY k.a, k.e DESC, name) = 1""")
def j6_enclosing_class(spark: SparkSession, d: str) -> DataFrame:
    return J.enclosing_class(table(spark, d, "symbols"))


@query(COMPS + """, docs AS (SELECT project_id, coalesce(qualified_name, name) AS dst, max(docstring) AS doc FROM symbols GROUP BY 1, 2)
    SELECT e.project_id, e.src, e.dst, substr(coalesce(doc, ''), 1, 200) AS doc FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY project_id, src ORDER BY dst) <= 5) e LEFT JOIN docs USING (project_id, dst)""")
def j10_callee_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "symbols").select("project_id", F.coalesce("qualified_name", "name").alias("component_id"), F.col("docstring").alias("doc"))
    return J.documented_callees(_edges(spark, d), docs)


# --- evaluation -----------------------------------------------------------------------------------------------------
RANKING = DENSE + """, r AS (SELECT d.query_id, d.rank, a.label = b.label AND d.query_id <> d.vec_id AS rel FROM dense d JOIN embeddings a ON a.vec_id = d.query_id JOIN embeddings b ON b.vec_id = d.vec_id),
    m AS (SELECT query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (rel), 0) AS mrr, max((rel AND rank <= 1)::INT)::DOUBLE AS hit_1, max((rel AND rank <= 3)::INT)::DOUBLE AS hit_3, max((rel AND rank <= 5)::INT)::DOUBLE AS hit_5, max((rel AND rank <= 10)::INT)::DOUBLE AS hit_10,
        coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 5), 0) AS g5, count(*) FILTER (rel AND rank <= 5) AS n5, coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 10), 0) AS g10, count(*) FILTER (rel AND rank <= 10) AS n10 FROM r GROUP BY 1),
    e AS (SELECT query_id, mrr, hit_1, hit_3, hit_5, hit_10, CASE WHEN n5 = 0 THEN 0 ELSE g5 / list_sum(list_transform(range(1, n5 + 1), lambda i: 1 / log2(i + 1))) END AS ndcg_5, CASE WHEN n10 = 0 THEN 0 ELSE g10 / list_sum(list_transform(range(1, n10 + 1), lambda i: 1 / log2(i + 1))) END AS ndcg_10 FROM m)"""
METRICS = ["mrr", "hit_1", "hit_3", "hit_5", "hit_10", "ndcg_5", "ndcg_10"]


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "embeddings").select("vec_id", "label")
    hits = _dense(spark, d).join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return A.ranking(hits.select("query_id", "rank", ((F.col("label") == F.col("own")) & (F.col("query_id") != F.col("vec_id"))).alias("rel")))


@query(RANKING + " SELECT query_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM e")
def a7_ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d).select("query_id", *[F.round(m, 6).alias(m) for m in METRICS])


@query(RANKING + " SELECT count(*) AS cases, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + " FROM e")
def a3_mean_metrics(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    return A.mean_over_cases(_ranking(spark, d), q).select("cases", *[F.round(m, 6).alias(m) for m in METRICS])


@query(RANKING + """ SELECT metric, round(value, 6) AS value, threshold, value >= threshold AS passed FROM (SELECT 'mrr' AS metric, avg(mrr) AS value, 0.40::DOUBLE AS threshold FROM e UNION ALL SELECT 'hit_3', avg(hit_3), 0.55 FROM e
    UNION ALL SELECT 'hit_5', avg(hit_5), 0.70 FROM e UNION ALL SELECT 'ndcg_5', avg(ndcg_5), 0.45 FROM e)""")
def a8_thresholds(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    t = A.thresholds(A.mean_over_cases(_ranking(spark, d), q), {"mrr": 0.40, "hit_3": 0.55, "hit_5": 0.70, "ndcg_5": 0.45})
    return t.withColumn("value", F.round("value", 6))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[least(floor(len(v) * 50 / 100.0), len(v) - 1)::BIGINT + 1] AS p50,
    v[least(floor(len(v) * 95 / 100.0), len(v) - 1)::BIGINT + 1] AS p95, v[least(floor(len(v) * 99 / 100.0), len(v) - 1)::BIGINT + 1] AS p99 FROM s""")
def a5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return A.percentile(table(spark, d, "events"), ["event_type"], "value", 50, 95, 99)


@query("SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a6_profile(spark: SparkSession, d: str) -> DataFrame:
    return A.profile(table(spark, d, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, round(coalesce(avg(value) FILTER (value > 10), 0), 6) AS mean FROM events GROUP BY 1")
def a4_mean_positive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.coalesce(F.avg(F.when(F.col("value") > 10, F.col("value"))), F.lit(0.0)), 6).alias("mean"))


QUALITY = "SELECT l_orderkey * 10 + l_linenumber AS doc, (l_quantity % 5) + 1 AS a, (l_linenumber % 5) + 1 AS b, (l_suppkey % 5) + 1 AS c FROM lineitem"


def _quality(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS doc", "(l_quantity % 5) + 1 AS a", "(l_linenumber % 5) + 1 AS b", "(l_suppkey % 5) + 1 AS c")
    return A.quality(q, "doc", ["a", "b", "c"])


@query(f"SELECT doc, round((a + b + c) / 3, 2) AS overall, (a + b + c) / 3 >= 3.5 AND least(a, b, c) >= 2 AS passed FROM ({QUALITY})")
def a10_quality(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d)


@query(f"SELECT round(avg(((a + b + c) / 3 >= 3.5 AND least(a, b, c) >= 2)::INT), 6) AS pass_rate FROM ({QUALITY})")
def a11_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    return A.pass_rate(_quality(spark, d), "passed").select(F.round("pass_rate", 6).alias("pass_rate"))


@query("""SELECT DISTINCT project_id, unnest(list_concat(coalesce(added, []), coalesce(modified, []))) AS file_path, 'changed' AS change FROM commits UNION SELECT DISTINCT project_id, unnest(removed), 'removed' FROM commits""")
def a12_changed_files(spark: SparkSession, d: str) -> DataFrame:
    return R.changed_files(table(spark, d, "commits"), ["project_id"])


@query("""SELECT project_id, CASE WHEN len(p) >= 2 THEN p[-2] ELSE regexp_replace(file_path, '\\.[^.]*$', '') END AS module, count(DISTINCT component_id) AS members FROM
    (SELECT project_id, file_path, string_split(file_path, '/') AS p, coalesce(qualified_name, name) AS component_id FROM symbols) GROUP BY 1, 2""")
def a14_by_directory(spark: SparkSession, d: str) -> DataFrame:
    return M.by_directory(J.components(table(spark, d, "symbols")))


@query("""WITH m AS (SELECT DISTINCT project_id, """ + DIR.format(c="file_path") + """ AS module, symbol_id, body FROM symbols)
    SELECT project_id, module, count(*) AS members, floor(sum(length(body)) / 4)::BIGINT AS tokens, count(*) > 8 OR floor(sum(length(body)) / 4) > 12000 AS split FROM m GROUP BY 1, 2""")
def a16_module_size(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "symbols").select("project_id", X.directory("file_path").alias("module"), F.col("symbol_id").alias("component_id"), F.col("body").alias("source")).distinct()
    return M.too_large(m)


@query("SELECT project_id, name, count(DISTINCT coalesce(qualified_name, name)) AS ids FROM symbols GROUP BY 1, 2")
def a20_name_index(spark: SparkSession, d: str) -> DataFrame:
    return J.components(table(spark, d, "symbols")).groupBy("project_id", "name").agg(F.countDistinct("component_id").alias("ids"))


# --- windows, order, sets -------------------------------------------------------------------------------------------
@query("SELECT chunk_id, max(end_line - start_line) AS score FROM code_repo GROUP BY 1")
def w1_keep_best(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_repo").select("chunk_id", (F.col("end_line") - F.col("start_line")).alias("score"))
    return V.keep_best(c)


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 3""")
def w3_top_per_group(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return K.top_per_group(e, ["user_id"], 3, F.desc("value"), F.asc("event_id")).select("user_id", "event_id", F.col("rank").cast("bigint"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def o1_top_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50)


@query("SELECT project_id, file_path FROM files EXCEPT SELECT project_id, file_path FROM symbols")
def u5_files_without_symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("project_id", "file_path").subtract(table(spark, d, "symbols").select("project_id", "file_path"))


@query("SELECT project_id FROM commits INTERSECT SELECT project_id FROM imports")
def u3_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits").select("project_id").intersect(table(spark, d, "imports").select("project_id"))


# --- graphs and modules ---------------------------------------------------------------------------------------------
def _node(p: str, n: str) -> F.Column:
    return F.concat_ws("|", p, n)


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select(_node("project_id", "src").alias("src"), _node("project_id", "dst").alias("dst"))


@query(COMPS + ", g AS (SELECT project_id || '|' || src AS src, project_id || '|' || dst AS dst FROM edges), n AS (SELECT DISTINCT project_id || '|' || component_id AS node FROM c) "
       "SELECT node, NOT EXISTS (SELECT 1 FROM g WHERE src = node) AS leaf, NOT EXISTS (SELECT 1 FROM g WHERE dst = node) AS root FROM n")
def g5_leaves_roots(spark: SparkSession, d: str) -> DataFrame:
    nodes = J.components(table(spark, d, "symbols")).select(_node("project_id", "component_id").alias("node")).distinct()
    leaf, root = G.leaves_and_roots(nodes, _graph(spark, d))
    out = nodes.join(leaf.withColumn("leaf", F.lit(True)), "node", "left").join(root.withColumn("root", F.lit(True)), "node", "left")
    return out.select("node", F.coalesce("leaf", F.lit(False)).alias("leaf"), F.coalesce("root", F.lit(False)).alias("root"))


#: Strong components of edges g(src, dst) by transitive closure; edges that breaking cycles keeps; longest chains of these.
STRONG = """, rr AS (SELECT src AS x, dst AS y FROM g UNION SELECT rr.x, g.dst FROM rr JOIN g ON g.src = rr.y), sc AS (SELECT a.x AS node, least(a.x, min(a.y)) AS component FROM rr a JOIN rr b ON a.x = b.y AND a.y = b.x WHERE a.x <> a.y GROUP BY a.x),
    gone AS (SELECT g.src, g.dst FROM g JOIN sc a ON a.node = g.src JOIN sc b ON b.node = g.dst AND a.component = b.component WHERE g.dst >= g.src), kept AS (SELECT src, dst FROM g WHERE src <> dst EXCEPT SELECT src, dst FROM gone),
    lv AS (SELECT node, 0 AS d FROM (SELECT src AS node FROM g UNION SELECT dst FROM g) n WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.src = n.node) UNION SELECT k.src, lv.d + 1 FROM lv JOIN kept k ON k.dst = lv.node)"""
GRAPH = RECURSIVE(COMPS) + ", g AS (SELECT project_id || '|' || src AS src, project_id || '|' || dst AS dst FROM edges)" + STRONG


@query(GRAPH + " SELECT node, component FROM sc")
def g2_cycles(spark: SparkSession, d: str) -> DataFrame:
    return G.strong_components(_graph(spark, d))


@query(GRAPH + " SELECT node, max(d) AS level FROM lv GROUP BY 1")
def g4_levels(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return G.topological_levels(g.select(F.col("src").alias("node")), g)


@query(COMPS + """, g AS (SELECT project_id || '|' || src AS src, project_id || '|' || dst AS dst FROM edges), h1 AS (SELECT src AS start, dst AS node FROM g),
    h2 AS (SELECT DISTINCT a.start, b.dst AS node FROM h1 a JOIN g b ON a.node = b.src WHERE b.dst <> a.start AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.start = a.start AND x.node = b.dst))
    SELECT start, node, 1 AS distance FROM h1 UNION ALL SELECT start, node, 2 FROM h2""")
def g6_two_hops(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return G.neighbours(g, g.select(F.col("src").alias("node")).distinct(), 2)


REACH = """, b AS (SELECT src AS x, dst AS y FROM g UNION SELECT dst, src FROM g), cc(node, seen) USING KEY (node) AS (SELECT DISTINCT x, x FROM b UNION
    (SELECT b.y, min(cc.seen) FROM cc JOIN b ON b.x = cc.node JOIN recurring.cc AS r ON r.node = b.y WHERE cc.seen < r.seen GROUP BY b.y))"""


@query(RECURSIVE(COMPS) + ", g AS (SELECT project_id || '|' || src AS src, project_id || '|' || dst AS dst FROM edges)" + REACH + " SELECT node, seen AS component FROM cc")
def g1_connected(spark: SparkSession, d: str) -> DataFrame:
    return G.connected_components(_graph(spark, d))


AFFECTED = f"""WITH m AS (SELECT DISTINCT project_id, coalesce(qualified_name, name) AS component_id, file_path, {DIR.format(c='file_path')} AS module FROM symbols), ch AS (SELECT DISTINCT project_id, unnest(list_concat(coalesce(added, []), coalesce(modified, []))) AS file_path FROM commits),
    hit AS (SELECT DISTINCT project_id, component_id FROM m JOIN ch USING (project_id, file_path)), direct AS (SELECT DISTINCT m.project_id, m.module FROM m JOIN hit USING (project_id, component_id) WHERE m.module <> ''),
    again AS (SELECT DISTINCT project_id, array_to_string(string_split(module, '/')[1:i], '/') AS module FROM (SELECT project_id, module, unnest(range(1, len(string_split(module, '/')) + 1)) AS i FROM direct))"""


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    comps = J.components(table(spark, d, "symbols"))
    parts = F.split("directory", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    tree = comps.filter("directory <> ''").select("project_id", F.col("directory").alias("module"), up.alias("path")).distinct()
    return tree, comps.select("project_id", F.col("directory").alias("module"), "component_id").distinct(), comps


@query(AFFECTED + " SELECT project_id, module FROM again")
def g8_affected_modules(spark: SparkSession, d: str) -> DataFrame:
    tree, members, comps = _tree(spark, d)
    return M.affected(tree, members, comps, R.changed_files(table(spark, d, "commits"), ["project_id"]).filter("change = 'changed'"))


@query(AFFECTED + " SELECT DISTINCT project_id, module FROM m WHERE module <> '' AND NOT EXISTS (SELECT 1 FROM again a WHERE a.project_id = m.project_id AND a.module = m.module)")
def j8_reused_modules(spark: SparkSession, d: str) -> DataFrame:
    tree, _, _ = _tree(spark, d)
    return M.reused(tree, g8_affected_modules(spark, d)).select("project_id", "module")


@query(f"""WITH s AS (SELECT DISTINCT project_id, symbol_id::VARCHAR AS component_id, file_path, body, string_split({DIR.format(c='file_path')}, '/') AS dirs FROM symbols),
    a AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY project_id) <= 2 OR dirs[1] = '' THEN ['root'] ELSE dirs[1:1] END AS p1 FROM s),
    b AS (SELECT *, CASE WHEN (count(*) OVER w > 8 OR floor(sum(length(body)) OVER w / 4) > 12000) AND len(dirs) > 1 AND p1[1] <> 'root' THEN dirs[1:2] ELSE p1 END AS p2 FROM a WINDOW w AS (PARTITION BY project_id, p1)),
    d AS (SELECT *, CASE WHEN (count(*) OVER w > 8 OR floor(sum(length(body)) OVER w / 4) > 12000) AND len(p2) = 2 AND len(dirs) > 2 AND p2[1] <> 'root' THEN dirs[1:3] ELSE p2 END AS p3 FROM b WINDOW w AS (PARTITION BY project_id, p2))
    SELECT project_id, array_to_string(p3, '/') AS module, component_id FROM d""")
def g9_clusters(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select("project_id", F.col("symbol_id").cast("string").alias("component_id"), "file_path", F.col("body").alias("source")).distinct()
    return M.cluster(s).select("project_id", F.array_join("path", "/").alias("module"), "component_id")


@query(f"""WITH t AS (SELECT DISTINCT project_id, {DIR.format(c='file_path')} AS module FROM symbols) SELECT project_id, module, row_number() OVER (PARTITION BY project_id ORDER BY len(string_split(module, '/')) DESC, module) AS place FROM t WHERE module <> ''""")
def g10_leaf_first(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)[0].withColumn("path", F.split("module", "/"))
    return M.order(t).select("project_id", "module", F.col("place").cast("bigint"))


@query(f"""WITH t AS (SELECT DISTINCT project_id, {DIR.format(c='file_path')} AS module FROM symbols) SELECT project_id, string_agg(repeat('  ', len(string_split(module, '/')) - 1) || string_split(module, '/')[-1], chr(10) ORDER BY module) AS listing FROM t WHERE module <> '' GROUP BY 1""")
def g11_tree_listing(spark: SparkSession, d: str) -> DataFrame:
    return M.listing(_tree(spark, d)[0].select("project_id", F.split("module", "/").alias("path")))


# --- events ---------------------------------------------------------------------------------------------------------
def _pushes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits").select(
        F.col("sha").alias("event_id"), F.lit("push").alias("kind"), F.lit("refs/heads/main").alias("ref"), F.col("sha").alias("after"), F.col("project_id").alias("project"), F.col("authored_date").alias("at"),
        F.array(F.struct("added", "modified", "removed")).alias("commits"),
    )


@query("""SELECT sha AS event_id, project_id AS project, 'main' AS branch, array_to_string(list_sort(list_distinct(list_concat(added, modified))), ',') AS changed, array_to_string(list_sort(list_distinct(removed)), ',') AS removed
    FROM commits WHERE len(added) + len(modified) + len(removed) > 0""")
def r1_push_changes(spark: SparkSession, d: str) -> DataFrame:
    p = R.push_changes(_pushes(spark, d))
    return p.select("event_id", "project", "branch", F.array_join(F.array_sort("changed"), ",").alias("changed"), F.array_join(F.array_sort("removed"), ",").alias("removed"))


@query(f"""WITH e AS (SELECT project_id, authored_date AS t, unnest(list_concat(added, modified)) AS file_path, 'changed' AS change FROM commits UNION ALL SELECT project_id, authored_date, unnest(removed), 'removed' FROM commits)
    SELECT DISTINCT project_id, file_path, change, epoch_us(t) AS "at" FROM e WHERE {LANG} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, file_path ORDER BY t DESC, change) = 1""")
def r2_batch_plan(spark: SparkSession, d: str) -> DataFrame:
    return R.plan_batch(R.push_changes(_pushes(spark, d))).select("project_id", "file_path", "change", F.unix_micros("at").alias("at"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def r10_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.tumbling(e).withColumn("window_start", F.unix_micros("window_start"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def r11_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.sessions(e).withColumn("session_start", F.unix_micros("session_start"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, w, greatest(ceil(len(w) / 5.0)::BIGINT, 1) AS c FROM w)
    SELECT doc_id AS thread_id, i AS seq, CASE WHEN i = 0 THEN 'thinking' WHEN i = c + 1 THEN 'done' ELSE 'chunk' END AS kind, md5(CASE WHEN i = 0 OR i = c + 1 THEN '' ELSE array_to_string(w[(i - 1) * 5 + 1 : i * 5], ' ') END) AS text_md5
    FROM n, LATERAL (SELECT unnest(range(0, c + 2)) AS i)""")
def r9_answer_stream(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("thread_id"), F.col("text").alias("answer"))
    return R.answer_events(a).select("thread_id", F.col("seq").cast("bigint"), "kind", F.md5("text").alias("text_md5"))


# --- further operators ----------------------------------------------------------------------------------------------
@query("SELECT DISTINCT chunk_id, contains(replace(file_path, '\\\\', '/'), 'core/') OR symbol_name = 'main' AS rel FROM code_repo")
def f9_relevance(spark: SparkSession, d: str) -> DataFrame:
    rel = A.relevant(F.col("file_path"), F.col("symbol_name"), F.array(F.lit("core/"), F.lit("")), F.array(F.lit("main")))
    return table(spark, d, "code_repo").select("chunk_id", rel.alias("rel")).distinct()


@query(f"SELECT count(*) FILTER (length({strip_sql('docstring')}) >= 10) AS symbol_docs, count(*) FILTER (length({strip_sql('docstring')}) >= 20) AS module_docs, count(*) FILTER (length({strip_sql('docstring')}) > 20) AS overviews FROM symbols")
def f10_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(X.strip("docstring"))
    return table(spark, d, "symbols").agg(F.count_if(n >= 10).alias("symbol_docs"), F.count_if(n >= 20).alias("module_docs"), F.count_if(n > 20).alias("overviews"))


@query("SELECT DISTINCT symbol_id, CASE WHEN length(body) > 400 THEN substr(body, 1, 400) || '[cut]' ELSE body END AS body, floor(length(body) / 4)::BIGINT AS tokens FROM symbols")
def f14_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").select("symbol_id", X.cut("body", 400, "[cut]").alias("body"), F.floor(F.length("body") / 4).alias("tokens")).distinct()


@query(COMPS + ", m AS (SELECT DISTINCT project_id, split_part(qualified_name, '.', 1) AS module, qualified_name AS component_id FROM imports WHERE qualified_name IS NOT NULL) SELECT DISTINCT m.project_id, m.module, m.component_id FROM m JOIN c USING (project_id, component_id)")
def j9_valid_members(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "imports").filter("qualified_name IS NOT NULL").select("project_id", F.substring_index("qualified_name", ".", 1).alias("module"), F.col("qualified_name").alias("component_id")).distinct()
    return M.valid_members(m, J.components(table(spark, d, "symbols")))


@query(AFFECTED + " SELECT project_id, module FROM direct")
def j7_changed_modules(spark: SparkSession, d: str) -> DataFrame:
    _, members, comps = _tree(spark, d)
    changed = R.changed_files(table(spark, d, "commits"), ["project_id"]).filter("change = 'changed'")
    hit = comps.join(changed, ["project_id", "file_path"], "left_semi").select("project_id", "component_id").distinct()
    return members.join(hit, ["project_id", "component_id"], "left_semi").filter("module <> ''").select("project_id", "module").distinct()


@query("""WITH q AS (SELECT item_id, tags, query FROM eval_items), a AS (SELECT item_id, contains(lower(query), 'explain') AND NOT contains(lower(query), 'suppose') AS passed FROM q) SELECT item_id AS query_id, passed FROM a""")
def j13_assertions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("query").alias("answer"), F.array(F.lit("Explain")).alias("must_contain"), F.array(F.lit("suppose")).alias("must_not_contain"),
                                             F.lit(1.0).alias("confidence"), F.lit(0.5).alias("min_confidence"))
    return A.assertions(q)


@query("SELECT project_id, file_path, count(DISTINCT symbol_id) AS members, md5(string_agg(name, ',' ORDER BY start_line, name)) AS names_md5 FROM (SELECT DISTINCT project_id, file_path, symbol_id, start_line, name FROM symbols) GROUP BY 1, 2")
def a15_code_by_file(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select("project_id", "file_path", "symbol_id", "start_line", "name").distinct()
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]), ",")
    return s.groupBy("project_id", "file_path").agg(F.count("*").alias("members"), F.md5(names).alias("names_md5"))


FENCED = "regexp_extract_all(text, '(?s)```(\\w+)\\s*\\n(.*?)```', 1)"


@query(f"SELECT doc_id, len({FENCED}) AS blocks, array_to_string(list_sort(list_distinct({FENCED})), ',') AS kinds FROM documents WHERE text IS NOT NULL")
def a17_fenced_blocks(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.regexp_extract_all("text", F.lit(r"(?s)```(\w+)\s*\n(.*?)```"), F.lit(1))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(kinds).alias("blocks"), F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds"))


@query("SELECT DISTINCT event_type FROM events ORDER BY 1")
def a18_unique_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type").distinct().orderBy("event_type")


@query("SELECT DISTINCT symbol_id, array_to_string(list_filter(params, lambda p: p NOT IN ('self', 'cls', 'def', 'class', 'int', 'str', 'float', 'bool', 'None')), ',') AS params FROM symbols WHERE params IS NOT NULL")
def u7_parameters(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter("params", lambda p: ~p.isin(sorted(S.NOT_PARAMS)))
    return table(spark, d, "symbols").filter("params IS NOT NULL").select("symbol_id", F.array_join(kept, ",").alias("params")).distinct()


@query("SELECT DISTINCT chunk_id, concat_ws(',', CASE WHEN repo_url IS NULL THEN 'repo_url' END, CASE WHEN branch IS NULL THEN 'branch' END, CASE WHEN commit_sha IS NULL THEN 'commit_sha' END, CASE WHEN content_hash IS NULL THEN 'content_hash' END) AS missing FROM code_repo")
def u4_missing_metadata(spark: SparkSession, d: str) -> DataFrame:
    wanted = ["repo_url", "branch", "commit_sha", "content_hash"]
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), c) for c in wanted]))
    return table(spark, d, "code_repo").select("chunk_id", F.array_join(F.array_except(F.array(*[F.lit(c) for c in wanted]), present), ",").alias("missing")).distinct()


@query("SELECT project_id, unnest(list_concat(coalesce(added, []), coalesce(modified, []))) AS file_path FROM commits UNION SELECT project_id, unnest(removed) FROM commits")
def u2_touched_files(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits")
    changed = c.select("project_id", F.explode(F.concat("added", "modified")).alias("file_path"))
    return changed.union(c.select("project_id", F.explode("removed"))).distinct()


@query(f"""WITH t AS (SELECT DISTINCT project_id, string_split({DIR.format(c='file_path')}, '/') AS p FROM symbols WHERE {DIR.format(c='file_path')} <> ''), k AS (SELECT project_id, p[1] AS parent, list_sort(list(DISTINCT p[2])) AS kids FROM t WHERE len(p) > 1 GROUP BY 1, 2)
    SELECT project_id, parent, 'graph TD' || chr(10) || '    ' || regexp_replace(parent, '[^A-Za-z0-9_]', '_', 'g') || '["' || parent || '"]' || chr(10)
    || array_to_string(list_transform(kids, lambda c: '    ' || regexp_replace(parent, '[^A-Za-z0-9_]', '_', 'g') || ' --> ' || regexp_replace(c, '[^A-Za-z0-9_]', '_', 'g') || '["' || c || '"]'), chr(10)) AS chart FROM k""")
def g12_flowcharts(spark: SparkSession, d: str) -> DataFrame:
    p = _tree(spark, d)[0].select("project_id", F.split("module", "/").alias("p")).filter(F.size("p") > 1)
    kids = p.groupBy("project_id", F.col("p")[0].alias("parent")).agg(F.array_sort(F.collect_set(F.col("p")[1])).alias("kids"))
    return kids.select("project_id", "parent", M.flowchart(F.col("parent"), F.col("kids")).alias("chart"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Part of a line -> part of the order's next line."""
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return line.filter("dst IS NOT NULL AND src <> dst").distinct()


PARTS = "WITH e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"


@query(PARTS + " SELECT src AS node, count(*) AS out_degree FROM e GROUP BY 1")
def g1_part_edges(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))


@query(RECURSIVE(PARTS) + ", g AS (SELECT * FROM e)" + REACH + " SELECT node, seen AS component FROM cc")
def g1_part_components(spark: SparkSession, d: str) -> DataFrame:
    return G.connected_components(_parts(spark, d))


@query(PARTS + """, s AS (SELECT DISTINCT src AS start FROM e WHERE src % 50 = 0), h1 AS (SELECT start, dst AS node FROM s JOIN e ON src = start), h2 AS (SELECT DISTINCT h.start, e.dst AS node FROM h1 h JOIN e ON e.src = h.node WHERE e.dst <> h.start AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.start = h.start AND x.node = e.dst))
    SELECT start, node, 1 AS distance FROM h1 UNION ALL SELECT start, node, 2 FROM h2""")
def g6_part_hops(spark: SparkSession, d: str) -> DataFrame:
    e = _parts(spark, d)
    return G.neighbours(e, e.filter("src % 50 = 0").select(F.col("src").alias("node")).distinct(), 2)
