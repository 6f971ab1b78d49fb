"""More queries over whole tables, for operators the first module doesn't reach, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scorers as SC
from ..functions import text as X
from ..operators import calls as J
from ..operators import chunking as T
from ..operators import collections as K
from ..operators import metrics as A
from ..operators import modules as M
from ..operators import search as V
from ..operators import symbols as S
from ..session import table
from ..sources import files as FS
from ..streaming import events as R
from . import graph as G
from . import wiki as WK
from .queries import BM25, DENSE, DIR, HMAC, LANG, RECURSIVE, SQL, STRONG, TOKENS, _dense, comps_sql, query, strip_sql

WALKED = f"""{LANG} IS NOT NULL AND size <= 1048576 AND NOT regexp_matches('/' || file_path, '/(?:node_modules|vendor|__pycache__|venv|env|dist|build|target|\\.[^/]*)/')"""


# --- sources --------------------------------------------------------------------------------------------------------
@query(f"SELECT project_id, file_path, row_number() OVER (PARTITION BY project_id ORDER BY file_path) AS place FROM (SELECT DISTINCT project_id, file_path FROM files WHERE {WALKED})")
def s1_sorted_walk(spark: SparkSession, d: str) -> DataFrame:
    return FS.sorted_walk(table(spark, d, "files")).withColumn("place", F.col("place").cast("bigint"))


@query("""SELECT file_path, CASE WHEN file_id % 3 = 0 THEN md5(chr(65533) || content) WHEN file_id % 3 = 1 THEN md5(content) END AS content_md5, CASE WHEN file_id % 3 = 2 THEN 'unreadable' WHEN file_id % 3 = 0 THEN 'repaired' ELSE 'whole' END AS state
    FROM (SELECT DISTINCT file_id, file_path, content FROM files)""")
def s4_readable(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("file_id", "file_path", "content").distinct()
    raw = f.select("file_path", F.when(F.col("file_id") % 3 == 0, F.concat(F.unhex(F.lit("FF")), F.encode("content", "UTF-8"))).when(F.col("file_id") % 3 == 1, F.encode("content", "UTF-8")).alias("content"))
    ok, rejects = FS.readable(raw)
    whole = ok.select("file_path", F.md5("content").alias("content_md5"), F.when(F.col("repaired"), "repaired").otherwise("whole").alias("state"))
    return whole.unionByName(rejects.select("file_path", F.lit(None).cast("string").alias("content_md5"), F.col("reason").alias("state")))


@query("SELECT project_id, sha, authored_date_us, review, row_number() OVER (PARTITION BY project_id ORDER BY authored_date_us, review, sha) AS place FROM (SELECT DISTINCT project_id, sha, epoch_us(authored_date) // 86400000000 AS authored_date_us, len(added) > 0 AS review FROM commits)")
def o3_ordered_comments(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits").select("project_id", "sha", F.floor(F.unix_micros("authored_date") / 86400000000).alias("authored_date_us"), (F.size("added") > 0).alias("review")).distinct()
    return c.withColumn("place", F.row_number().over(W.partitionBy("project_id").orderBy("authored_date_us", "review", "sha")).cast("bigint"))


@query(f"SELECT token, doc_id, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, unnest(t) AS token, len(t) AS n FROM (SELECT doc_id, {TOKENS.format(c=chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS t FROM documents)) GROUP BY 1, 2")
def k1_postings(spark: SparkSession, d: str) -> DataFrame:
    return V.postings(table(spark, d, "documents"), "doc_id", "text").select("token", "doc_id", "tf", F.col("n").cast("bigint"))


@query(BM25 + " SELECT doc_id, round(score, 6) AS score FROM bm")
def v5_bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n, mean = docs.select(F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(V._TOKEN % "[a-z0-9_]{2,40}")).alias("n")).agg(F.count("*"), F.avg("n")).first()
    return V.bm25_postings(V.postings(docs, "doc_id", "text"), n, mean, ["retry", "budget", "nightly"], "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT a.vec_id, b.label FROM embeddings a JOIN embeddings b USING (vec_id)")
def j1_points_and_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return K.check_vectors(e.select("vec_id", "label"), e.select("vec_id", "embedding"), "vec_id").select("vec_id", "label")


@query("SELECT DISTINCT sha256(content) AS content_hash, CASE WHEN regexp_matches(lower(content), '[a-z0-9_]') THEN 1.0::DOUBLE ELSE 0 END AS norm FROM code_repo")
def v2_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """A third of the texts is in the cache already; every distinct text comes out once, with a vector of unit length."""
    texts = table(spark, d, "code_repo").select(X.content_hash(F.col("content")).alias("content_hash"), "content")
    cache = SC.embed(texts.filter(F.substring("content_hash", 1, 1).isin("0", "1", "2", "3", "4")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return SC.embed(texts, cache).select("content_hash", F.round(norm, 4).alias("norm"))


@query("""WITH p AS (SELECT vec_id, list_transform(list_zip(embedding, list_reverse(embedding)), lambda x: (x[1]::DOUBLE + CASE WHEN vec_id % 2 = 0 THEN x[2]::DOUBLE ELSE 0 END) / CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END) AS v FROM embeddings)
    SELECT vec_id, round(v[1] / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 5) AS first, round(list_sum(v) / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12), 5) AS total FROM p""")
def v3_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    wide = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, d, "embeddings").select("vec_id", F.array(wide, F.reverse(wide)).alias("v"), F.array(F.lit(1.0), F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(0.0)).alias("m"))
    p = e.select("vec_id", SC.mean_pool(F.col("v"), F.col("m")).alias("p"))
    return p.select("vec_id", F.round(F.col("p")[0], 5).alias("first"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


# --- parsing --------------------------------------------------------------------------------------------------------
EXACT = "regexp_matches(lower(file_path), '\\.(?:py|cs|kt|kts)$')"


@query(f"SELECT DISTINCT project_id, file_path, name, symbol_type, start_line, end_line FROM symbols WHERE {EXACT} AND NOT regexp_matches(name, '^chunk_\\d+$')")
def t1_symbols_exact(spark: SparkSession, d: str) -> DataFrame:
    """Python, C# and Kotlin, whose symbols the table has one for one; files of which it has none (their extraction failed there) are left out."""
    known = table(spark, d, "symbols").filter(~F.col("name").rlike(r"^chunk_\d+$")).select("project_id", "file_path").distinct()
    files = table(spark, d, "files").filter(F.lower("file_path").rlike(r"\.(?:py|cs|kt|kts)$")).join(known, ["project_id", "file_path"], "left_semi")
    return S.extract(files).select("project_id", "file_path", "name", "symbol_type", "start_line", "end_line").distinct()


QUOTES = ['"""', "'''", '"', "'"]


def _module_doc_sql(c: str) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    whens = " ".join(f"WHEN starts_with({c}, {q(x)}) AND instr(substr({c}, {len(x) + 1}), {q(x)}) > 0 THEN {strip_sql(f'substr({c}, {len(x) + 1}, instr(substr({c}, {len(x) + 1}), {q(x)}) - 1)')}" for x in QUOTES)
    return f"CASE {whens} ELSE '' END"


@query(f"WITH f AS (SELECT DISTINCT file_id, {strip_sql('content')} AS t FROM files WHERE ends_with(file_path, '.py')) SELECT file_id, {_module_doc_sql('t')} AS doc FROM f")
def t1d_module_docstrings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").filter(F.endswith("file_path", F.lit(".py"))).select("file_id", T.module_docstring(F.col("content")).alias("doc")).distinct()


@query("SELECT DISTINCT doc_id, CASE WHEN doc_kind = 'incident_reports' OR doc_kind = 'incidents' THEN 'incident_reports' ELSE 'app_docs' END AS collection FROM documents")
def t12_collections(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("doc_kind") == "incidents", "incident_reports").otherwise(F.coalesce("doc_kind", F.lit("none")))
    return table(spark, d, "documents").select("doc_id", X.collection_for(label).alias("collection")).distinct()


@query(f"""WITH f AS (SELECT DISTINCT project_id, file_path, coalesce(language, {LANG}) AS lang, content FROM files),
    ms AS (SELECT project_id, file_path, unnest(regexp_extract_all(content, '(?m)^[ \\t]*from[ \\t]+[\\w.]+[ \\t]+import[ \\t]+(?:\\([^)]*\\)|[^\\r\\n]+)')) AS s FROM f WHERE lang = 'python'),
    mp AS (SELECT project_id, file_path, regexp_extract(s, 'from\\s+([\\w.]+)', 1) AS m, {strip_sql('p')} AS p FROM (SELECT *, unnest(string_split(regexp_replace(regexp_extract(s, '(?s)import[ \\t]+(.+)$', 1), '#[^\\r\\n]*|[()]', '', 'g'), ',')) AS p FROM ms)),
    js AS (SELECT project_id, file_path, unnest(regexp_extract_all(content, '(?m)^[ \\t]*import\\s*\\{{[^}}]*\\}}\\s*from\\s*[''"][^''"\\r\\n]+[''"]')) AS s FROM f WHERE lang IN ('javascript', 'typescript')),
    jp AS (SELECT project_id, file_path, regexp_extract(s, 'from\\s*[''"]([^''"]+)', 1) AS m, {strip_sql('p')} AS p FROM (SELECT *, unnest(string_split(regexp_extract(s, '\\{{([^}}]*)\\}}', 1), ',')) AS p FROM js)),
    jd AS (SELECT project_id, file_path, unnest(regexp_extract_all(content, '(?m)^[ \\t]*import\\s+\\w+\\s+from\\s*[''"][^''"\\r\\n]+[''"]')) AS s FROM f WHERE lang IN ('javascript', 'typescript')),
    pi AS (SELECT project_id, file_path, {strip_sql('p')} AS p FROM (SELECT *, unnest(string_split(regexp_extract(s, 'import[ \\t]+([^#\\r\\n]+)', 1), ',')) AS p FROM (SELECT project_id, file_path, unnest(regexp_extract_all(content, '(?m)^[ \\t]*import[ \\t]+[^\\r\\n]+')) AS s FROM f WHERE lang = 'python'))),
    ja AS (SELECT project_id, file_path, regexp_extract(s, 'import\\s+(?:static\\s+)?([\\w.]*\\w(?:\\.\\*)?)$', 1) AS q FROM (SELECT project_id, file_path, unnest(regexp_extract_all(content, '(?m)^[ \\t]*import\\s+(?:static\\s+)?[\\w.]*\\w(?:\\.\\*)?')) AS s FROM f WHERE lang IN ('java', 'kotlin'))),
    cs AS (SELECT project_id, file_path, regexp_extract(s, 'using\\s+(?:static\\s+)?([\\w.]+)', 1) AS q FROM (SELECT project_id, file_path, unnest(regexp_extract_all(content, '(?m)^[ \\t]*using\\s+(?:static\\s+)?[\\w.]+\\s*;')) AS s FROM f WHERE lang = 'c_sharp')),
    go AS (SELECT project_id, file_path, unnest(regexp_extract_all(s, '"([^"]+)"', 1)) AS q FROM (SELECT project_id, file_path, unnest(regexp_extract_all(content, '(?m)^import[ \\t]+(?:\\([^)]*\\)|[^\\r\\n]*"[^"\\r\\n]+")')) AS s FROM f WHERE lang = 'go')),
    n AS (SELECT *, regexp_extract(p, '^[\\w.]+\\s+as\\s+(\\w+)', 1) AS a, regexp_extract(p, '^([\\w.*]+)', 1) AS o FROM (SELECT *, 'm' AS k FROM mp UNION ALL SELECT *, 'j' FROM jp UNION ALL SELECT project_id, file_path, '', p, 'i' FROM pi) WHERE p <> '')
    SELECT DISTINCT project_id, file_path AS source_file, CASE WHEN k = 'm' AND p = '*' THEN '*' WHEN a <> '' THEN a WHEN k = 'i' THEN split_part(o, '.', 1) ELSE o END AS imported_name, CASE WHEN k = 'i' THEN o ELSE m END AS module_path,
        CASE WHEN k = 'i' THEN o ELSE m || '.' || o END AS qualified_name, k = 'm' AND p = '*' AS is_wildcard FROM n
    UNION SELECT project_id, file_path, regexp_extract(s, 'import\\s+(\\w+)', 1), regexp_extract(s, 'from\\s*[''"]([^''"]+)', 1), regexp_extract(s, 'from\\s*[''"]([^''"]+)', 1) || '.default', false FROM jd
    UNION SELECT project_id, file_path, string_split(q, '.')[-1], regexp_replace(q, '\\.?[^.]*$', ''), q, ends_with(q, '*') FROM ja WHERE q <> ''
    UNION SELECT project_id, file_path, string_split(q, '.')[-1], q, q, false FROM cs UNION SELECT project_id, file_path, string_split(q, '/')[-1], q, q, false FROM go""")
def t14_import_entries(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("project_id", "file_path", F.coalesce("language", X.language("file_path")).alias("language"), "content").distinct()
    return T.import_entries(f).distinct()


SQL["t14_imports"] = SQL["t14_import_entries"]

MERMAID = "replace(replace(replace(text, '```java' || chr(10), '```mermaid' || chr(10) || 'graph TD' || chr(10)), '```python' || chr(10), '```mermaid' || chr(10)), '```go' || chr(10), '```mermaid' || chr(10) || '%% none' || chr(10) || 'Sequence-Diagram x' || chr(10))"


def _mermaid(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose code blocks are made diagrams of several kinds."""
    t = F.col("text")
    for a, b in (("```java\n", "```mermaid\ngraph TD\n"), ("```python\n", "```mermaid\n"), ("```go\n", "```mermaid\n%% none\nSequence-Diagram x\n")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, d, "documents").select("doc_id", t.alias("text"))


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, {MERMAID} AS x FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, x, 0 AS base, -1 AS n, '' AS w, 0 AS "at" FROM t UNION ALL SELECT doc_id, substr(rest, 1), base + pos - 1 + length(w2), n + 1, w2, base + pos - 1 FROM
        (SELECT doc_id, n, base, w2, instr(x, w2) AS pos, substr(x, instr(x, w2) + length(w2)) AS rest FROM (SELECT *, regexp_extract(x, '(?s)```mermaid\\s*\\n(.*?)```', 0) AS w2 FROM r) WHERE w2 <> '')),
    b AS (SELECT doc_id, n AS block_no, "at" AS start, {strip_sql("regexp_extract(w, '(?s)```mermaid' || '\\s*\\n(.*?)```', 1)")} AS source FROM r WHERE n >= 0),
    f AS (SELECT *, list_filter(string_split(source, chr(10)), lambda l: {strip_sql('l')} <> '' AND NOT starts_with({strip_sql('l')}, '%%'))[1] AS line FROM b)
    SELECT doc_id, block_no, start, coalesce(replace(lower(regexp_extract({strip_sql('line')}, '^(\\S+)', 1)), '-', ''), '') AS kind, md5(source) AS source_md5 FROM f""")
def t15_diagram_blocks(spark: SparkSession, d: str) -> DataFrame:
    return T.diagram_blocks(_mermaid(spark, d), "doc_id", "text").select("doc_id", "block_no", "start", "kind", F.md5("source").alias("source_md5"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN '{}' ELSE props END AS found FROM events""")
def t17_tagged_json(spark: SparkSession, d: str) -> DataFrame:
    """Answers with JSON inside the first tag, the second, nothing that can be read, and bare braces."""
    k, p = F.col("event_id") % 4, F.col("props")
    answer = (
        F.when(k == 0, F.concat(F.lit("so <tree> "), p, F.lit(" </tree> or {x}"))).when(k == 1, F.concat(F.lit("<tree>{bad</tree><json>"), p, F.lit("</json>")))
        .when(k == 2, F.concat(F.lit("no { brace "), p)).otherwise(F.concat(F.lit("it is "), p, F.lit(" indeed")))
    )
    return table(spark, d, "events").select("event_id", T.tagged_json(answer, "tree", "json").alias("found"))


REVIEW = "SELECT l_orderkey * 10 + l_linenumber AS doc, (l_quantity % 5) + 1 AS a, (l_linenumber % 5) + 1 AS b, l_suppkey % 7 AS c FROM lineitem"


@query(f"""SELECT doc, CASE WHEN c = 6 THEN 0 ELSE (a + b) / 2 END AS overall, c < 6 AND CASE WHEN c = 0 THEN true WHEN c = 1 THEN false ELSE least(a, b) >= 3 AND (a + b) / 2 >= 4 END AS passed, CASE WHEN c = 6 THEN 1 WHEN c = 5 THEN 2 ELSE 0 END AS issues FROM ({REVIEW})""")
def t18_reviews(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS doc", "(l_quantity % 5) + 1 AS a", "(l_linenumber % 5) + 1 AS b", "l_suppkey % 7 AS c")
    flag = F.when(F.col("c") == 0, F.lit(True)).when(F.col("c") == 1, F.lit(False))
    issues = F.when(F.col("c") == 5, F.array(F.lit("x"), F.lit("y")))
    body = F.to_json(F.struct(((F.col("a") + F.col("b")) / 2).alias("overall"), flag.alias("passed"), F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b")).alias("scores"), issues.alias("issues")))
    answer = F.when(F.col("c") == 6, "I can't say").otherwise(F.concat(F.lit("<review>"), body, F.lit("</review>")))
    return WK.reviews(q.select("doc", answer.alias("answer")))


@query(f"SELECT doc, CASE WHEN c = 0 THEN true WHEN c = 1 THEN false ELSE least(a, b) >= 3 AND (a + b) / 2 >= 4 END AS passed FROM ({REVIEW})")
def a19_review_passed(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS doc", "(l_quantity % 5) + 1 AS a", "(l_linenumber % 5) + 1 AS b", "l_suppkey % 7 AS c")
    flag = F.when(F.col("c") == 0, F.lit(True)).when(F.col("c") == 1, F.lit(False))
    return q.select("doc", A.review_passed(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b")), (F.col("a") + F.col("b")) / 2, flag).alias("passed"))


# --- filters and views ------------------------------------------------------------------------------------------------
@query("SELECT project_id, count(*) AS n FROM code_repo WHERE contains(file_path, 'core/') AND language = 'python' GROUP BY 1")
def f3_partial_path(spark: SparkSession, d: str) -> DataFrame:
    return V.matches(table(spark, d, "code_repo"), {"file_path__contains": "core/", "language": "python"}).groupBy("project_id").agg(F.count("*").alias("n"))


@query("SELECT upper(severity) AS severity, count(*) AS n FROM (SELECT 'p' || (p_size % 4 + 1) AS severity FROM part) WHERE upper(severity) = 'P1' GROUP BY 1")
def f2_tool_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.concat(F.lit("P"), (F.col("p_size") % 4 + 1).cast("string")).alias("severity"))
    return V.matches(rows, V.tool_filters(severity="p1", language=None, file_path="")).groupBy("severity").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, least(p_size * 3, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 50 ELSE 30 END) AS k FROM part")
def f5_clamped(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_brand") == "Brand#1", "code").when(F.col("p_brand") == "Brand#2", "keyword").otherwise("docs")
    return table(spark, d, "part").select("p_partkey", X.clamped(F.col("p_size") * 3, kind).alias("k"))


@query("SELECT DISTINCT symbol_id, CASE WHEN length(body) > 2000 THEN substr(body, 1, 2000) || '…' ELSE body END AS content FROM symbols")
def f7_entity_view(spark: SparkSession, d: str) -> DataFrame:
    return V.entity_view(table(spark, d, "symbols").select("symbol_id", F.col("body").alias("content"))).distinct()


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'push' WHEN 'view' THEN 'merge_request' WHEN 'signup' THEN 'issue' WHEN 'error' THEN 'ping' ELSE 'ignored' END AS route FROM events")
def f11_routes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "Push Hook").when(F.col("event_type") == "view", "pull_request").when(F.col("event_type") == "signup", "Issue Hook").when(F.col("event_type") == "error", "PING")
    return table(spark, d, "events").select("event_id", R.route(kind).alias("route"))


SENT = "CASE ascii(sha) % 6 WHEN 0 THEN 'hook-signing' WHEN 1 THEN h WHEN 2 THEN 'sha256=' || h WHEN 3 THEN 'sha256=' || sha WHEN 4 THEN '' ELSE NULL END"


@query(f"""WITH s AS (SELECT DISTINCT sha, len(added) > 0 AS lab, {HMAC} AS h FROM commits), t AS (SELECT *, {SENT} AS sent FROM s)
    SELECT sha, bool_or(CASE WHEN lab THEN coalesce(sent = 'hook-signing' OR replace(sent, 'sha256=', '') = h, false) ELSE coalesce(sent = 'sha256=' || h, false) END) AS genuine FROM t GROUP BY 1""")
def f12_genuine(spark: SparkSession, d: str) -> DataFrame:
    h = X.hmac_sha256("hook-signing", F.col("message"))
    k = F.ascii("sha") % 6
    sent = F.when(k == 0, F.lit("hook-signing")).when(k == 1, h).when(k == 2, F.concat(F.lit("sha256="), h)).when(k == 3, F.concat(F.lit("sha256="), F.col("sha"))).when(k == 4, F.lit(""))
    host = F.when(F.size("added") > 0, "gitlab").otherwise("github")
    return table(spark, d, "commits").groupBy("sha").agg(F.bool_or(X.signature_ok(host, sent, "hook-signing", F.col("message"))).alias("genuine"))


@query("SELECT DISTINCT file_path, starts_with(file_path, 'src/') AND file_id % 2 = 1 AS inside FROM files")
def f13_path_guard(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("file_id") % 2 == 1, F.col("file_path")).otherwise(F.concat(F.lit("src/../"), "file_path"))
    return table(spark, d, "files").select("file_path", X.inside(path, "src/").alias("inside")).distinct()


# --- search ---------------------------------------------------------------------------------------------------------
@query(f"""WITH q AS (SELECT ['retry', 'budget', 'nightly', 'index'] AS q), s AS (SELECT doc_id, len(list_intersect(q, {TOKENS.format(c="substr(coalesce(text, ''), 1, 2048)")})) / 4.0::DOUBLE * 20 - 10 AS score FROM documents, q)
    SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 50""")
def x2_model_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Reranking by a Python model in Arrow batches, with the scores of the built-in overlap."""
    import re

    def model(q: str, c: str) -> float:
        words = set(re.findall("[a-z0-9_]{2,}", q.lower()))
        return len(words & {w for w in re.findall("[a-z0-9_]+", c.lower()) if len(w) <= 40}) / len(words) * 20 - 10

    hits = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.col("doc_id").alias("rank"), F.lit(0.0).alias("score"))
    return V.rerank(hits, "retry budget nightly index", 50, SC.pair_scorer(model)).select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@query("SELECT doc_id, doc_id / 1000.0::DOUBLE AS score, row_number() OVER (ORDER BY doc_id) AS rank FROM documents ORDER BY doc_id LIMIT 50")
def v16_failed_rerank(spark: SparkSession, d: str) -> DataFrame:
    """A model that raises on an executor leaves order and scores as they were."""
    def model(q: str, c: str) -> float:
        raise RuntimeError("no model")

    hits = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.col("doc_id").alias("rank"), (F.col("doc_id") / 1000.0).alias("score"))
    return V.rerank(hits, "retry budget", 50, SC.pair_scorer(model)).select("doc_id", "score", F.col("rank").cast("bigint"))


ARMS = [("code_repo", "wiki", ["retry", "budget"]), ("app_docs", "readme", ["nightly", "index"]), ("incident_reports", "incidents", ["retry", "nightly"])]


def _arm_sql(k: int, kind: str, words: list[str]) -> str:
    return f"""d{k} AS (SELECT doc_id, {TOKENS.format(c="coalesce(text, '')")} AS t FROM documents WHERE doc_kind = '{kind}'), s{k} AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d{k}),
    tf{k} AS (SELECT doc_id, w, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, unnest(t) AS w, len(t) AS n FROM d{k}) WHERE w IN ({', '.join(f"'{w}'" for w in words)}) GROUP BY 1, 2), df{k} AS (SELECT w, count(*) AS df FROM tf{k} GROUP BY 1),
    bm{k} AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM tf{k} JOIN df{k} USING (w), s{k} GROUP BY 1),
    a{k} AS (SELECT doc_id, score, '{ARMS[k][0]}' AS collection FROM bm{k} ORDER BY score DESC, doc_id LIMIT {20 if k == 0 else 10})"""


@query("WITH " + ", ".join(_arm_sql(k, kind, words) for k, (_, kind, words) in enumerate(ARMS)) + " SELECT doc_id, round(score, 6) AS score, collection FROM (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2)")
def v9_three_arms(spark: SparkSession, d: str) -> DataFrame:
    """Three collections, each with its own texts, statistics and query; the first gives twice as many hits."""
    docs = table(spark, d, "documents")
    arms = {name: V.bm25(docs.filter(F.col("doc_kind") == kind), words, "doc_id", "text") for name, kind, words in ARMS}
    return V.fan_out(arms, 10, "doc_id").select("doc_id", F.round("score", 6).alias("score"), "collection")


@query("""WITH h AS (SELECT chunk_id, symbol_name, qualified_name, file_path, row_number() OVER (ORDER BY chunk_id) AS rank FROM (SELECT DISTINCT chunk_id, symbol_name, qualified_name, file_path FROM code_repo WHERE contains(lower(content), 'token budget')) QUALIFY rank <= 10),
    w AS (SELECT max(symbol_name) AS s, max(file_path) AS f FROM h), m AS (SELECT h.*, CASE WHEN symbol_name = s OR qualified_name = s THEN 0 WHEN contains(lower(symbol_name), lower(s)) THEN 1 END AS match, contains(file_path, f) AS near FROM h, w)
    SELECT chunk_id, match FROM m WHERE match IS NOT NULL ORDER BY match, NOT near, rank LIMIT 1""")
def v13_entity_of_search(spark: SparkSession, d: str) -> DataFrame:
    """The entity a node name with a file hint means, among the ranked hits of a keyword search over the whole collection."""
    c = table(spark, d, "code_repo").filter(F.contains(F.lower("content"), F.lit("token budget"))).select("chunk_id", "symbol_name", "qualified_name", "file_path").distinct()
    hits = c.orderBy("chunk_id").limit(10).withColumn("rank", F.row_number().over(W.orderBy("chunk_id")))
    r = hits.agg(F.max("symbol_name").alias("s"), F.max("file_path").alias("f")).first()
    return V.find_entity(hits, f"{r.f}:{r.s}").select("chunk_id", "match") if r.s else hits.select("chunk_id", F.lit(0).alias("match")).limit(0)


@query("""WITH h AS (SELECT chunk_id, file_path, symbol_name, start_line, end_line, content, row_number() OVER (ORDER BY length(content) - length(replace(content, 'budget', '')) DESC, chunk_id) AS rank FROM (SELECT DISTINCT chunk_id, file_path, symbol_name, start_line, end_line, content FROM code_repo WHERE contains(content, 'budget')) QUALIFY rank <= 5)
    SELECT string_agg('[' || rank || '] ' || file_path || ' | ' || symbol_name || ' | ' || start_line || '-' || end_line || chr(10) || content, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM h""")
def v21_context_of_search(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_repo").filter(F.contains("content", F.lit("budget"))).select("chunk_id", "file_path", "symbol_name", "start_line", "end_line", "content").distinct()
    order = [F.desc(F.length("content") - F.length(F.replace("content", F.lit("budget"), F.lit("")))), F.asc("chunk_id")]
    return V.context(c.orderBy(*order).limit(5).withColumn("rank", F.row_number().over(W.orderBy(*order))))


@query("""WITH h AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS rank, CASE doc_kind WHEN 'incidents' THEN 'incident_reports' WHEN 'wiki' THEN 'code_repo' ELSE 'app_docs' END AS collection FROM documents)
    SELECT source, arg_min(doc_id, {'a': collection <> 'code_repo', 'b': rank}) AS doc_id FROM h GROUP BY 1""")
def v22_localize(spark: SparkSession, d: str) -> DataFrame:
    """The place an issue is about, for each source: the first hit in code, else the first of all."""
    kind = F.when(F.col("doc_kind") == "incidents", "incident_reports").when(F.col("doc_kind") == "wiki", "code_repo").otherwise("app_docs")
    h = table(spark, d, "documents").select("doc_id", "source", kind.alias("collection"), F.col("doc_id").alias("rank"))
    return V.localize(h, ["source"]).select("source", "doc_id")


@query("""SELECT chunk_id, 0.5::DOUBLE AS score, content FROM (SELECT DISTINCT chunk_id, content FROM code_repo WHERE symbol_type = 'class') UNION ALL
    SELECT 'e' || symbol_id, 1.0, substr(body, 1, 500) FROM (SELECT DISTINCT symbol_id, body FROM symbols WHERE symbol_type = 'method') WHERE symbol_id % 2 = 0 UNION ALL
    SELECT 'graph:' || project_id, 0.8, 'callers: ' || array_to_string(a, ', ') || '; callees: ' || array_to_string(r, ', ') FROM (SELECT project_id, list_sort(list_distinct(flatten(list(added)))) AS a, list_sort(list_distinct(flatten(list(removed)))) AS r FROM commits GROUP BY 1) WHERE len(a) > 0 OR len(r) > 0""")
def v19_evidence(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "code_repo").filter("symbol_type = 'class'").select("chunk_id", F.lit(0.5).alias("score"), "content").distinct()
    lists = lists.unionByName(lists.limit(3).withColumn("chunk_id", F.lit(None).cast("string")))
    found = table(spark, d, "symbols").filter("symbol_type = 'method'").select(F.concat(F.lit("e"), F.col("symbol_id").cast("string")).alias("chunk_id"), (F.col("symbol_id") % 2 == 0).alias("found"), F.col("body").alias("content")).distinct()
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    graph = table(spark, d, "commits").groupBy(F.col("project_id").alias("node")).agg(flat("added").alias("callers"), flat("removed").alias("callees"))
    return V.evidence(lists, found, graph)


@query("SELECT l_orderkey, b.c AS content, b.a::VARCHAR AS provider FROM (SELECT l_orderkey, min({'a': l_linenumber, 'c': l_quantity::BIGINT::VARCHAR}) FILTER (l_suppkey % 3 > 0) AS b FROM lineitem GROUP BY 1)")
def x4_first_success(spark: SparkSession, d: str) -> DataFrame:
    """Lines are attempts at an answer; those of every third supplier fail, by an error text or by none at all."""
    text = F.col("l_quantity").cast("bigint").cast("string")
    failed = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(SC.FAILED), text))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("attempt"), F.col("l_linenumber").cast("string").alias("provider"), F.when(F.col("l_suppkey") % 3 > 0, text).otherwise(failed).alias("content"))
    return SC.first_attempt(rows, "l_orderkey").select("l_orderkey", "content", "provider")


@query(f"SELECT DISTINCT symbol_id, CASE WHEN {strip_sql('body')} = '' THEN '' ELSE {strip_sql('body')} END AS content, 'second' AS provider, (length({strip_sql('body')}) // 4)::INT AS tokens FROM symbols")
def x3_completed(spark: SparkSession, d: str) -> DataFrame:
    """Texts from a chain of providers whose first one fails."""
    def broken(prompt: str) -> str:
        raise RuntimeError("down")

    p = SC.Providers()
    p.register("first", broken)
    p.register("second", lambda t: t.strip(" \t\r\n\f\v"))
    s = table(spark, d, "symbols").select("symbol_id", F.col("body").alias("prompt")).distinct()
    return SC.completed(s, "symbol_id", p.chain("first", "second")).distinct()


# --- evaluation -----------------------------------------------------------------------------------------------------
@query(DENSE + """, r AS (SELECT d.query_id, d.rank, 'l' || b.label AS label, a.label % 3 = b.label % 3 AS rel FROM dense d JOIN embeddings a ON a.vec_id = d.query_id JOIN embeddings b ON b.vec_id = d.vec_id),
    f AS (SELECT query_id, label, min(rank) AS r FROM r WHERE rel GROUP BY 1, 2) SELECT query_id, string_agg(label, ',' ORDER BY r, label) AS matched FROM f GROUP BY 1""")
def a13_matched(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "embeddings").select("vec_id", "label")
    hits = _dense(spark, d).join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    hits = hits.select("query_id", "rank", (F.col("label") % 3 == F.col("own") % 3).alias("rel"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("value"))
    return A.matched(hits, "query_id", "value").select("query_id", F.array_join("matched", ",").alias("matched"))


@query("SELECT event_type, coalesce(avg(value - 10) FILTER (value > 10), 0) AS mean FROM events GROUP BY 1")
def a4_mean_of_positive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(A.mean_positive(F.col("value") - 10).alias("mean"))


@query(DENSE + """, e AS (SELECT vec_id AS query_id, ['f' || (label % 4) || '/', ''] AS fs, ['s' || (vec_id % 7)] AS ss FROM embeddings)
    SELECT query_id, d.vec_id, list_bool_or(list_transform(fs, lambda f: f <> '' AND contains('d/f' || (b.label % 4) || '/x', f))) OR list_contains(ss, 's' || (d.vec_id % 11)) AS rel FROM dense d JOIN e USING (query_id) JOIN embeddings b ON b.vec_id = d.vec_id""")
def j12_case_relevance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    cases = e.select(F.col("vec_id").alias("query_id"), F.array(F.concat(F.lit("f"), (F.col("label") % 4).cast("string"), F.lit("/")), F.lit("")).alias("fs"), F.array(F.concat(F.lit("s"), (F.col("vec_id") % 7).cast("string"))).alias("ss"))
    hits = _dense(spark, d).join(e.select("vec_id", "label"), "vec_id").join(cases, "query_id")
    path = F.concat(F.lit("d\\f"), (F.col("label") % 4).cast("string"), F.lit("\\x"))
    return hits.select("query_id", "vec_id", A.relevant(path, F.concat(F.lit("s"), (F.col("vec_id") % 11).cast("string")), F.col("fs"), F.col("ss")).alias("rel"))


@query(f"""WITH w AS (SELECT doc_id, {TOKENS.format(c="coalesce(text, '')")} AS t FROM documents) SELECT doc_id AS query_id, list_contains(t, 'index') AND NOT list_contains(t, 'retry') AS passed FROM w
    WHERE contains(lower(coalesce((SELECT text FROM documents x WHERE x.doc_id = w.doc_id), '')), 'index') = list_contains(t, 'index') AND contains(lower(coalesce((SELECT text FROM documents x WHERE x.doc_id = w.doc_id), '')), 'retry') = list_contains(t, 'retry')""")
def j13_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that must hold one word and mustn't hold another; those that hold them as parts of longer words are left out on both sides."""
    t = table(spark, d, "documents").withColumn("_t", X.tokens(F.coalesce("text", F.lit(""))))
    low = F.lower(F.coalesce("text", F.lit("")))
    plain = [F.contains(low, F.lit(w)) == F.array_contains("_t", w) for w in ("index", "retry")]
    q = t.filter(plain[0] & plain[1]).select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"), F.array(F.lit("INDEX")).alias("must_contain"), F.array(F.lit("retry")).alias("must_not_contain"), F.lit(0.5).alias("confidence"), F.lit(0.5).alias("min_confidence"))
    return A.assertions(q)


# --- symbols, calls, modules ------------------------------------------------------------------------------------------
@query("SELECT project_id, file_path, symbol_id, row_number() OVER (PARTITION BY project_id, file_path ORDER BY start_line, symbol_type <> 'class', name, end_line, symbol_id) AS place FROM (SELECT DISTINCT project_id, file_path, symbol_id, symbol_type, name, start_line, end_line FROM symbols)")
def o2_symbols_in_order(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select("project_id", "file_path", "symbol_id", "symbol_type", "name", "start_line", "end_line").distinct()
    return S.in_order(s, "symbol_id").select("project_id", "file_path", "symbol_id", F.col("place").cast("bigint"))


@query("WITH n AS (SELECT max(c) AS c FROM (SELECT unnest(calls) AS c FROM symbols)) SELECT DISTINCT project_id, coalesce(qualified_name, name) AS caller_id, file_path FROM symbols, n WHERE list_contains(calls, n.c)")
def g6_callers_of(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols")
    return J.callers_of(s, s.select(F.explode("calls").alias("c")).agg(F.max("c")).first()[0])


@query(f"""WITH s AS (SELECT DISTINCT file_id, symbol_id, name, docstring FROM symbols), docs AS (SELECT DISTINCT file_id, start_line AS place, coalesce(qualified_name, name) AS doc_name, docstring AS doc FROM symbols WHERE docstring <> ''),
    h AS (SELECT symbol_id, arg_min(doc, {{'p': place, 'n': doc_name, 'd': doc}}) AS doc FROM s JOIN docs USING (file_id) WHERE contains(doc_name, name) GROUP BY 1)
    SELECT symbol_id, coalesce(nullif({strip_sql('substr(h.doc, 1, 150)')}, ''), substr(coalesce(nullif(docstring, ''), 'No documentation'), 1, 150)) AS doc FROM s LEFT JOIN h USING (symbol_id)""")
def j11_docs_by_name(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols")
    docs = s.filter("docstring <> ''").select("file_id", F.col("start_line").alias("place"), F.coalesce("qualified_name", "name").alias("doc_name"), F.col("docstring").alias("doc")).distinct()
    return J.fuzzy_docs(s, docs, ["file_id"])


@query(f"""WITH m AS (SELECT DISTINCT project_id, {DIR.format(c='file_path')} AS module FROM files), k AS (SELECT DISTINCT project_id, {DIR.format(c='file_path')} AS module FROM symbols WHERE docstring <> '')
    SELECT project_id, module, k.module IS NOT NULL AS has_doc FROM m LEFT JOIN k USING (project_id, module)""")
def j14_has_doc(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "files").select("project_id", X.directory("file_path").alias("module")).distinct()
    docs = table(spark, d, "symbols").filter("docstring <> ''").select("project_id", X.directory("file_path").alias("module"))
    return M.with_docs(m, docs)


#: Components, calls and imports made of parts so that every tier of call resolution is reached.
MADE = f"""WITH sy AS (SELECT p_brand AS project_id, 'd' || (p_size % 5) || '/f' || (p_size % 9) || '.py' AS file_path, 'n' || (p_partkey % 97) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'n' || (p_partkey % 97) ELSE 'c' || (p_partkey % 7) || '.n' || (p_partkey % 97) END AS qualified_name,
        p_size AS start_line, ['n' || (p_partkey * 7 % 131), 'c' || (p_partkey % 7) || '.n' || (p_partkey * 5 % 97), 'none' || p_size] AS calls FROM part),
    im0 AS (SELECT DISTINCT p_brand AS project_id, 'd' || (p_size % 5) || '/f' || (p_size % 9) || '.py' AS source_file, 'n' || (p_partkey * 7 % 131) AS imported_name, CASE WHEN p_partkey % 2 = 0 THEN 'c' || (p_partkey % 5) || '.n' || (p_partkey * 7 % 131) ELSE 'c' || (p_partkey % 5) END AS qualified_name, p_partkey % 11 = 0 AS is_wildcard FROM part),
    """


@query(comps_sql("sy", "im0", MADE.removeprefix("WITH ")) + " SELECT project_id, caller_id, caller_file, call, tier, callee_id FROM resolved WHERE call IS NOT NULL")
def j3_all_tiers(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    t = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    path = t("d", n % 5, "/f", n % 9, ".py")
    s = table(spark, d, "part").select(
        F.col("p_brand").alias("project_id"), path.alias("file_path"), t("n", k % 97).alias("name"), F.when(k % 3 == 0, t("n", k % 97)).otherwise(t("c", k % 7, ".n", k % 97)).alias("qualified_name"),
        n.alias("start_line"), F.array(t("n", k * 7 % 131), t("c", k % 7, ".n", k * 5 % 97), t("none", n)).alias("calls"),
    )
    imports = table(spark, d, "part").select(
        F.col("p_brand").alias("project_id"), path.alias("source_file"), t("n", k * 7 % 131).alias("imported_name"), F.when(k % 2 == 0, t("c", k % 5, ".n", k * 7 % 131)).otherwise(t("c", k % 5)).alias("qualified_name"), (k % 11 == 0).alias("is_wildcard")
    )
    return J.resolve(J.calls_of(s), J.components(s), imports)


# --- graphs of suppliers that follow each other in an order ---------------------------------------------------------------
SUPPLIERS = """WITH g AS (SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst AND (src * 31 + dst * 17) % 101 < 3)"""


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst"))
    return line.filter("dst IS NOT NULL AND src <> dst AND (src * 31 + dst * 17) % 101 < 3").distinct()


@query(RECURSIVE(SUPPLIERS) + STRONG + " SELECT node, component FROM sc")
def g2_supplier_cycles(spark: SparkSession, d: str) -> DataFrame:
    return G.strong_components(_suppliers(spark, d))


@query(RECURSIVE(SUPPLIERS) + STRONG + " SELECT src, dst FROM gone")
def g3_removed_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.break_cycles(_suppliers(spark, d))[1]


@query(RECURSIVE(SUPPLIERS) + STRONG + " SELECT node, max(d) AS level FROM lv GROUP BY 1")
def g4_supplier_levels(spark: SparkSession, d: str) -> DataFrame:
    e = _suppliers(spark, d)
    return G.topological_levels(e.select(F.col("src").alias("node")), e)


@query(RECURSIVE(SUPPLIERS) + STRONG + """, n AS (SELECT node, max(d) AS level FROM lv GROUP BY 1), k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM kept)
    SELECT node, level, node || ':' || coalesce(string_agg(dst::VARCHAR, ',' ORDER BY r) FILTER (r <= 5), '') AS content FROM n LEFT JOIN k ON k.src = n.node GROUP BY node, level""")
def g7_documents_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Documents of symbols made callees first; each names the callees whose documents it was given."""
    import re

    def text(kind: str, name: str, given: str) -> str:
        return f"{name}:{','.join(re.findall('(?m)^## (.+)$', given))}"

    e = _suppliers(spark, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("source", F.lit(None).cast("string"))
    return WK.symbol_documents(nodes, e, text)


# --- modules with changes: those that aren't touched -----------------------------------------------------------------
@query("""WITH t AS (SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey), ch AS (SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900),
    again AS (SELECT nation AS m FROM t WHERE nation IN (SELECT n_name FROM ch) UNION SELECT region FROM t WHERE nation IN (SELECT n_name FROM ch)) SELECT m AS module FROM (SELECT nation AS m FROM t UNION SELECT region FROM t) WHERE m NOT IN (SELECT m FROM again)""")
def j8_untouched_nations(spark: SparkSession, d: str) -> DataFrame:
    """Regions and nations as a tree of modules, customers as components, rich customers as changed files."""
    t = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tree = t.select(F.lit("p").alias("project_id"), F.col("n_name").alias("module"), F.array("r_name", "n_name").alias("path")).unionByName(t.select(F.lit("p").alias("project_id"), F.col("r_name").alias("module"), F.array("r_name").alias("path"))).distinct()
    c = table(spark, d, "customer").join(t, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("p").alias("project_id"), F.col("n_name").alias("module"), F.col("c_name").alias("component_id"), F.col("c_name").alias("file_path"), "c_acctbal")
    return M.reused(tree, M.affected(tree, c.select("project_id", "module", "component_id"), c.select("project_id", "component_id", "file_path"), c.filter("c_acctbal > 9900").select("project_id", "file_path"))).select("module")


@query("SELECT n_name AS module, c_name AS component_id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def j9_members_that_exist(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    members = c.select(F.lit("p").alias("project_id"), F.col("n_name").alias("module"), F.col("c_name").alias("component_id"))
    return M.valid_members(members, c.filter("c_mktsegment = 'BUILDING'").select(F.lit("p").alias("project_id"), F.col("c_name").alias("component_id"))).select("module", "component_id")


# --- events ---------------------------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT doc_id, doc_kind, project_id, text, row_number() OVER (PARTITION BY project_id, doc_kind, doc_id // 3 ORDER BY doc_id DESC) AS n FROM documents WHERE doc_kind IN ('issues', 'reviews'))
    SELECT project_id, CASE doc_kind WHEN 'issues' THEN 'issue' ELSE 'merge_request' END AS context_type, doc_id // 3 AS context_id, md5('# ' || CASE doc_kind WHEN 'issues' THEN 'Issue' ELSE 'Merge Request' END || ' #' || (doc_id // 3) || ': t' || doc_id || chr(10) || chr(10)
        || '**State:** open' || chr(10) || '**Author:** a' || (doc_id % 5) || chr(10) || chr(10) || CASE WHEN coalesce(text, '') = '' THEN '(no description)' ELSE text END) AS content_md5 FROM e WHERE n = 1""")
def r3_discussions(spark: SparkSession, d: str) -> DataFrame:
    """Issue and merge-request events, three to a thread, the last of which counts; other kinds of events are ignored."""
    k = F.col("doc_kind")
    e = table(spark, d, "documents").select(
        F.when(k == "issues", "Issue Hook").when(k == "reviews", "pull_request").otherwise("ping").alias("kind"), F.col("project_id").alias("project"), F.floor(F.col("doc_id") / 3).alias("number"),
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), "text", F.lit("open").alias("state"), F.concat(F.lit("a"), (F.col("doc_id") % 5).cast("string")).alias("author"), F.col("doc_id").alias("at"),
    )
    return T.discussion_chunks(R.threads(e)).select("project_id", "context_type", "context_id", F.md5("content").alias("content_md5"))


@query("""WITH ch AS (SELECT project_id, unnest(list_concat(added, modified)) AS file_path, authored_date AS "at" FROM commits), due AS (SELECT project_id, epoch_us(max("at")) + 60000000 AS due FROM ch GROUP BY 1),
    h AS (SELECT DISTINCT project_id, name, file_path FROM symbols WHERE EXISTS (SELECT 1 FROM ch WHERE ch.project_id = symbols.project_id AND ch.file_path = symbols.file_path))
    SELECT project_id, due, name, file_path FROM h JOIN due USING (project_id) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY name, file_path) <= 50""")
def r4_regeneration(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits")
    changes = c.select("project_id", F.col("authored_date").alias("at"), F.explode(F.concat("added", "modified")).alias("file_path"), F.lit("changed").alias("change"))
    return R.regeneration(changes, table(spark, d, "symbols")).withColumn("due", F.unix_micros("due"))


@query("""WITH l AS (SELECT project_id, max(authored_date) AS "at" FROM commits GROUP BY 1) SELECT project_id FROM l WHERE "at" <= (SELECT max("at") FROM l) - INTERVAL 1 DAY""")
def r5_refresh_due(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "commits").groupBy("project_id").agg(F.max("authored_date").alias("at"))
    now = last.agg(F.max("at")).first()[0]
    return R.refresh_due(last, F.lit(now))


@query("SELECT event_id, event_type FROM events")
def r7_idempotence(spark: SparkSession, d: str) -> DataFrame:
    """Every event delivered twice, and all of it merged in again, leaves each once."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    once = K.latest(e.unionByName(e), ["event_id"], F.col("ts"))
    return K.upsert(once, e, ["event_id"], F.col("ts")).select("event_id", "event_type")


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, w, greatest(ceil(len(w) / 5.0)::BIGINT, 1) AS c FROM w), k AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 2 ELSE c + 3 END AS last FROM n)
    SELECT doc_id AS thread_id, i AS seq, CASE WHEN i = 0 THEN 'thinking' WHEN i = last THEN 'done' WHEN doc_id % 9 = 0 THEN 'error' WHEN i = c + 1 THEN 'sources' WHEN i = c + 2 THEN 'metadata' ELSE 'chunk' END AS kind FROM k, LATERAL (SELECT unnest(range(0, last + 1)) AS i)""")
def r9_answer_events(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("thread_id"), F.col("text").alias("answer"), F.lit("[]").alias("sources"), F.lit("{}").alias("metadata"), F.when(F.col("doc_id") % 9 == 0, "down").alias("error"))
    return R.answer_events(a).select("thread_id", F.col("seq").cast("bigint"), "kind")
