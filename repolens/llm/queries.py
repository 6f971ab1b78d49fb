"""Queries of the operators in this subpackage, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import code_text as C
from . import corpus_text as T
from . import near_duplicates as N


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return C.documented(table(spark, d, "symbols"), table(spark, d, "files")).select("symbol_id").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.documented_pairs(table(spark, d, "symbols"), table(spark, d, "files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return C.file_origin(table(spark, d, "files")).select("file_id").distinct()


def p2_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return C.handwritten(table(spark, d, "files")).select("file_id", "project_id", "file_path").distinct()


def p2_evidence(spark: SparkSession, d: str) -> DataFrame:
    found = C.file_origin(table(spark, d, "files"))
    return found.groupBy("origin", "shown_by").agg(F.countDistinct("file_id").alias("files"), F.round(F.avg("expansion"), 3).alias("expansion"), F.round(F.avg("uniformity"), 3).alias("uniformity"), F.round(F.avg("literals"), 3).alias("literals"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return C.unparsable(table(spark, d, "files")).select("file_id").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return C.unparsable_rates(table(spark, d, "files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return C.secret_lines(C.text_records(table(spark, d, "code_repo"), table(spark, d, "symbols")))


def p4_masked(spark: SparkSession, d: str) -> DataFrame:
    return C.masked(C.text_records(table(spark, d, "code_repo"), table(spark, d, "symbols")))


def _chunk_limits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "size_limits").filter("item_kind = 'chunk'")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return C.split_oversized(table(spark, d, "code_repo"), _chunk_limits(spark, d)).filter("piece_no = 1").select("chunk_id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return C.split_oversized(table(spark, d, "code_repo"), _chunk_limits(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return N.similar_pairs(table(spark, d, "code_repo"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return N.near_duplicate_groups(table(spark, d, "code_repo"))


def p6_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    return N.class_pairs(table(spark, d, "code_repo")).withColumn("similarity", F.round("similarity", 9))


def _capacity(spark: SparkSession, d: str) -> int:
    return table(spark, d, "size_limits").filter("item_kind = 'document' AND unit = 'token'").agg(F.min("max_size")).first()[0]


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return T.containers(table(spark, d, "documents"), _capacity(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return p7_containers(spark, d).groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return T.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return T.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return T.mislabelled(table(spark, d, "documents"), T.language_model(table(spark, d, "lang_samples")))


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return T.passages_by_language(table(spark, d, "documents"), T.language_model(table(spark, d, "lang_samples")))


# --- what must hold of results that SQL can't make ----------------------------------------------------------------------
def p4_unharmed(spark: SparkSession, d: str) -> DataFrame:
    """Lines and characters of each text after masking."""
    return C.masked_shape(C.text_records(table(spark, d, "code_repo"), table(spark, d, "symbols")))


def p5_whole(spark: SparkSession, d: str) -> DataFrame:
    """For each chunk above its limit: are its pieces within the limit, do they overlap as given, do they make the text without overlaps?"""
    limits = _chunk_limits(spark, d).select("language", "max_size", "overlap_size")
    text = table(spark, d, "code_repo").select("chunk_id", "language", "content").dropDuplicates(["chunk_id"]).join(limits, "language")
    p = C.split_oversized(table(spark, d, "code_repo"), _chunk_limits(spark, d))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "content", "overlap"))), lambda x: F.struct(x["content"].alias("c"), x["overlap"].alias("o")))
    one = p.groupBy("chunk_id").agg(parts.alias("parts")).join(text, "chunk_id")
    joined = F.array_join(F.transform("parts", lambda x: F.substring(x["c"], x["o"] + 1, F.length(x["c"]))), "")
    fits = F.forall("parts", lambda x: F.length(x["c"]) <= F.col("max_size"))
    overlaps = F.forall(F.slice("parts", F.lit(2), F.size("parts")), lambda x: x["o"] == F.col("overlap_size"))
    return one.select("chunk_id", fits.alias("fits"), overlaps.alias("overlaps"), (joined == F.col("content")).alias("whole"))


def p7_placed(spark: SparkSession, d: str) -> DataFrame:
    """For each document: are its parts without gaps, and all but the last of them full?"""
    n = _capacity(spark, d)
    one = p7_containers(spark, d).groupBy("doc_id").agg(
        (F.sum("tokens") == F.max(F.col("first_token") + F.col("tokens"))).alias("gapless"), ((F.count("*") == F.max("part") + 1) & (F.count_if(F.col("tokens") < n) <= 1)).alias("full")
    )
    return one.select("doc_id", "gapless", "full")


def p7_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed, containers over the capacity."""
    n = _capacity(spark, d)
    parts = p7_containers(spark, d)
    over = parts.groupBy("container_id").agg(F.sum("tokens").alias("t")).filter(F.col("t") > n).agg(F.count("*").alias("containers_over"))
    return parts.agg(F.countDistinct("doc_id").alias("documents")).crossJoin(over)  # two single rows


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_handwritten, p2_evidence, p3_found, p3_rates, p4_found, p4_masked, p4_unharmed, p5_found, p5_pieces, p5_whole, p6_found, p6_groups, p6_class_pairs,
                            p7_containers, p7_fill, p7_placed, p7_capacity, p8_found, p8_report, p9_found, p9_passages)
}

#: Classes of chunks with the same words, their sets of runs of three words, and links between classes.
LINKS = """WITH RECURSIVE t AS (SELECT DISTINCT chunk_id, project_id, file_path, content, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM code_repo WHERE content IS NOT NULL),
    k AS (SELECT chunk_id, project_id, file_path, w, array_to_string(w, ' ') AS words FROM t WHERE len(w) >= 40), cls AS (SELECT words, min(chunk_id) AS head, any_value(w) AS w FROM k GROUP BY words),
    sh AS (SELECT DISTINCT head, s FROM (SELECT head, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM cls)), n AS (SELECT head, count(*) AS n FROM sh GROUP BY 1),
    pr AS (SELECT a.head AS x, b.head AS y, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.head < b.head GROUP BY 1, 2),
    links AS (SELECT x, y, common::DOUBLE / (p.n + q.n - common) AS similarity FROM pr JOIN n p ON p.head = x JOIN n q ON q.head = y WHERE common::DOUBLE / (p.n + q.n - common) >= 0.6 - 1e-12),
    m AS (SELECT chunk_id, project_id, file_path, head FROM k JOIN cls USING (words))"""

SQL: dict[str, str] = {
    "p4_unharmed": """SELECT DISTINCT 'chunk' AS record_kind, chunk_id AS record_id, length(content) - length(replace(content, chr(10), '')) + 1 AS lines, length(content) AS characters FROM code_repo
        UNION SELECT 'symbol', symbol_id::VARCHAR, length(body) - length(replace(body, chr(10), '')) + 1, length(body) FROM symbols""",
    "p5_found": """SELECT DISTINCT c.chunk_id FROM code_repo c JOIN size_limits s ON s.item_kind = 'chunk' AND s.language = c.language
        WHERE length(c.content) > s.max_size""",
    "p5_whole": """SELECT DISTINCT c.chunk_id, true AS fits, true AS overlaps, true AS whole FROM code_repo c JOIN size_limits s ON s.item_kind = 'chunk' AND s.language = c.language
        WHERE length(c.content) > s.max_size""",
    "p6_found": LINKS + """, l AS (SELECT x, y FROM links UNION ALL SELECT head, head FROM cls) SELECT DISTINCT least(a.chunk_id, b.chunk_id) AS chunk_id_a, greatest(a.chunk_id, b.chunk_id) AS chunk_id_b
        FROM l JOIN m a ON a.head = l.x JOIN m b ON b.head = l.y WHERE a.chunk_id <> b.chunk_id AND (a.project_id, a.file_path) <> (b.project_id, b.file_path)""",
    "p6_groups": LINKS + """, e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links), c AS (SELECT x AS head, count(*) AS links FROM e GROUP BY 1),
        cc(head, seen) USING KEY (head) AS (SELECT DISTINCT x, x FROM e UNION (SELECT e.y, min(cc.seen) FROM cc JOIN e ON e.x = cc.head JOIN recurring.cc AS r ON r.head = e.y WHERE cc.seen < r.seen GROUP BY e.y))
        SELECT DISTINCT chunk_id, head AS class_id, coalesce(links, 0) AS links, coalesce(seen, head) AS group_id FROM m LEFT JOIN c USING (head) LEFT JOIN cc USING (head)""",
    "p6_class_pairs": LINKS + " SELECT x AS class_a, y AS class_b, round(similarity, 9) AS similarity FROM links",
    "p7_placed": "SELECT doc_id, true AS gapless, true AS full FROM documents",
    "p7_capacity": "SELECT count(*) AS documents, 0::BIGINT AS containers_over FROM documents",
}
