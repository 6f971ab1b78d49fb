"""Search: exact and lexical arms, rank fusion, fan-out, reranking, diversity, evidence. All on DataFrames of hits.

A set of queries is small by nature and travels to the data; vectors are never paired by a cross join of tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..functions.batches import in_arrow, spread
from ..session import checkpoint
from .collections import latest, top_per_group

RRF = 60
MOST_QUERIES, QUERY_BYTES, PRODUCT = 100_000, 1 << 28, 1 << 24  # queries and bytes that travel at once, numbers of a matrix product


def matches(df: DataFrame, filters: dict | None) -> DataFrame:
    """Payload filter: equality a key, membership for lists, part of the value for keys with __contains; an empty dict lets everything through."""
    for k, v in (filters or {}).items():
        if k.endswith("__contains"):  # opt-in: a part of the value is enough
            df = df.filter(F.contains(F.col(k.removesuffix("__contains")), F.lit(v)))
            continue
        df = df.filter(F.col(k).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(k) == v)
    return df


def tool_filters(language: str | None = None, file_path: str | None = None, project: str | None = None, section: str | None = None, severity: str | None = None) -> dict:
    """Filters of the search tools; severities are upper-cased."""
    given = {"language": language, "file_path": file_path, "project_id": project, "section_path": section, "severity": severity and severity.upper()}
    return {k: v for k, v in given.items() if v}


def clamp_k(k: int, kind: str = "code") -> int:
    """At most 50 hits for code and keywords, 30 for documents and incidents."""
    return min(k, 50 if kind in ("code", "keyword") else 30)


def dense(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", block: int = 4096) -> DataFrame:
    """Exact cosine top-k: vectors(key, embedding), queries(query_id, embedding) -> (query_id, key, score, rank).

    Queries go to every task, in groups of at most `MOST_QUERIES` and `QUERY_BYTES`; each block of vectors meets them in matrix products of at
    most `PRODUCT` numbers, and each task keeps k a query, so the exchange carries tasks x queries x k rows. Ties go to the smaller
    key. Null vectors match nothing. `near` answers many queries against many vectors with an index.
    """
    kind = f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(vectors.dtypes)[key]}, score double"
    asked = queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
    n, size = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], kind + ", rank int")
    groups = max(1, -(-n // MOST_QUERIES), -(-n * size * 8 // QUERY_BYTES))
    parts = [asked] if groups == 1 else [asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g) for g in range(groups)]
    out = None
    for p in parts:
        rows = p.collect()
        if rows:
            one = _dense(vectors, rows, k, key, block, kind)
            out = one if out is None else out.unionByName(one)
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties by id; a partial selection comes before the sort."""
    if score.shape[1] > 4 * k:
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        keep = np.flatnonzero((score >= least[:, None]).any(0))
        score, ids = score[:, keep], ids[keep]
    order = np.stack([np.lexsort((ids, -row))[:k] for row in score])
    return np.take_along_axis(score, order, 1), ids[order]


def _dense(vectors: DataFrame, rows: list, k: int, key: str, block: int, kind: str) -> DataFrame:
    names = [r.query_id for r in rows]
    q = np.array([r.embedding for r in rows], np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    shared = vectors.sparkSession.sparkContext.broadcast((names, q))
    arrow = to_arrow_schema(T._parse_datatype_string(kind))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        step = max(1, PRODUCT // block)
        tops: list = [None] * -(-len(names) // step)  # for each group of queries its best scores and keys
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                flat = np.asarray(part.column(1).flatten(), np.float64).reshape(len(part), -1)
                flat = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)
                ids = np.asarray(part.column(0).to_pylist())
                for g in range(len(tops)):
                    s, i = _best(q[g * step : (g + 1) * step] @ flat.T, ids, k)
                    if tops[g] is not None:
                        s, i = np.hstack([tops[g][0], s]), np.hstack([tops[g][1], i])
                        order = np.stack([np.lexsort((y, -x))[:k] for x, y in zip(s, i, strict=True)])
                        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                    tops[g] = s, i
        for g, top in enumerate(tops):
            if top is not None:
                n = top[0].shape[1]
                columns = [[x for x in names[g * step : (g + 1) * step] for _ in range(n)], top[1].ravel().tolist(), top[0].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    near = in_arrow(vectors.select(key, "embedding").filter("embedding IS NOT NULL"), best, kind)
    return top_per_group(near, ["query_id"], k, F.desc("score"), F.asc(key))


def lexical_match(docs: DataFrame, words: list[str], text: str = "content") -> DataFrame:
    """Documents whose text holds all words; a blank query matches nothing."""
    if not words:
        return docs.limit(0)
    own = X.tokens(text)
    return docs.filter(F.forall(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.array_contains(own, w)))


_TOKEN = "(?<![a-z0-9_])%s(?![a-z0-9_])"


def bm25(docs: DataFrame, words: list[str], key: str, text: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents with any of the words, by a scan. Lengths and frequencies are over all documents. Tokens are counted, not
    cut out, in one scan whose few numbers a document are checkpointed. For many queries use `postings`."""
    query = list(dict.fromkeys(w.lower() for w in words))
    if not all(2 <= len(w) <= 40 and w.replace("_", "a").isalnum() and w.isascii() for w in query):
        raise ValueError("words are 2 to 40 letters, digits and underscores")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    n = F.regexp_count(low, F.lit(_TOKEN % "[a-z0-9_]{2,40}")).alias("_n")
    tf = [F.when(F.contains(low, F.lit(w)), F.regexp_count(low, F.lit(_TOKEN % w))).otherwise(0).alias(f"_f{i}") for i, w in enumerate(query)]
    d = checkpoint(spread(docs.select(key, text)).select(key, n, *tf))
    # one row of statistics: a size that doesn't depend on the documents
    stats = d.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(query))])
    any_of = F.greatest(*[F.col(f"_f{i}") for i in range(len(query))], F.lit(0)) > 0
    both = d.filter(any_of).crossJoin(F.broadcast(stats))
    part = [_weight(F.col("_docs"), F.col(f"_d{i}"), F.col(f"_f{i}"), F.col("_n"), F.col("_mean"), k1, b) for i in range(len(query))]
    return both.select(key, sum(part[1:], part[0]).alias("score"))


def _weight(docs: Column, df: Column, tf: Column, n: Column, mean: Column, k1: float, b: float) -> Column:
    idf = F.log(1 + (docs - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))


def postings(docs: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(token, key, tf, n): a row a token and document with its frequency and the document's length in tokens; what a collection keeps to answer
    queries without reading its texts. Written partitioned by token_part (hash of the token, 256 parts), a query reads its words' parts."""
    d = docs.select(key, X.tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t")).select(key, F.size("_t").alias("n"), F.explode("_t").alias("token"))
    return d.groupBy(key, "n", "token").agg(F.count("*").alias("tf")).select("token", key, "tf", "n", F.pmod(F.xxhash64("token"), F.lit(256)).cast("int").alias("token_part"))


def bm25_postings(index: DataFrame, docs: int, mean: float, words: list[str], key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The scores of `bm25` from postings and the corpus's number of documents and mean length, which are kept beside them."""
    query = list(dict.fromkeys(w.lower() for w in words))
    mine = index.filter(F.col("token").isin(query))
    df = F.broadcast(mine.groupBy("token").agg(F.count("*").alias("_df")))  # a row a query word
    score = _weight(F.lit(docs), F.col("_df"), F.col("tf"), F.col("n"), F.lit(mean), k1, b)
    return mine.join(df, "token").groupBy(key).agg(F.sum(score).alias("score"))


def fuse(dense_hits: DataFrame, text_hits: DataFrame, key: str, k: int, by: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of two arms with (by..., key, rank): score is the sum of 1 / (60 + rank); ties keep the dense order, then the text order."""
    by = by or []
    both = dense_hits.select(*by, key, F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("text_rank")).unionByName(
        text_hits.select(*by, key, F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("text_rank"))
    )
    one = both.groupBy(*by, key).agg(F.min("dense_rank").alias("dense_rank"), F.min("text_rank").alias("text_rank"))
    score = F.coalesce(1 / (RRF + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1 / (RRF + F.col("text_rank")), F.lit(0.0))
    one = one.withColumn("score", score)
    order = [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("text_rank"), F.asc(key)]
    if by:
        return top_per_group(one, by, k, *order)
    # a global top-k is a TakeOrderedAndProject; only its k rows are numbered
    return one.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def keep_best(hits: DataFrame, key: str = "chunk_id", score: str = "score", *ties: Column) -> DataFrame:
    """One hit a key: the best score, then the given order."""
    return latest(hits, [key], F.col(score), *ties)


def fan_out(arms: dict[str, DataFrame], k: int, key: str = "chunk_id") -> DataFrame:
    """Hits of several collections, each with (key, score): code takes twice as many, all are united and the best a key kept."""
    parts = []
    for name, df in arms.items():
        n = 2 * k if name == "code_repo" else k
        parts.append(df.orderBy(F.desc("score"), key).limit(n).withColumn("collection", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return keep_best(out, key)


def hit_view(hits: DataFrame) -> DataFrame:
    """What a caller sees of hits: content cut at 500 characters, scores at 4 decimals, blanks for what is missing."""
    return hits.withColumns({"content": X.cut(F.coalesce("content", F.lit("")), 500), "score": F.round("score", 4)})


def entity_view(found: DataFrame) -> DataFrame:
    """What a caller sees of an entity: content cut at 2,000 characters."""
    return found.withColumn("content", X.cut(F.coalesce("content", F.lit("")), 2000))


def node_name(wanted: str) -> tuple[str, str, str]:
    """(file hint, qualified name, base name) of a node name: the hint stands before the first colon, the base behind the last dot."""
    hint, _, rest = wanted.rpartition(":") if ":" not in wanted else wanted.partition(":")
    return hint, rest, rest.rsplit(".", 1)[-1]


def find_entity(hits: DataFrame, wanted: str, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """The hit a node name means: among the first k by rank an exact name or qualified name, else a partial one; no row if none. A file
    hint puts hits of files whose path holds it first among equals."""
    hint, name, base = node_name(wanted)
    exact = (F.col("symbol_name") == base) | (F.col("qualified_name") == name)
    partial = F.contains(F.lower("symbol_name"), F.lit(base.lower()))
    found = hits.filter(F.col("rank") <= k).withColumn("match", F.when(exact, 0).when(partial, 1)).filter("match IS NOT NULL")
    order = ["match", *([~F.contains(F.coalesce("file_path", F.lit("")), F.lit(hint))] if hint and "file_path" in hits.columns else []), "rank"]
    return found.orderBy(*order).limit(1)


def diverse(hits: DataFrame, k: int, most: int = 2, by: list[str] | None = None) -> DataFrame:
    """At most `most` hits a file (heading, else 'doc', where there is none) among the best, then k of them, numbered anew."""
    by = by or []
    group = F.coalesce(F.nullif("file_path", F.lit("")), *([F.nullif("heading", F.lit(""))] if "heading" in hits.columns else []), F.lit("doc"))
    order = [F.desc("score"), F.asc("rank")]
    kept = hits.withColumn("_g", group).withColumn("_n", F.row_number().over(W.partitionBy(*by, "_g").orderBy(*order))).filter(F.col("_n") <= most).drop("_g", "_n")
    if by:
        return top_per_group(kept.withColumnRenamed("rank", "_r"), by, k, F.desc("score"), F.asc("_r")).drop("_r")
    top = kept.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("int"))


def rerank(hits: DataFrame, query: str, k: int, scorer=None) -> DataFrame:
    """Hits by a pair score of query and content (first 2,048 characters): overlap of words on [-10, 10], or the given scorer, a column
    function (query, content). If it raises, or any score of the candidates is null - which is what `scorers.pair_scorer` makes of
    a Python model that raises on an executor -, it has failed: order and scores stay as they are. Candidates are the few hits of a search."""
    text = F.substring(F.coalesce("content", F.lit("")), 1, 2048)
    try:
        score = (scorer or overlap_score)(F.lit(query), text)
    except Exception:  # noqa: BLE001 - whatever a scorer raises
        score = F.lit(None).cast("double")
    scored = hits.withColumn("rerank_score", score)
    if scorer is not None:
        scored = scored.withColumn("_bad", F.max(F.col("rerank_score").isNull()).over(W.partitionBy(F.lit(0))))
        scored = scored.withColumn("rerank_score", F.when(~F.col("_bad"), F.col("rerank_score"))).drop("_bad")
    order = [F.desc_nulls_last("rerank_score"), F.asc("rank")]
    top = scored.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("int")).withColumn("score", F.coalesce("rerank_score", "score"))


def overlap_score(query: Column, content: Column) -> Column:
    """Share of the query's distinct words that the content holds, mapped to [-10, 10]; built-in functions only."""
    q = F.array_distinct(X.tokens(query))
    both = F.size(F.array_intersect(q, X.tokens(content)))
    return F.when(F.size(q) == 0, F.lit(-10.0)).otherwise(both / F.size(q) * 20 - 10)


def collection_hits(hits: DataFrame) -> DataFrame:
    """(collection, hits) for the three collections, zero where there are none; others aren't counted."""
    spark = hits.sparkSession
    n = hits.groupBy("collection").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(c,) for c in X.COLLECTIONS], "collection string").join(n, "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("hits"))


def evidence(lists: DataFrame | None = None, entities: DataFrame | None = None, graphs: DataFrame | None = None) -> DataFrame:
    """Chunks from tool results: rows with a chunk_id; a found entity with score 1 and 500 characters; a graph answer with callers or
    callees as text with score 0.8."""
    parts = []
    if lists is not None:
        parts.append(lists.filter("chunk_id IS NOT NULL").select("chunk_id", "score", "content"))
    if entities is not None:
        parts.append(entities.filter("found").select("chunk_id", F.lit(1.0).alias("score"), F.substring("content", 1, 500).alias("content")))
    if graphs is not None:
        text = F.concat(F.lit("callers: "), F.array_join("callers", ", "), F.lit("; callees: "), F.array_join("callees", ", "))
        parts.append(graphs.filter((F.size("callers") > 0) | (F.size("callees") > 0)).select(F.concat(F.lit("graph:"), "node").alias("chunk_id"), F.lit(0.8).alias("score"), text.alias("content")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def context(hits: DataFrame) -> DataFrame:
    """One row: the hits as one text, a header line each, in rank order; meant for the few hits of an answer."""
    head = F.concat_ws(" | ", F.nullif("file_path", F.lit("")), F.nullif("symbol_name", F.lit("")), F.when(F.col("start_line").isNotNull(), F.concat_ws("-", "start_line", "end_line")))
    block = F.struct("rank", F.concat(F.lit("["), "rank", F.lit("] "), head, F.lit("\n"), "content").alias("b"))
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n---\n").alias("context"))


def localize(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The first hit of the code collection, else the first; no row without hits. With `by`, one for each of these keys."""
    order = F.struct(F.coalesce(F.col("collection") != "code_repo", F.lit(True)), "rank")
    if by:
        rest = [c for c in hits.columns if c not in by]
        return hits.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_b")).select(*by, *[F.col("_b")[c].alias(c) for c in rest])
    return hits.orderBy(order).limit(1)


def wiki_search(docs: DataFrame, query: str, name: str = "module_name", text: str = "content", most: int = 20) -> DataFrame:
    """Substring search without case: (name, score, snippet); score counts occurrences, the snippet shows the first one between 80
    characters before and 120 after. Queries under two characters find nothing."""
    q = query.strip().lower()
    if len(q) < 2:
        return docs.limit(0).select(name, F.lit(0).alias("score"), F.lit("").alias("snippet"))
    low = F.lower(F.col(text))
    at = F.instr(low, q)
    start, end = F.greatest(at - 81, F.lit(0)), F.least(at - 1 + len(q) + 120, F.length(text))
    part = F.replace(F.substring(F.col(text), start + 1, end - start), F.lit("\n"), F.lit(" "))
    shown = F.concat(F.when(start > 0, "...").otherwise(""), part, F.when(end < F.length(text), "...").otherwise(""))
    n = ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / len(q)).cast("int")
    return docs.filter(at > 0).select(name, n.alias("score"), shown.alias("snippet")).orderBy(F.desc("score"), name).limit(most)
