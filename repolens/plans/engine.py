"""The engine as one object: indexing, search tools, questions, wiki and evaluation over collections in one folder."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scorers
from ..functions import text as X
from ..operators import calls as J
from ..operators import chunking as T
from ..operators import collections as K
from ..operators import metrics as A
from ..operators import modules as M
from ..operators import search as V
from ..operators import symbols as S
from ..session import checkpoint
from ..sources import files as FS
from . import graph as G
from . import wiki as WK

POINT = (
    "chunk_id string, point_id string, file_path string, language string, symbol_name string, symbol_type string, qualified_name string, parent_symbol string, section_path string, heading string,"
    " start_line int, end_line int, content string, content_hash string, source_collection string, trust_level string, severity string, calls array<string>, embedding array<float>, last_indexed_at timestamp, project_id string"
)


@dataclass(frozen=True)
class Settings:
    window: int = 50
    most_per_file: int = 2
    steps: int = 10
    depth: int = 3
    query_length: int = 2000


class Engine:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings or Settings()
        self.collections = {n: FS.Snapshot(spark, f"{self.folder}/{n}", schema=POINT) for n in X.COLLECTIONS}
        for s in self.collections.values():
            s.create(POINT)

    # --- indexing ------------------------------------------------------------------------------------------------
    def _points(self, rows: DataFrame, collection: str, trust: str, as_of: str) -> DataFrame:
        names = [f.split()[0] for f in POINT.split(", ")]
        d = rows.withColumn("content_hash", X.content_hash(F.col("content")))
        have = [c for c in d.columns if c in names]
        vectors = scorers.embed(d.select("content_hash", "content"), self._cache())
        d = d.select(*have).join(vectors, "content_hash")
        fixed = {"point_id": X.point_id(F.col("chunk_id")), "source_collection": F.lit(collection), "trust_level": F.lit(trust), "last_indexed_at": F.lit(as_of).cast("timestamp")}
        d = d.withColumns(fixed)
        kinds = dict(self.spark.createDataFrame([], POINT).dtypes)
        return d.select(*[(F.col(n) if n in d.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names])

    def _cache(self) -> DataFrame:
        """Vectors that are stored already, by content hash."""
        parts = [s.read().select("content_hash", "embedding") for s in self.collections.values()]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["content_hash"])

    def _chunks(self, files: DataFrame) -> DataFrame:
        found = checkpoint(S.extract(files))
        rest = files.join(found.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_anti")
        own = found.withColumn("content", T.chunk_content(F.col("language"), F.col("docstring"), F.col("body"))).filter("content <> ''").select(
            "project_id", "file_path", "language", F.col("name").alias("symbol_name"), "symbol_type", "qualified_name", F.col("parent").alias("parent_symbol"), "start_line", "end_line", "content", "calls"
        )
        loose = T.windows(rest, self.settings.window).select(
            "project_id", "file_path", "language", F.col("name").alias("symbol_name"), F.lit("function").alias("symbol_type"), F.col("name").alias("qualified_name"), F.lit(None).cast("string").alias("parent_symbol"),
            "start_line", "end_line", F.col("body").alias("content"), F.array().cast("array<string>").alias("calls"),
        ).filter(X.strip("content") != "")
        both = own.unionByName(loose)
        return both.withColumn("chunk_id", X.chunk_id(F.col("project_id"), F.col("file_path"), F.col("qualified_name"), F.col("content")))

    def index_repo(self, root: str, project: str, as_of: str, force: bool = False) -> dict:
        """Indexes a source tree; a project that has points already is left as it is unless forced. Returns counts."""
        code = self.collections["code_repo"]
        if not force and not code.read().filter(F.col("project_id") == project).limit(1).isEmpty():
            return {"skipped": True}
        files = checkpoint(FS.walk(self.spark, root, project))
        points = checkpoint(self._points(self._chunks(files), "code_repo", "code", as_of))
        code.delete_project(project)
        code.upsert(points, F.col("last_indexed_at"))
        return {"skipped": False, "files": files.count(), "chunks": points.count()}

    def index_files(self, files: DataFrame, removed: DataFrame, as_of: str) -> None:
        """files(project_id, file_path, language, size, content) replace what is stored of them; removed(project_id, file_path) vanish."""
        kept = files.filter(X.is_walked("file_path", "size"))
        touched = files.select("project_id", "file_path").union(removed.select("project_id", "file_path")).distinct()
        self.collections["code_repo"].replace_files(touched, self._points(self._chunks(kept), "code_repo", "code", as_of))

    def index_docs(self, docs: DataFrame, label: str, project: str, as_of: str) -> None:
        """docs(path, text): Markdown of one label, cut into sections; incident reports get severity and date."""
        s = T.section_chunks(docs, "path", "text", F.lit(label)).withColumn("severity", T.incident_fields(F.col("heading"))[0])
        s = s.select(F.lit(project).alias("project_id"), F.col("path").alias("file_path"), F.lit("markdown").alias("language"), "section_path", "heading", "severity", "content", "chunk_id")
        name = "incident_reports" if label == "incident_reports" else "app_docs"
        self.collections[name].upsert(self._points(s, name, "generated" if label == "generated" else "documentation", as_of), F.col("last_indexed_at"))

    def index_discussions(self, threads: DataFrame, as_of: str) -> None:
        c = T.discussion_chunks(threads)
        place = F.concat_ws("/", "context_type", F.col("context_id").cast("string"))
        c = c.select("project_id", F.when(F.col("comment_no") < 0, place).otherwise(F.concat(place, F.lit("/comment_"), "comment_no")).alias("file_path"), F.lit("markdown").alias("language"), F.lit(1).alias("start_line"), "end_line", "content", "chunk_id")
        self.collections["app_docs"].upsert(self._points(c, "app_docs", "documentation", as_of), F.col("last_indexed_at"))

    def collection_status(self) -> DataFrame:
        parts = [s.read().select("source_collection", "chunk_id") for s in self.collections.values()]
        return K.statistics(parts[0].unionByName(parts[1]).unionByName(parts[2]))

    # --- search tools --------------------------------------------------------------------------------------------
    def hybrid(self, collection: str, query: str, filters: dict | None = None, k: int = 10, words: list[str] | None = None) -> DataFrame:
        """Dense arm (2k) and keyword arm fused; an unknown collection has no hits, a blank query no keyword arm."""
        if collection not in self.collections:
            return self.spark.createDataFrame([], POINT).withColumns({"score": F.lit(0.0), "rank": F.lit(0), "collection": F.lit(collection)})
        points = V.matches(self.collections[collection].read(), filters)
        q = self.spark.createDataFrame([(0, scorers.embed_query(query))], "query_id int, embedding array<float>")
        near = V.dense(points, q, 2 * k, "chunk_id").select("chunk_id", "rank")
        match = V.lexical_match(points, words if words is not None else _tokens(query)).select("chunk_id").orderBy("chunk_id").limit(k)
        text = K.top_per_group(match.withColumn("_g", F.lit(0)), ["_g"], k, F.asc("chunk_id")).select("chunk_id", "rank")
        return V.fuse(near, text, "chunk_id", k).select("chunk_id", "score", "rank").join(points, "chunk_id").withColumn("collection", F.lit(collection))

    def search_code(self, query: str, k: int = 10, **filters: str | None) -> DataFrame:
        return self.hybrid("code_repo", query, V.tool_filters(**filters), V.clamp_k(k))

    def search_app_docs(self, query: str, k: int = 10, **filters: str | None) -> DataFrame:
        return self.hybrid("app_docs", query, V.tool_filters(**filters), V.clamp_k(k, "docs"))

    def search_incidents(self, query: str, k: int = 10, **filters: str | None) -> DataFrame:
        return self.hybrid("incident_reports", query, V.tool_filters(**filters), V.clamp_k(k, "docs"))

    def keyword_search(self, words: list[str], collection: str = "code_repo", k: int = 10) -> DataFrame:
        aliases = {"code": "code_repo", "docs": "app_docs", "incidents": "incident_reports"}
        return self.hybrid(aliases.get(collection, collection), " ".join(words), None, V.clamp_k(k, "keyword"), [w.lower() for w in words])

    def retrieve_entity(self, name: str, project: str | None = None) -> DataFrame:
        return V.find_entity(self.search_code(name.rsplit(".", 1)[-1], 10, project=project), name)

    def traverse_graph(self, name: str, project: str, hops: int = 1) -> DataFrame:
        """(node, distance, direction) of callers and callees of a symbol, exact over all stored calls."""
        p = self.collections["code_repo"].read().filter(F.col("project_id") == project)
        sy = p.select("project_id", F.col("symbol_name").alias("name"), "qualified_name", "file_path", "calls")
        none = self.spark.createDataFrame([], "project_id string, source_file string, imported_name string, module_path string, qualified_name string, is_wildcard boolean")
        e = checkpoint(J.edges(J.resolve(J.calls_of(sy), J.components(sy), none)))
        start = sy.filter((F.col("qualified_name") == name) | (F.col("name") == name)).select(F.col("qualified_name").alias("node")).distinct()
        out = G.neighbours(e, start, hops).withColumn("direction", F.lit("callees"))
        return out.unionByName(G.neighbours(e, start, hops, forward=False).withColumn("direction", F.lit("callers"))).select("node", "distance", "direction")

    # --- questions -----------------------------------------------------------------------------------------------
    def search_all(self, query: str, project: str | None = None, k: int = 10) -> DataFrame:
        """Code (filtered by project), documents and incidents, the best of each chunk."""
        arms = {"code_repo": self.search_code(query, 2 * k, project=project), "app_docs": self.search_app_docs(query, k), "incident_reports": self.search_incidents(query, k)}
        return V.fan_out({n: d.drop("collection") for n, d in arms.items()}, k)

    def query(self, text: str, project: str | None = None, k: int = 8, scorer=None) -> dict:
        """A loop of tool calls within the budget of `Settings.steps`: search in all collections; then, as long as fewer than k hits are known, keyword
        searches of the question's longest words, one a step, and the entity each names; then rerank and diversity. Returns sources (a
        DataFrame), confidence, hits a collection and the steps taken."""
        if not 1 <= len(text) <= self.settings.query_length:
            raise ValueError("a query has 1 to 2,000 characters")
        from pyspark.sql import Window as W

        found = self.search_all(text, project, 2 * k)
        steps = ["search"]
        plan = [(tool, w) for w in sorted(set(_tokens(text)), key=lambda w: (-len(w), w)) for tool in ("keywords", "entity")]
        while plan and len(steps) < self.settings.steps and found.limit(k).count() < k:
            tool, word = plan.pop(0)
            more = self.keyword_search([word], k=k) if tool == "keywords" else self.retrieve_entity(word, project)
            found = checkpoint(V.keep_best(found.unionByName(more.select(*[c for c in more.columns if c in found.columns]), allowMissingColumns=True), "chunk_id"))
            steps.append(f"{tool}:{word}")

        found = found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")))  # a few hits, bounded by k
        best = checkpoint(V.diverse(V.rerank(found, text, 4 * k, scorer), k, self.settings.most_per_file))
        top = best.agg(F.max("score").alias("s")).select(X.confidence(F.col("s")).alias("c")).first().c
        hits = {r.collection: r.hits for r in V.collection_hits(best).collect()}
        context = V.context(best).first()
        run = {"steps": steps, "thread_id": f"{project or 'all'}:{text[:32]}", "confidence": top, "collection_hits": hits}
        self.spark.createDataFrame([(run["thread_id"], text, float(top), json.dumps(hits))], "thread_id string, query string, confidence double, hits string").write.mode("append").parquet(f"{self.folder}/agent_runs")
        return run | {"sources": best, "context": context.context if context else ""}

    def conversation(self, thread_id: str) -> DataFrame:
        """The stored runs of a thread; none before the first."""
        if not FS.exists(self.spark, f"{self.folder}/agent_runs"):
            return self.spark.createDataFrame([], "thread_id string, query string, confidence double, hits string")
        return self.spark.read.parquet(f"{self.folder}/agent_runs").filter(F.col("thread_id") == thread_id)

    def localize(self, issue: str, project: str | None = None) -> DataFrame:
        if not 10 <= len(issue) <= 5000:
            raise ValueError("an issue has 10 to 5,000 characters")
        return V.localize(self.query(issue[: self.settings.query_length], project)["sources"])

    # --- wiki ----------------------------------------------------------------------------------------------------
    def components(self, project: str) -> DataFrame:
        p = self.collections["code_repo"].read().filter(F.col("project_id") == project)
        return p.select("project_id", F.col("chunk_id").alias("component_id"), F.coalesce("qualified_name", "symbol_name").alias("name"), "file_path", F.col("content").alias("source"))

    def wiki_generate(self, project: str, generator: WK.Generator = WK.outline, changed: DataFrame | None = None) -> DataFrame:
        """Writes the wiki of a project and returns it; with changed(project_id, file_path) only what they affect is written anew."""
        comps = checkpoint(self.components(project))
        tree = checkpoint(M.cluster(comps, self.settings.depth))
        stored = self.wiki(project) if changed is not None else None
        docs = WK.regenerate(tree, comps, stored, changed, generator) if changed is not None else WK.generate(tree, comps, generator)
        out = checkpoint(WK.checked(docs))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(f"{self.folder}/wiki_docs")
        return out

    def wiki(self, project: str) -> DataFrame | None:
        if not FS.exists(self.spark, f"{self.folder}/wiki_docs"):
            return None
        return self.spark.read.parquet(f"{self.folder}/wiki_docs").filter(F.col("project_id") == project)

    def wiki_regenerate(self, project: str, changed: DataFrame | None = None, generator: WK.Generator = WK.outline) -> DataFrame:
        """All documents of a project anew, or only what changed(project_id, file_path) affects."""
        return self.wiki_generate(project, generator, changed)

    def wiki_tree(self, project: str) -> DataFrame:
        """Modules in order of their paths, each with whether it has a document."""
        t = WK.with_parents(M.cluster(self.components(project), self.settings.depth))
        docs = self.wiki(project)
        have = docs.select("project_id", "module", F.lit(True).alias("has_doc")) if docs is not None else t.select("project_id", "module", F.lit(True).alias("has_doc")).limit(0)
        return t.join(have, ["project_id", "module"], "left").select("project_id", "module", "depth", F.coalesce("has_doc", F.lit(False)).alias("has_doc")).orderBy("module")

    def wiki_search(self, project: str, query: str) -> DataFrame:
        return V.wiki_search(self.wiki(project), query, "module")

    def wiki_projects(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/wiki_docs").select("project_id").distinct().orderBy("project_id")

    def _batch_hits(self, cases: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, file_path, symbol_name, score) of all cases at once: one dense pass and one keyword join a collection, fused."""
        embed = F.udf(scorers.embed_query, "array<float>")  # cases are a hand-written set
        q = checkpoint(cases.select("query_id", "project_id", embed("query").alias("embedding"), F.array_distinct(X.tokens("query")).alias("words")))
        parts = []
        for name, s in self.collections.items():
            n = 2 * k if name == "code_repo" else k
            points = s.read().select("chunk_id", "project_id", "file_path", "symbol_name", "content", "embedding")
            near = V.dense(points, q.select("query_id", "embedding"), 4 * n, "chunk_id") if name != "code_repo" else self._dense_by_project(points, q, 4 * n)
            words = q.select("query_id", F.col("project_id").alias("_p"), F.size("words").alias("_n"), F.explode("words").alias("token"))
            match = V.postings(points, "chunk_id").join(F.broadcast(words), "token").join(points.select("chunk_id", "project_id"), "chunk_id")
            if name == "code_repo":
                match = match.filter(F.col("_p").isNull() | (F.col("_p") == F.col("project_id")))
            match = match.groupBy("query_id", "chunk_id", "_n").agg(F.count("*").alias("_m")).filter("_m = _n").select("query_id", "chunk_id")
            text = K.top_per_group(match, ["query_id"], n, F.asc("chunk_id"))
            fused = V.fuse(near.select("query_id", "chunk_id", "rank"), text, "chunk_id", n, ["query_id"])
            parts.append(fused.select("query_id", "chunk_id", "score").join(points.select("chunk_id", "file_path", "symbol_name"), "chunk_id"))
        out = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return out.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.first("file_path").alias("file_path"), F.first("symbol_name").alias("symbol_name"))

    def _dense_by_project(self, points: DataFrame, q: DataFrame, k: int) -> DataFrame:
        """Dense hits of queries that ask for a project among its points only: a pass for each project asked for."""
        asked = [r.project_id for r in q.select("project_id").distinct().collect()]
        parts = [V.dense(V.matches(points, {"project_id": p} if p else None), q.filter(F.col("project_id").eqNullSafe(p)).select("query_id", "embedding"), k, "chunk_id") for p in asked]
        if not parts:
            return V.dense(points, q.select("query_id", "embedding"), k, "chunk_id")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # --- evaluation ----------------------------------------------------------------------------------------------
    def evaluate(self, cases: DataFrame, limits: dict[str, float] | None = None, k: int = 20) -> tuple[DataFrame, DataFrame]:
        """Retrieval metrics of cases(query_id, query, project_id, expected_files, expected_symbols), a hand-written set; and the thresholds."""
        asked = cases.select("query_id", "query", "project_id", "expected_files", "expected_symbols")
        hits = self._batch_hits(asked, k)
        ranked = K.top_per_group(hits, ["query_id"], k, F.desc("score"), F.asc("chunk_id")).join(asked.select("query_id", "expected_files", "expected_symbols"), "query_id")
        rel = A.relevant(F.col("file_path"), F.col("symbol_name"), F.col("expected_files"), F.col("expected_symbols"))
        means = A.mean_over_cases(A.ranking(ranked.select("query_id", "rank", rel.alias("rel"))), cases)
        means = checkpoint(means)
        return means, A.thresholds(means, limits or {"mrr": 0.40, "hit_3": 0.55, "hit_5": 0.70, "ndcg_5": 0.45})

    @staticmethod
    def report(means: DataFrame, passed: DataFrame) -> tuple[str, str]:
        """JSON and Markdown of an evaluation."""
        values, rows = means.first().asDict(), [r.asDict() for r in passed.collect()]
        table = "\n".join(f"| {r['metric']} | {r['value']:.4f} | {r['threshold']:.2f} | {'pass' if r['passed'] else 'fail'} |" for r in rows)
        return json.dumps({"metrics": values, "thresholds": rows}), f"# Evaluation\n\n| metric | value | least | |\n|---|---|---|---|\n{table}\n"


def _tokens(text: str) -> list[str]:
    import re

    return [w for w in re.findall(r"[a-z0-9_]+", text.lower()) if 2 <= len(w) <= 40]
