"""Calls to components: the tiered resolution join, edges, callers and callees, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def components(symbols: DataFrame) -> DataFrame:
    """(project_id, component_id, name, file_path, directory, start_line): one row a qualified name and file of a project, with its first line."""
    start = F.min("start_line") if "start_line" in symbols.columns else F.lit(0)
    return symbols.groupBy("project_id", F.coalesce("qualified_name", "name").alias("component_id"), "name", "file_path").agg(start.alias("start_line")).select(
        "project_id", "component_id", "name", "file_path", X.directory("file_path").alias("directory"), "start_line"
    )


def calls_of(symbols: DataFrame) -> DataFrame:
    """(project_id, caller_id, caller_file, call): distinct calls of all symbols; null lists have none."""
    return symbols.select(
        "project_id", F.coalesce("qualified_name", "name").alias("caller_id"), F.col("file_path").alias("caller_file"), F.explode("calls").alias("call")
    ).filter("call IS NOT NULL").distinct()


def resolve(calls: DataFrame, comps: DataFrame, imports: DataFrame) -> DataFrame:
    """calls with callee_id and tier: 1 the call is a component's id; 2 an import of the caller's file names it: of its candidates, in the
    order of statements, the first that is a component's id or part of an id that ends with the call, an exact id before such a part; 3 a
    component of the same file whose id ends with .call; 4 a component of that name: the first of the caller's directory, else the first of
    all; null where nothing is found. Components come in the order files are walked in (by path), then of lines. Statements come in the
    order of `position`, if imports have it, else of their qualified names; wildcards name nothing.

    Every tier is an equi-join on (project, last segment). Before it, the sides are reduced to what the join keeps - the
    first component a key, each qualified name once whatever the number of its importers - so a name that a third of all
    components or files bear meets the other side as one row.
    """
    c = comps.select("project_id", "component_id", "name", "file_path", "directory", F.coalesce("start_line", F.lit(0)).alias("start_line") if "start_line" in comps.columns else F.lit(0).alias("start_line"))
    c = c.withColumn("at", F.struct("file_path", "start_line", "component_id"))
    keys = ["project_id", "caller_file", "call"]
    wanted = calls.select(*keys).distinct()
    first = F.min("at").alias("at")
    dotted = c.filter(F.contains("component_id", F.lit("."))).withColumn("call", X.last_segment("component_id"))

    def tier(df: DataFrame, n: int, pos: Column = F.lit(""), kind: Column = F.lit(0)) -> DataFrame:
        return df.select(*keys, F.lit(n).alias("tier"), pos.cast("string").alias("pos"), kind.alias("kind"), "at")

    ids = c.groupBy("project_id", F.col("component_id").alias("call")).agg(first)
    found = tier(wanted.join(ids, ["project_id", "call"]), 1)

    pos = F.lpad(F.col("position").cast("string"), 12, "0") if "position" in imports.columns else F.col("qualified_name")
    named = imports.filter(~F.col("is_wildcard") & F.col("qualified_name").isNotNull()).groupBy("project_id", F.col("source_file").alias("caller_file"), F.col("imported_name").alias("call"), "qualified_name").agg(F.min(pos).alias("pos"))
    named = wanted.join(named, keys)
    candidates = named.select("project_id", "call", "qualified_name").distinct()
    exact = candidates.join(ids.withColumnRenamed("call", "qualified_name"), ["project_id", "qualified_name"]).withColumn("kind", F.lit(0))
    ends = dotted.groupBy("project_id", "call", "component_id").agg(first)
    part = candidates.join(ends, ["project_id", "call"]).filter(F.contains("component_id", F.col("qualified_name"))).groupBy("project_id", "call", "qualified_name").agg(first).withColumn("kind", F.lit(1))
    cols = ["project_id", "call", "qualified_name", "kind", "at"]
    met = named.join(exact.select(*cols).unionByName(part.select(*cols)), ["project_id", "call", "qualified_name"])
    found = found.unionByName(tier(met, 2, F.col("pos"), F.col("kind")))

    same = dotted.groupBy("project_id", F.col("file_path").alias("caller_file"), "call").agg(first)
    found = found.unionByName(tier(wanted.join(same, keys), 3))

    near = c.groupBy("project_id", F.col("name").alias("call"), "directory").agg(first)
    found = found.unionByName(tier(wanted.withColumn("directory", X.directory("caller_file")).join(near, ["project_id", "call", "directory"]), 4))
    anywhere = c.groupBy("project_id", F.col("name").alias("call")).agg(first)
    found = found.unionByName(tier(wanted.join(anywhere, ["project_id", "call"]), 4, kind=F.lit(1)))

    best = found.groupBy(*keys).agg(F.min(F.struct("tier", "pos", "kind", "at")).alias("b"))
    return calls.join(best, keys, "left").select(*calls.columns, F.col("b.tier").alias("tier"), F.col("b.at.component_id").alias("callee_id"))


def edges(resolved: DataFrame) -> DataFrame:
    """(project_id, src, dst): distinct resolved calls, loops left out."""
    return resolved.filter("callee_id IS NOT NULL AND callee_id <> caller_id").select("project_id", F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).distinct()


def callers_and_callees(e: DataFrame, most_callees: int = 20) -> DataFrame:
    """(project_id, node, callers, callees): sizes and the first callees in order of name, at most `most_callees` shown."""
    from .collections import top_per_group

    out = e.groupBy("project_id", F.col("src").alias("node")).agg(F.count("*").alias("callees"))
    shown = top_per_group(e, ["project_id", "src"], most_callees, F.asc("dst")).groupBy("project_id", F.col("src").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("first_callees"))
    into = e.groupBy("project_id", F.col("dst").alias("node")).agg(F.count("*").alias("callers"))
    return out.join(into, ["project_id", "node"], "full_outer").join(shown, ["project_id", "node"], "left").select(
        "project_id", "node", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"), F.coalesce("first_callees", F.lit("")).alias("first_callees")
    )


def enclosing_class(symbols: DataFrame) -> DataFrame:
    """Range join within a file: (symbol_id, class_name) of functions whose lines lie in a class's; the outermost-first class
    wins (smallest first line, then the longer one), as a scan over classes in order finds it."""
    cls = symbols.filter("symbol_type = 'class'").select("file_id", F.col("start_line").alias("a"), F.col("end_line").alias("e"), F.col("name").alias("class_name")).distinct()
    fn = symbols.filter(F.col("symbol_type").isin("function", "method")).select("symbol_id", "file_id", "start_line", "end_line").distinct()
    both = fn.join(cls, (fn.file_id == cls.file_id) & (fn.start_line >= cls.a) & (fn.end_line <= cls.e))
    return both.groupBy("symbol_id").agg(F.min_by("class_name", F.struct("a", -F.col("e"), "class_name")).alias("class_name"))


def documented_callees(e: DataFrame, docs: DataFrame, most: int = 5, size: int = 200) -> DataFrame:
    """(project_id, src, dst, doc): first `most` callees a caller by name, with the start of their documentation, '' if there is none."""
    from .collections import top_per_group

    top = top_per_group(e, ["project_id", "src"], most, F.asc("dst")).drop("rank")
    d = docs.groupBy("project_id", F.col("component_id").alias("dst")).agg(F.max("doc").alias("doc"))
    return top.join(d, ["project_id", "dst"], "left").select("project_id", "src", "dst", F.substring(F.coalesce("doc", F.lit("")), 1, size).alias("doc"))


def callers_of(symbols: DataFrame, name: str) -> DataFrame:
    """(project_id, caller_id, file_path) of symbols that call something of this name, exactly and whatever the rank of any search."""
    return symbols.filter(F.array_contains("calls", name)).select("project_id", F.coalesce("qualified_name", "name").alias("caller_id"), "file_path").distinct()


def fuzzy_docs(symbols: DataFrame, docs: DataFrame, by: list[str], size: int = 150) -> DataFrame:
    """symbols(by..., symbol_id, name, docstring), docs(by..., place, doc_name, doc) -> (symbol_id, doc): the first document by place whose name
    holds the symbol's, else its docstring, else 'No documentation', `size` characters of it. A symbol meets only documents with the same `by`."""
    s = symbols.select(*by, "symbol_id", "name", "docstring").distinct()
    hit = s.select(*by, "symbol_id", "name").join(docs, by).filter(F.contains("doc_name", F.col("name"))).groupBy("symbol_id").agg(F.min_by("doc", F.struct("place", "doc_name", "doc")).alias("doc"))
    text = F.coalesce(F.nullif(X.strip(F.substring("doc", 1, size)), F.lit("")), F.substring(F.coalesce(F.nullif("docstring", F.lit("")), F.lit("No documentation")), 1, size))
    return s.join(hit, "symbol_id", "left").select("symbol_id", text.alias("doc"))
