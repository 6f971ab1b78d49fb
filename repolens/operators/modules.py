"""Modules of components: grouping, size rule, recursive splitting, propagation of changes, listing. Trees are kept flat,
a row a module with the array of names on its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import checkpoint

MOST_MEMBERS, MOST_TOKENS, DEPTH = 8, 12_000, 3


def by_directory(comps: DataFrame) -> DataFrame:
    """(project_id, module, members): components by parent directory, files at the root by their stem."""
    parts = F.split("file_path", "/")
    name = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.regexp_replace("file_path", r"\.[^.]*$", ""))
    return comps.select("project_id", name.alias("module"), "component_id").distinct().groupBy("project_id", "module").agg(F.count("*").alias("members"))


def too_large(members: DataFrame, most: int = MOST_MEMBERS, tokens: int = MOST_TOKENS) -> DataFrame:
    """members(module..., source) -> modules with members, tokens (characters / 4) and whether they must be split."""
    keys = [c for c in members.columns if c not in ("component_id", "source")]
    size = members.groupBy(*keys).agg(F.count("*").alias("members"), F.floor(F.sum(F.length(F.coalesce("source", F.lit("")))) / 4).alias("tokens"))
    return size.withColumn("split", (F.col("members") > most) | (F.col("tokens") > tokens))


def valid_members(modules: DataFrame, comps: DataFrame) -> DataFrame:
    """modules(project_id, module, component_id) with the members that exist; modules left empty vanish."""
    return modules.join(comps.select("project_id", "component_id").distinct(), ["project_id", "component_id"], "left_semi")


def cluster(comps: DataFrame, depth: int = DEPTH, most: int = MOST_MEMBERS, tokens: int = MOST_TOKENS) -> DataFrame:
    """comps(project_id, component_id, file_path, source) -> (project_id, path array, component_id): modules are split by the next
    directory of their members as long as they are too large and not deeper than `depth`. A project with two components or
    fewer is one module `root`. All modules of a level are split in one step."""
    few = comps.groupBy("project_id").agg(F.countDistinct("component_id").alias("_n"))
    c = comps.join(few, "project_id").withColumn("_dirs", F.split(X.directory("file_path"), "/"))
    start = F.when((F.col("_n") <= 2) | (X.directory("file_path") == ""), F.array(F.lit("root"))).otherwise(F.slice("_dirs", 1, 1))
    now = checkpoint(c.select("project_id", "component_id", "source", "_dirs", start.alias("path")))
    for level in range(1, depth):
        size = now.groupBy("project_id", "path").agg(F.count("*").alias("m"), F.floor(F.sum(F.length(F.coalesce("source", F.lit("")))) / 4).alias("t"))
        split = size.filter((F.col("m") > most) | (F.col("t") > tokens)).select("project_id", "path", F.lit(True).alias("_s"))
        deeper = F.col("_s") & (F.size("path") == level) & (F.size("_dirs") > level) & (F.col("path")[0] != "root")
        now = checkpoint(
            now.join(split, ["project_id", "path"], "left")
            .select("project_id", "component_id", "source", "_dirs", F.when(F.coalesce(deeper, F.lit(False)), F.slice("_dirs", 1, level + 1)).otherwise(F.col("path")).alias("path"))
        )
    return now.select("project_id", "path", "component_id")


def affected(tree: DataFrame, members: DataFrame, comps: DataFrame, changed: DataFrame) -> DataFrame:
    """Modules to do again after files changed: those with a component in a changed file and all modules above them.

    tree(project_id, module, path array), members(project_id, module, component_id), comps(project_id, component_id, file_path),
    changed(project_id, file_path). With the path stored in the row, no recursion is needed.
    """
    hit = comps.join(changed.select("project_id", F.ltrim(F.col("file_path"), F.lit("./")).alias("file_path")).distinct(), ["project_id", "file_path"], "left_semi")
    direct = members.join(hit.select("project_id", "component_id").distinct(), ["project_id", "component_id"], "left_semi").select("project_id", "module").distinct()
    return tree.join(direct, ["project_id", "module"], "left_semi").select("project_id", F.explode("path").alias("module")).distinct()


def reused(tree: DataFrame, again: DataFrame) -> DataFrame:
    return tree.join(again, ["project_id", "module"], "left_anti")


def with_docs(modules: DataFrame, docs: DataFrame) -> DataFrame:
    """modules(project_id, module) with has_doc: is there a document of that module?"""
    have = docs.select("project_id", "module").distinct().withColumn("has_doc", F.lit(True))
    return modules.join(have, ["project_id", "module"], "left").withColumn("has_doc", F.coalesce("has_doc", F.lit(False)))


def order(tree: DataFrame) -> DataFrame:
    """Modules with their place in leaf-first order: deeper ones first, by name."""
    return tree.withColumn("place", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc(F.size("path")), F.array_join("path", "/"))))


def listing(tree: DataFrame) -> DataFrame:
    """(project_id, listing): the tree as indented lines."""
    line = F.struct(F.array_join("path", "/").alias("k"), F.concat(F.repeat(F.lit("  "), F.size("path") - 1), F.element_at("path", -1)).alias("l"))
    return tree.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(line)), lambda x: x["l"]), "\n").alias("listing"))


def flowchart(parent: Column, children: Column) -> Column:
    """Text of a starter diagram of a module and its children; ids keep letters, digits and underscores."""
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    arrows = F.transform(children, lambda c: F.concat(F.lit("    "), clean(parent), F.lit(" --> "), clean(c), F.lit('["'), c, F.lit('"]')))
    return F.concat(F.lit("graph TD\n    "), clean(parent), F.lit('["'), parent, F.lit('"]\n'), F.array_join(arrows, "\n"))
