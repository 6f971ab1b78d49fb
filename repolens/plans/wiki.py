"""Wiki documents of module trees: inputs are assembled relationally, texts come from a pluggable generator.

A generator maps (kind, name, input text) to a text; the default writes an outline from the input. Documents are made level
by level, leaves first, so that a module's input holds the documents of its children.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.batches import map_rows
from ..operators import modules as M
from ..operators.chunking import diagram_problems, diagrams
from ..operators.collections import top_per_group
from ..session import checkpoint

Generator = Callable[[str, str, str], str]
DOCS = "project_id string, module string, depth int, content string, members int"
#: Caps of what goes into a document's input: members shown, characters of each member, of a child's document, of all.
MEMBERS, SOURCE, CHILD, INPUT = 30, 2000, 1500, 24_000


def outline(kind: str, name: str, text: str) -> str:
    """The default generator: a heading and the names in the input."""
    lines = [x[3:] for x in text.split("\n") if x.startswith("## ")]
    return f"# {name}\n\nThis {kind} has {len(lines)} parts.\n\n" + "\n".join(f"- {x}" for x in lines)


def with_parents(tree: DataFrame) -> DataFrame:
    """tree(project_id, path, component_id) -> (project_id, module, path, depth) of its modules and of all modules above them."""
    up = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))
    return tree.select("project_id", F.explode(up).alias("path")).distinct().select("project_id", F.array_join("path", "/").alias("module"), "path", F.size("path").alias("depth"))


def generate(tree: DataFrame, comps: DataFrame, generator: Generator = outline, keep: DataFrame | None = None) -> DataFrame:
    """Documents (project_id, module, depth, content, members) of all modules of tree(project_id, path, component_id), whose members'
    sources are in comps(project_id, component_id, name, source). Modules in keep(project_id, module, content) are taken over."""
    modules = checkpoint(with_parents(tree))
    members = tree.select("project_id", F.array_join("path", "/").alias("module"), "component_id").join(comps, ["project_id", "component_id"])
    counts = members.groupBy("project_id", "module").agg(F.count("*").alias("members"))
    shown = top_per_group(members, ["project_id", "module"], MEMBERS, F.asc("name"), F.asc("component_id"))
    block = F.concat(F.lit("## "), "name", F.lit("\n"), X.cut(F.coalesce("source", F.lit("")), SOURCE))
    own = shown.groupBy("project_id", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n").alias("own"))
    todo = modules.join(own, ["project_id", "module"], "left").join(counts, ["project_id", "module"], "left").withColumn("members", F.coalesce("members", F.lit(0)).cast("int"))
    if keep is not None:
        kept = todo.join(keep.select("project_id", "module", "content"), ["project_id", "module"]).select("project_id", "module", "depth", "content", "members")
        todo = todo.join(keep.select("project_id", "module"), ["project_id", "module"], "left_anti")
        docs = checkpoint(kept)
    else:
        docs = modules.sparkSession.createDataFrame([], DOCS)
    todo = checkpoint(todo)
    deepest = modules.agg(F.max("depth")).first()[0] or 0

    def write(project, module, depth, n, text):
        kind = "module" if depth > 1 else "subsystem"
        yield project, module, depth, generator(kind, module, text), n

    for depth in range(deepest, 0, -1):
        now = todo.filter(F.col("depth") == depth)
        child = docs.filter(F.col("depth") == depth + 1).select("project_id", F.regexp_replace("module", r"/[^/]*$", "").alias("module"), F.struct(F.col("module").alias("m"), F.substring("content", 1, CHILD).alias("c")).alias("d"))
        below = child.groupBy("project_id", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda d: F.concat(F.lit("## "), d["m"], F.lit("\n"), d["c"])), "\n").alias("below"))
        text = F.concat_ws("\n", F.col("own"), F.col("below"))
        made = map_rows(now.join(below, ["project_id", "module"], "left").select("project_id", "module", "depth", "members", F.substring(text, 1, INPUT).alias("text")), write, DOCS)
        docs = checkpoint(docs.unionByName(made))
    return docs


def regenerate(tree: DataFrame, comps: DataFrame, stored: DataFrame | None, changed: DataFrame, generator: Generator = outline) -> DataFrame:
    """Documents after files changed(project_id, file_path): modules with a changed member and those above them are written
    anew, all others taken from the stored documents. Without stored documents everything is written."""
    if stored is None or stored.isEmpty():
        return generate(tree, comps, generator)
    flat = with_parents(tree).select("project_id", "module", "path")
    named = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.array_join(F.slice("path", F.lit(1), i), "/"))
    members = tree.select("project_id", F.array_join("path", "/").alias("module"), "component_id")
    again = M.affected(flat.withColumn("path", named), members, comps.select("project_id", "component_id", "file_path"), changed)
    return generate(tree, comps, generator, keep=M.reused(stored, again))


def overview(docs: DataFrame, generator: Generator = outline) -> DataFrame:
    """(project_id, content): a document a project from the starts of its top-level documents."""
    top = docs.filter("depth = 1").select("project_id", F.struct("module", F.substring("content", 1, CHILD).alias("c")).alias("d"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda d: F.concat(F.lit("## "), d["module"], F.lit("\n"), d["c"])), "\n")
    return map_rows(top.groupBy("project_id").agg(F.substring(text, 1, INPUT).alias("t")), lambda p, t: [(p, generator("overview", p, t))], "project_id string, content string")


def checked(docs: DataFrame) -> DataFrame:
    """Documents with numbers of their diagrams and of problems in them; those too short to say anything (under 20 characters) are left out."""
    d = docs.filter(F.length(X.strip("content")) >= 20).withColumn("_d", diagrams(F.col("content")))
    problems = F.aggregate(F.transform("_d", lambda s: F.size(diagram_problems(s))), F.lit(0), lambda a, n: a + n)
    return d.withColumn("diagrams", F.size("_d")).withColumn("diagram_problems", problems).drop("_d")


def refine(docs: DataFrame, review: Callable[[str], tuple[float, bool]], improve: Callable[[str], str], rounds: int = 2) -> DataFrame:
    """(project_id, module, content, score, passed): documents that fail the review are improved and reviewed again, a few rounds;
    only those that still fail go on."""

    def judge(p, m, c):
        score, passed = review(c)
        yield p, m, c, float(score), bool(passed)

    def better(p, m, c):
        yield from judge(p, m, improve(c))

    schema = "project_id string, module string, content string, score double, passed boolean"
    state = checkpoint(map_rows(docs.select("project_id", "module", "content"), judge, schema))
    for _ in range(rounds):
        failing = state.filter("NOT passed")
        if failing.isEmpty():
            break
        state = checkpoint(state.filter("passed").unionByName(map_rows(failing.select("project_id", "module", "content"), better, schema)))
    return state


def reviews(answers: DataFrame) -> DataFrame:
    """answers(doc, answer) -> (doc, overall, passed, issues): the tagged JSON of a reviewer; one that can't be read scores 0 with one issue."""
    from ..operators.chunking import tagged_json
    from ..operators.metrics import review_passed

    kind = "struct<overall:double,passed:boolean,scores:map<string,double>,issues:array<string>>"
    r = F.from_json(tagged_json(F.col("answer"), "review", "json"), kind)
    readable = r["overall"].isNotNull()
    return answers.select(
        "doc", F.when(readable, r["overall"]).otherwise(0.0).alias("overall"),
        (readable & review_passed(F.coalesce(r["scores"], F.create_map().cast("map<string,double>")), r["overall"], r["passed"])).alias("passed"),
        F.when(readable, F.coalesce(F.size(F.coalesce(r["issues"], F.array().cast("array<string>"))), F.lit(0))).otherwise(1).alias("issues"),
    )


# Callees whose documents go into a symbol's input, characters of each.
CALLEES, CALLEE = 5, 200


def symbol_documents(nodes: DataFrame, edges: DataFrame, generator: Generator = outline) -> DataFrame:
    """nodes(node, source), edges(src, dst) -> (node, level, content): a document a symbol, callees before callers, so that a symbol's input holds
    the starts of the documents of its first callees. All symbols of a level are one step; their number is the longest chain."""
    from . import graph as G

    level = checkpoint(G.topological_levels(nodes.select("node"), edges).join(nodes.select("node", "source"), "node"))
    kept = checkpoint(G.break_cycles(edges)[0])
    docs = nodes.sparkSession.createDataFrame([], f"node {dict(nodes.dtypes)['node']}, level int, content string")

    def write(node, n, text):
        yield node, n, generator("function", str(node), text or "")

    for n in range((level.agg(F.max("level")).first()[0] or 0) + 1):
        now = level.filter(F.col("level") == n)
        below = kept.join(now.select(F.col("node").alias("src")), "src", "left_semi").join(docs.select(F.col("node").alias("dst"), "content"), "dst")
        first = top_per_group(below, ["src"], CALLEES, F.asc("dst")).groupBy(F.col("src").alias("node")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("## "), F.col("dst").cast("string"), F.lit("\n"), F.substring("content", 1, CALLEE)).alias("b")))), lambda x: x["b"]), "\n").alias("callees")
        )
        text = F.concat_ws("\n", F.substring(F.coalesce("source", F.lit("")), 1, SOURCE), F.col("callees"))
        docs = checkpoint(docs.unionByName(map_rows(now.join(first, "node", "left").select("node", "level", text.alias("t")), write, docs.schema)))
    return docs
