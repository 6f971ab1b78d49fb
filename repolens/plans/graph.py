"""Iterative graph plans: components, levels, strongly connected components. Rounds are cut by checkpoints."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """edges(src, dst), taken as undirected -> (node, component), component being the smallest node reached.

    Alternates the large-star and small-star steps, which end in a number of rounds logarithmic in the longest chain.
    Each round first takes the minimum a node sees as a partial aggregate; the join that follows leaves a hub's edges to adaptive
    skew handling. A round that changes neither the number of edges nor the sum of their hashes is the last. Null ends
    and loops are ignored; an empty input gives an empty result. With `rounds`, an error if these aren't enough.
    """
    e = checkpoint(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    nodes = e.select("u").union(e.select("v")).distinct()
    before = _sum(e, "u", "v")
    for k in count():
        if k == rounds:
            raise RuntimeError(f"components aren't settled after {rounds} rounds")
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        new = checkpoint(small.select("p.u", "p.v").filter("u <> v").distinct())
        now = _sum(new, "u", "v")
        if now == before:
            break
        e, before = new, now
    star = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(star, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))


def _sum(df: DataFrame, *cols: str) -> tuple:
    """Number of rows and a sum of their hashes: equal for equal sets of rows, found without an exchange of them."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first())


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def leaves_and_roots(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that depend on nothing, nodes nothing depends on; an edge says that src depends on dst. Loops don't count."""
    e = _edges(edges)
    n = nodes.select("node").distinct()
    return n.join(e.select(F.col("src").alias("node")), "node", "left_anti"), n.join(e.select(F.col("dst").alias("node")), "node", "left_anti")


def neighbours(edges: DataFrame, start: DataFrame, hops: int = 1, forward: bool = True) -> DataFrame:
    """start(node) -> (start, node, distance) reached in at most `hops` steps along the edges, or against them.

    Semi-naive: each round joins only what the last one found new.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    e = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).filter("_a IS NOT NULL AND _b IS NOT NULL").distinct()
    new = start.select(F.col("node").alias("start"), "node").distinct().withColumn("distance", F.lit(0))
    found = new
    for k in range(1, hops + 1):
        step = new.join(e, F.col("node") == F.col("_a")).select("start", F.col("_b").alias("node")).distinct()
        new = checkpoint(step.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(k)))
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found.filter("distance > 0")


def _trim(e: DataFrame) -> DataFrame:
    """Edges whose ends both have edges in and out, again and again: what is left holds every cycle."""
    while True:
        kept = checkpoint(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if kept.count() == e.count():
            return kept
        e = kept


def strong_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of strongly connected components with more than one node; component is the smallest node of each.

    Forward-backward colouring: edges outside cycles are trimmed; every node takes the smallest node that reaches it; what
    reaches that node within its colour is a component; the rest goes on without it, until no edge is left (each round
    settles a node at least). Loops aren't components. With `rounds`, an error if edges are left after so many.
    """
    e = _trim(checkpoint(_edges(edges)))
    out: DataFrame | None = None
    for k in count():
        if e.isEmpty():
            break
        if k == rounds:
            raise RuntimeError(f"edges are left after {rounds} rounds")
        colour = checkpoint(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("c", F.col("node")))
        before = _sum(colour, "node", "c")
        while True:
            came = e.join(colour, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "c").groupBy("node").agg(F.min("c").alias("m"))
            new = checkpoint(colour.join(came, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c")))
            now = _sum(new, "node", "c")
            colour = new
            if now == before:
                break
            before = now
        inside = checkpoint(
            e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        )
        reach = checkpoint(colour.filter("node = c"))
        frontier = reach
        while not frontier.isEmpty():
            back = inside.join(frontier.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            frontier = checkpoint(back.join(reach, ["node", "c"], "left_anti"))
            reach = reach.unionByName(frontier)
        reach = checkpoint(reach)
        sizes = reach.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1")
        part = reach.join(sizes.select("c"), "c", "left_semi").select("node", F.col("c").alias("component"))
        out = part if out is None else out.unionByName(part)
        done = reach.select("node")
        e = _trim(checkpoint(inside.select("src", "dst").join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")))
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    return out if out is not None else spark.createDataFrame([], f"node {kind}, component {kind}")


def break_cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): within a strongly connected component every edge to the same or a larger node is removed, so what is
    kept has no cycle. Deterministic; may remove more than the least number."""
    comp = strong_components(edges)
    e = _edges(edges)
    inside = (
        e.join(comp.select(F.col("node").alias("src"), F.col("component").alias("cs")), "src").join(comp.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst")
        .filter("cs = cd AND dst >= src").select("src", "dst")
    )
    removed = checkpoint(inside)
    return e.join(removed, ["src", "dst"], "left_anti"), removed


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level), dependencies first: 0 for nodes that depend on nothing, else one more than the highest dependency.

    Cycles are broken first. Nodes are peeled level by level; each round drops the edges to nodes already placed, so the
    rounds get smaller, and their number is the longest chain.
    """
    kept, _ = break_cycles(edges)
    e = checkpoint(kept)
    open_nodes = checkpoint(nodes.select("node").union(e.select(F.col("src").alias("node"))).union(e.select(F.col("dst").alias("node"))).distinct())
    out, level = None, 0
    while True:
        ready = checkpoint(open_nodes.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
        if ready.isEmpty():
            if not open_nodes.isEmpty():
                raise RuntimeError("nodes are left that depend on each other")
            break
        part = ready.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
        open_nodes = checkpoint(open_nodes.join(ready, "node", "left_anti"))
        e = checkpoint(e.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        level += 1
    return out if out is not None else nodes.select("node").limit(0).withColumn("level", F.lit(0))
