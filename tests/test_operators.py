"""Worked cases and brute force for operators that tables alone don't cover."""

import hashlib
import hmac
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolens.functions import scorers
from repolens.functions import text as X
from repolens.operators import chunking as T
from repolens.operators import collections as K
from repolens.operators import metrics as A
from repolens.operators import modules as M
from repolens.operators import search as V
from repolens.operators import symbols as S
from repolens.plans import graph as G
from repolens.sources import files as FS
from repolens.streaming import events as R


def test_fusion_of_overlapping_arms(spark):
    dense = spark.createDataFrame([("d1", 1), ("d2", 2), ("d3", 3)], "id string, rank int")
    text = spark.createDataFrame([("d3", 1), ("d4", 2)], "id string, rank int")
    rows = V.fuse(dense, text, "id", 10).orderBy("rank").collect()
    assert [r.id for r in rows] == ["d3", "d1", "d2", "d4"]
    assert [round(r.score, 6) for r in rows] == [0.032266, 0.016393, 0.016129, 0.016129]
    assert [r.id for r in V.fuse(dense, text.limit(0), "id", 2).orderBy("rank").collect()] == ["d1", "d2"]


def test_diversity_and_rerank(spark):
    rows = [(f"c{i}", "A" if i < 4 else "B", float(10 - i), i + 1, "x") for i in range(6)]
    hits = spark.createDataFrame(rows, "chunk_id string, file_path string, score double, rank int, content string")
    out = V.diverse(hits, 4).orderBy("rank").collect()
    assert [(r.chunk_id, r["rank"]) for r in out] == [("c0", 1), ("c1", 2), ("c4", 3), ("c5", 4)]
    scores = {"c0": 0.1, "c1": 0.9, "c2": 0.5, "c3": 0.3, "c4": 0.8, "c5": 0.0}
    by_id = hits.withColumn("content", F.col("chunk_id"))
    top = V.rerank(by_id, "q", 3, scorers.pair_scorer(lambda q, c: scores[c])).orderBy("rank").collect()
    assert [round(r.score, 1) for r in top] == [0.9, 0.8, 0.5]

    def broken(q, c):
        raise ValueError

    assert [r.chunk_id for r in V.rerank(hits, "q", 2, broken).orderBy("rank").collect()] == ["c0", "c1"]


def test_entity_prefers_exact_over_rank(spark):
    hits = spark.createDataFrame([("a", "loadAll", None, 1), ("b", "load", None, 2)], "chunk_id string, symbol_name string, qualified_name string, rank int")
    assert V.find_entity(hits, "src/x.py:Box.load").first().chunk_id == "b"
    assert V.find_entity(hits, "ALL").first().chunk_id == "a"
    assert V.find_entity(hits, "none").count() == 0


def test_evidence_and_context(spark):
    lists = spark.createDataFrame([("a", 0.5, "x"), (None, 0.1, "y")], "chunk_id string, score double, content string")
    entity = spark.createDataFrame([(True, "e", "z" * 900), (False, "f", "")], "found boolean, chunk_id string, content string")
    graph = spark.createDataFrame([("n", ["p"], []), ("m", [], [])], "node string, callers array<string>, callees array<string>")
    rows = {r.chunk_id: r for r in V.evidence(lists, entity, graph).collect()}
    assert set(rows) == {"a", "e", "graph:n"} and len(rows["e"].content) == 500 and rows["graph:n"].score == 0.8


def test_percentiles_and_ranking(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", float(i)) for i in range(1, 101)] + [("c", 7.0)], "g string, v double")
    got = {r.g: (r.p50, r.p95, r.p99) for r in A.percentile(df, ["g"], "v", 50, 95, 99).collect()}
    assert got == {"a": (6, 10, 10), "b": (51, 96, 100), "c": (7, 7, 7)}
    cases = [("x", [0, 0, 1, 1]), ("y", [0, 1, 0, 1, 0]), ("z", [1, 0, 0])]
    hits = spark.createDataFrame([(q, i + 1, bool(r)) for q, rs in cases for i, r in enumerate(rs)], "query_id string, rank int, rel boolean")
    m = {r.query_id: r for r in A.ranking(hits).collect()}
    assert round(m["x"].mrr, 6) == 0.333333 and round(m["y"].ndcg_5, 6) == 0.650921 and m["z"].ndcg_5 == 1.0
    assert spark.range(1).select(*[X.confidence(F.lit(float(v))).alias(f"c{i}") for i, v in enumerate((-30, -10, 0, 5, 10, 30))]).first() == (0, 0, 0.5, 0.75, 1, 1)


def test_identity_and_signature(spark):
    p, f, s, c = (F.lit(x) for x in "pfsc")
    row = spark.range(1).select(X.chunk_id(p, f, s, c).alias("i"), X.point_id(X.chunk_id(p, f, s, c)).alias("u"), X.hmac_sha256("k", F.lit("payload ü")).alias("h")).first()
    assert row.i == "0533fa28ed3d21c8ff04ef82a66a6aa9eeebafa487e00bfe355ee8fc96ee3128" and row.u == "0533fa28-ed3d-21c8-ff04-ef82a66a6aa9"
    assert row.h == hmac.new(b"k", "payload ü".encode(), hashlib.sha256).hexdigest()


def test_sections_and_chunks(spark):
    text = "# A\n" + "x" * 60 + "\n### B\nshort\n## C\n" + "\n\n".join("w" * 1500 for _ in range(4))
    docs = spark.createDataFrame([(1, text), (2, "no heading, only a text that is long enough to be kept as a section"), (3, None), (4, "")], "id int, text string")
    rows = T.sections(docs, "id", "text").orderBy("id", "section_no").collect()
    assert [(r.id, r.heading, r.section_path) for r in rows] == [(1, "A", "A"), (1, "B", "A / B"), (1, "C", "A / C"), (2, "", "")]
    chunks = T.section_chunks(docs, "id", "text", F.lit("application_docs")).orderBy("id", "chunk_index").collect()
    assert [(c.id, c.chunk_index) for c in chunks] == [(1, 0), (1, 200), (1, 201), (2, 0)]
    assert all(len(c.content) <= 4000 for c in chunks)


def test_windows(spark):
    f = spark.createDataFrame([(1, "\n".join(str(i) for i in range(120))), (2, ""), (3, None), (4, "one\n")], "id int, content string")
    assert [(r.id, r["name"], r.start_line, r.end_line) for r in T.windows(f).orderBy("id", "start_line").collect()] == [
        (1, "chunk_0", 1, 50), (1, "chunk_1", 51, 100), (1, "chunk_2", 101, 120), (4, "chunk_0", 1, 1),
    ]


def test_imports(spark):
    files = [
        ("a.py", "python", "from x.y import b as c, d\nimport os.path as p\nimport sys, re\nfrom z import *\n"),
        ("b.ts", "typescript", 'import { f, g as h } from "./m";\nimport K from "k";\n'),
        ("C.java", "java", "import static a.b.C;\nimport a.d.*;\n"),
        ("d.cs", "c_sharp", "using System.Linq;\n"),
        ("e.go", "go", 'import (\n "fmt"\n "a/b"\n)\n'),
        ("f.c", "c", None),
    ]
    df = spark.createDataFrame([("p", *f) for f in files], "project_id string, file_path string, language string, content string")
    got = {(r.imported_name, r.qualified_name, r.is_wildcard) for r in T.import_entries(df).collect()}
    assert got == {
        ("c", "x.y.b", False), ("d", "x.y.d", False), ("p", "os.path", False), ("sys", "sys", False), ("re", "re", False), ("*", "z.*", True), ("f", "./m.f", False), ("h", "./m.g", False),
        ("K", "k.default", False), ("C", "a.b.C", False), ("*", "a.d.*", True), ("Linq", "System.Linq", False), ("fmt", "fmt", False), ("b", "a/b", False),
    }


def test_diagrams(spark):
    rows = [("graph TD\n a-->b",), ("nonsense x",), ("%% only\n",), ("  ",), ("flowchart LR\n ((((",)]
    out = [r.p for r in spark.createDataFrame(rows, "s string").select(T.diagram_problems(F.col("s")).alias("p")).collect()]
    assert out[0] == [] and "Unknown" in out[1][0] and "comments" in out[2][0] and out[3] == ["Empty diagram"] and "Unclosed" in out[4][0]
    text = "a\n```mermaid\ngraph TD\n```\nb\n```mermaid\npie\n```"
    assert spark.range(1).select(F.size(T.diagrams(F.lit(text)))).first()[0] == 2
    answer = 'x <plan>{bad</plan> <json>{"a": 1}</json>'
    assert spark.range(1).select(T.tagged_json(F.lit(answer), "plan", "json")).first()[0] == '{"a": 1}'


def test_symbols_in_ten_languages(spark):
    texts = {
        "a.py": "class A:\n    def m(self, x):\n        '''doc'''\n        return f(x)\n\ndef g(y):\n    return A().m(y)\n",
        "a.js": "class A {\n  m(x) {\n    return f(x);\n  }\n}\nfunction g(y) {\n  return new A().m(y);\n}\n",
        "a.ts": "class A {\n  m(x: number): number {\n    return f(x);\n  }\n}\nexport function g(y: A): number {\n  return y.m(1);\n}\n",
        "A.java": "class A {\n  public int m(int x) {\n    return f(x);\n  }\n}\n",
        "a.go": "package a\n\ntype A struct {\n}\n\nfunc (s *A) m(x int) int {\n\treturn f(x)\n}\n\nfunc g(y int) int {\n\treturn y\n}\n",
        "a.c": "int g(int y) {\n  return f(y);\n}\n",
        "a.cpp": "class A {\npublic:\n  int m(int x) {\n    return f(x);\n  }\n};\nint g(int y) {\n  return y;\n}\n",
        "A.cs": "class A {\n  public long M(long x) {\n    return F(x);\n  }\n}\n",
        "a.kt": "class A {\n  fun m(x: Int): Int {\n    return f(x)\n  }\n}\nfun g(y: Int): Int {\n  return y\n}\n",
        "a.php": "<?php\nclass A {\n  public function m($x) {\n    return f($x);\n  }\n}\nfunction g($y) {\n  return $y;\n}\n",
    }
    df = spark.createDataFrame([("p", n, None, t) for n, t in texts.items()] + [("p", "x.py", None, None), ("p", "y.txt", None, "z")], "project_id string, file_path string, language string, content string")
    got = {}
    for r in S.extract(df).collect():
        got.setdefault(r.file_path, set()).add((r.qualified_name, r.symbol_type))
    for n in texts:
        assert ("A", "class") in got[n] or n == "a.c"
        assert any(q.lower() == "a.m" and t == "method" for q, t in got[n]) or n in ("a.c", "a.go")
        assert ("g", "function") in got[n] or n in ("A.java", "A.cs")


def reach(edges):
    nodes = {x for e in edges for x in e}
    out = {n: set() for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in out[n]:
                    out[n].add(b)
                    todo.insert(0, b)
            todo.pop()
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randrange(12), rng.randrange(12)) for _ in range(16)}) + [(20, 20)]
    df = spark.createDataFrame(edges, "src int, dst int")
    r = reach([e for e in edges if e[0] != e[1]])
    want = {n: min(m for m in r[n] if n in r.get(m, ())) for n in r if n in r[n]}
    assert {x.node: x.component for x in G.strong_components(df).collect()} == want
    both = reach([e for a, b in edges if a != b for e in ((a, b), (b, a))])
    assert {x.node: x.component for x in G.connected_components(df).collect()} == {n: min(both[n] | {n}) for n in both}
    kept, removed = G.break_cycles(df)
    k = [(x.src, x.dst) for x in kept.collect()]
    assert not any(n in s for n, s in reach(k).items()) and len(k) + removed.count() == len({e for e in edges if e[0] != e[1]})
    level = {x.node: x.level for x in G.topological_levels(df.select(F.col("src").alias("node")), df).collect()}
    assert all(level[a] > level[b] for a, b in k) and set(level) == {x for e in edges for x in e}
    hops = {(x.start, x.node) for x in G.neighbours(df, spark.createDataFrame([(n,) for n in range(12)], "node int"), 2).filter("distance = 1").collect()}
    assert hops == {(a, b) for a, b in edges if a != b and a < 12}


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src string, dst string")
    assert G.connected_components(e).count() == G.strong_components(e).count() == 0


def test_chain_listed_backwards(spark):
    df = spark.createDataFrame([(i, i + 1) for i in reversed(range(12))], "src int, dst int")
    assert {r.node: r.component for r in G.connected_components(df).collect()} == dict.fromkeys(range(13), 0)


def test_collections(spark):
    old = spark.createDataFrame([("a", "p", "f", 1), ("b", "p", "g", 1)], "chunk_id string, project_id string, file_path string, v int")
    new = spark.createDataFrame([("a", "p", "f", 3), ("a", "p", "f", 2), ("c", "p", "h", 1)], old.schema)
    assert {(r.chunk_id, r.v) for r in K.upsert(old, new, ["chunk_id"], F.col("v")).collect()} == {("a", 3), ("b", 1), ("c", 1)}
    texts = spark.createDataFrame([("h1", "x"), ("h2", "y"), ("h2", "y")], "content_hash string, content string")
    cache = scorers.embed(texts.filter("content_hash = 'h1'"))
    hits, misses = K.cache_split(texts, cache)
    assert hits.count() == 1 and misses.count() == 1 and scorers.embed(texts, cache).count() == 2
    points = old.select("chunk_id", "file_path")
    with pytest.raises(ValueError):
        K.check_vectors(points, spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<double>"))


def test_snapshot(spark, tmp_path):
    schema = "chunk_id string, file_path string, v int, project_id string"
    s = FS.Snapshot(spark, str(tmp_path / "points"))
    assert not s.populated()
    s.create(schema)
    s.create(schema)
    row = lambda *r: spark.createDataFrame([r], schema)
    s.upsert(row("a", "f", 1, "p/x").union(row("b", "g", 1, "q")), F.col("v"))
    s.upsert(row("a", "f", 2, "p/x"), F.col("v"))
    assert {(r.chunk_id, r.v, r.project_id) for r in s.read().collect()} == {("a", 2, "p/x"), ("b", 1, "q")}
    s.replace_files(spark.createDataFrame([("p/x", "f")], "project_id string, file_path string"), row("c", "f", 9, "p/x"))
    assert {r.chunk_id for r in s.read().collect()} == {"b", "c"}
    s.delete_files(spark.createDataFrame([("p/x", "f")], "project_id string, file_path string"))
    assert {r.chunk_id for r in s.read().collect()} == {"b"} and s.populated()


def test_walk_and_markdown(spark, tmp_path):
    for name, text in {"src/a.py": b"x = 1\n", "src/\xc3\xa4.js".encode().decode(): b"\xff ok", "node_modules/b.py": b"y", ".git/c.py": b"z", "d.txt": b"t", "big.py": b"#" * ((1 << 20) + 1)}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text)
    rows = {r.file_path: r for r in FS.walk(spark, str(tmp_path), "p").collect()}
    assert "src/a.py" in rows and rows["src/a.py"].language == "python" and not {"node_modules/b.py", ".git/c.py", "d.txt", "big.py"} & set(rows)
    (tmp_path / "m.md").write_text("# T\ntext")
    assert FS.markdown(spark, str(tmp_path / "m.md")).count() == 1
    assert FS.markdown(spark, str(tmp_path / "none.md"), required=False).count() == 0
    with pytest.raises(FileNotFoundError):
        FS.markdown(spark, str(tmp_path / "none.md")).count()
    assert FS.manifest(spark, str(tmp_path / "none.json")).count() == 0
    assert FS.module_tree(spark, "{broken", "p").count() == 0
    tree = '{"core": {"components": ["a"], "children": {"io": {"components": ["b"]}}}}'
    assert {(r.module, tuple(r.path)) for r in FS.module_tree(spark, tree, "p").collect()} == {("core", ("core",)), ("io", ("core", "io"))}


def test_exported_issues_leave_out_merge_requests(spark, tmp_path):
    p = tmp_path / "issues.json"
    p.write_text('{"number": 1, "title": "a", "user": {"login": "u"}, "body": "b"}\n\n{"number": 2, "title": "m", "pull_request": {"url": "x"}}\n')
    spark.dataSource.register(FS.ExportedEvents)
    rows = spark.read.format("scm_export").option("kind", "issues").load(str(p)).collect()
    assert [(r.number, r.author, r.description) for r in rows] == [(1, "u", "b")]


def test_stream_keeps_collection_as_a_batch_would(spark, tmp_path):
    src = tmp_path / "in"
    commits = "array<struct<added:array<string>,modified:array<string>,removed:array<string>>>"
    schema = R.PUSH
    rows = [
        ("1", "push", "refs/heads/main", "s1", "p", "2024-01-01 00:00:00", [(["a.py", "n.txt"], None, None)]),
        ("2", "push", "refs/heads/main", "s2", "p", "2024-01-01 00:01:00", [([], ["b.py"], ["a.py"])]),
        ("2", "push", "refs/heads/main", "s2", "p", "2024-01-01 00:01:00", [([], ["b.py"], ["a.py"])]),
        ("3", "push", "refs/heads/main", "s3", "p", "2024-01-01 00:02:00", []),
    ]
    raw = spark.createDataFrame(rows, f"event_id string, kind string, ref string, after string, project string, at string, commits {commits}")
    raw.withColumn("at", F.to_timestamp("at")).write.parquet(str(src))
    seen = {}

    def apply(plan, n):
        for r in plan.collect():
            seen[r.file_path] = r.change

    q = R.maintain(spark.readStream.schema(schema).parquet(str(src)), apply, str(tmp_path / "check"))
    q.awaitTermination(60)
    assert seen == {"a.py": "removed", "b.py": "changed"}
    assert [r.r for r in spark.createDataFrame([("Push Hook",), ("pull_request",), ("issues",), ("ping",), (None,)], "k string").select(R.route(F.col("k")).alias("r")).collect()] == ["push", "merge_request", "issue", "ping", "ignored"]


def test_scorers(spark):
    def bad(p):
        raise RuntimeError("down")

    assert scorers.first_success("x", [("a", bad), ("b", lambda p: "[error] soft"), ("c", lambda p: "fine")]).provider == "c"
    assert scorers.first_success("x", [("a", bad)]).content.startswith("[error]")
    tries = spark.createDataFrame([("q", 1, "a", "[error] x"), ("q", 2, "b", "ok"), ("r", 1, "a", None)], "id string, attempt int, provider string, content string")
    assert {r.id: r.content for r in scorers.first_attempt(tries, "id").collect()} == {"q": "ok", "r": None}
    v = spark.range(1).select(scorers.mean_pool(F.array(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0))), F.array(F.lit(1.0), F.lit(1.0))).alias("v")).first().v
    assert [round(x, 3) for x in v] == [0.6, 0.8]


def test_dense_search_with_ties_and_nulls(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None)], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id int, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in V.dense(v, q, 2).orderBy("rank").collect()] == [(9, 1), (9, 3)]
    assert V.dense(v, q.filter("query_id = 8"), 2).count() == 0


def test_module_rules(spark):
    m = spark.createDataFrame([("p", "m", str(i), "x" * n) for i, n in enumerate([6000] * 7 + [6003])] + [("p", "n", str(i), "") for i in range(9)], "project_id string, module string, component_id string, source string")
    got = {r.module: (r.members, r.tokens, r.split) for r in M.too_large(m).collect()}
    assert got == {"m": (8, 12000, False), "n": (9, 0, True)}
    text = spark.range(1).select(M.flowchart(F.lit("my mod"), F.array(F.lit("a-b"))).alias("t")).first().t
    assert text == 'graph TD\n    my_mod["my mod"]\n    my_mod --> a_b["a-b"]'


def test_package_has_no_back_reference():
    import repolens
    from pathlib import Path

    root = Path(repolens.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "repolens.llm" not in p.read_text() and "from .llm" not in p.read_text() and "from ..llm" not in p.read_text()


def test_cycles_are_complete_or_an_error(spark):
    """Cycles in a chain, in ascending order of name: a round settles one."""
    names = "abcd"
    edges = [(f"{c}1", f"{c}2") for c in names] + [(f"{c}2", f"{c}1") for c in names] + [(f"{a}1", f"{b}1") for a, b in zip(names, names[1:], strict=False)]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {tuple(r) for r in G.strong_components(df).collect()}
    assert got == {(f"{c}{i}", f"{c}1") for c in names for i in (1, 2)}
    for few in (lambda: G.strong_components(df, rounds=1), lambda: G.connected_components(df, rounds=1)):
        with pytest.raises(RuntimeError):
            few()


def test_a_model_that_fails_on_executors_changes_nothing(spark):
    hits = spark.createDataFrame([("a", 1.0, 1, "x"), ("b", 0.5, 2, "y")], "chunk_id string, score double, rank int, content string")

    def broken(q, c):
        raise ValueError(c)

    assert [(r.chunk_id, r.score) for r in V.rerank(hits, "q", 2, scorers.pair_scorer(broken)).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.5)]


def test_providers():
    p = scorers.Providers()
    p.register("down", lambda t: scorers.FAILED + " no")
    p.register("up", str.upper)
    assert p.complete("ab c", "down", "up").content == "AB C" and p.complete("ab c", "down", "up").provider == "up"
    assert p.chat([("user", "hi")], "up").content == "USER: HI"
    assert "".join(p.stream("a b c d e f g", "up")) == "A B C D E F G" and "".join(p.stream("x", "down")).startswith(scorers.FAILED)
    assert p.complete("One. Two! Three? Four.").content == "One. Two! Three?"
    with pytest.raises(KeyError):
        p.complete("x", "nobody")


def test_batches_are_tried_again_and_laid_aside():
    calls, dead = [], []

    def apply(df, n):
        calls.append(n)
        if len(calls) < 3:
            raise OSError("busy")

    R.retried(apply, wait=0)(None, 7)
    assert calls == [7, 7, 7]
    fails = lambda df, n: 1 / 0
    R.retried(fails, lambda df, n, why: dead.append((n, why)), wait=0)(None, 8)
    assert dead == [(8, "division by zero")]
    with pytest.raises(ZeroDivisionError):
        R.retried(fails, wait=0)(None, 9)


def test_exports_from_any_file_system(spark, tmp_path):
    lines = ['{"number": 1, "title": "a", "body": "x", "user": {"login": "u"}}', '{"number": 2, "pull_request": {}}', "", '{"number": 3, "title": "c"}']
    (tmp_path / "i.jsonl").write_text("\n".join(lines))
    path = f"file://{tmp_path}/i.jsonl"
    assert [(r.number, r.description, r.author) for r in FS.exported(spark, path).collect()] == [(1, "x", "u"), (3, None, None)]
    assert [r.number for r in FS.exported(spark, path, limit=2).collect()] == [1]  # the limit comes before merge requests are dropped
    (tmp_path / "c.jsonl").write_text('{"number": 1, "body": "x", "system": true}\n{"number": 1, "body": "y"}')
    assert [r.system for r in FS.exported(spark, f"file://{tmp_path}/c.jsonl", "comments").collect()] == [True, False]


def test_postings_and_scans_give_the_same_scores(spark):
    docs = spark.createDataFrame([(1, "Retry the budget, retry"), (2, None), (3, ""), (4, "budget_x budget " + "w" * 50), (5, "retry" * 3)], "doc_id bigint, content string")
    scan = {r.doc_id: round(r.score, 9) for r in V.bm25(docs, ["retry", "BUDGET", "retry"], "doc_id").collect()}
    index = V.postings(docs, "doc_id")
    mean = (4 + 0 + 0 + 2 + 1) / 5
    assert scan == {r.doc_id: round(r.score, 9) for r in V.bm25_postings(index, 5, mean, ["retry", "budget"], "doc_id").collect()} and set(scan) == {1, 4}
    assert V.bm25(docs.limit(0), ["retry"], "doc_id").count() == 0
    with pytest.raises(ValueError):
        V.bm25(docs, ["a b"], "doc_id")


def test_dense_search_in_groups_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, None)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    q = v.filter("vec_id % 7 = 0 AND vec_id < 60").select(F.col("vec_id").alias("query_id"), "embedding")
    want = {(r.query_id, r.vec_id, r["rank"]) for r in V.dense(v, q, 5).collect()}
    assert len(want) == 9 * 5
    monkeypatch.setattr(V, "MOST_QUERIES", 4)
    monkeypatch.setattr(V, "PRODUCT", 8192)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in V.dense(v, q, 5, block=16).collect()} == want


def test_sessions_on_clusters_need_a_named_folder():
    from types import SimpleNamespace

    from repolens import session

    empty = SimpleNamespace(isEmpty=lambda: True)
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getConf=lambda: conf, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)), master="spark://x:7077")
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_the_package_reaches_workers_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"import sys; sys.path.insert(0, {str(root)!r})\nfrom repolens.session import local_session\nfrom repolens.operators import symbols as S\ns = local_session(2)\nd = s.createDataFrame([('p', 'a.py', 'python', 'def f():\\n    pass\\n')], 'project_id string, file_path string, language string, content string')\nprint(S.extract(d).count())\n"
    (tmp_path / "run.py").write_text(code)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("1"), out.stderr[-2000:]
