"""The engine end to end on a small source tree."""

import json

import pytest
from pyspark.sql import functions as F

from repolens.operators import metrics as A
from repolens.plans import wiki as WK
from repolens.plans.engine import Engine

AT = "2024-01-01 00:00:00"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {
        "core/io/reader.py": "def read_file(path):\n    '''Reads a file from disk'''\n    return parse_text(open(path).read())\n",
        "core/io/parser.py": "def parse_text(text):\n    '''Parses the text into words'''\n    return text.split()\n",
        "web/app.js": "function startServer(port) {\n  return readFile(port);\n}\n",
        "node_modules/x.js": "function hidden() {\n}\n",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    assert e.index_repo(str(root), "p", AT) == {"skipped": False, "files": 3, "chunks": 3}
    assert e.index_repo(str(root), "p", AT) == {"skipped": True}
    md = "# P1 PaymentService 2025-03-15: queue timeout\n\n" + "The parser queue timed out because the text was too long to read. " * 2
    docs = spark.createDataFrame([("inc.md", md)], "path string, text string")
    e.index_docs(docs, "incident_reports", "p", AT)
    return e


def test_status_and_search(engine):
    status = {r.collection: r.points for r in engine.collection_status().collect()}
    assert status == {"code_repo": 3, "app_docs": 0, "incident_reports": 1}
    assert engine.search_code("parse text words", 2).orderBy("rank").first().symbol_name == "parse_text"
    assert engine.search_code("parse", 5, language="javascript").count() == 1
    assert engine.search_incidents("queue timeout", severity="p1").count() == 1
    assert engine.search_app_docs("anything").count() == 0
    assert engine.keyword_search(["startserver"], "code").orderBy("rank").first().symbol_name == "startServer"
    assert engine.retrieve_entity("read_file").first().symbol_name == "read_file"
    assert engine.hybrid("unknown", "x").count() == 0
    assert {(r.node, r.direction) for r in engine.traverse_graph("parse_text", "p").collect()} == {("read_file", "callers")}


def test_questions(engine):
    out = engine.query("read file from disk", "p")
    assert out["sources"].orderBy("rank").first().symbol_name == "read_file" and 0 < out["confidence"] <= 1 and "reader.py" in out["context"]
    assert engine.localize("the reading of a file from disk fails", "p").first().collection == "code_repo"
    with pytest.raises(ValueError):
        engine.query("")
    with pytest.raises(ValueError):
        engine.localize("short")


def test_incremental_index(engine, spark):
    files = spark.createDataFrame([("p", "web/app.js", "javascript", 10, "function stopServer(port) {\n  return port;\n}\n")], "project_id string, file_path string, language string, size bigint, content string")
    engine.index_files(files, spark.createDataFrame([], "project_id string, file_path string"), AT)
    names = {r.symbol_name for r in engine.collections["code_repo"].read().collect()}
    assert names == {"read_file", "parse_text", "stopServer"}


def test_wiki(engine, spark):
    docs = engine.wiki_generate("p")
    made = {r.module: r for r in docs.collect()}
    assert "core" in made and all(r.content.startswith("# ") for r in made.values())
    assert {r.module for r in engine.wiki_tree("p").filter("has_doc").collect()} == set(made)
    assert engine.wiki_search("p", "parts").count() == len(made)
    calls = spark.sparkContext.accumulator(0)

    def counted(kind, name, text):
        calls.add(1)
        return f"# {name}\n\nwritten again with new words"

    changed = spark.createDataFrame([("p", "./core/io/parser.py")], "project_id string, file_path string")
    again = {r.module: r.content for r in engine.wiki_generate("p", counted, changed).collect()}
    assert "again" in again["core"] and "again" not in again["web"] and calls.value == sum("again" in c for c in again.values())
    assert [r.project_id for r in engine.wiki_projects().collect()] == ["p"]
    assert WK.overview(docs).count() == 1


def test_review_loop(spark):
    docs = spark.createDataFrame([("p", "a", "x"), ("p", "b", "good text")], "project_id string, module string, content string")
    out = {r.module: (r.content, r.passed) for r in WK.refine(docs, lambda c: (len(c), len(c) > 4), lambda c: c + "yy", 2).collect()}
    assert out == {"a": ("xyyyy", True), "b": ("good text", True)}
    answers = spark.createDataFrame([(1, '<review>{"overall": 4.5, "scores": {"a": 4.0}, "issues": []}</review>'), (2, "no json"), (3, '{"overall": 4.5, "passed": false, "issues": ["x"]}')], "doc int, answer string")
    assert {r.doc: (r.overall, r.passed, r.issues) for r in WK.reviews(answers).collect()} == {1: (4.5, True, 0), 2: (0.0, False, 1), 3: (4.5, False, 1)}


def test_evaluation(engine, spark):
    cases = spark.createDataFrame([("q", "parse text into words", "p", ["core/io/parser.py"], [])], "query_id string, query string, project_id string, expected_files array<string>, expected_symbols array<string>")
    means, passed = engine.evaluate(cases)
    assert means.first().mrr >= 0.5 and means.first().hit_3 == 1.0 and passed.count() == 4
    j, md = engine.report(means, passed)
    assert json.loads(j)["metrics"]["hit_3"] == 1.0 and "| mrr |" in md
    answers = spark.createDataFrame([("q", "It is Fine", ["fine"], ["bad"], 0.9, 0.5), ("r", None, ["x"], None, None, None)], "query_id string, answer string, must_contain array<string>, must_not_contain array<string>, confidence double, min_confidence double")
    assert {r.query_id: r.passed for r in A.assertions(answers).collect()} == {"q": True, "r": False}
    assert A.pass_rate(answers.select(F.lit(True).alias("ok")), "ok").first().pass_rate == 1.0
