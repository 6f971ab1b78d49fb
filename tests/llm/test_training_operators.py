"""The operators on DataFrames: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from repolens.llm import code_text as C
from repolens.llm import corpus_text as T
from repolens.llm import language
from repolens.llm import near_duplicates as N
from repolens.llm.queries import QUERIES, SQL

FILES = "file_id bigint, project_id string, file_path string, language string, content string, comment string, kind string, line int"
SYMBOLS = "symbol_id bigint, file_id bigint, project_id string, file_path string, language string, name string, qualified_name string, symbol_type string, start_line int, end_line int, params array<string>, body string, line int, comment string"
DOC = "/** Moves every open ticket to the next free shelf. */\n"


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        (1, "p", "a.c", "c", DOC + "int f(int x) {\n  return x;\n}\n", "x", "y", 7),
        (1, "p", "a.c", "c", DOC + "int f(int x) {\n  return x;\n}\n", "x", "y", 7),
        (2, "p", "b.py", None, "def g(:\n", None, None, None),
        (3, "p", "c.py", "python", None, None, None, None),
        (4, "q", "d.py", "python", "", None, None, None),
        (5, "q", "noext", None, "password: hunter", None, None, None),
        (6, "q", "e.go", "go", "package e\n" + "// x\n" * 50_000, None, None, None),
        (7, "q", "gen/f.py", "python", "x = 1\n", None, None, None),
    ]
    return spark.createDataFrame(rows, FILES)


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [
        (10, 1, "p", "a.c", "c", "f", "f", "function", 2, 4, ["x"], "int f(int x) {}", 1, "z"),
        (10, 1, "p", "a.c", "c", "f", "f", "function", 2, 4, ["x"], "int f(int x) {}", 1, "z"),
        (11, 1, "p", "a.c", "c", "chunk_0", None, "function", 2, 4, None, "", None, None),
        (12, 1, "p", "a.c", "c", "k", None, "function", 3, 4, None, 'token = "Kernel1441#Journal"', None, None),
        (13, 99, "p", "z.c", None, "n", None, "method", 1, 1, None, "", None, None),
    ]
    return spark.createDataFrame(rows, SYMBOLS)


def test_code_operators(spark, files, symbols):
    assert [r.symbol_id for r in C.documented(symbols, files).select("symbol_id").distinct().collect()] == [10]
    pair = C.documented_pairs(symbols, files).collect()
    assert [(r.symbol_id, r.description) for r in pair] == [(10, "Moves every open ticket to the next free shelf.")]
    assert {r.file_id for r in C.file_origin(files).collect()} == {7}
    assert {r.file_id for r in C.unparsable(files).collect()} == {2}
    rates = {(r.project_id, r.language): (r.files, r.broken) for r in C.unparsable_rates(files).collect()}
    assert rates[("p", "python")] == (2, 1) and rates[("p", "c")] == (1, 0)
    chunks = spark.createDataFrame([("c1", "a.py", "python", None), ("c2", "x", None, "API_KEY=u5bqtrfpdhk4aj5F_x\n")], "chunk_id string, file_path string, language string, content string")
    rec = C.text_records(chunks, symbols)
    assert {tuple(r) for r in C.secret_lines(rec).collect()} == {("chunk", "c2", 1), ("symbol", "12", 1)}
    assert {r.record_id: r.masked_text for r in C.masked(rec).collect()} == {"c2": "API_KEY=" + "*" * 18 + "\n", "12": 'token = "' + "*" * 18 + '"'}


def test_code_operators_on_empty_tables(spark, files, symbols):
    f, s = files.limit(0), symbols.limit(0)
    assert C.documented(s, f).count() == C.file_origin(f).count() == C.unparsable(f).count() == C.unparsable_rates(f).count() == C.handwritten(f).count() == 0


def test_splitting(spark):
    limits = spark.createDataFrame([("python", 50, 10), ("go", 10, 0)], "language string, max_size int, overlap_size int")
    long = "".join(f"line {i}\n" for i in range(30))
    kind = "chunk_id string, language string, content string, start_line int, end_line int, overlap int, piece_no int"
    rows = [("a", "python", long, 1, 30, 0, 0), ("a", "python", long, 1, 30, 0, 0), ("b", "python", "short", 1, 1, 0, 0), ("c", "none", long, 1, 30, 0, 0), ("d", "go", None, 1, 1, 0, 0), ("e", "go", "ÄÖÜ" * 3, 1, 1, 0, 0), ("f", "go", "x" * 200_000, 1, 1, 0, 0)]
    out = C.split_oversized(spark.createDataFrame(rows, kind), limits).collect()
    assert {r.chunk_id for r in out} == {"a", "f"}
    ps = sorted((r for r in out if r.chunk_id == "a"), key=lambda r: r.piece_no)
    assert "".join(r.content[r.overlap :] for r in ps) == long and ps[-1].end_line == 30
    assert C.split_oversized(spark.createDataFrame([], kind), limits).count() == 0


def brute(rows):
    out = set()
    sets = []
    for cid, p, f, t in {r for r in rows if r[3]}:
        w = re.findall("[a-z0-9_]+", t.lower())
        if len(w) >= 40:
            sets.append((cid, (p, f), {tuple(w[i : i + 3]) for i in range(len(w) - 2)}))
    for (a, fa, x), (b, fb, y) in itertools.combinations(sorted(sets), 2):
        if fa != fb and a != b and len(x & y) / len(x | y) >= 0.6:
            out.add((a, b))
    return out


def texts(seed, n=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(90)] for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 3, 6, 12])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((f"c{i:03}", f"p{i % 3}", f"f{i}", " ".join(w)))
    return [*rows, rows[0], ("n", "p", "f", None), ("s", "p", "f", "too short"), ("m", "p0", "f0", rows[0][3])]


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates_against_brute_force(spark, block, monkeypatch):
    rows = texts(block)
    df = spark.createDataFrame(rows, "chunk_id string, project_id string, file_path string, content string").withColumn("class_id", F.lit(1)).repartition(5)
    monkeypatch.setattr(N.class_links, "__defaults__", (0.6, block))
    assert {tuple(r) for r in N.similar_pairs(df).collect()} == brute(rows)
    groups = N.near_duplicate_groups(df).collect()
    assert len(groups) == len({r.chunk_id for r in groups}) == 41
    assert N.similar_pairs(df.limit(0)).count() == 0


def test_large_groups_of_copies_stay_connected(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(f"c{i:03}", "p", f"f{i}", text) for i in range(90)], "chunk_id string, project_id string, file_path string, content string")
    pairs = {tuple(r) for r in N.similar_pairs(df).collect()}
    assert pairs == {("c000", f"c{i:03}") for i in range(1, 90)}
    assert {r.group_id for r in N.near_duplicate_groups(df).collect()} == {r.class_id for r in N.near_duplicate_groups(df).collect()}


def test_large_groups_of_copies_lose_no_link(spark):
    """c000 to c004 lie in one file, as do near copies; other texts have all their copies in one file or differ in signs only."""
    words = [f"w{i}" for i in range(60)]
    text, near, third = " ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words[:-2], "more", "words"])
    rows = [(f"c{i:03}", "p", "f0" if i < 5 else f"f{i}", text) for i in range(90)]
    rows += [("near", "p", "f0", near), ("sign", "p", "f0", text.upper() + "."), ("sign2", "p", "f6", text.upper() + ".")]
    rows += [(f"d{i:03}", "p", "g", third) for i in range(70)]
    df = spark.createDataFrame(rows, "chunk_id string, project_id string, file_path string, content string").repartition(3)
    pairs = {tuple(r) for r in N.similar_pairs(df).collect()}
    assert pairs <= brute(rows)
    assert {(f"c{i:03}", "c005") for i in range(5)} <= pairs and {("c000", f"c{i:03}") for i in range(5, 90)} <= pairs
    assert {("c005", "near"), ("c005", "sign"), ("c000", "sign2"), ("sign", "sign2"), ("near", "sign2")} <= pairs
    of = {r[0]: (r[2], r[3]) for r in rows}
    for c, (f, t) in of.items():  # each chunk has a pair wherever it has one at all; each text one with every similar text in another file
        assert any(c in p for p in pairs)
        if t in (near, text.upper() + ".") or c[0] == "d":
            for u in {text, near, third, text.upper() + "."} - {t}:
                if any(of[x][0] != f and of[x][1] == u for x in of):
                    assert any(c in p and of[p[p[0] == c]][1] == u for p in pairs), (c, u)


def test_packing_assigns_everything(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 30, 40, 60, 100, 250, 100])) for i in range(500)] + [(1000, None)]
    out, n = T.pack(spark.createDataFrame(rows, "doc_id bigint, tokens int").repartition(7), 100)
    got = out.collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    by_doc, fill = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
        fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
    for i, size in rows:
        ps = sorted(by_doc[i])
        assert sum(t for _, t in ps) == (size or 0) and len(ps) == max(1, -(-(size or 0) // 100))
    assert max(fill.values()) <= 100 and len(fill) == n and n <= 1.05 * -(-sum(t or 0 for _, t in rows) // 100)
    empty, k = T.pack(spark.createDataFrame([], "doc_id bigint, tokens int"), 100)
    assert empty.count() == 0 and k == 0


def test_leaks_against_brute_force(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    from repolens.llm import leaks

    query = {r.item_id: leaks.words(r["query"]) for r in items.collect()}
    runs = {}
    for k, w in query.items():
        for a in range(len(w) - 12):
            runs.setdefault(tuple(w[a : a + 13]), set()).add(k)
    want = set()
    for r in docs.collect():
        for numbers in (True, False):
            w = leaks.words(r.text or "", numbers)
            want |= {(r.doc_id, k) for a in range(len(w) - 12) for k in runs.get(tuple(w[a : a + 13]), ())}
    got = {tuple(r) for r in T.leaked(docs, items).collect()}
    assert want and got <= want and len(got) >= 0.98 * len(want)
    assert T.leaked(docs.limit(0), items).count() == T.leaked(docs, items.limit(0)).count() == 0


def test_report_holds_every_exact_leak(spark):
    """Passages full of pieces of four other items, too short to count: near the item they leak, but not by a cosine of 0.6."""
    rng = random.Random(5)
    queries = {k: [f"w{k}x{i}" for i in range(30)] for k in range(40)}
    items = spark.createDataFrame([(k, " ".join(w)) for k, w in queries.items()], "item_id bigint, query string")
    rows = []
    for i in range(200):
        k, *others = rng.sample(range(40), 5)
        pieces = [queries[k][5:18], *(queries[o][5:17] for o in others)]
        rng.shuffle(pieces)
        rows.append((i, " ".join(w for p in pieces for w in p)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {tuple(r) for r in T.leaked(docs, items).collect()}
    strict = {(r.doc_id, r.item_id) for r in T.LeakSearch(docs, items).search(cosine=0.6).collect()}
    assert len(found - strict) > 5  # a threshold of 0.6 does lose exact runs here
    assert {(r.doc_id, r.item_id) for r in T.leak_report(docs, items).filter("exact").collect()} == found


def test_languages_on_odd_rows(spark):
    model = language.train([("en", "The service drops the old copy when the new one arrives too late. We saw that the job was done."), ("de", "Der Dienst verwirft die alte Kopie, sobald die neue zu spät eintrifft. Wir haben gesehen, dass es fertig war.")] * 5)
    rows = [(1, None, None), (2, "", "en"), (3, "The service drops the new copy when the old one arrives.", "de"), (3, "The service drops the new copy when the old one arrives.", "de"), (4, "Der Dienst verwirft die neue Kopie, sobald die alte eintrifft.", "DE-at"), (5, "1 2 3", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("label", F.lit(1))
    assert {tuple(r) for r in T.mislabelled(df, model).collect()} == {(3, "en")}
    assert {r.doc_id for r in T.passages_by_language(df, model).collect()} == {3, 4}
    assert T.mislabelled(df.limit(0), model).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(name, spark, data):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert df.columns
    if name in SQL:
        con = duckdb.connect()
        for t in ("code_repo", "size_limits", "symbols", "documents"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
        rel = con.sql(SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in rows) == sorted(rel.select(*sorted(df.columns)).fetchall())


def test_the_nearest_comment_is_taken_and_statements_reject(spark):
    far, near = "// Counts every closed ticket of the shelf.\n", "// Moves every open ticket to the shelf.\n"
    pad = "int y;\n" * 62  # intervals across stretches of lines
    text = pad + far + "\n" + near + "\n\nint f() {\n}\n" + far + "int x = 1;\nint g() {\n}\n"
    files = spark.createDataFrame([(1, "a.c", "c", text)] * 2, "file_id bigint, file_path string, language string, content string")
    line = text[: text.index("int f")].count("\n") + 1
    kind = "symbol_id bigint, file_id bigint, name string, symbol_type string, start_line int, params array<string>"
    symbols = spark.createDataFrame([(1, 1, "f", "function", line, None), (2, 1, "g", "function", line + 4, None)] * 2, kind)
    assert [(r.symbol_id, r.comment) for r in C.documented(symbols, files, 5).collect()] == [(1, near.strip())]
    assert C.documented(symbols, files, 0).count() == 0


def test_more_items_than_a_block_are_searched_in_blocks(spark, data, monkeypatch):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    whole = {tuple(r) for r in T.leaked(docs, items).collect()}
    monkeypatch.setattr(T, "ITEMS", 120)
    assert {tuple(r) for r in T.leaked(docs, items.union(items)).collect()} == whole
