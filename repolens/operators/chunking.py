"""Files and Markdown to chunks: windows, symbol chunks, sections, paragraphs, discussions, diagrams, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

SECTION_LEAST, SECTION_MOST = 50, 4000


def lines(c: Column) -> Column:
    """Array of lines, split at line feeds."""
    return F.split(c, "\n", -1)


def line_range(content: Column, first: Column, last: Column) -> Column:
    """Lines first..last (1-based, inclusive) of a text."""
    return F.array_join(F.slice(lines(content), F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), "\n")


def windows(files: DataFrame, size: int = 50) -> DataFrame:
    """Windows of `size` lines named chunk_0, chunk_1, ... for files without a parser: keeps file columns, adds name, start_line,
    end_line, body. One generator a file; no line is exploded and gathered again. A final line end opens no line."""
    ls = lines(F.regexp_replace("content", r"\n$", ""))
    n = F.ceil(F.size(ls) / size).cast("int")
    w = files.filter(F.length("content") > 0).withColumn("_ls", ls).withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1)))
    return w.select(
        *files.columns, F.concat(F.lit("chunk_"), "_i").alias("name"), (F.col("_i") * size + 1).alias("start_line"),
        F.least((F.col("_i") + 1) * size, F.size("_ls")).alias("end_line"), F.array_join(F.slice("_ls", F.col("_i") * size + 1, F.lit(size)), "\n").alias("body"),
    )


def chunk_content(language: Column, docstring: Column, body: Column) -> Column:
    """Documentation block, if any, above the body."""
    doc = F.coalesce(docstring, F.lit(""))
    block = F.when(language == "python", F.concat(F.lit('"""'), doc, F.lit('"""'))).otherwise(F.concat(F.lit("/* "), doc, F.lit(" */")))
    return X.strip(F.when(doc == "", body).otherwise(F.concat(block, F.lit("\n"), body)))


def symbol_chunks(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One chunk a symbol with a body, one __module__ chunk a non-blank file without symbols:
    (chunk_id, project_id, file_path, qualified_name, symbol_type, start_line, end_line, content)."""
    own = symbols.filter(X.strip(F.coalesce("body", F.lit(""))) != "").select(
        "project_id", "file_path", F.coalesce("qualified_name", "name").alias("qualified_name"), "symbol_type", "start_line", "end_line",
        chunk_content(F.col("language"), F.col("docstring"), F.col("body")).alias("content"),
    ).distinct()
    rest = files.join(symbols.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_anti").filter(X.strip("content") != "")
    module = rest.select(
        "project_id", "file_path", F.lit("__module__").alias("qualified_name"), F.lit("module").alias("symbol_type"), F.lit(1).alias("start_line"),
        F.size(lines(F.regexp_replace("content", r"\n$", ""))).alias("end_line"), F.col("content"),
    ).distinct()
    both = own.unionByName(module)
    return both.select(X.chunk_id(F.col("project_id"), F.col("file_path"), F.col("qualified_name"), F.col("content")).alias("chunk_id"), "*")


# --- Markdown -----------------------------------------------------------------------------------------------------
def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Heading sections of Markdown: (key, section_no, level, heading, section_path, body).

    A heading closes the section above it; text before the first heading is a section without heading. section_path
    holds the headings above with a smaller level. Fences aren't special. Nothing is exploded before sections are whole, and
    nothing moves: only the headings are folded, bodies are slices between them. Null texts have no sections.
    """
    heading = r"^#{1,6}[ \t]+(.+)$"

    def found(line: Column, i: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^(#{1,6})[ \t]", 1))
        return F.when(line.rlike(heading), F.struct((i + 1).alias("n"), level.alias("l"), X.strip(F.regexp_extract(line, heading, 1)).alias("h")))

    def step(acc: Column, x: Column) -> Column:
        stack = F.concat(F.filter(acc["stack"], lambda y: y["l"] < x["l"]), F.array(x))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.array_join(F.transform(stack, lambda y: y["h"]), " / "))).alias("out"))

    start = F.struct(F.array().cast("array<struct<n:int,l:int,h:string>>").alias("stack"), F.array().cast("array<string>").alias("out"))
    part = lambda a, e: F.array_join(F.slice("_ls", a, e - a), "\n")
    end = lambda k: F.coalesce(F.get("_hs", k)["n"], F.size("_ls") + 1)
    opening = F.struct(F.lit(0).alias("level"), F.lit("").alias("heading"), F.lit("").alias("section_path"), part(F.lit(1), end(F.lit(0))).alias("body"))
    rest = F.transform("_hs", lambda x, k: F.struct(x["l"].alias("level"), x["h"].alias("heading"), F.get("_paths", k).alias("section_path"), part(x["n"] + 1, end(k + 1)).alias("body")))
    d = docs.filter(F.col(text).isNotNull()).select(F.col(key), lines(F.col(text)).alias("_ls"))
    d = d.withColumn("_hs", F.array_compact(F.transform("_ls", found)))
    d = d.withColumn("_paths", F.aggregate("_hs", start, step, lambda a: a["out"]))
    # an empty opening part counts only if something stands in it
    whole = F.filter(F.concat(F.array(opening), rest), lambda x, i: (i > 0) | (X.strip(x["body"]) != ""))
    return d.select(key, F.posexplode(whole).alias("section_no", "s")).select(key, "section_no", "s.level", "s.heading", "s.section_path", "s.body")


def section_text(level: Column, heading: Column, body: Column) -> Column:
    """Heading line, blank line, body; a section without heading is its body."""
    mark = F.concat(F.repeat(F.lit("#"), F.greatest(level, F.lit(1))), F.lit(" "), heading)
    return F.when(heading == "", X.strip(body)).otherwise(X.strip(F.concat(mark, F.lit("\n\n"), X.strip(body))))


def pack_paragraphs(content: Column, heading: Column, body: Column, most: int = SECTION_MOST) -> Column:
    """Array of pieces of a section: content as it is, if it has at most `most` characters; else paragraphs of the body below a heading of
    the first level, a piece being closed before a paragraph that would make it longer than `most`; a longer paragraph stays
    whole. Further pieces are headed as continued. A section without any paragraph is cut at `most`."""
    first = F.when(heading == "", "").otherwise(F.concat(F.lit("# "), heading, F.lit("\n\n")))
    start = F.struct(F.array().cast("array<string>").alias("out"), first.alias("cur"))

    def step(a: Column, p: Column) -> Column:
        full = (F.length(a["cur"]) + F.length(p) > most) & (X.strip(a["cur"]) != "")
        return F.struct(
            F.when(full, F.concat(a["out"], F.array(X.strip(a["cur"])))).otherwise(a["out"]).alias("out"),
            F.when(full, F.concat(F.lit("# "), heading, F.lit(" (continued)\n\n"), p, F.lit("\n\n"))).otherwise(F.concat(a["cur"], p, F.lit("\n\n"))).alias("cur"),
        )

    ps = F.filter(F.transform(F.split(body, r"\n\s*\n"), X.strip), lambda p: p != "")
    packed = F.aggregate(ps, start, step, lambda a: F.when(X.strip(a["cur"]) == "", a["out"]).otherwise(F.concat(a["out"], F.array(X.strip(a["cur"])))))
    return F.when(F.length(content) <= most, F.array(content)).when(F.size(packed) == 0, F.array(F.substring(content, 1, most))).otherwise(packed)


def section_chunks(docs: DataFrame, key: str, text: str, label: Column) -> DataFrame:
    """Chunks of Markdown documents: (key, chunk_index, section_path, heading, content, chunk_id). Sections under 50 characters
    are dropped; their number still counts, as chunk_index = section * 100 + piece."""
    s = sections(docs, key, text).withColumn("_t", section_text(F.col("level"), F.col("heading"), F.col("body"))).filter(F.length("_t") >= SECTION_LEAST)
    p = s.select("*", F.posexplode(pack_paragraphs(F.col("_t"), F.col("heading"), F.col("body"))).alias("_j", "content"))
    index = (F.col("section_no") * 100 + F.col("_j")).cast("int")
    return p.select(key, index.alias("chunk_index"), "section_path", "heading", "content", X.doc_chunk_id(label, F.col(key).cast("string"), index, F.col("content")).alias("chunk_id"))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, heading, body): non-blank paragraphs, named by their place, blank ones counted."""
    p = docs.select(key, F.posexplode(F.split(F.col(text), r"\n\s*\n")).alias("_i", "body"))
    return p.filter(X.strip("body") != "").select(key, F.concat(F.lit("Paragraph "), F.col("_i") + 1).alias("heading"), X.strip("body").alias("body"))


def incident_fields(heading: Column) -> list[Column]:
    """severity, incident_date (as written) and affected_services of an incident heading."""
    # What the three patterns take for a severity, a date and a service.
    return [
        F.nullif(F.upper(F.regexp_extract(heading, r"(?i)\b(P[1-4])\b", 1)), F.lit("")).alias("severity"),
        F.nullif(F.regexp_extract(heading, r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit("")).alias("incident_date"),
        F.regexp_extract_all(heading, F.lit(r"\b([A-Z][a-z]+(?:Service|Api|Worker|Queue|Handler))\b"), F.lit(1)).alias("affected_services"),
    ]


def discussion_chunks(threads: DataFrame) -> DataFrame:
    """threads(project_id, context_type, context_id, title, state, author, body, comments array<struct<author, body>>) -> one main
    row and one a comment of at least 10 characters: (project_id, context_type, context_id, comment_no, content, end_line, chunk_id)."""
    label = F.initcap(F.replace("context_type", F.lit("_"), F.lit(" ")))
    title = F.concat(label, F.lit(" #"), F.col("context_id").cast("string"))
    extra = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "").otherwise(F.concat(F.lit(f"**{name}:** "), F.col(c), F.lit("\n")))
    main = F.concat(F.lit("# "), title, F.lit(": "), "title", F.lit("\n\n"), extra("State", "state"), extra("Author", "author"), F.lit("\n"),
                    F.coalesce(F.nullif("body", F.lit("")), F.lit("(no description)")))
    keys = ["project_id", "context_type", "context_id"]
    end = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1
    place = F.concat_ws("/", "context_type", F.col("context_id").cast("string"))
    top = threads.select(*keys, F.lit(-1).alias("comment_no"), main.alias("content")).withColumn("chunk_id", X.doc_chunk_id(F.col("context_type"), place, F.lit(0), F.col("content")))
    c = threads.select(*keys, title.alias("_t"), F.posexplode("comments").alias("comment_no", "_c")).withColumn("_b", X.strip(F.coalesce("_c.body", F.lit(""))))
    said = F.concat(F.lit("## Comment by "), F.coalesce("_c.author", F.lit("unknown")), F.lit(" on "), "_t", F.lit("\n\n"), "_b")
    notes = c.filter(F.length("_b") >= 10).select(*keys, "comment_no", said.alias("content")).withColumn(
        "chunk_id", X.doc_chunk_id(F.col("context_type"), F.concat(place, F.lit("/comment")), F.col("comment_no") + 1, F.col("content"))
    )
    return top.unionByName(notes).withColumn("end_line", end(F.col("content")))


# --- import statements --------------------------------------------------------------------------------------------
def import_entries(files: DataFrame) -> DataFrame:
    """files(project_id, file_path, language, content) -> (project_id, source_file, imported_name, module_path, qualified_name, is_wildcard)
    of Python, JavaScript/TypeScript, Java, C# and Go import statements; a branch a language, all built-in functions."""
    keys = [F.col("project_id"), F.col("file_path").alias("source_file")]

    def statements(pattern: str, *languages: str) -> DataFrame:
        return files.filter(F.col("language").isin(*languages)).select(*keys, F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("s"))

    def entries(df: DataFrame, name: Column, module: Column, qualified: Column, wildcard: Column) -> DataFrame:
        return df.select("project_id", "source_file", name.alias("imported_name"), module.alias("module_path"), qualified.alias("qualified_name"), wildcard.alias("is_wildcard"))

    def part_of(df: DataFrame, names: Column) -> DataFrame:
        return df.withColumn("_p", F.explode(F.split(names, ","))).withColumn("_p", X.strip("_p")).filter("_p <> ''")

    alias = F.regexp_extract("_p", r"^[\w.]+\s+as\s+(\w+)", 1)
    original = F.regexp_extract("_p", r"^([\w.*]+)", 1)
    named = F.when(alias != "", alias).otherwise(original)

    py = statements(r"(?m)^[ \t]*from[ \t]+[\w.]+[ \t]+import[ \t]+(?:\([^)]*\)|[^\r\n]+)", "python").withColumn("_m", F.regexp_extract("s", r"from\s+([\w.]+)", 1))
    py = part_of(py, F.regexp_replace(F.regexp_extract("s", r"(?s)import[ \t]+(.+)$", 1), r"#[^\r\n]*|[()]", ""))
    out = entries(py, F.when(F.col("_p") == "*", "*").otherwise(named), F.col("_m"), F.concat_ws(".", "_m", original), F.col("_p") == "*")
    py = part_of(statements(r"(?m)^[ \t]*import[ \t]+[^\r\n]+", "python"), F.regexp_extract("s", r"import[ \t]+([^#\r\n]+)", 1))
    out = out.unionByName(entries(py, F.when(alias != "", alias).otherwise(F.substring_index(original, ".", 1)), original, original, F.lit(False)))

    js = statements(r"(?m)^[ \t]*import\s*\{[^}]*\}\s*from\s*['\"][^'\"\r\n]+['\"]", "javascript", "typescript").withColumn("_m", F.regexp_extract("s", r"from\s*['\"]([^'\"]+)", 1))
    js = part_of(js, F.regexp_extract("s", r"\{([^}]*)\}", 1))
    out = out.unionByName(entries(js, named, F.col("_m"), F.concat_ws(".", "_m", original), F.lit(False)))
    js = statements(r"(?m)^[ \t]*import\s+\w+\s+from\s*['\"][^'\"\r\n]+['\"]", "javascript", "typescript").withColumn("_m", F.regexp_extract("s", r"from\s*['\"]([^'\"]+)", 1))
    out = out.unionByName(entries(js, F.regexp_extract("s", r"import\s+(\w+)", 1), F.col("_m"), F.concat(F.col("_m"), F.lit(".default")), F.lit(False)))

    java = statements(r"(?m)^[ \t]*import\s+(?:static\s+)?[\w.]*\w(?:\.\*)?", "java", "kotlin").withColumn("_f", F.regexp_extract("s", r"import\s+(?:static\s+)?([\w.]*\w(?:\.\*)?)$", 1))
    short = F.substring_index("_f", ".", -1)
    out = out.unionByName(entries(java.filter(F.col("_f") != ""), short, F.regexp_replace("_f", r"\.?[^.]*$", ""), F.col("_f"), short == "*"))
    cs = statements(r"(?m)^[ \t]*using\s+(?:static\s+)?[\w.]+\s*;", "c_sharp").withColumn("_f", F.regexp_extract("s", r"using\s+(?:static\s+)?([\w.]+)", 1))
    out = out.unionByName(entries(cs, F.substring_index("_f", ".", -1), F.col("_f"), F.col("_f"), F.lit(False)))
    go = statements(r"(?m)^import[ \t]+(?:\([^)]*\)|[^\r\n]*\"[^\"\r\n]+\")", "go").withColumn("_f", F.explode(F.regexp_extract_all("s", F.lit(r"\"([^\"]+)\""), F.lit(1))))
    return out.unionByName(entries(go, F.substring_index("_f", "/", -1), F.col("_f"), F.col("_f"), F.lit(False)))


# --- diagrams and answers of language models --------------------------------------------------------------------------
# First words of diagrams, without hyphens and in lower case.
DIAGRAMS = ["graph", "flowchart", "sequencediagram", "sequence", "classdiagram", "statediagram", "erdiagram", "gantt", "pie", "gitgraph", "mindmap", "timeline", "journey", "quadrantchart",
            "sankey", "xychart", "block"]


def diagrams(text: Column) -> Column:
    """Array of the sources of fenced mermaid blocks."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```mermaid\s*\n(.*?)```"), F.lit(1))


def diagram_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, start, kind, source) of fenced mermaid blocks: start is the 0-based place of the fence, kind the first word of the first
    line that isn't a comment, in lower case without hyphens ('' without one). Null texts have none."""
    mark = r"(?s)```mermaid\s*\n(.*?)```"
    whole = F.regexp_extract_all(text, F.lit(mark), F.lit(0))
    # each block begins where the ones before it and what stands between them end
    between = F.split(F.col(text), mark, -1)
    ends = F.transform(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.aggregate(F.slice("_w", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("_b", F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)))
    d = docs.select(key, whole.alias("_w"), between.alias("_b")).filter(F.size("_w") > 0).withColumn("_at", ends)
    d = d.select(key, F.posexplode(F.arrays_zip("_w", "_at")).alias("block_no", "x"))
    source = X.strip(F.regexp_extract("x._w", mark, 1))
    first = F.filter(F.split(source, "\n"), lambda l: (X.strip(l) != "") & ~X.strip(l).startswith("%%"))
    kind = F.replace(F.lower(F.regexp_extract(X.strip(F.get(first, F.lit(0))), r"^(\S+)", 1)), F.lit("-"), F.lit(""))
    return d.select(key, "block_no", F.col("x._at").alias("start"), F.coalesce(kind, F.lit("")).alias("kind"), source.alias("source"))


def module_docstring(c: Column) -> Column:
    """What stands in the quotes a text begins with - three double, three single, one double, one single are tried in this order -
    without blanks at its ends; '' if it begins with none or the quotes don't close. Null for null."""
    t = X.strip(c)
    out = F.lit("")
    for q in ("'", '"', "'''", '"""'):
        body = F.substring(t, F.lit(len(q) + 1), F.length(t))
        closes = F.instr(body, q)
        out = F.when(t.startswith(q) & (closes > 0), X.strip(F.substring(body, F.lit(1), closes - 1))).otherwise(out)
    return F.when(c.isNotNull(), out)


def diagram_problems(source: Column) -> Column:
    """Array of what is wrong with a diagram: empty, only comments, unknown type, more than three brackets left open."""
    # The texts of the four problems.
    ls = F.filter(F.split(F.coalesce(source, F.lit("")), "\n"), lambda x: (X.strip(x) != "") & ~X.strip(x).startswith("%%"))
    word = F.regexp_extract(X.strip(ls[0]), r"^(\S+)", 1)
    known = F.replace(F.lower(word), F.lit("-"), F.lit("")).isin(DIAGRAMS)

    def step(stack: Column, c: Column) -> Column:
        close = F.when(c == "(", ")").when(c == "[", "]").when(c == "{", "}")
        top = F.substring(stack, -1, 1)
        return F.when(close.isNotNull(), F.concat(stack, close)).when(c.isin(")", "]", "}") & (top == c), F.substring(stack, F.lit(1), F.length(stack) - 1)).otherwise(stack)

    brackets = F.split(F.regexp_replace(F.coalesce(source, F.lit("")), r"[^()\[\]{}]", ""), "")
    left = F.length(F.aggregate(brackets, F.lit(""), step))
    return (
        F.when(X.strip(F.coalesce(source, F.lit(""))) == "", F.array(F.lit("Empty diagram")))
        .when(F.size(ls) == 0, F.array(F.lit("Diagram contains only comments")))
        .otherwise(F.array_compact(F.array(F.when(~known, F.concat(F.lit("Unknown diagram type: "), word)), F.when(left > 3, F.concat(F.lit("Unclosed brackets: "), left.cast("string"))))))
    )


def tagged_json(answer: Column, *tags: str) -> Column:
    """JSON text of an answer: inside the first tag that holds valid JSON, else the outermost braces, else '{}'."""
    tries = [F.regexp_extract(answer, rf"(?s)<{t}>\s*(.*?)\s*</{t}>", 1) for t in tags] + [F.regexp_extract(answer, r"(?s)(\{.*\})", 1)]
    valid = [F.when(F.try_parse_json(t).isNotNull() & (X.strip(t) != ""), t) for t in tries]
    return F.coalesce(*valid, F.lit("{}"))


def clean_docstring(c: Column) -> Column:
    """Without code fences and quote marks."""
    return X.strip(F.regexp_replace(F.regexp_replace(c, r"(?m)^```\w*[ \t]*$", ""), r"^\s*(?:\"\"\"|''')|(?:\"\"\"|''')\s*$", ""))
