"""Symbol extraction: functions, classes and their calls from source files in ten languages.

Python is parsed with the standard library's parser; the other languages, and Python files it refuses, by a scanner that
follows brackets (or indentation) outside strings and comments. That is an approximation of a grammar: macros and
unusual formatting can hide a symbol.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..functions.batches import map_rows, spread
from ..functions.text import LANGUAGES

SCHEMA = (
    "project_id string, file_path string, language string, name string, qualified_name string, symbol_type string, docstring string,"
    " start_line int, end_line int, parent string, calls array<string>, params array<string>, body string"
)
# Words that are never parameters; words that look like a call or a function but aren't.
NOT_PARAMS = {"self", "cls", "def", "class", "int", "str", "float", "bool", "None"}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "sizeof", "function", "func", "fun", "def", "class", "elif", "and", "or", "not", "in", "using", "lock", "when", "match", "foreach", "super", "new"}
_BLANKED = re.compile(
    r'//[^\n]*|/\*[\s\S]*?\*/|"""[\s\S]*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`'
)
_NAME = r"[A-Za-z_$][\w$]*"
_HEADS = {
    "class": re.compile(rf"^[ \t]*(?:[\w@]+[ \t]+)*?(?:class|interface|struct|enum|object|trait|record)[ \t]+({_NAME})[^;{{}}()]*(?:\([^{{}};]*\)[^;{{}}]*)?\{{", re.M),
    "go_type": re.compile(rf"^type[ \t]+({_NAME})[ \t]+(?:struct|interface)[ \t]*\{{", re.M),
    "keyword": re.compile(rf"^[ \t]*(?:(?:export|default|async|public|private|protected|internal|static|final|override|suspend|inline|open|abstract)[ \t]+)*(?:function\*?|fun|func)[ \t]+(?:<[^>]*>[ \t]*)?(?:\((?P<recv>[^)]*)\)[ \t]*)?(?P<name>{_NAME})[ \t]*(?:<[^>()]*>)?\(", re.M),
    # a name before a bracket; what stands before it on the line is judged afterwards
    "typed": re.compile(rf"^(?P<before>[^\n(){{}};=]*[\s*&>])(?P<name>{_NAME})[ \t]*\(", re.M),
    "method": re.compile(rf"^(?P<before>[ \t]+(?:(?:async|static|get|set|public|private|protected|readonly)[ \t]+)*)(?P<name>{_NAME})[ \t]*(?:<[^>()\n]*>)?\(", re.M),
}
_CALL = re.compile(rf"({_NAME})[ \t]*\(")
_IDENTIFIER = re.compile(r"\b[a-zA-Z_]\w*\b")


def _params(text: str) -> list[str]:
    return [p for p in _IDENTIFIER.findall(text) if p not in NOT_PARAMS]


def _closing(code: str, i: int, pair: str) -> int:
    depth, opener, closer = 0, pair[0], pair[1]
    for m in re.compile(f"[{re.escape(pair)}]").finditer(code, i):
        depth += 1 if m[0] == opener else -1
        if not depth:
            return m.start()
    return -1


def _statements(node: ast.AST) -> Iterator[ast.AST]:
    """Statements below a node, without going into expressions."""
    for part in ("body", "orelse", "finalbody", "handlers", "cases"):
        yield from getattr(node, part, ())


def _python(text: str) -> Iterator[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    lines = text.split("\n")

    def down(node: ast.AST, parent: str | None) -> Iterator[tuple]:
        for child in _statements(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                a = child.args
                params = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
                calls = {getattr(c.func, "attr", None) or getattr(c.func, "id", None) for c in ast.walk(child) if isinstance(c, ast.Call)} - {None}
                yield child.name, "method" if parent else "function", ast.get_docstring(child, clean=False), child.lineno, child.end_lineno, parent, sorted(calls), [p for p in params if p not in NOT_PARAMS], "\n".join(lines[child.lineno - 1 : child.end_lineno])
                yield from down(child, parent)
            elif isinstance(child, ast.ClassDef):
                yield child.name, "class", ast.get_docstring(child, clean=False), child.lineno, child.end_lineno, parent, [], [], "\n".join(lines[child.lineno - 1 : child.end_lineno])
                yield from down(child, parent or child.name)
            else:
                yield from down(child, parent)

    yield from down(tree, None)


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _braces(text: str, language: str) -> Iterator[tuple]:
    code = _BLANKED.sub(_blank, text)
    found = []
    for kind in ("class", "go_type"):
        if kind == "go_type" and language != "go":
            continue
        for m in _HEADS[kind].finditer(code):
            end = _closing(code, m.end() - 1, "{}")
            if end > 0:
                found.append((m.start() + len(m[0]) - len(m[0].lstrip()), end, m[1], "class", None, ""))
    classes = [(a, e, n) for a, e, n, *_ in found]
    heads = ["keyword"] if language in ("go", "kotlin", "php") else ["keyword", "method"] if language in ("javascript", "typescript") else ["typed"]
    for kind in heads:
        for m in _HEADS[kind].finditer(code):
            name = m["name"]
            first = m[0].split()[0]
            if name in _NOT_CALLS or first in ("return", "else", "new", "throw", "case", "await", "yield") or kind == "typed" and not m["before"].strip():
                continue
            close = _closing(code, m.end() - 1, "()")
            brace = code.find("{", close) if close > 0 else -1
            if brace < 0 or any(c in code[close + 1 : brace] for c in ";=})") and kind != "keyword" or ";" in code[close:brace] or (kind == "keyword" and "\n\n" in code[close:brace]):
                continue
            end = _closing(code, brace, "{}")
            if end < 0:
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            owner = next((n for a, e, n in classes if a <= start and end <= e), None)
            if kind == "method" and not owner:
                continue
            found.append((start, end, name, "method" if owner else "function", owner, text[m.end() : close]))
    seen = set()
    for start, end, name, kind, owner, params in sorted(found, key=lambda f: (f[0], f[3] != "class")):
        if start in seen:
            continue
        seen.add(start)
        calls = [] if kind == "class" else sorted({c for c in _CALL.findall(code, code.find("{", start), end) if c not in _NOT_CALLS})
        yield name, kind, None, text.count("\n", 0, start) + 1, text.count("\n", 0, end) + 1, owner, calls, _params(params), text[start : end + 1]


def symbols_of(text: str | None, language: str | None) -> list[tuple]:
    """(name, type, docstring, start_line, end_line, parent, calls, params, body) of a text; none for null texts and other languages."""
    if not text or language not in set(LANGUAGES.values()):
        return []
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if language == "python":
        try:
            return list(_python(text))
        except (SyntaxError, ValueError, RecursionError):
            return []
    return list(_braces(text, language))


def extract(files: DataFrame) -> DataFrame:
    """files(project_id, file_path, language, content) -> symbols; one pass over each file, repeated deliveries once."""

    def row(project, path, language, content):
        name = (path or "").lower().rsplit("/", 1)[-1]
        spoken = LANGUAGES.get("." + name.rsplit(".", 1)[-1]) if "." in name else None
        spoken = spoken or language
        for n, kind, doc, a, e, parent, calls, params, body in symbols_of(content, spoken):
            yield project, path, spoken, n, f"{parent}.{n}" if parent else n, kind, doc, a, e, parent, calls, params, body

    return map_rows(spread(files.select("project_id", "file_path", "language", "content")), row, SCHEMA).distinct()


def in_order(symbols: DataFrame, *ties: str) -> DataFrame:
    """Symbols with their place in their file: by first line, classes before functions on the same line, then by name."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    kind = F.when(F.col("symbol_type") == "class", 0).otherwise(1)
    return symbols.withColumn("place", F.row_number().over(W.partitionBy("project_id", "file_path").orderBy("start_line", kind, "name", "end_line", *ties)))
