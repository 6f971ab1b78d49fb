"""Column functions: identity rules, languages, links, tokens and cuts. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language, directories that are never walked, the largest file taken.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go",
    ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "c_sharp",
    ".kt": "kotlin", ".kts": "kotlin", ".php": "php",
}
SKIPPED = [".git", ".svn", "node_modules", "vendor", "__pycache__", ".venv", "venv", "env", ".env", "dist", "build", ".cache", ".pytest_cache", "target"]
LARGEST_FILE = 1 << 20
COLLECTIONS = ["code_repo", "app_docs", "incident_reports"]
BLANK = r"[ \t\r\n\f\x0B]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without blanks at both ends."""
    return F.regexp_replace(col(c), rf"^{BLANK}+|{BLANK}+$", "")


def extension(path: Column | str) -> Column:
    """Lower-case suffix with its dot, or ''."""
    return F.regexp_extract(F.lower(col(path)), r"[^/](\.[^./]+)$", 1)


def language(path: Column | str) -> Column:
    """Language the extension tells, else null."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.create_map(*pairs)[extension(path)]


def is_walked(path: Column | str, size: Column | str) -> Column:
    """Would the walk of a repository return this relative path?"""
    parts = F.split(col(path), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.exists(dirs, lambda d: d.isin(SKIPPED) | d.startswith("."))
    return language(path).isNotNull() & ~bad & (col(size) <= LARGEST_FILE)


def file_id_text(*parts: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def chunk_id(project: Column, path: Column, symbol: Column, content: Column) -> Column:
    """sha256 of project:path:symbol:content; nulls count as ''."""
    return F.sha2(file_id_text(project, path, symbol, content), 256)


def doc_chunk_id(label: Column, path: Column, index: Column, content: Column) -> Column:
    return F.sha2(file_id_text(label, path, index, content), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def point_id(chunk: Column) -> Column:
    """First 32 hex digits of an id as a UUID."""
    return F.concat_ws("-", *[F.substring(chunk, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def permalink(provider: Column, base: Column, path: Column, branch: Column, sha: Column, start: Column, end: Column) -> Column:
    """Web address of a line range; '' without a base. A sha that is empty or HEAD gives way to the branch."""
    ref = F.when(F.coalesce(sha, F.lit("")).isin("", "HEAD"), F.coalesce(branch, F.lit(""))).otherwise(sha)
    root = F.regexp_replace(F.coalesce(base, F.lit("")), "/+$", "")
    gitlab = provider == "gitlab"
    lines = F.when(start.isNotNull() & end.isNotNull() & (start != end), F.concat(F.lit("#L"), start, F.when(gitlab, "-").otherwise("-L"), end)).when(
        start.isNotNull(), F.concat(F.lit("#L"), start)
    ).otherwise("")
    return F.when(root == "", "").otherwise(F.concat(root, F.when(gitlab, "/-/blob/").otherwise("/blob/"), ref, F.lit("/"), path, lines))


def first_filled(*cols: Column) -> Column:
    """First that is neither null nor ''; '' if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def cut(c: Column | str, n: int, mark: str = "…") -> Column:
    """At most n characters, with a mark where something was cut off."""
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit(mark))).otherwise(col(c))


def tokens(c: Column | str) -> Column:
    """Words of a text as a keyword index holds them: lower-case runs of letters, digits and underscores of 2 to 40 characters."""
    return F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit(r"[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t).between(2, 40))


def last_segment(c: Column | str, sep: str = ".") -> Column:
    return F.substring_index(col(c), sep, -1)


def directory(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(path), r"[^/]*$", ""), r"/$", "")


def collection_for(label: Column) -> Column:
    """Collection a document label belongs to; app_docs unless it is incident_reports."""
    return F.when(label == "incident_reports", "incident_reports").otherwise("app_docs")


def confidence(score: Column) -> Column:
    """Reranker score of the best hit mapped from [-10, 10] to [0, 1]; 0 without hits."""
    return F.coalesce(F.greatest(F.least((score + 10) / 20, F.lit(1.0)), F.lit(0.0)), F.lit(0.0))


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string column with a fixed key, from built-in functions only."""
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in raw))
    outer = F.lit(bytearray(b ^ 0x5C for b in raw))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def signature_ok(provider: Column, signature: Column, key: str, message: Column) -> Column:
    """Is a delivery signed with the key? GitLab sends the key itself or the hex digest, with or without its prefix; GitHub the digest with the
    prefix sha256=. No signature is none."""
    digest = hmac_sha256(key, message)
    gitlab = (signature == key) | (F.regexp_replace(signature, "^sha256=", "") == digest)
    github = signature == F.concat(F.lit("sha256="), digest)
    return F.coalesce(F.when(provider == "gitlab", gitlab).otherwise(github), F.lit(False))


def clamped(k: Column, kind: Column) -> Column:
    """Number of hits asked for, at most 50 for code and keywords, 30 for documents and incidents."""
    return F.least(k, F.when(kind.isin("code", "keyword"), 50).otherwise(30))


def inside(path: Column, base: str) -> Column:
    """Does a path stay within a folder? It must begin there and never step up."""
    root = base.rstrip("/")
    return ((path == root) | path.startswith(root + "/")) & ~F.array_contains(F.split(path, "/"), "..")
