"""Documentation comments: their spans, the lines they may document, and whether they say anything.

:func:`comment_spans` extracts every comment block and every Python docstring of a text independently of the
functions around it. Each carries the interval of lines on which what it documents may begin: for a comment the lines below it
down to the next line of code (at most `max_gap` blank lines further), so that a statement between ends the interval; for a
docstring the lines from the decorators to the ``def`` or ``class`` it belongs to. Blocks are whole lines of comment; a remark
after code on the same line is a statement's, not a function's.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from .lexer import scan

_HEADER = re.compile(r"^[ \t]*(?:async[ \t]+)?(?:def|class)\b", re.M)


def comment_spans(text: str, language: str, max_gap: int = 0) -> list[tuple[int, int, int, int, str, str]]:
    """(first line, last line, from line, to line, kind, comment text), lines 1-based; kind is ``comment`` or ``docstring``."""
    text = text.removeprefix("\ufeff")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    s = scan(text, language)
    starts = [0]
    find = text.find
    i = find("\n")
    while i >= 0:
        starts.append(i + 1)
        i = find("\n", i + 1)
    out: list[tuple[int, int, int, int, str, str]] = []
    block = None  # first line, last line, marker, parts
    for a, e, marker in s.comments:
        if marker in ("#pp", "#!"):
            continue
        first = bisect_right(starts, a)
        last = bisect_right(starts, max(a, e - 1))
        if text[starts[first - 1] : a].strip():
            continue  # a remark after code
        tail = text[e : starts[last] if last < len(starts) else len(text)]
        if tail.strip():
            continue  # code after the comment on its line
        if marker != "/*" and block and block[2] == marker and block[1] + 1 == first:
            block[1] = last
            block[3].append(text[a:e])
            continue
        if block:
            out.append((block[0], block[1], block[1] + 1, block[1] + 1, "comment", "\n".join(block[3])))
        block = [first, last, marker, [text[a:e]]]
    if block:
        out.append((block[0], block[1], block[1] + 1, block[1] + 1, "comment", "\n".join(block[3])))
    if max_gap:
        lines = s.code.split("\n")
        for k, (first, last, _, _, kind, comment) in enumerate(out):
            below = last
            while below < len(lines) and below - last < max_gap and not lines[below].strip():
                below += 1
            out[k] = (first, last, last + 1, below + 1, kind, comment)
    if language == "python":
        headers = [m.start() for m in _HEADER.finditer(text)]
        ends = {e: a for a, e, _ in s.comments}
        for a, e in s.strings:
            line = bisect_right(starts, a)
            before = text[starts[line - 1] : a]
            if before.strip(" \t").lower() not in ("", "r", "u", "b", "f", "br", "rb", "fr", "rf"):
                if not before.rstrip(" \trRuU").endswith(":"):
                    continue
            # the last code before it must be the colon of a header
            j = a - len(before) + len(before.rstrip(" \trRuU"))
            j = _code_end(text, j, ends, starts)
            if j <= 0 or text[j - 1] != ":":
                continue
            h = bisect_right(headers, j) - 1
            if h < 0:
                continue
            top = head = bisect_right(starts, headers[h])
            quote = text[a : a + 3] if text[a : a + 3] in ('"""', "'''") else text[a]
            last = bisect_right(starts, e - 1)
            while top > 1 and text[starts[top - 2] : starts[top - 1]].lstrip().startswith("@"):
                top -= 1  # a symbol may begin with its decorators
            out.append((line, last, top, head, "docstring", text[a + len(quote) : e - len(quote)]))
    return out


def _code_end(text: str, j: int, ends: dict, starts: list) -> int:
    """Where the code before j ends, blanks and comments skipped."""
    while True:
        k = j
        while k > 0 and text[k - 1] in " \t\r\n\f":
            k -= 1
        if k in ends:
            j = ends[k]
            continue
        return k


# Words that open tag lines, section labels, directives and placeholders.
_TAG = re.compile(
    r"^(?:[@\\](?:param|arg|argument|return|returns|throws|exception|raises|see|since|author|version|deprecated|type|typedef|property|prop|template|tparam|retval|link"
    r"|todo|ignore|suppress|override|inheritdoc|link|code|default|example|public|private|protected|internal|static|class|function|method|memberof|module|namespace"
    r"|[A-Za-z][\w-]*)\b|:(?:param|parameter|type|return|returns|rtype|raises|raise|ivar|cvar|var|vartype|keyword|meta|[a-z]+)\b[^:]*:|\.\. [\w-]+::|\+\w+:|#\[)",
    re.I,
)
_LABEL = re.compile(
    r"^(?:args?|arguments?|params?|parameters?|returns?|raises?|yields?|throws|exceptions?|notes?|examples?|see also|references|attributes|methods|usage|input|output|inputs|outputs"
    r"|description|summary|warnings?|todo|other parameters|keyword args|keyword arguments|deprecated|remarks|parameter|rückgabe|argumente|devuelve|retourne|argumentos|paramètres|retorna|restituisce|значение|возвращает|参数|返回)\s*[:：]?\s*[-=~]*$",
    re.I,
)
_DIRECTIVE = re.compile(
    r"^(?:eslint|tslint|jshint|jslint|prettier|noqa|nolint|nosec|noinspection|pylint|flake8|mypy|type:|pragma|istanbul|c8 |v8 |clang-format|clang-tidy|NOLINT|coverage|fmt:|isort|yapf|black|ruff|pyright"
    r"|@ts-|ts-|go:|\+build|swiftlint|ktlint|detekt|phpcs|phpstan|psalm|@phpstan|@psalm|checkstyle|CHECKSTYLE|spotless|resharper|ReSharper|sonar|NOSONAR|region\b|endregion\b|#region|#endregion|vim:|-\*-|cspell|codespell|language=|formatter:|stylelint|biome-|deno-|@formatter|SPDX|skipcq|lint:|line-length|skip-file|webpackChunkName|@__PURE__|exhaustive|gocyclo|revive:|staticcheck|nocover|no cover)",
    re.I,
)
_MISSING = re.compile(
    r"^\W*(?:todo|fixme|tbd|tbc|xxx|wip|undocumented|placeholder|lorem ipsum)\b|^\W*(?:n/?a|none|null|hack|missing|empty)\W*$"
    r"|\b(?:no|missing|needs?|add|write|insert|lacks?|without|fill in|update|describe|document) (?:a |the |some |proper |any |more |your )?(?:docs?|documentation|docstrings?|description|comments?|summary)(?: (?:here|yet|available|provided|needed|missing|later|string|for this \w+|for the \w+|of this \w+))*\s*[.!]?\s*$"
    r"|\b(?:documentation|docs?|docstring|description|comment|summary) (?:is |are |still |to be |will be )*(?:missing|todo|tbd|pending|needed|required|goes here|follows?|here|coming soon|added later|written|not available|not yet|unavailable|to follow)\b"
    r"|\bauto-?generated (?:method|function|constructor|catch|class|javadoc|docs?|documentation)?\s*(?:stub|block|comment)?\b|^\W*(?:method|function|type|class) (?:stub|description|documentation)\W*$|\bnot (?:yet )?documented\b|\bdocument (?:me|this)\b|^\W*see (?:above|below|base|super|parent|docs?|documentation|interface|the \w+)\W*$|^\W*(?:\{@inheritdoc\}|@inheritdoc|inherited|same as above|self[- ]explanatory|as above|ditto)\W*$|\binsert description\b|\bdescription of\b.{0,30}$|\bgenerated by (?:ide|intellij|eclipse|copilot|visual studio)\b",
    re.I,
)
_CODE = re.compile(
    r"[;{}]\s*$|^[\w.$\[\]]+\s*(?:[-+*/%|&^]?=|:=|<-)\s*[^=]|^(?:if|for|while|switch|return|def|class|function|func|fun|var|let|const|int|long|auto|public|private|import|from|using|package|include|else|elif|try|except|catch|print|await|yield|throw|raise|assert|del|pass|break|continue|case)\b.*[:;(){}=]\s*$|^[\w.$:>-]+\([^)]*\)[;,]?$|^(?:return|import|from|pass|break|continue|raise|del)\b [\w.,()* ]+$|^#(?:include|define|if|endif)|=>\s*\{?$|^\}|^\w+\s*\+\+|^</?\w+>$|^>>>|^\.\.\.\s|^\$ |^[A-Za-z_$][\w$]* [A-Za-z_$][\w$]* = .+|^[\w$]+(?:\.|->|::)[\w$]+\(.*\)|^[a-z]+(?:[A-Z]\w*|_\w+)\(.*\)$|^for (?:\w+ in .*|\(.*):?$|^(?:if|while) .*(?:[<>=!]=|[<>]) ?[\w.]+ ?[:{]?$"
)
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|\{@\w+[^{}]*\}|`+|\*\*|__(?=\w)|(?<=\w)__|&[a-z]+;|https?://\S+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


def name_words(*names: str | None) -> set[str]:
    """Lower-case words of identifiers in camel or snake case."""
    out: set[str] = set()
    for n in names:
        if n:
            out.update(x.lower() for x in _SPLIT.findall(n))
            out.update(x.lower() for x in _WORD.findall(n))
    return out


def prose(comment: str) -> str:
    """What is prose in a comment: without marks, tags and what follows them, labels, directives, markup and code."""
    kept, skipping, indent, fence = [], False, 0, False
    for raw in comment.split("\n"):
        line = raw.strip()
        line = re.sub(r"^(?:/\*+!?|\*+/|///?!?|//+|#+!?|\*+(?!\*)|<!--|--|\"\"\"|''')+\s?", "", line)
        line = re.sub(r"(?:\*+/|-->)\s*$", "", line).rstrip()
        depth = len(raw) - len(raw.lstrip()) if not raw.lstrip().startswith(("*", "/", "#")) else len(line) - len(line.lstrip())
        line = line.strip()
        if line.startswith(("```", "~~~")):
            fence = not fence
            continue
        if fence:
            continue
        if not line:
            skipping = False
            continue
        if _TAG.match(line):
            skipping, indent = True, depth
            continue
        if _LABEL.match(line):
            skipping, indent = True, depth
            continue
        m = re.match(r"^(?:Args?|Arguments|Params?|Parameters?|Returns?|Raises|Yields|Throws|Attributes|:return|:param)\s*:\s*\S", line)
        if m:
            skipping, indent = True, depth
            continue
        if skipping and (depth > indent or re.match(r"^[\w*$, \[\]]{1,60}?(?:\([^)]*\))?\s*:(?:\s|$)|^-+$", line)):
            continue
        skipping = False
        if _DIRECTIVE.match(line) or _MISSING.search(line) or _CODE.search(line) or not any(c.isalpha() for c in line):
            continue
        kept.append(_MARKUP.sub(" ", line))
    return "\n".join(kept)


def says_something(comment: str | None, name: str | None, params: list | None = None, least: int = 5) -> bool:
    """Has the comment at least `least` words of prose besides the words of the symbol's and its parameters' names?"""
    if not comment or not comment.strip():
        return False
    text = prose(comment)
    own = name_words(name, *(params or []))
    words = [w for w in _WORD.findall(text)]
    cjk = len(_CJK.findall(text))
    if cjk:
        words = [w for w in words if not _CJK.search(w)]
    n = cjk // 2
    for w in words:
        parts = name_words(w)
        if not (w.lower() in own or parts and parts <= own):
            n += 1
    return n >= least
