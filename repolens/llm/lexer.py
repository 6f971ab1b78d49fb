"""Lexers of the ten source languages, shared by the code-text operators.

:func:`scan` walks a text once and separates it into

* ``code``  - the text with every string literal replaced by ``""`` and every
  comment by a blank (line ends inside comments are kept),
* ``comments`` and ``strings`` - spans in the original text,
* ``error`` - an unterminated literal or comment, if there is one.

Only the starts of literals and comments are searched for, so the cost is that of a
few C-level regular expression searches per literal, not of a Python step per character.
Brackets are then matched by :func:`pushdown` on the remaining code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: File extensions of the ten languages.
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "c_sharp",
    ".kt": "kotlin", ".kts": "kotlin", ".php": "php",
}


def language_of(path: str | None, language: str | None = None) -> str | None:
    """The language the extension tells, else the given label if it is one of the ten, else None."""
    name = (path or "").rsplit("/", 1)[-1].lower()
    dot = name.rfind(".")
    found = EXTENSIONS.get(name[dot:]) if dot >= 0 else None
    if found:
        return found
    return language if language in set(EXTENSIONS.values()) else None


@dataclass
class Scan:
    code: str = ""
    comments: list = field(default_factory=list)  # (start, end, marker)
    strings: list = field(default_factory=list)  # (start, end)
    error: str | None = None


_STARTS = {
    "python": re.compile(r"""[#"']"""),
    "javascript": re.compile(r"""["'`/]"""),
    "typescript": re.compile(r"""["'`/]"""),
    "java": re.compile(r"""["']|//|/\*"""),
    "go": re.compile(r"""["'`]|//|/\*"""),
    "c": re.compile(r"""["']|//|/\*"""),
    "cpp": re.compile(r"""["']|//|/\*"""),
    "c_sharp": re.compile(r"""["']|//|/\*|^[ \t]*#.*""", re.M),
    "kotlin": re.compile(r"""["'`]|//|/\*"""),
    "php": re.compile(r"""["'`]|//|/\*|#(?!\[)|<<<(?=[ \t]*["'A-Za-z_])|\?>"""),
}
_DQ = re.compile(r'"(?:[^"\\\n]++|\\(?:\r\n|[\s\S]))*+"')
_SQ = re.compile(r"'(?:[^'\\\n]++|\\(?:\r\n|[\s\S]))*+'")
_DQ_ML = re.compile(r'"(?:[^"\\]++|\\[\s\S])*+"')
_SQ_ML = re.compile(r"'(?:[^'\\]++|\\[\s\S])*+'")
_BT_ML = re.compile(r"`(?:[^`\\]++|\\[\s\S])*+`")
_BT_RAW = re.compile(r"`[^`]*+`")
_T_DQ = re.compile(r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""')
_T_SQ = re.compile(r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''")
_VERBATIM = re.compile(r'"(?:[^"]++|"")*+"')
_LINE = re.compile(r"[^\r\n]*")
_C_LINE = re.compile(r"(?:[^\\\r\n]++|\\(?:\r\n|[\s\S]))*+")
_BLOCK = re.compile(r"/\*[\s\S]*?\*/")
_REGEX = re.compile(r"/(?:[^/\\\[\r\n]++|\\[^\r\n]|\[(?:[^\]\\\r\n]++|\\[^\r\n])*+\])++/[A-Za-z]*")
_CHAR = re.compile(r"'(?:\\[^\r\n][^'\r\n]{0,10}|[^'\\\r\n]{1,4})'")
_REGEX_BEFORE = re.compile(r"(?:^|[-(,=:\[!&|?{};+*%~^<>]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|yield|await))\s*$")
_HEREDOC = re.compile(r"""<<<[ \t]*(["']?)([A-Za-z_]\w*)\1[ \t]*\r?\n""")
_RAW_CPP = re.compile(r'"([^()\\\s]{0,16})\(')


def _nested(text: str, i: int, close: str, interpolate: str | None, multiline: bool, escape: bool = True) -> int:
    """End of a literal from i (after its opening quote) that may hold interpolated code; -1 if it doesn't end."""
    n, size = len(text), len(close)
    while i < n:
        c = text[i]
        if escape and c == "\\":
            i += 2
        elif text.startswith(close, i):
            return i + size
        elif c == "\n" and not multiline:
            return -1
        elif interpolate and text.startswith(interpolate, i):
            if interpolate == "{" and text.startswith("{{", i):
                i += 2
                continue
            i = _hole(text, i + len(interpolate))
            if i < 0:
                return -1
        else:
            i += 1
    return -1


def _hole(text: str, i: int) -> int:
    """End of interpolated code from i (after its opening brace)."""
    depth, n = 1, len(text)
    while i < n:
        c = text[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        elif c in "\"'`":
            if text.startswith(c * 3, i) and c != "`":
                j = text.find(c * 3, i + 3)
                i = j + 2 if j >= 0 else n
            else:
                i = _nested(text, i + 1, c, "${" if c == "`" else None, c == "`") - 1
                if i < 0:
                    return -1
        i += 1
    return -1


def scan(text: str, language: str) -> Scan:
    """One pass over the text in the given language (one of the ten)."""
    out = Scan()
    pieces: list[str] = []
    find, pos, n = _STARTS[language].search, 0, len(text)
    copied = 0
    if language == "php":
        i = re.search(r"<\?(?:php\b|=|(?=\s))", text)
        if not i:
            return Scan(code="", error="no code" if text.strip() else None)
        pos = copied = i.end()
    elif language in ("javascript", "typescript") and text.startswith("#!"):
        pos = copied = _LINE.match(text).end()
        out.comments.append((0, pos, "#!"))
    while m := find(text, pos):
        i, c = m.start(), m[0]
        end, comment = -1, None
        if c == "//":
            end, comment = (_C_LINE if language in ("c", "cpp") else _LINE).match(text, i).end(), "//"
            if language == "php" and (q := text.find("?>", i, end)) >= 0:
                end = q
        elif c == "/*":
            if language == "kotlin":
                depth, j = 0, i
                for t in re.compile(r"/\*|\*/").finditer(text, i):
                    depth += 1 if t[0] == "/*" else -1
                    if not depth:
                        j = t.end()
                        break
                end = j if not depth else -1
            else:
                end = (b.end() if (b := _BLOCK.match(text, i)) else -1)
            comment = "/*"
        elif c == "#":
            end, comment = _LINE.match(text, i).end(), "#"
            if language == "php" and (q := text.find("?>", i, end)) >= 0:
                end = q
        elif c == "?>":
            j = re.compile(r"<\?(?:php\b|=|(?=\s))").search(text, i)
            pieces.append(text[copied:i] + ";")
            pos = copied = j.end() if j else n
            continue
        elif c == "<<<":
            h = _HEREDOC.match(text, i)
            if h and (e := re.compile(r"^[ \t]*" + h[2] + r"\b", re.M).search(text, h.end() - 1)):
                end = e.end()
        elif c == "/":
            nxt = text[i + 1 : i + 2]
            if nxt == "/":
                end, comment = _LINE.match(text, i).end(), "//"
            elif nxt == "*":
                end, comment = (b.end() if (b := _BLOCK.match(text, i)) else -1), "/*"
            else:
                before = text[max(copied, i - 40) : i]
                b = None
                if _REGEX_BEFORE.search(before) and not before.rstrip().endswith(("++", "--")):
                    b = _REGEX.match(text, i)
                elif not before.strip() and pieces and _REGEX_BEFORE.search(pieces[-1][-40:]) and pieces[-1] not in ('""', '``'):
                    b = _REGEX.match(text, i)
                if not b:
                    pos = i + 1
                    continue
                end = b.end()
        elif c[0] in " \t#" or c.startswith("#"):
            end, comment = m.end(), "#pp"
        elif c == "`":
            if language == "go":
                end = b.end() if (b := _BT_RAW.match(text, i)) else -1
            elif language == "kotlin":
                end = b.end() if (b := re.compile(r"`[^`\r\n]+`").match(text, i)) else -1
                if end > 0:  # a quoted identifier
                    pieces.append(text[copied:i] + "quoted")
                    pos = copied = end
                    continue
            elif language == "php":
                end = b.end() if (b := _BT_ML.match(text, i)) else -1
            else:
                b = _BT_ML.match(text, i)
                end = b.end() if b and "${" not in b[0] else _nested(text, i + 1, "`", "${", True)
        elif c == "'":
            if language == "python":
                end = _python_string(text, i, c)
            elif language in ("javascript", "typescript"):
                end = b.end() if (b := _SQ.match(text, i)) else -1
            elif language == "php":
                end = b.end() if (b := _SQ_ML.match(text, i)) else -1
            else:
                if language in ("c", "cpp") and i and text[i - 1].isalnum() and text[i + 1 : i + 2].isalnum():
                    k = i - 1
                    while k >= 0 and (text[k].isalnum() or text[k] in "'_."):
                        k -= 1
                    if text[k + 1].isdigit():  # a digit separator
                        pos = i + 1
                        continue
                if language in ("c", "cpp") and text.rfind("\n", 0, i) < (h := text.rfind("#", 0, i)) and re.match(
                    r"[ \t]*#[ \t]*(?:error|warning)\b", text[text.rfind("\n", 0, i) + 1 : i]
                ):
                    pos = _LINE.match(text, i).end()
                    continue
                end = b.end() if (b := (_SQ if language in ("c", "cpp") else _CHAR).match(text, i)) else -1
                if end == i + 2:
                    end = -1
        elif c == '"':
            if language == "python":
                end = _python_string(text, i, c)
            elif language == "php":
                end = b.end() if (b := _DQ_ML.match(text, i)) else -1
            elif language in ("java", "kotlin") and text.startswith('"""', i):
                if language == "java":
                    end = b.end() if (b := _T_DQ.match(text, i)) else -1
                else:
                    j = text.find('"""', i + 3)
                    end = j + 3 if j >= 0 else -1
                    while 0 < end < n and text[end] == '"':
                        end += 1
            elif language == "kotlin":
                b = _DQ.match(text, i)
                end = b.end() if b and "${" not in b[0] else _nested(text, i + 1, '"', "${", False)
            elif language == "cpp" and text[max(0, i - 1) : i] == "R" and (b := _RAW_CPP.match(text, i)):
                j = text.find(")" + b[1] + '"', b.end())
                end = j + len(b[1]) + 2 if j >= 0 else -1
            elif language == "c_sharp":
                end = _sharp_string(text, i)
            else:
                end = b.end() if (b := _DQ.match(text, i)) else -1
        if end < 0:
            out.error = out.error or f"unterminated {'comment' if comment else 'literal'} at {i}"
            # go on after the opening mark, so that the rest is still seen
            end = _LINE.match(text, i).end() if not comment else n
        pieces.append(text[copied:i])
        if comment:
            out.comments.append((i, end, comment))
            lines = text.count("\n", i, end)
            pieces.append("\n" * lines if lines else " ")
        else:
            out.strings.append((i, end))
            pieces.append("``" if c == "`" else '""')
        pos = copied = end
    pieces.append(text[copied:])
    out.code = "".join(pieces)
    return out


def _python_string(text: str, i: int, quote: str) -> int:
    k = i
    while k > 0 and i - k < 2 and text[k - 1] in "rRbBuUfFtT":
        k -= 1
    prefix = text[k:i] if not (k and (text[k - 1].isalnum() or text[k - 1] == "_")) else ""
    triple = text.startswith(quote * 3, i)
    if prefix and set(prefix) & set("fFtT"):
        close = quote * (3 if triple else 1)
        plain = (_T_DQ if quote == '"' else _T_SQ) if triple else (_DQ if quote == '"' else _SQ)
        b = plain.match(text, i)
        if b and "{" not in b[0]:
            return b.end()
        end = _nested(text, i + len(close), close, "{", triple, not set(prefix) & set("rR"))
        return end if end >= 0 or not b else b.end()
    if triple:
        b = (_T_DQ if quote == '"' else _T_SQ).match(text, i)
    else:
        b = (_DQ if quote == '"' else _SQ).match(text, i)
    return b.end() if b else -1


def _sharp_string(text: str, i: int) -> int:
    before = text[max(0, i - 3) : i]
    if text.startswith('"""', i):
        k = i
        while text.startswith('"', k):
            k += 1
        j = text.find('"' * (k - i), k)
        return j + (k - i) if j >= 0 else -1
    marks = before[len(before.rstrip("@$")) :]
    if "@" in marks:
        b = _VERBATIM.match(text, i)
        return b.end() if b else -1
    if "$" in marks:
        b = _DQ.match(text, i)
        return b.end() if b and "{" not in b[0] else _nested(text, i + 1, '"', "{", False)
    b = _DQ.match(text, i)
    return b.end() if b else -1


_NOT_BRACKET = re.compile(r"[^(){}\[\]]+")
_PAIR = {")": "(", "]": "[", "}": "{"}


def pushdown(code: str) -> str | None:
    """Matches brackets with a stack; says what is wrong, or None."""
    stack: list[str] = []
    push, pop = stack.append, stack.pop
    for c in _NOT_BRACKET.sub("", code):
        if c in "([{":
            push(c)
        elif not stack or pop() != _PAIR[c]:
            return "unbalanced " + c
    return "premature end" if stack else None
