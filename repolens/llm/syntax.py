"""Is a text syntactically valid in its language? A lexer, a pushdown stack and rules on neighbouring tokens.

:func:`problem` names the first reason why a text can't be valid: an unterminated literal or comment,
unbalanced brackets, a premature end, a merge-conflict or template marker, stray binary characters, tokens that
can't follow each other (as in another language's text), or broken indentation. It errs on the side of "valid":
rules cover what no valid text contains. For Python, a text with a reason is put to the built-in parser as the
exact last word. ``script`` tells a Kotlin script (``.kts``), where statements may stand at the outermost level.
"""

from __future__ import annotations

import ast
import re
import warnings

from .lexer import pushdown, scan

_MARKERS = re.compile(r"^(?:<{7}|>{7}|\|{7}|={7})(?:[ \t]|\r?$)", re.M)
_MARKER_SIGNS = ("<" * 7, ">" * 7, "|" * 7, "=" * 7)
_TEMPLATE_SIGNS = ("<%", "%>", "{%", "%}", "@@", "{{")
_TEMPLATE = re.compile(r"\w[ \t]+\$?\{\{\s*\w+\s*\}\}")
_BINARY = re.compile("[\x00-\x08\x0e-\x1f\x7f�﷐-﷯￾￿]")
_PREPROCESSOR = re.compile(r"^[ \t]*#(?:[^\\\r\n]++|\\(?:\r\n|[\s\S]))*+", re.M)
_DIRECTIVE = re.compile(
    r"[ \t]*#[ \t]*(?:$|(?:include|include_next|define|undef|ifdef|ifndef|if|elifdef|elifndef|elif|else|endif|error|warning"
    r"|pragma|line|import|embed|ident|region|endregion|nullable|load|r|\d+)\b|!)"
)
_TOKEN = re.compile(
    r'[A-Za-z_$\x80-\U0010ffff][\w$]*(?:"")?|[;,(){}\[\]\n]|""|\.?\d(?:[eEpP][+-]|[\w.\'])*'
    r"|(?:\+\+|--|->|=>|::|\?\?=?|\?\.|\.\.\.|\.\.|&&=?|\|\|=?|===?|!==?|<=|>=|:=|<-|\*\*=?|[-+*/%&|^]=|//=?|``|\S)"
)
#: Marks that may stand right before a string literal.
_PREFIXES = frozenset("r b u f t l rb br fr rf tr rt lr ur u8 u8r".split())

_CONTROL = {"if", "while", "for", "switch"}
_COMMON = "break continue return else do try catch finally throw new case default class this super null true false".split()
# The languages' reserved words.
_KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from"
    " global if import in is lambda nonlocal not or pass raise return try while with yield match case type print exec".split(),
    "javascript": [*_COMMON, *_CONTROL, *"function var let const typeof instanceof in of void delete yield await async import export"
    " extends static get set from as with debugger enum".split()],
    "typescript": [*_COMMON, *_CONTROL, *"function var let const typeof instanceof in of void delete yield await async import export"
    " extends static get set from as with debugger enum type interface namespace module declare abstract readonly public private"
    " protected override is keyof infer asserts satisfies accessor implements global unique never unknown any require".split()],
    "java": [*_COMMON, *_CONTROL, *"package import public private protected static final abstract interface enum record extends"
    " implements throws synchronized volatile transient native strictfp instanceof assert void int long short byte char float double"
    " boolean var yield sealed permits non when".split()],
    "go": "package import func var const type struct interface map chan go defer return if else for range switch case default select"
    " break continue fallthrough goto".split(),
    "c": [*_CONTROL, *"break continue return else do case default goto sizeof typedef struct union enum static const extern inline"
    " register volatile restrict void int long short char float double signed unsigned bool auto".split()],
    "cpp": [*_COMMON, *_CONTROL, *"goto sizeof typedef struct union enum static const constexpr extern inline volatile void int long"
    " short char float double signed unsigned bool auto namespace using template typename public private protected virtual override"
    " operator friend explicit mutable noexcept decltype nullptr and or not xor bitand bitor compl co_await co_return co_yield"
    " final concept requires import module export".split()],
    "c_sharp": [*_COMMON, *_CONTROL, *"using namespace public private protected internal static readonly const abstract sealed"
    " override virtual partial async await interface struct enum record delegate event void int long short byte char float double"
    " decimal bool string object var foreach in is as out ref params where lock unchecked checked unsafe fixed get set init yield"
    " when and or not with switch base sizeof typeof nameof from select orderby join on equals into group by let ascending"
    " descending".split()],
    "kotlin": [*_COMMON, *_CONTROL, *"package import fun val var object interface when is as in out typealias companion data"
    " sealed open override internal private public protected lateinit inline suspend until downTo step by where init constructor"
    " get set to and or xor shl shr and infix operator tailrec external annotation enum inner abstract final const".split()],
    "php": [*_COMMON, *_CONTROL, *"function fn use namespace public private protected static abstract final interface trait enum"
    " extends implements echo print foreach as instanceof insteadof global const var elseif endif endwhile endfor endforeach"
    " endswitch require require_once include include_once and or xor clone list array match yield from readonly declare goto isset"
    " unset empty exit die int float string bool void mixed callable iterable self parent never object false null".split()],
}
_KEYWORDS = {k: frozenset(v) for k, v in _KEYWORDS.items()}
#: Words that may stand after a complete operand.
_AFTER = {
    "python": {"and", "or", "in", "is", "if", "else", "not", "for", "as", "import", "from", "async"},
    "javascript": {"in", "of", "instanceof", "as", "from", "with"},
    "typescript": {"in", "of", "instanceof", "as", "from", "with", "is", "satisfies", "extends", "implements", "keyof", "asserts"},
    "java": {"instanceof", "when", "implements", "extends", "throws", "permits"},
    "go": {"range", "case", "default"},
    "c": set(),
    "cpp": {"and", "or", "xor", "bitand", "bitor", "not_eq", "and_eq", "or_eq", "noexcept", "override", "final", "const", "requires"},
    "c_sharp": {"is", "as", "in", "switch", "with", "when", "and", "or", "where", "into", "on", "equals", "by", "select", "from",
                "orderby", "join", "let", "group", "ascending", "descending", "not"},
    "kotlin": set(),
    "php": {"and", "or", "xor", "instanceof", "as", "from", "insteadof", "use"},
}
_BINARY_OPS = frozenset("= == === != !== <= >= + - / % += -= *= /= %= |= ^= || ^ | := => ??".split())
_CLOSE = frozenset(") ] } ; ,".split())
_FIRST_JAVA = frozenset(
    "package import @ public private protected abstract final class interface enum record sealed non static strictfp open module ; void".split()
)
_NO_HASH, _NO_TICK, _NO_AT = {"java", "go", "kotlin"}, {"c", "cpp", "java", "c_sharp", "python", "go", "kotlin"}, {"c", "cpp", "go"}
_NAMES = {"java": 3, "c_sharp": 4, "c": 5, "cpp": 5, "kotlin": 7, "go": 4, "php": 3, "javascript": 3, "typescript": 4}


class _Kinds(dict):
    """Token -> its kind in one language; learns tokens as they come and forgets them all when there are many."""

    def __init__(self, language: str):
        self.words, self.language = _KEYWORDS[language], language

    def __missing__(self, t: str) -> str:
        if len(self) > 100_000:
            self.clear()
        c = t[0]
        if t[-1] == '"':
            loose = len(t) > 2 and t[:-2].lower() not in _PREFIXES
            k = "NS" if loose and self.language not in ("c", "cpp") else "S"
            if loose and t[:-2] in self.words:
                k = "S"
        elif t == "``":
            k = "T"
        elif t == "\n":
            k = "\n"
        elif c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            k = "0"
        elif c == "$" and len(t) > 1:
            k = "V" if self.language == "php" else "N"
        elif c.isidentifier() or c == "$" and self.language != "python":
            k = t if t in self.words else "N"
        else:
            k = t
        self[t] = k
        return k


_OF = {k: _Kinds(k) for k in _KEYWORDS}


def _kinds(tokens: list[str], language: str) -> list[str]:
    return list(map(_OF[language].__getitem__, tokens))


def _word(k: str) -> bool:
    return k in ("N", "V") or k[0].isidentifier() and k not in ("S", "T", "NS", "EOF", "NL")


def _clash(a: str, b: str, language: str) -> bool:
    """Can no valid text have token kind b right after a? Line ends count as tokens where they end statements."""
    after = _AFTER[language]
    if "NS" in (a, b):
        return b == "NS"
    if a in _BINARY_OPS and (b in _CLOSE or b == "EOF"):
        if a == "=" and b in ("]", ",") and language == "cpp" or a in ("/", "|") and language in ("python", "typescript"):
            return False
        if a == "=>" and language == "php" or a == "-" and language == "php":
            return b == "EOF"
        if a in ("|", "-", "+", "==", "=", "/", "%", "^", "<=", ">=") and language == "cpp":  # operator names, macros
            return b in (";", "EOF") and a != "="
        return not (a == "=" and language in ("c_sharp", "kotlin", "go"))
    if ":=" in (a, b) and language not in ("go", "python"):
        return True
    if "::" in (a, b) and language in ("c", "go", "javascript", "typescript"):
        return a != "[" and b != "["
    if b == "import" and language == "kotlin" and a not in ("\n", ";", "}", "package"):
        return True
    if a == "import" and b in ("{", "*", "S") and language in ("kotlin", "java", "c_sharp", "c"):
        return True
    if a == "(" and b == "," or a == "," and (b == ";" or b == "EOF" and language != "python"):
        return True
    if a == "," and b == ")" and language in ("java", "c", "c_sharp"):
        return True
    if a == "EOF":
        return False
    if b == "0" and a in ("N", "V", "0", "S", "T", "]"):
        return language != "kotlin" or a in ("0", "S")
    if a in ("0", "S", "T") and _word(b) and b not in after:
        if language == "kotlin":
            return b == "V" or a == "S" and b in _KEYWORDS["kotlin"] - {"to", "and", "or", "in", "is", "as", "else", "until"}
        if language in ("c", "cpp") and a == "S":
            return False  # macros and literal suffixes
        if language == "go" and a == "S":
            return True
        if b == "else" and language == "python":
            return False
        return True
    if a in ("S", "0") and b == "S" and language in ("java", "javascript", "typescript", "go", "c_sharp", "kotlin", "php"):
        return True
    if language in ("javascript", "typescript"):
        if a == "N" and b in ("N", "S"):
            return True
        if a == "function":
            return not (_word(b) or b in ("(", "*", ":", ";", ")", ",", "[", "="))
        return a in ("@",) and not (_word(b) or b == "(")
    if language == "python":
        if a in ("N", ")", "]", "}", "0", "S") and _word(b) and b not in after:
            return True
        if a == "N" and b in ("S", "{"):
            return True
        if a in ("def", "class"):
            return b != "N" and b not in ("match", "case", "type", "print", "exec")
        return a in ("?", "$") or b in ("?", "$", "!") or a in ("++",) and b in ("NL", ")")
    if language == "php":
        if a == "V" and (_word(b) or b == "S") and b not in after:
            return True
        if a == "N" and b == "S":
            return True
        if a == "function":
            return not (_word(b) or b in ("(", "&"))
        return False
    if language == "java":
        if a in ("int", "long", "short", "byte", "char", "float", "double", "boolean", "void"):
            return not (b == "N" or b in ("[", ")", "...", "::", ".", ">", ",", "@", "record", "yield", "var", "permits", "when"))
        return a == "N" and b == "S"
    if language == "c_sharp" and a == "N" and b == "S":
        return True
    if language == "go" and a == "func":
        return not (b in ("N", "("))
    if language == "kotlin" and a == "fun":
        return not (_word(b) or b in ("<", "(", "@"))
    return False


_KNOWN: dict[str, set] = {}


def _neighbours(kinds: list[str], language: str) -> str | None:
    known = _KNOWN.setdefault(language, set())
    for pair in set(zip(kinds, kinds[1:], strict=False)) - known:
        if language == "python" and "\n" in pair:
            pair = ("NL" if pair[0] == "\n" else pair[0], "EOF" if pair[1] == "\n" else pair[1])
        if "\n" not in pair and _clash(*pair, language):
            return f"{pair[1]} after {pair[0]}"
        known.add(pair)
    return None


_INNERMOST = re.compile(r"\([^(){}\[\]]*\)|\{[^(){}\[\]]*\}|\[[^(){}\[\]]*\]")
_SHUT = {"(": "\x01", "{": "\x02", "[": "\x03"}
# Words that open a declaration at the outermost level, or that can't.
_OPENS = {
    "go": frozenset("package import const var type func".split()),
    "java": _FIRST_JAVA,
    "kotlin": frozenset(
        "package import fun val var class interface object typealias enum data sealed abstract open annotation inline private public internal protected"
        " suspend operator infix const tailrec external expect actual value override lateinit final inner companion quoted by get set where".split()
    ),
}
_NEVER_OPENS = {
    "c": frozenset("public private protected class namespace using import package function let fun val export def template interface internal func from elif".split()),
    "cpp": frozenset("public private protected package function let fun val interface def internal func from elif".split()),
    "c_sharp": frozenset("package import function let fun val def func from elif export".split()),
}
_START_OF = re.compile(r"(?:^|[;\x02])\s*([A-Za-z_@#$]\w*|\S)")
_LINE_START = re.compile(r"^([A-Za-z_$]\w*|[^\s])", re.M)
_TYPED_SCRIPT = re.compile(r"\b(?:let|const|var)\s+[\w$]+\s*:|\(\s*[A-Za-z_$][\w$]*\s*\??:\s*[\w$]|\)\s*:\s*[\w$.<>\[\]| ]+\{|^\s*(?:export\s+)?(?:interface\s+\w+[^;(){}]*\{|type\s+\w+\s*(?:<[^>]*>)?\s*=|enum\s+\w+\s*\{)|^\s*(?:public|private|protected|readonly)\s+\w+", re.M)
_PYTHONIC = re.compile(r"^[ \t]*(?:async[ \t]+)?(?:def[ \t]+\w+[ \t]*\(.*|class[ \t]+\w+[^{;]*|elif\b.*|if\b[^{]*|for\b[^{]*|while\b[^{]*|else|try)(?<!default):[ \t]*$", re.M)


def _outermost(code: str) -> str:
    """The code with everything inside brackets folded away."""
    while True:
        code, n = _INNERMOST.subn(lambda m: _SHUT[m[0][0]], code)
        if not n:
            return code


def _foreign(code: str, language: str, script: bool) -> str | None:
    """Signs of another language: words that can't open a declaration, typed parameters in plain script, Python's blocks."""
    if language in ("go", "java") or language == "kotlin" and not script:
        starts = (_LINE_START if language != "java" else _START_OF).findall(_outermost(code))
        for w in starts:
            if w not in _OPENS[language] and not (w in ("@", "\x01", "\x02", "\x03", "}", ")", "]", ";") or w.startswith("@")) and (w[0].isalpha() or w[0] in "_#<-*{"):
                return w + " opens no declaration"
    elif language in _NEVER_OPENS:
        for w in set(_START_OF.findall(_outermost(code))) & _NEVER_OPENS[language]:
            return w + " opens no declaration"
    if language == "javascript" and _TYPED_SCRIPT.search(code):
        for m in _TYPED_SCRIPT.finditer(code):
            before = code[max(0, m.start() - 200) : m.start()].rsplit("\n", 1)[-1]
            if not (m[0].lstrip().startswith((")", "(")) and ("?" in before or "case " in before)):
                return "typed script"
    if language not in ("python", "javascript", "typescript") and _PYTHONIC.search(code):
        for m in _PYTHONIC.finditer(code):
            if m[0].lstrip().startswith(("def", "elif", "class")) and not (language in ("kotlin", "cpp", "c_sharp") and m[0].lstrip().startswith("class")):
                return "another language"
    return None


def problem(text: str | None, language: str, script: bool = False) -> str | None:
    """Why the text isn't valid in the language, or None if nothing speaks against it. Null, blank and comment-only texts are valid."""
    if not text or not text.strip():
        return None
    text = text.removeprefix("﻿")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    found = _problem(text, language, script)
    if found and language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return None
        except (SyntaxError, ValueError):
            return found
        except (RecursionError, MemoryError):
            return found
    return found


def _problem(text: str, language: str, script: bool = False) -> str | None:
    s = scan(text, language)
    code = s.code
    if s.error == "no code":
        return None
    if s.error:
        return s.error.split(" at ")[0]
    if not code.strip():
        return None
    if any(x in code for x in _MARKER_SIGNS) and _MARKERS.search(code):
        return "merge-conflict marker"
    for x in _TEMPLATE_SIGNS:
        if x in code and not (x in ("<%", "%>") and language in ("c", "cpp", "php") and not re.search(r"<%=?\s*\w+\s*%>", code) or x == "@@" and language == "php"):
            if x != "{{" or _TEMPLATE.search(code):
                return "template marker " + x
    if _BINARY.search(code):
        return "binary characters"
    if language in ("c", "cpp"):
        for m in _PREPROCESSOR.finditer(code):
            if not _DIRECTIVE.match(m[0]):
                return "no directive"
        plain = _PREPROCESSOR.sub("", code)
        if (b := pushdown(plain)) and (plain is code or pushdown(code)):
            if not re.search(r"^[ \t]*#[ \t]*(?:else|elif)", code, re.M):
                return b
        code = plain
        if not code.strip():
            return None
    else:
        if language == "c_sharp":
            for a, e, kind in s.comments:
                if kind == "#pp" and not _DIRECTIVE.match(text[a:e]):
                    return "no directive"
        if b := pushdown(code):
            return b
    if language == "python":
        return _python(code)
    tokens = _TOKEN.findall(code)
    if language not in ("javascript", "typescript", "go", "kotlin"):
        tokens = [t for t in tokens if t != "\n"]
    else:
        while tokens and tokens[-1] == "\n":
            tokens.pop()
        while tokens and tokens[0] == "\n":
            del tokens[0]
    kinds = _kinds(tokens, language)
    plain = [k for k in kinds[:12] if k != "\n"]
    first, second = plain[0] if plain else "", plain[1] if len(plain) > 1 else ""
    if first in ("{", "<") and (first == "<" and not text.lstrip().startswith("<>") or second in ("S", "}", "N")) and language != "php":
        if not (language == "kotlin" or language == "c_sharp" and first == "{") or second == "S" or first == "<":
            return "starts as another format"
    if first == "N" and second == ":" and language not in ("php",) or first in ("-", "*") and language not in ("javascript", "typescript", "php"):
        return "starts as another format"
    if language == "go" and first != "package":
        return "no package clause"
    if language == "java" and first not in _FIRST_JAVA:
        return "no declaration"
    if language in ("java", "c_sharp", "c", "cpp") and kinds[-1] not in ("}", ";", ")", "]"):
        return "premature end"
    if language == "java" and kinds[-1] not in ("}", ";"):
        return "premature end"
    if "#" in kinds and (language in _NO_HASH or language in ("c", "cpp") or language in ("javascript", "typescript") and re.search(r"#(?!\w)", code)):
        return "stray #"
    if "`" in kinds and language in _NO_TICK or "@" in kinds and language in _NO_AT:
        return "stray mark"
    if found := _neighbours([*kinds, "EOF"], language):
        return found
    if found := _foreign(code, language, script):
        return found
    if language in ("javascript", "typescript"):
        if re.search(r"\bfunction\b\s*\*?\s*[\w$]+\s*\([^()]*\)\s*$", code) and language == "javascript":
            return "premature end"
        if ("def " in code or "fun" in code) and re.search(r"^[ \t]*(?:def|elif|fun|func)[ \t]+\w+", code, re.M) and re.search(r":[ \t]*$", code, re.M):
            return "another language"
    for word in _CONTROL & set(kinds) if language not in ("go", "kotlin", "javascript", "typescript") else ():
        i = kinds.index(word)
        while i >= 0:
            nxt = kinds[i + 1] if i + 1 < len(kinds) else "EOF"
            if nxt != "(" and not (i and kinds[i - 1] in (".", "->", "::", "?.", "@", "?->", "case", "default")) and not (
                word == "if" and language == "cpp" or word == "switch" and language == "c_sharp" or nxt in (":", "=", ",", ")", "await", "!")
            ):
                return f"{nxt} after {word}"
            try:
                i = kinds.index(word, i + 1)
            except ValueError:
                break
    if language == "kotlin" and re.search(r"(?:^|[({,;=\n] )N N (?:[=;,)]|\n)", " ".join(kinds)):
        return "N after N"
    most = _NAMES[language]
    run = "N " * most
    flat = " ".join(kinds) + " "
    if (" " + run) in (" " + flat) and not (language in ("c", "cpp") and not re.search(r"(?:\w+[ \t]+){%d}\w+[.,]?[ \t]*\n" % most, code)):
        return "prose"
    return None


_PY_HEAD = re.compile(r"(?:async[ \t]+)?(if|elif|else|for|while|def|class|try|except|finally|with)\b")
_PY_SOFT = re.compile(r"(?:match|case)\b")
_BRACKETS = re.compile(r"[(){}\[\]]")


def _python(code: str) -> str | None:
    """Logical lines, indentation and neighbours of a Python text without literals and comments."""
    indents, expects, depth, logical, parts = [0], False, 0, [], []
    for line in code.split("\n"):
        if not depth and not parts:
            bare = line.strip()
            if not bare:
                continue
            body = line.lstrip(" \t\f")
            width = len((line[: len(line) - len(body)]).expandtabs(8))
            if expects:
                if width <= indents[-1]:
                    return "no indented block"
                indents.append(width)
            elif width != indents[-1]:
                while indents and width < indents[-1]:
                    indents.pop()
                if not indents or width != indents[-1]:
                    return "wrong indentation"
            expects = False
        for c in _BRACKETS.findall(line):
            depth += 1 if c in "([{" else -1
        stripped = line.rstrip()
        if stripped.endswith("\\"):
            parts.append(stripped[:-1])
            continue
        parts.append(line)
        if depth > 0:
            continue
        depth = 0
        whole = parts[0] if len(parts) == 1 else " ".join(parts)
        parts = []
        whole = whole.strip()
        logical.append(whole)
        if _PY_HEAD.match(whole):
            if whole.endswith(":"):
                expects = True
            elif ":" not in whole:
                return "no colon"
        elif whole.endswith(":"):
            if _PY_SOFT.match(whole):
                expects = True
            else:
                return "stray colon"
    if expects:
        return "premature end"
    kinds = _kinds(_TOKEN.findall("\n".join(logical)), "python")
    return _neighbours([*kinds, "EOF"], "python")
