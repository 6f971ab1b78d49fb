"""Credentials inside source text: candidates, entropy per alphabet, exclusions and masking.

Candidates are all long tokens, quoted or not, and the quoted strings and tokens of any length that stand in a telling place
(after a telling name, in a header, in an address, beside an account, as second argument of a log-in call, inside key
armour). A candidate is a credential if its Shannon entropy reaches a share of what a random value of its length over its
alphabet can have, and it isn't a placeholder, a reference, a checksum, an identifier or running words. The place is one
feature: it says how large a share is asked for (`SHARES`).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick

_NAMES = (
    r"pass(?:w(?:or)?d|phrase|code)?|pwd|pw|secret|token|tok|api[_.-]?key|(?:access|auth|service|signing|private|secret|encryption|account|master"
    r"|client|login|deploy|license|shared|storage|subscription|hmac|jwt|webhook|admin|app|rest)[_.-]?key|auth|authorization|credentials?|creds?|bearer|apikey|access[_.-]?id[_.-]?secret"
)
# One Aho-Corasick pass over the lower-cased text finds every place worth a look; the place's own pattern then decides.
# What such places begin with.
_SIGNS = {
    "url": ["://"],
    "pem": ["-----begin "],
    "call": ['("', "('"],
    "pair": [" / "],
    "shape": ["eyj", "_live_", "_prod_", "_srv_", "_test_", "_dev_", "_stage_", "_staging_", "_sk_", "_pk_", "akia", "asia", "ghp_",
              "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "npm_", "pypi-", "aiza", "hf_", "sg."],
    "scheme": ["bearer ", "basic ", "token ", "digest ", "apikey ", "negotiate "],
    "header": ["x-"],
    "key": ["pass", "pwd", "secret", "token", "tok", "key", "auth", "cred", "bearer", "pw"],
}
_PATTERNS = {
    "url": re.compile(r"://[^\s/:@\"'`<>]*+:"),
    "pem": re.compile(r"-----BEGIN "),
    "call": re.compile(r"\((?=[\"'][\w.@+-]+[\"']\s*,\s*[\"'])"),
    "shape": re.compile(r"(?:eyJ(?=[\w-]{8,}\.)|[a-z]{2,6}_(?:live|prod|srv|test|dev|stage|staging|sk|pk)_|AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|npm_|pypi-|AIza|hf_|SG\.)"),
    "scheme": re.compile(r"(?<![A-Za-z])(?:Bearer|Basic|Token|Digest|ApiKey|Negotiate|bearer|basic|token) +(?=\S{8})"),
    "header": re.compile(r"(?<![A-Za-z-])[Xx]-[A-Za-z-]{2,}+: *(?=[\w+/=.~-]{12})"),
    "pair": re.compile(r"(?<=\w) / (?=[^\s/]{6})"),
    "key": re.compile(
        r"(?:[Pp]ass(?:w|phrase|code|\b|_|\d|[A-Z])|PASS|[Pp]wd|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|(?:(?<=[a-z_])T|(?<=_)t|\bt)ok(?![a-z])|TOK\b"
        r"|[Kk]ey(?![a-z])|KEY|[Aa]uth|AUTH|[Cc]red|CRED|[Bb]earer|BEARER|(?<![a-z])[Pp]w(?![a-z])|PW\b)"
    ),
}
_AUTOMATON = ahocorasick.Automaton()
for _kind, _signs in _SIGNS.items():
    for _sign in _signs:
        _AUTOMATON.add_word(_sign, (_kind, len(_sign)))
_AUTOMATON.make_automaton()


def _places(text: str):
    """(kind, match) of every telling place, in order."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for end, (kind, size) in _AUTOMATON.iter(low):
        i = end - size + 1
        if kind == "shape" and low[i] == "_":
            k = i
            while k > 0 and i - k < 6 and "a" <= text[k - 1] <= "z":
                k -= 1
            i = k
        if kind == "shape" and i and text[i - 1].isalnum():
            continue
        m = _PATTERNS[kind].match(text, i)
        if m:
            yield kind, m


_SEPARATOR = re.compile(
    r"""[\w.\-]*+(?:\\?["'`\]])?(?:\s*:\s*(?:[\w<>\[\]?.]+(?:::[\w<>]+)*)\s*(?==)|\s*\[\s*\d*\s*\]\s*(?==))?[ \t]*(?P<sep>=>|:=|==?|:|,|\()[ \t]*(?:\r?\n[ \t]*(?=["'`]))?(?:[|>][-+]?[ \t]*\r?\n[ \t]*)?(?:(?:@|\$|[rbuRBU])(?=["']))?"""
)
_QUOTED = re.compile(r'"(?P<d>(?:[^"\\\r\n]|\\.)*)"|\'(?P<s>(?:[^\'\\\r\n]|\\.)*)\'|`(?P<b>[^`\r\n]*)`')
_JOIN = re.compile(r"\s*(?:\\\r?\n\s*|\+|\.(?!\w)|&|\.\.)?\s*(?:\\?\r?\n\s*)?(?:\+\s*)?")
_BARE = re.compile(r"[^\s\"'`,;()\[\]{}<>|\\]+")
_URL_REST = re.compile(r"(?P<pw>[^\s/\"'`<>@]+(?:@[^\s/\"'`<>@]*?)?)@(?=[\w\[])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_MARKS = r"(?:[\s\"'`+.,;:()\[\]#*>|/{}&-]|\\[nrt\\])*"
_PEM_LINE = re.compile(_MARKS + r"(?:[A-Z][\w-]+: [^\r\n]*|(?P<run>(?:\\[nrt\\]|[A-Za-z0-9+/=])*))" + _MARKS)
_IN_LINE = re.compile(r"(?:\\[nrt]|[A-Za-z0-9+/=])*+")
_CALL = re.compile(r"\([\"'](?P<user>[\w.@+-]+)[\"']\s*,\s*(?P<q>[\"'])(?P<pw>[^\"'\r\n]{6,})(?P=q)")
_SHAPE = re.compile(r"[\w+/=.~-]{16,}")

# What stands where a secret would stand but isn't one.
_PLACEHOLDER = re.compile(
    r"change[-_ ]?(?:me|it|this)|your[-_ ]|[-_ ]here\b|placeholder|(?<![a-z])(?:example|dummy|sample|insert|replace|todo|fixme|hidden|fake|masked)(?![a-z])|redacted|set[-_]?me|<[^>]*>|\*{3,}|x{4,}|X{4,}|\.{3,}|\u2026"
    r"|^(?:none|null|nil|undefined|true|false|yes|no|password|passwd|secret|token|test|testing|default|empty|unset|n/?a|foo|bar|baz|admin|root|guest|user)$|^0+$|^(.)\1+$|not[-_ ]?(?:set|a[-_ ]?secret)|dont[-_]?use|abc123|123456",
    re.I,
)
_REFERENCE = re.compile(
    r"\$\{|\$\(|^\$\w+$|\{\{|\}\}|%\(|%\w+%|^%[sdv]$|^\{\w*\}$|#\{|<%|\benv[.\[(:/]|getenv|environ|^(?:vault|env|ssm|secretsmanager|aws-?sm|gcp-?sm|keyvault|op|sops|ref|file|kms|doppler|arn|azure-?kv|k8s|secret|secrets|sm)[:+/]|^ENC\[|\bprocess\.|\bsecrets?\.|\bvault\b|^@|^/run/secrets|^(?:/|\./|\.\./|~/)[\w./-]+$"
)
_HEX = re.compile(r"[0-9a-fA-F]+")
_WORD_RUN = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}|\d{5,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_WORDS = re.compile(r"[A-Za-z]?[a-z]+(?:[-_./: ,][A-Za-z]?[a-z]+)*[.!?]?")
_CAMEL = re.compile(r"[A-Za-z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*\d{0,2}|[A-Z]+(?:_[A-Z]+)*\d{0,2}")
_PLAIN = re.compile(
    r"[-+]?[\d.,:]+(?:[a-zA-Z%]{1,3})?|v?\d+(?:\.\d+)+[\w.-]*|\d{4}-\d\d-\d\d[\dT:.Z+-]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?:[a-z][\w+.-]*://).*|(?:[a-z0-9-]+\.)+[a-z]{2,}(?::\d+)?(?:/.*)?|sha\d+[-:].*|md5:.*|data:.*|[a-z]+/[\w.+-]+"
)
_NOT_SECRET_NAME = re.compile(r"(?i)(?:sha\d*|hash|checksum|digest|md5|commit|trace|span|request|correlation|etag|integrity|fingerprint|public|pub|uuid|guid|nonce|cursor|icon|png|image|count|len|size|limit|label|name|type|expir\w*|ttl|url|uri|path|file|id|header|prefix|field|column|budget)$")
_TRAILER = re.compile(r"(?i)[_.\-]?(?:old|new|prev|previous|current|prod|dev|live|staging|stage|test|value|val|str|string|text|raw|plain|default|primary|secondary|main|backup|b64|base64|\d+)$")


def entropy(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


#: Share of the highest entropy that is asked for: where only the value can tell, where the place hints at a secret, where it says so.
SHARES = (0.85, 0.72, 0.6)


def threshold(value: str, strength: int = 1) -> float:
    """Least entropy of a credential: the share of its place of the most a value of this length over this alphabet can have.
    A value of n characters can't exceed log2(n), whatever its alphabet."""
    n = len(value)
    size = 16 if _HEX.fullmatch(value) else 36 if value.lower() == value or value.upper() == value else 62
    if any(not c.isalnum() for c in value):
        size += 32
    return SHARES[strength] * math.log2(max(2, min(n, size)))


def _classes(v: str) -> int:
    return any(c.islower() for c in v) + any(c.isupper() for c in v) + any(c.isdigit() for c in v) + any(not c.isalnum() for c in v)


def _wordy(v: str) -> bool:
    """Does the value consist of words and numbers for the most part, as paths and compound identifiers do?"""
    return 2 * sum(len(m) for m in _WORD_RUN.findall(v)) > len(v)


def is_secret(value: str, strength: int) -> bool:
    """strength 2: the place says a secret stands here; 1: the place hints at it; 0: only the value itself can tell."""
    v = value.strip()
    n = len(v)
    if n < (20, 12, 6)[strength] or any(c in v for c in " \t\r\n"):
        return False
    if _PLACEHOLDER.search(v) or _REFERENCE.search(v) or _PLAIN.fullmatch(v):
        return False
    if _WORDS.fullmatch(v) or _CAMEL.fullmatch(v):
        return False
    if _HEX.fullmatch(v) or _UUID.fullmatch(v):  # a checksum or an identifier, unless the place says otherwise
        return strength == 2 and n >= 16 and entropy(v) >= threshold(v, 2)
    classes = _classes(v)
    if classes < 2 or n < 8 and classes < 3:
        return False
    if strength < 2 and (classes < 3 or n < 16 or not any(c.isdigit() for c in v)):
        return False
    if strength == 0 and (_wordy(v) or not (any(c.islower() for c in v) and any(c.isupper() for c in v))):
        return False
    return entropy(v) >= threshold(v, strength)


def _name_before(text: str, i: int) -> str:
    """The name that ends before i; its end decides, so of a very long one the last 200 characters are enough."""
    j = i
    while j > 0 and i - j < 200 and (text[j - 1].isalnum() or text[j - 1] in "_.-$"):
        j -= 1
    return text[j:i]


_LAST = re.compile(r"(?i)(?:^|[_.\-$a-z0-9])(?:" + _NAMES + r")$")


def _strength(name: str) -> int:
    for _ in range(3):
        shorter = _TRAILER.sub("", name)
        if shorter == name or not shorter:
            break
        name = shorter
    if _NOT_SECRET_NAME.search(name):
        return 0
    return 2 if _LAST.search(name) else 1


def _key_end(text: str, i: int) -> int:
    """Where the body of an armoured key ends that begins at i: before its end mark, else behind the last line that can belong to it."""
    end = text.find("-----END ", i)
    at = last = i
    while at < len(text):
        e = text.find("\n", at)
        e = len(text) if e < 0 else e
        if at <= end < e:
            return end if _PEM_LINE.fullmatch(text, at, end) else last
        m = _PEM_LINE.fullmatch(text, at, e)
        if not m:
            # the rest of the armour's own line, up to the end of its literal
            return _IN_LINE.match(text, i).end() if at == i else last
        last = e
        if m["run"] and len(m["run"]) < 16 and at > i and (end < 0 or text.count("\n", e, end) > 1):
            break  # only the last line of a key is short
        at = e + 1
    return last


def find(text: str | None, config: bool = False) -> list[tuple[int, list[tuple[int, int]]]]:
    """(start, spans to mask) of each credential in a text, by start. config: the text is a settings file."""
    if not text:
        return []
    found, skipped = _told(text, config)
    for start, end in _untold(text, found, skipped):
        found[start] = [(start, end)]
    return sorted(found.items())


_TOKEN = re.compile(r"(?<![\w+/.~-])[\w+/.~-]{20,}+={0,2}")
_NEUTRAL_MOST = 128  # a longer literal without a telling name holds data, not a credential
_NAMED = re.compile(r"([\w.$-]+)[\"'\]]?\s*(?:=>|:=|=|:)\s*[\"'`]?$")
_ALONE = re.compile(r"[\s\"'`+,.;()\[\]{}\\]*+")
_DATA_LINE = re.compile(r"[\s\"'`+,.;()\[\]{}\\]*+[\w/=~-][\w+/=.~-]{19,}[\s\"'`+,.;()\[\]{}\\]*")


def _untold(text: str, found: dict, skipped: list) -> list[tuple[int, int]]:
    """Long tokens outside telling places that are credentials by their entropy alone.

    Left out: checksums and identifiers by name, addresses, what stands in data: addresses and public keys, lines of a longer literal."""
    out: list[tuple[int, int]] = []
    taken = sorted([x for spans in found.values() for x in spans] + skipped)
    k = 0
    for m in _TOKEN.finditer(text):
        a = m.start()
        v = m[0].rstrip(".-")
        e = a + len(v)
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < e or len(v) > _NEUTRAL_MOST or not is_secret(v, 0):
            continue
        begin = text.rfind("\n", 0, a) + 1
        before = text[max(begin, a - 200) : a]
        named = _NAMED.search(before)
        if "://" in before.rsplit(" ", 1)[-1] or before.endswith(("/", "@", "\\")) or _data_before(text, a) or v.startswith("AAAA") or named and _NOT_SECRET_NAME.search(named[1]):
            continue
        if _part_of_data(text, begin, a, e):
            continue
        out.append((a, e))
    return out


def _part_of_data(text: str, begin: int, a: int, e: int) -> bool:
    """Is the token at a..e, on the line that begins at `begin`, a line of a longer literal: before another such
    line, or alone on its line and behind one or of the length encoders give lines?"""
    stop = text.find("\n", e)
    stop = len(text) if stop < 0 else stop
    if not _ALONE.fullmatch(text, e, stop):
        return False
    after = text.find("\n", stop + 1)
    if _DATA_LINE.fullmatch(text, stop + 1, len(text) if after < 0 else after):
        return True
    if not _ALONE.fullmatch(text, begin, a):
        return False
    before = text.rfind("\n", 0, max(0, begin - 1)) + 1
    return e - a in (64, 76) or bool(begin and _DATA_LINE.fullmatch(text, before, begin - 1))


def _told(text: str, config: bool) -> tuple[dict[int, list[tuple[int, int]]], list[tuple[int, int]]]:
    """Credentials in telling places, and the spans of public keys, certificates and the like."""
    found: dict[int, list[tuple[int, int]]] = {}
    skipped: list[tuple[int, int]] = []
    done = tested = -1
    for kind, m in _places(text):
        i, j = m.start(), m.end()
        if i < done:
            continue
        if kind == "pem":
            p = _PEM.match(text, i)
            if p:
                a, e = p.end(), _key_end(text, p.end())
                body = text[a:e].replace("\\r", "").replace("\\n", "\n")
                packed = re.sub(r"[^A-Za-z0-9+/=]", "", "\n".join(x for x in re.split(r"[\n\"']", body) if ":" not in x))
                if len(packed) >= 24 and len(set(packed)) > 10 and not _PLACEHOLDER.search(body[:400]):
                    found[i] = [(a, e)]
                done = e
            else:
                armour = text.find("-----", j, j + 80)
                done = _key_end(text, armour + 5 if armour >= 0 else j)
                skipped.append((i, done))
        elif kind == "pair":
            p = _BARE.match(text, j)
            if p and _ACCOUNT.search(text, max(text.rfind("\n", 0, i) + 1, i - 200), i):
                v = p[0].rstrip(".")
                if is_secret(v, 2):
                    found[j] = [(j, j + len(v))]
                    done = j + len(v)
        elif kind == "url":
            p = _URL_REST.match(text, j)
            if p and p["pw"]:
                pw = p["pw"]
                if is_secret(pw, 2):
                    found[j] = [(j, p.end("pw"))]
                    done = p.end()
        elif kind == "call":
            p = _CALL.match(text, i)
            if p and not _NOT_CALL.search(text[max(0, i - 40) : i]):
                user, pw = p["user"], p["pw"]
                caller = _name_before(text, i)
                sure = re.search(r"(?i)(?:_svc|_user|_admin|_bot|svc|user|admin|bot|root|account|@\w+)$", user) or re.search(r"(?i)login|connect|auth|signin|sign_in|logon|bind|credential", caller)
                if sure and pw != user and is_secret(pw, 2):
                    found[p.start("pw")] = [p.span("pw")]
        elif kind == "shape":
            p = _SHAPE.match(text, i)
            if p and len(p[0]) >= 20 and not _PLACEHOLDER.search(p[0]) and entropy(p[0]) > 3 and (m[0] != "eyJ" or "." in p[0]) and not _data_before(text, i):
                q = p.end() - (len(p[0]) - len(p[0].rstrip(".")))
                found.setdefault(i, [(i, q)])
                done = q
        elif kind in ("scheme", "header"):
            p = _BARE.match(text, j)
            if p:
                v = p[0].rstrip(".,:")
                if kind == "header" and (s := re.match(r"(?:Bearer|Basic|Token|ApiKey)$", v)):
                    continue
                if kind == "scheme" and not (any(c.isdigit() for c in v) and not _CAMEL.fullmatch(v) and (len(v) >= 16 or _classes(v) >= 3)):
                    continue
                if kind == "header" and not re.search(r"(?i)key|auth|token|secret|pass|sign|cred", m[0]):
                    continue
                if is_secret(v, 2):
                    found[j] = [(j, j + len(v))]
                    done = j + len(v)
        else:
            if i < tested:  # a further sign within a name that was judged
                continue
            s = _SEPARATOR.match(text, j)
            if not s:
                tested = _NAME_REST.match(text, j).end()
                continue
            name = _name_before(text, i) + text[i : s.start("sep")].split(":")[0].split("[")[0].rstrip(" \t\"'`]\\")
            sep, at = s["sep"], s.end()
            if sep == "==" or sep == "(" and not re.search(r"(?i)^(?:set|with|add)?[_.]?\w*$", name):
                continue
            q = _QUOTED.match(text, at)
            strength = _strength(name)
            if q:
                if sep == "," and text[s.start("sep") - 1 : s.start("sep")] not in "\"'`":
                    continue
                if sep == "(" and not re.search(r"(?i)(?:^|\.)(?:set|with)_?\w+$|^\w*\.(?:password|token|secret|bearerAuth|apiKey)$", name):
                    continue
                spans, value = [], ""
                while q:
                    g = q.lastgroup
                    spans.append(q.span(g))
                    value += q[g]
                    e = q.end()
                    nxt = _JOIN.match(text, e)
                    if not nxt[0].strip(" \t\r\n\\") and not (nxt[0] and config is False and len(spans) and "\n" not in nxt[0] and nxt[0].strip()):
                        break
                    q = _QUOTED.match(text, nxt.end())
                inner = text[spans[0][0] : spans[0][1]]
                if re.match(r"(?:Bearer|Basic|Token) ", value) or "://" in value or "-----BEGIN" in value:
                    continue
                if value and value[0] == "$" and config is False and re.fullmatch(r"\$\{?\w+\}?", value):
                    continue
                if is_secret(value, strength):
                    found[spans[0][0]] = [x for x in spans if x[1] > x[0]]
                    done = spans[-1][1]
                elif inner and done < i:
                    done = -1
            elif strength and sep in ("=", ":"):
                p = _BARE.match(text, at)
                if not p:
                    continue
                v = p[0]
                if "://" in v or text[p.end() : p.end() + 1] in ("(", "[", "{"):
                    continue
                tight = sep == "=" and s.end() == s.end("sep") and text[s.start("sep") - 1] not in " \t"
                line_start = text.rfind("\n", 0, i) + 1
                if not config and not tight:
                    head = text[line_start:i].lstrip()
                    if not head.startswith(("#", "//", "*", "/*", "--")) or sep == ":":
                        if not (sep == ":" and head.startswith(("#", "//", "*"))):
                            continue
                if v.endswith((";", ",")):
                    v = v[:-1]
                if not config and re.fullmatch(r"[A-Za-z_$][\w$.]*", v) and (_classes(v) < 3 and sum(map(str.isdigit, v)) < 4 or not tight):
                    continue
                if is_secret(v, strength):
                    found[at] = [(at, at + len(v))]
                    done = at + len(v)
    return found, skipped


_NAME_REST = re.compile(r"[\w.\-]*+")
# What stands on a line that tells an account and its password.
_ACCOUNT = re.compile(r"(?i)\b(?:log-?in|access|account|sign-?in|log-?on|locked out|credentials?|creds|user(?:name)?|password|auth)\b")
_NOT_CALL = re.compile(r"(?i)(?:log(?:ger)?|debug|info|warn|error|print\w*|format|replace|split|join|put|get\w*|has|contains|assert\w*|equals?|regex|match|test|describe|it)\s*$")


def _data_before(text: str, i: int) -> bool:
    """Does the token stand inside a data: address or a checksum?"""
    before = text[max(0, i - 60) : i]
    return "base64," in before or "sha" in before[-8:].lower()


def lines(text: str | None, config: bool = False) -> list[int]:
    """1-based lines on which credentials begin, distinct and ascending."""
    out: list[int] = []
    for start, _ in find(text, config):
        n = text.count("\n", 0, start) + 1
        if not out or out[-1] != n:
            out.append(n)
    return out


def mask(text: str | None, config: bool = False, sign: str = "*") -> str | None:
    """The text with every character of a credential replaced by sign; quotes, separators and lines stay as they are."""
    spans = sorted(x for _, s in find(text, config) for x in s)
    if not spans:
        return text
    out, at = [], 0
    for a, e in spans:
        a = max(a, at)
        if e <= a:
            continue
        out.append(text[at:a])
        out.append(re.sub(r"\\[nr]|[^\r\n]", lambda m: m[0] if len(m[0]) == 2 else sign, text[a:e]))
        at = e
    return "".join(out) + text[at:]
