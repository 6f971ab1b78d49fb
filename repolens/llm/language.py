"""Language of sentences: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A word's features are itself and its character 2- to 4-grams with word marks, hashed into buckets. A text's vector is
the average of its features' embeddings; a softmax over languages follows. After training, embedding and output layer
are multiplied out once, so that a word costs one look-up of its ready scores. Confidences are calibrated by a
temperature fitted on held-out pieces of one and of two languages; a sentence below the rejection level, which is fitted on
the same pieces, has no language.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np

BUCKETS, DIM = 1 << 15, 24
#: Training takes at most so many labelled samples; the rest of a larger table is left aside.
MAX_SAMPLES = 20_000

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[㐀-鿿豈-﫿]")


def features(word: str) -> list[int]:
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


def words(text: str) -> list[str]:
    """Lower-case words; a run of Chinese characters counts as one word a character."""
    if _CJK.search(text):
        text = _CJK.sub(lambda m: f" {m[0]} ", text)
    return _WORD.findall(text.lower())


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # buckets x languages: embedding times output layer
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.5
    held_out: float = 0.0
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def _rows(self, tokens: list[str]) -> np.ndarray:
        """Rows of tokens in the table of ready token scores, which grows with the tokens met and starts anew when large."""
        c = self.cache
        if "index" not in c or len(c["index"]) > 400_000:
            c["index"], c["n"] = {}, 0
            c["rows"] = np.zeros((4096, len(self.langs) + 3), np.float32)
        index = c["index"]
        ids = list(map(index.get, tokens))
        if None in ids:
            for t in dict.fromkeys(t for t, i in zip(tokens, ids, strict=True) if i is None):
                i = c["n"]
                if i == len(c["rows"]):
                    c["rows"] = np.vstack([c["rows"], np.zeros_like(c["rows"])])
                ws, ends = token(t)
                f = [x for w in ws for x in features(w)]
                if f:
                    c["rows"][i, :-3] = self.scores[f].sum(0)
                c["rows"][i, -3:] = len(f), len(ws), ends
                index[t] = i
                c["n"] = i + 1
            ids = list(map(index.__getitem__, tokens))
        return c["rows"][np.array(ids, np.int64)] if ids else c["rows"][:0]

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Calibrated probabilities from rows of summed scores with the number of features last."""
        z = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return z / z.sum(1, keepdims=True)

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """Summed scores of lists of words."""
        out = np.zeros((len(texts), len(self.langs) + 1), np.float32)
        for i, ws in enumerate(texts):
            f = [x for w in ws for x in features(w)]
            if f:
                out[i, :-1] = self.scores[f].sum(0)
            out[i, -1] = len(f)
        return out


def train(samples: list[tuple[str, str]], epochs: int = 30, rate: float = 8.0, seed: int = 1, reject: float | None = None) -> Model:
    """samples: (language, clean text). Sentences of a fifth of the samples are held out for temperature and rejection level, unless
    one is given."""
    rng = np.random.default_rng(seed)
    samples = sorted(samples)
    langs = sorted({a for a, _ in samples})
    of = {a: i for i, a in enumerate(langs)}

    def fit(items: list[tuple[int, list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        w = np.zeros((DIM, len(langs)), np.float32)
        b = np.zeros(len(langs), np.float32)
        counts = np.bincount([y for y, _ in items], minlength=len(langs))
        weight = len(items) / (len(langs) * np.maximum(counts, 1))
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for k in rng.permutation(len(items)):
                y, ws = items[k]
                if len(ws) > 4 and rng.random() < 0.7:  # fragments, so that short passages are learnt too
                    a = rng.integers(0, len(ws) - 3)
                    ws = ws[a : a + rng.integers(3, 12)]
                f = np.array([x for v in ws for x in features(v)])
                x = e[f].mean(0)
                z = x @ w + b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                p *= weight[y]
                grad = w @ p
                w -= step * 0.1 * np.outer(x, p)
                b -= step * 0.01 * p
                np.add.at(e, f, -step * grad / len(f))
        return e, w, b

    def sentences(part):
        return [(of[a], words(s)) for a, t in part for s in split(t) if words(s)]

    order = rng.permutation(len(samples))
    held = [samples[i] for i in order[: max(1, len(samples) // 5)]]
    kept = [samples[i] for i in order[max(1, len(samples) // 5) :]]
    e, w, b = fit(sentences(kept))
    model = Model(langs, e @ w, b)
    model.temperature, model.reject, held_out = _calibrated(model, sentences(held), rng)
    e, w, b = fit(sentences(samples))
    return Model(langs, e @ w, b, temperature=model.temperature, reject=reject or model.reject, held_out=held_out)


def _calibrated(model: Model, test: list[tuple[int, list[str]]], rng: np.random.Generator, most: int = 4000) -> tuple[float, float, float]:
    """(temperature, rejection level, accuracy on whole sentences) from held-out sentences.

    Pure pieces are three words of a sentence; mixed ones are halves of sentences of two languages, which have no language of
    their own. The temperature makes the probabilities of both most likely (a mixed piece's two languages share its weight). The
    rejection level is where as large a share of the pure pieces falls below it as of the mixed ones stands above it."""
    pure = [(y, ws[i : i + 3]) for y, ws in test for i in range(0, len(ws) - 2, 3)]
    if len({y for y, _ in test}) < 2 or not pure:
        return 1.0, 0.5, 0.0
    pure = [pure[i] for i in rng.permutation(len(pure))[:most]]
    mixed = []
    for i, j in zip(rng.integers(0, len(test), most), rng.integers(0, len(test), most), strict=True):
        (a, x), (b, y) = test[i], test[j]
        if a != b and min(len(x), len(y)) >= 4:
            n = min(len(x), len(y)) // 2
            mixed.append((a, b, x[:n] + y[-n:]))
    sp, sm = model.sums([ws for _, ws in pure]), model.sums([ws for *_, ws in mixed])
    ys = np.array([y for y, _ in pure])
    one, two = np.array([a for a, *_ in mixed], int), np.array([b for _, b, _ in mixed], int)
    best = None
    for t in np.geomspace(0.02, 4, 40):
        model.temperature = float(t)
        p, q = model.probabilities(sp), model.probabilities(sm)
        loss = -np.log(p[np.arange(len(ys)), ys] + 1e-9).mean()
        if len(mixed):
            r = np.arange(len(mixed))
            loss -= (np.log(q[r, one] + 1e-9) / 2 + np.log(q[r, two] + 1e-9) / 2).mean()
        if best is None or loss < best[0]:
            best = loss, float(t), p.max(1), q.max(1)
    _, t, p, q = best
    right = model.probabilities(model.sums([ws for _, ws in test])).argmax(1) == np.array([y for y, _ in test])
    levels = np.linspace(0.3, 0.95, 66)
    reject = min(levels, key=lambda x: abs((p < x).mean() - (q >= x).mean())) if len(mixed) else 0.5
    return t, float(reject), float(right.mean())


# --- from a text to its sentences of running text ---------------------------------------------------------------------
_FENCE = re.compile(r"^[ \t>]*(```|~~~)")
_NOT_PROSE = re.compile(
    r"^\s*(?:\||\+[-=+]{3,}|[-=_*~]{3,}\s*$|\$\s|>\s*\$\s|>>>\s|#!|at\s+[\w.$<>]+[(\s]|File\s+\"|Traceback|Caused by|\.\.\.\s+\d+\s+more"
    r"|\[?\d{4}-\d\d-\d\d[T ]\s*\d\d:|\[?\d\d:\d\d:\d\d|(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL|CRITICAL)\b[ :\]]|[{}\[\]();]+\s*$|<[^>]+>\s*$|https?://\S+$)"
)
_SPECIAL = re.compile(r"^[^A-Za-z\u00c0-\uffff]|^(?:at\s|File\s|Traceback|Caused|INFO|WARN|ERROR|DEBUG|TRACE|FATAL|CRIT|http)")
_MARK = re.compile(r"^\s*(?:(?:[>*+\u2022\u2013#-]|\d{1,3}[.)]|[a-z][.)]|\[[ xX]\])\s+|>|#+\s*)+")
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:def|class|function|func|fun|import|from|return|if|for|while|let|var|const|public|private|package|using|#include)\b.*[:;({]?\s*$")
_INLINE = re.compile(r"`[^`\n]*`|!?\[([^\]\n]*)\]\([^)\n]*\)|<[^<>\n]+>")
_QUOTE = re.compile("[\"\u201c\u201e\u00ab\u300c\u300e][^\"\u201c\u201d\u201e\u00ab\u00bb\u300d\u300f\n]{1,200}[\"\u201d\u201c\u00bb\u300d\u300f]")
_QUOTED_ONLY = re.compile("^[\"\u201c\u201e\u00ab\u300c\u300e\u2018'\u2039][^\\n]*[\"\u201d\u201c\u00bb\u300d\u300f\u2019'\u203a]\\s*[.,;:]?$")
_END = re.compile(r"(?<=[.!?\u2026])[\"'\u201d\u00bb)\]]*\s+|(?<=[\u3002\uff01\uff1f])")
_HAN_END = re.compile("([\u3002\uff01\uff1f])")
_IDENTIFIER = re.compile(r"[\d_/\\@=<>{}|~^]|[a-z][A-Z]|[A-Za-z]-[A-Za-z]|\w\.\w|::|\(.*\)")
_BOUNDARY = "\x00"


def split(text: str) -> list[str]:
    return [s for s in _END.split(text) if s and s.strip()]


def token(t: str) -> tuple[list[str], int]:
    """Words of a token between blanks (none for identifiers, numbers and addresses), and whether a sentence ends with it."""
    if t == _BOUNDARY:
        return [], 1
    bare = t.rstrip("\"'\u201d\u00bb\u300d\u300f)]*_`")
    ends = int(bool(bare) and bare[-1] in ".!?\u2026\u3002\uff01\uff1f")
    core = t.strip(".,;:!?\u2026\"'\u201c\u201d\u201e\u00ab\u00bb()[]*\u3002\uff01\uff1f\uff0c\uff1a`")
    if not _CJK.search(core) and _IDENTIFIER.search(core):
        return [], ends
    if _CJK.search(core):
        core = re.sub(r"[A-Za-z0-9_`./-]+", " ", core)
    return words(core), ends


def tokens(text: str) -> tuple[list[str], list[int]]:
    """Tokens of the running text with marks between sentences that can't join, and the line of each.
    Left out: code, logs, tables and quotations that stand alone or inside a sentence."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[str] = []
    where: list[int] = []
    fence = False
    for n, line in enumerate(text.split("\n")):
        if "```" in line or "~~~" in line:
            if _FENCE.match(line):
                fence = not fence
                out.append(_BOUNDARY)
                where.append(n)
                continue
        if fence:
            continue
        bare = line.strip()
        if not bare:
            out.append(_BOUNDARY)
            where.append(n)
            continue
        if _SPECIAL.match(bare):
            if _NOT_PROSE.match(bare):
                out.append(_BOUNDARY)
                where.append(n)
                continue
            m = _MARK.match(bare)
            if m:
                out.append(_BOUNDARY)
                where.append(n)
                bare = bare[m.end() :].strip()
            if bare and bare[0] in "\"\u201c\u201e\u00ab\u300c\u300e\u2018'\u2039" and len(bare) < 400 and _QUOTED_ONLY.match(bare):
                out.append(_BOUNDARY)
                where.append(n)
                continue
        elif line[0] in " \t" and line.startswith(("    ", "\t")) and _CODE_LINE.search(line):
            out.append(_BOUNDARY)
            where.append(n)
            continue
        if "`" in bare or "<" in bare or "](" in bare:
            bare = _INLINE.sub(lambda m: f" {m[1]} " if m.lastindex else " ` ", bare)
        if any(c in bare for c in "\"\u201c\u201e\u00ab\u300c\u300e"):
            bare = _QUOTE.sub(" ", bare)
        if "\u3002" in bare or "\uff01" in bare or "\uff1f" in bare:
            bare = _HAN_END.sub(r"\1 ", bare)
        ts = bare.split()
        out += ts
        where += [n] * len(ts)
    out.append(_BOUNDARY)
    where.append(0)
    return out, where


# How languages are spelled in labels (ISO 639-1, -2 and -3 codes, English and own names).
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
    "zh": "zh zho chi chinese cmn 中文 mandarin 汉语 zh-hans zh-hant",
}
_CODES = {name: code for code, names in NAMES.items() for name in names.split()}


def label(lang: str | None) -> str | None:
    """The two-letter code a label names, whatever its spelling, case or region; None for missing, placeholders and unknown names."""
    if not lang:
        return None
    low = lang.strip().lower()
    return _CODES.get(low) or _CODES.get(re.split(r"[-_ .(@]", low, maxsplit=1)[0])


@dataclass
class Found:
    langs: list  # (language, confidence, sentences)
    passages: list  # (start line, language, confidence)


def detect(texts: list[str | None], model: Model, least: int = 3) -> list[Found]:
    """Languages of each text: all with at least `least` sentences, else the one of most running text; none without running text."""
    flat: list[str] = []
    where: list[int] = []
    bounds = [0]
    for t in texts:
        if t:
            ts, ns = tokens(t)
            flat += ts
            where += ns
        bounds.append(len(flat))
    out = [Found([], []) for _ in texts]
    if not flat:
        return out
    rows = model._rows(flat)
    k = len(model.langs)
    ends = rows[:, -1] > 0
    first = np.flatnonzero(np.concatenate([[True], ends[:-1]]))  # a boundary token ends each text
    sums = np.add.reduceat(rows[:, : k + 2], first, axis=0)
    some = sums[:, k + 1] > 0
    first, sums = first[some], sums[some]
    p = model.probabilities(sums[:, : k + 1])
    size = sums[:, k + 1]
    best = p.argmax(1)
    sure = (p.max(1) >= model.reject) & (size >= 3)
    starts = np.searchsorted(first, np.array(bounds))
    for i in range(len(texts)):
        a, e = starts[i], starts[i + 1]
        if a == e:
            continue
        b, c = best[a:e], p[np.arange(a, e), best[a:e]]
        counts = np.bincount(b[sure[a:e]], minlength=k)
        many = [j for j in np.argsort(-counts, kind="stable") if counts[j] >= least]
        if many:
            out[i].langs = [(model.langs[j], float(c[(b == j) & sure[a:e]].mean()), int(counts[j])) for j in many]
        elif size[a:e].sum() >= 3:
            weight = np.bincount(b, weights=c * size[a:e], minlength=k)
            j = int(weight.argmax())
            out[i].langs = [(model.langs[j], float((p[a:e, j] * size[a:e]).sum() / size[a:e].sum()), int(counts[j]))]
        change = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        for x, y in zip(change, [*change[1:], e - a], strict=True):
            out[i].passages.append((where[first[a + x]] + 1, model.langs[b[x]], float(c[x:y].mean())))
    return out
