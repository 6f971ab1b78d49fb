"""Test passages inside documents: normalised words, passages, and the pieces of a latent semantic search."""

from __future__ import annotations

import html
import re
from itertools import repeat

import numpy as np

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]{0,300}>", re.S)
_LINK = re.compile(r"\]\([^()\s]*(?:\([^()]*\))?[^()]*\)|\]\[[^\]\n]*\]")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
_START = re.compile(r"^[ \t]*(?:(?:[>|*+#;%•‣▪–—·-]+|//+[/!]?|/\*+|--+|\"\"\"|\(?\d{1,3}[.)](?=[ \t])|\(?[a-zA-Z][.)](?=[ \t])|\[[ xX]\]|(?:REM|dnl)\b)[ \t]*)+", re.M)
_START_NO_NUMBER = re.compile(r"^[ \t]*(?:(?:[>|*+#;%•‣▪–—·-]+|//+[/!]?|/\*+|--+|\"\"\"|\[[ xX]\]|(?:REM|dnl)\b)[ \t]*)+", re.M)
#: A number that may be a list mark or a word.
NUMBERED = re.compile(r"^[ \t>*#|-]*\(?\d{1,3}[.)][ \t]", re.M)
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑](?:[ \t]*\r?\n[ \t]*)+(?=[^\W\d_])")
_HYPHEN_BEFORE = re.compile(r"[-‐‑][ \t]*\n")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def words(text: str, numbers: bool = True) -> list[str]:
    """Lower-case runs of letters and digits, after removal of what may stand between words without interrupting a run:
    entities, markup, invisible characters, marks at line starts (numbers="1." ones too) and hyphens at line ends."""
    if "&" in text:
        for _ in range(2):
            text = html.unescape(text)
    plain = text.isascii()
    if not plain:
        text = _INVISIBLE.sub("", text)
    if "<" in text:
        text = _TAG.sub(lambda m: "\n" if "\n" in m[0] else "" if m[0][1:2] != "!" and m[0][:3].lower() not in ("<br", "<p>", "</p", "<li", "</l", "<di", "</d", "<td", "</t", "<tr", "<h1", "<h2", "<h3", "</h", "<hr") else " ", text)
    if "](" in text or "][" in text:
        text = _LINK.sub("] ", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = (_START if numbers else _START_NO_NUMBER).sub("", text)
    if _HYPHEN_BEFORE.search(text):
        text = _HYPHEN.sub("", text)
    return (_ASCII_WORD if plain else _WORD).findall(text.lower())


class Items:
    """Vocabulary, windows and runs of the test items; bounded by the test set."""

    def __init__(self, items: list[tuple[int, str]], run: int = 13, passage: int = 64):
        self.run, self.passage = run, passage
        self.stride = passage - run + 1  # any run of `run` words lies within one passage
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.windows: list[tuple[int, np.ndarray]] = []  # (position in items, word ids)
        self.runs: dict[bytes, list[int]] = {}
        for item_id, query in items:
            variants = {tuple(words(query or "", n)) for n in (True, False)}
            for ws in sorted(variants):
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], np.int32)
                k = len(self.items)
                self.items.append((item_id, ids))
                half = max(run, 2 * run)
                for a in range(0, max(1, len(ids) - half + run), run):
                    if len(ids[a : a + half]) >= min(run, len(ids)):
                        self.windows.append((k, ids[a : a + half]))
                for a in range(len(ids) - run + 1):
                    self.runs.setdefault(ids[a : a + run].tobytes(), []).append(k)

    def ids(self, ws: list[str]) -> np.ndarray:
        """Word ids, -1 for words of no item."""
        return np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int32, len(ws))

    def passages(self, ids: np.ndarray, least: int = 1) -> list[np.ndarray]:
        """Overlapping windows that hold at least `least` words of items."""
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        if len(ids) <= self.passage:
            return [ids] if known[-1] >= least else []
        starts = np.arange(0, len(ids) - self.passage + self.stride, self.stride)
        held = known[np.minimum(starts + self.passage, len(ids))] - known[starts]
        return [ids[a : a + self.passage] for a in starts[held >= least].tolist()]


class Rows:
    """TF-IDF rows of unit length, kept sparse: entries sorted by row; every row has at least one word of the vocabulary."""

    def __init__(self, passages: list[np.ndarray], idf: np.ndarray):
        d, n = len(idf), len(passages)
        flat = np.concatenate(passages).astype(np.int64)
        row = np.repeat(np.arange(n), [len(p) for p in passages])
        keep = flat >= 0
        key, count = np.unique(row[keep] * d + flat[keep], return_counts=True)
        self.row, self.col = key // d, key % d
        weight = np.log1p(count.astype(np.float32)) * idf[self.col] + np.float32(1e-9)
        self.start = np.searchsorted(self.row, np.arange(n))
        norm = np.sqrt(np.add.reduceat(weight * weight, self.start))
        self.weight = weight / norm[self.row]

    def times(self, m: np.ndarray) -> np.ndarray:
        """Product with a dense matrix of vocabulary rows."""
        return np.add.reduceat(m[self.col] * self.weight[:, None], self.start, axis=0)

    def transposed_times(self, m: np.ndarray, d: int) -> np.ndarray:
        """Product of the transpose with a dense matrix of passage rows."""
        order = np.argsort(self.col, kind="stable")
        col = self.col[order]
        first = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
        out = np.zeros((d, m.shape[1]), np.float64)
        out[col[first]] = np.add.reduceat(m[self.row[order]] * self.weight[order, None], first, axis=0)
        return out


def with_run(passages: list[np.ndarray], run: int) -> np.ndarray:
    """Which passages hold `run` words of the vocabulary in a row."""
    sizes = np.array([len(p) for p in passages])
    end = np.cumsum(sizes)
    flat = np.concatenate(passages) >= 0
    total = np.concatenate([[0], np.cumsum(flat)])
    out = np.zeros(len(passages), bool)
    if len(flat) >= run:
        whole = np.flatnonzero(total[run:] - total[:-run] == run)
        owner = np.searchsorted(end, whole, "right")
        out[owner[whole + run <= end[owner]]] = True
    return out


def places(ids: np.ndarray) -> dict[int, int]:
    """For each word id the positions it has in ids, as bits."""
    out: dict[int, int] = {}
    for i, x in enumerate(ids.tolist()):
        out[x] = out.get(x, 0) | 1 << i
    return out


def longest_common(at: dict[int, int], size: int, b: list[int]) -> int:
    """Length of the longest common subsequence of a list, given by its places and size, and b (ids below 0 match nothing). All
    positions of the first list are worked on at once, as bits of one number."""
    full = v = (1 << size) - 1
    for m in filter(None, map(at.get, b)):
        u = v & m
        v = v + u | v - u  # carries above the highest place never come back
    return size - (v & full).bit_count()
