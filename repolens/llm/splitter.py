"""Cutting a text into pieces under a limit, at natural seams, each repeating the end of the one before.

A text is divided by the coarsest separator; what is still too large for a piece is divided by the next finer one, down to
characters. The units are then packed greedily: a piece takes as many whole units as fit behind its overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

#: Separators from coarse to fine (sections, members, paragraphs, lines, sentences, words); a cut stands right after the match.
_LEVELS = [
    re.compile(r"\n(?=(?:@[\w.]+.*\n)*(?:(?:export |default |public |private |protected |internal |static |async |abstract |final |override )*(?:class|interface|struct|enum|def|func|fun|function|impl|module|namespace|object|trait|type|record)\b|#{1,6} |\[[^\]\n]+\]\s*\n|[\w.-]+:\s*\n))"),
    re.compile(r"\n(?=[ \t]+(?:@[\w.]+.*\n[ \t]+)*(?:(?:export |default |public |private |protected |internal |static |async |abstract |final |override )*(?:class|interface|struct|enum|def|func|fun|function)\b|(?:public|private|protected|internal|static) ))"),
    re.compile(r"\n[ \t]*\n+"),
    re.compile(r"\n"),
    re.compile(r"[.!?。！？;][ \t]+|[。！？]|;"),
    re.compile(r"[ \t]+|,"),
]


class Piece(NamedTuple):
    content: str
    start_line: int
    end_line: int
    overlap: int


def units(text: str, room: int) -> list[int]:
    """Ends of the units of a text, none longer than `room`: recursively divided by the hierarchy of separators. A unit that fits is not
    divided further; one without any separator is cut every `room` characters, never between CR and LF if room is above 1."""
    ends: list[int] = []
    todo = [(0, len(text), 0)]  # a stack instead of recursion: parts still to look at, the next one last
    seams: dict[int, list[int]] = {}
    while todo:
        a, e, level = todo.pop()
        if e - a <= room:
            ends.append(e)
        elif level == len(_LEVELS):
            while e - a > room:
                a += room
                if room > 1 and text[a - 1] == "\r" and text[a] == "\n":
                    a -= 1
                ends.append(a)
            ends.append(e)
        else:
            if level not in seams:
                seams[level] = [m.end() for m in _LEVELS[level].finditer(text)]
            at = seams[level]
            inner = [a, *at[bisect_right(at, a) : bisect_left(at, e)], e]
            todo += [(x, y, level + 1) for x, y in zip(inner[-2::-1], inner[:0:-1], strict=True)]
    return ends


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece. Pieces have at most limit characters; each but the first begins exactly `overlap` characters
    before the end of the one before it - or at the text's start, if less than that stands before. Overlap must be below the limit."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive, overlap at least 0 and below the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    ends = units(text, limit - overlap)
    out, start, k = [], 0, 0
    while True:
        j = bisect_right(ends, start + limit, k) - 1  # the next unit always fits behind the overlap
        out.append((start, ends[j]))
        if ends[j] == n:
            return out
        start, k = max(0, ends[j] - overlap), j + 1


def pieces(text: str | None, limit: int, overlap: int, start_line: int | None = None, end_line: int | None = None) -> list[Piece]:
    """The pieces with their own line ranges. Where the text has more lines than start_line..end_line (a documentation
    block set above the body), the lines above the body belong to start_line. A null text has no pieces."""
    if not text:
        return []
    first = start_line or 1
    lines = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    total = len(lines) + (0 if text.endswith("\n") else 1)
    last = end_line if end_line is not None else first + total - 1
    extra = max(0, total - (last - first + 1))

    def line(at: int) -> int:
        return min(max(last, first), first + max(0, bisect_right(lines, at) - extra))

    spans = cuts(text, limit, overlap)
    return [Piece(text[a:e], line(a), line(max(a, e - 1)), spans[k - 1][1] - a if k else 0) for k, (a, e) in enumerate(spans)]
