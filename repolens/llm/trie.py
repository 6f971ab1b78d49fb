"""Binary trie self-join of bit sketches, and the sketches.

A parity sketch of a set has one bit for each of a number of buckets: the parity of how many elements fall into it. Two
sketches never differ in more bits than the sets have elements in only one of them, and sets with a Jaccard similarity
of t or more have at most (1 - t) / (1 + t) * (|A| + |B|) such elements. That is an exact error budget: a pair of trie
nodes whose bits differ more often can hold no similar pair. The sketches of different sets differ in nearly half of their bits if
they have about as many bits as elements, so larger sets get wider sketches; a wide sketch is folded to meet a narrow one.
"""

from __future__ import annotations

import numpy as np

#: Bits of a sketch by the size of its set: the first width whose size isn't exceeded.
WIDTHS = ((96, 128), (192, 256), (1 << 62, 512))


def width(size: int) -> int:
    return next(bits for most, bits in WIDTHS if size <= most)


def fold(x: int, bits: int, to: int) -> int:
    """A sketch of `bits` bits as one of `to` bits."""
    while bits > to:
        bits //= 2
        x = (x >> bits) ^ (x & (1 << bits) - 1)
    return x


def join(sketches: list[int], sizes: list[int], threshold: float, split: int | None = None) -> list[tuple[int, int]]:
    """Index pairs (i < j) within the error budget; with `split`, only pairs of one index below it and one not.

    Sets are joined by the width of their sketches, each width with itself and with the others.
    """
    n = len(sketches)
    by: dict[int, tuple[list[int], list[int]]] = {}
    for i in range(n):
        by.setdefault(width(sizes[i]), ([], []))[split is not None and i >= split].append(i)
    out: list[tuple[int, int]] = []
    widths = sorted(by)
    for k, w in enumerate(widths):
        low, high = by[w]
        out += _walk(low, low if split is None else high, sketches, sizes, threshold, w)
        for v in widths[k + 1 :]:
            folded = {i: sketches[i] for i in (*low, *high)}
            for i in (*by[v][0], *by[v][1]):
                folded[i] = fold(sketches[i], v, w)
            if split is None:
                out += _walk(low, by[v][0], folded, sizes, threshold, w)
            else:
                out += _walk(low, by[v][1], folded, sizes, threshold, w) + _walk(by[v][0], high, folded, sizes, threshold, w)
    return out


def _walk(left: list[int], right: list[int], sketches, sizes: list[int], threshold: float, bits: int) -> list[tuple[int, int]]:
    """Two nodes are walked down together, bit by bit; the bits in which they differ add up, and the pair is left as soon as
    they exceed the budget of the largest sets below them. A node with one sketch left is compared at once (its
    path has no more branches)."""
    share = (1 - threshold) / (1 + threshold)
    out: list[tuple[int, int]] = []
    stack = [(left, right, bits - 1, 0)]
    while stack:
        a, b, bit, differ = stack.pop()
        same = a is b
        if same and len(a) < 2 or not a or not b:
            continue
        if len(a) == 1 or len(b) == 1 or bit < 0 or len(a) * len(b) <= 16:
            mask = (1 << (bit + 1)) - 1
            for k, i in enumerate(a):
                x, size = sketches[i], sizes[i]
                least, most = threshold * size - 1e-9, size / threshold + 1e-9
                for j in b[k + 1 :] if same else b:
                    if least <= sizes[j] <= most and differ + ((x ^ sketches[j]) & mask).bit_count() <= share * (size + sizes[j]) + 1e-9:
                        out.append((i, j) if i < j else (j, i))
            continue
        if differ > share * (max(sizes[i] for i in a) + max(sizes[i] for i in b)) + 1e-9:
            continue
        a0 = [i for i in a if not sketches[i] >> bit & 1]
        a1 = [i for i in a if sketches[i] >> bit & 1]
        if same:
            b0, b1 = a0, a1
        else:
            b0 = [i for i in b if not sketches[i] >> bit & 1]
            b1 = [i for i in b if sketches[i] >> bit & 1]
            stack.append((a1, b0, bit - 1, differ + 1))
        stack.append((a0, b1, bit - 1, differ + 1))
        stack.append((a0, b0, bit - 1, differ))
        stack.append((a1, b1, bit - 1, differ))
    return out


def sketch(shingles: np.ndarray) -> bytes:
    """Parity sketch of an array of distinct uint32 values, of the width of its size."""
    bits = width(len(shingles))
    x = shingles.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((x >> np.uint64(40)) & np.uint64(bits - 1)).astype(np.int64)
    parity = np.bincount(bits - 1 - bucket, minlength=bits) & 1  # bucket 0 is the lowest bit of the number
    return np.packbits(parity.astype(np.uint8)).tobytes()


# --- shingles ---------------------------------------------------------------------------------------------------------
_RNG = np.random.default_rng(20240601)
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_IS_WORD = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _IS_WORD[_c] = True
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_CHUNK = 1 << 21
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingled(texts: list[str | None], n: int = 3, least: int = 40, sets: bool = True) -> list[tuple[bytes, np.ndarray] | None]:
    """For each text (class id of its word sequence, sorted distinct uint32 hashes of its runs of n words), None for
    texts with fewer than `least` words. Without `sets` the arrays are left empty. A word is a run of ASCII letters, digits and underscores, lower-case."""
    out: list = []
    group: list[bytes] = []
    held = 0
    for t in texts:
        b = (t or "").lower().encode("utf-8", "surrogatepass")
        group.append(b)
        held += len(b) + 1
        if held >= _CHUNK:
            out += _shingled(group, n, least, sets)
            group, held = [], 0
    return out + _shingled(group, n, least, sets)


def _shingled(group: list[bytes], n: int, least: int, sets: bool) -> list:
    if not group:
        return []
    data = np.frombuffer(b"\n".join([*group, b""]), np.uint8)
    lengths = np.array([len(b) + 1 for b in group])
    row_end = np.cumsum(lengths)
    up, down = _powers(len(data) + 1)
    word = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    out: list = [None] * len(group)
    if not len(starts):
        return out
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up[: len(data)], dtype=np.uint64)])
    h = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    row = np.searchsorted(row_end, starts, "right")
    counts = np.bincount(row, minlength=len(group))
    first = np.concatenate([[0], np.cumsum(counts)])
    k = (np.arange(len(h)) - first[row]).astype(np.int64)
    a = np.add.reduceat(h * up[k], first[:-1][counts > 0])
    b = np.add.reduceat(_mix(h) * down[k + 1], first[:-1][counts > 0])
    some = np.flatnonzero(counts > 0)
    ids = dict(zip(some.tolist(), zip(a.tolist(), b.tolist(), strict=True), strict=True))
    values, at = np.zeros(0, np.uint32), np.zeros(len(group) + 1, np.int64)
    if sets and len(h) >= n:
        s = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            s = _mix(s + h[j : len(h) - n + 1 + j])
        whole = row[: len(s)] == row[n - 1 :]
        key = np.unique((row[: len(s)][whole].astype(np.uint64) << np.uint64(32)) | (s[whole] >> np.uint64(32)))
        rows = (key >> np.uint64(32)).astype(np.int64)
        values = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = np.searchsorted(rows, np.arange(len(group) + 1))
    for i in some.tolist():
        if counts[i] >= max(least, n):
            x, y = ids[i]
            out[i] = (x.to_bytes(8, "big") + y.to_bytes(8, "big"), values[at[i] : at[i + 1]])
    return out
