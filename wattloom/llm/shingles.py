"""Word shingles of a text as sorted 64-bit hashes, computed on UTF-8 bytes with numpy.

A-Z are lower-cased; words are runs of bytes outside space and \\t\\n\\v\\f\\r, all ASCII, so working on
bytes is the same as working on code points. A text with fewer words than a shingle has gives its
whole sequence as one; a text without words gives none.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII character but digits and letters, for words without punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(max(n, 1 << 16), base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers


def _words(raw: np.ndarray, blank: np.ndarray, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A hash for each word; with ``prefixes`` rows of these of the distinct words, and for each length of the beginnings' hashes and which words are longer."""
    low = _LOWER[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank[low], [True]))))
    starts, ends = edges[::2], edges[1::2]
    up, down = _tables(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)
    if not prefixes:
        return words
    words, at = np.unique(words, return_index=True)
    starts, ends = starts[at], ends[at]
    parts = [words]
    for n in prefixes:
        longer = ends - starts > n
        s = np.where(longer, starts, 0)
        parts.append(np.where(longer, mix((sums[np.minimum(s + n, len(low))] - sums[s]) * down[s], 100 + n), 0))
        parts.append(longer.astype(np.uint64))
    return np.stack(parts)


def word_hashes(text: bytes, blank: np.ndarray = _BLANK, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """One hash for each word, a run of bytes outside ``blank``, in order. With ``prefixes``: for each distinct word of the text, and for the beginning of so many bytes of each longer one. Long texts go through in blocks that end at a blank."""
    raw = np.frombuffer(text, np.uint8)
    parts, at = [], 0
    while at < len(raw) or not parts:
        end = min(at + _BLOCK, len(raw))
        while end < len(raw) and not blank[raw[end]]:
            end += 1
        parts.append(_words(raw[at:end], blank, prefixes))
        if prefixes and len(parts) > 1:
            both = np.concatenate(parts, axis=1)
            parts = [both[:, np.unique(both[0], return_index=True)[1]]]
        at = end
    if not prefixes:
        return np.concatenate(parts)
    words, *rest = parts[0]
    return np.concatenate([words, *(h[longer > 0] for h, longer in zip(rest[::2], rest[1::2], strict=True))])


def shingle_hashes(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """One hash for each run of ``size`` words, in order, with repeats."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    out = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        out = out * _STEP + words[j : n - width + 1 + j]
    return mix(out, width)


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingle_hashes(word_hashes(text), size))


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two 63-bit keys of a set; the lowest bit of the first is 0."""
    if not len(shingles):
        return 0, 0
    n = np.uint64(len(shingles))
    a, b = (int(mix(np.add.reduce(mix(shingles, s), keepdims=True) + n, s)[0]) for s in (11, 12))
    return (a >> 1) & ~1, b >> 1
