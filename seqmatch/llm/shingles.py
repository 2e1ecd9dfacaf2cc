"""Word shingles of whole texts as 64-bit hashes, many texts at once."""

from __future__ import annotations

import numpy as np

from .common import blocks

BLOCK = 1 << 20
U = np.uint64
# Odd multipliers.
_P = U(0x9DDFEA08EB382D69)
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_STEP = U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_power = np.ones(1, U)
_inverse = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U(30))
    x = x * _MIX1
    x = x ^ (x >> U(27))
    x = x * _MIX2
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = max(n, BLOCK + 1)
        back = U(pow(int(_P), -1, 1 << 64))
        _power = np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, _P, U))])
        _inverse = np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, back, U))])
    return _power[:n], _inverse[:n]


def run_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes starts..ends-1 of ``part``."""
    power, inverse = _powers(len(part))
    total = np.concatenate([np.zeros(1, U), np.cumsum((part.astype(U) + U(1)) * power)])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * _STEP)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word; words are runs without ASCII blanks, A-Z in lower case."""
    lo, hi = int(at[0]), int(at[-1])
    if hi == lo:
        return np.zeros(0, U), np.zeros(0, np.int64)
    part = raw[lo:hi]
    blank = _BLANK[part]
    edge = np.zeros(hi - lo + 1, bool)
    edge[at - lo] = True
    starts = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])) + 1
    return run_hashes(_LOWER[part], starts, ends), np.searchsorted(at - lo, starts, side="right") - 1


def _long(raw: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Word hashes of one long text, window by window; windows end at a blank."""
    out = []
    while lo < hi:
        end = min(hi, lo + BLOCK)
        while end < hi and not _BLANK[raw[end]]:
            more = np.flatnonzero(_BLANK[raw[end : min(hi, end + BLOCK)]])
            end = end + int(more[0]) if len(more) else min(hi, end + BLOCK)
        out.append(word_hashes(raw, np.array([lo, end]))[0])
        lo = end
    return np.concatenate(out) if out else np.zeros(0, U)


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int = 5):
    """Yield (first text, last text, hashes, their text numbers from the first): the distinct shingles of each text,
    sorted by text and hash.  A text of 1 to width - 1 words has one shingle of all of them; one without words has none."""
    for a, b in blocks(at, BLOCK):
        if at[b] - at[a] > BLOCK:
            words = _long(raw, int(at[a]), int(at[b]))
            doc = np.zeros(len(words), np.int64)
        else:
            words, doc = word_hashes(raw, at[a : b + 1])
        count = np.bincount(doc, minlength=b - a)
        n = max(0, len(words) - width + 1)
        h = np.zeros(n, U)
        factor = U(1)
        with np.errstate(over="ignore"):
            for j in range(width):
                factor = factor * _P
                h += words[j : j + n] * factor
            whole = doc[:n] == doc[width - 1 :] if n else np.zeros(0, bool)
            h, of = mix(h[whole]), doc[:n][whole]
            short = np.flatnonzero((count > 0) & (count < width))
            if len(short):
                first = (np.cumsum(count) - count)[short]
                extra = np.zeros(len(short), U)
                factor = U(1)
                for j in range(width - 1):
                    factor = factor * _P
                    has = count[short] > j
                    extra[has] += words[first[has] + j] * factor
                h, of = np.concatenate([h, mix(extra + count[short].astype(U))]), np.concatenate([of, short])
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        yield a, b, h[fresh], of[fresh]
