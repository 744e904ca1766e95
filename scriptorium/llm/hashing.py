"""Vectorised byte, word and shingle hashing over concatenated texts (numpy only)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
#: ASCII whitespace that separates words: space and U+0009..U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _pow(name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), _BASE if name == "up" else _INV, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = have = np.multiply.accumulate(steps)
    return have[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[e] - P[s] = hash of data[s:e] times BASE**s, modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * _pow("up", len(data)), out=out[1:])
    return out


def ranges(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for arrays of bounds, from prefix(data)."""
    return mix((p[end] - p[start]) * _pow("down", len(p))[start] + (end - start).astype(np.uint64))


def windows(p: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of width bytes, by their starts."""
    n = max(len(p) - width, 0)
    return mix((p[width:] - p[:n]) * _pow("down", n)) if n else np.zeros(0, np.uint64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another as uint8, and their len(texts) + 1 bounds."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (A-Z lower-cased, split at ASCII whitespace and at bounds) and len(bounds) word counts so far."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    low = _LOWER[data]
    word = ~_SPACE[low]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = bounds[(bounds < len(data))]
    first[edges] = word[edges]
    start = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = bounds[bounds > 0] - 1
    last[ends] = word[ends]
    end = np.flatnonzero(last) + 1
    p = prefix(low)
    return ranges(p, start, end), np.searchsorted(start, bounds)


def shingles(w: np.ndarray, bounds: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each document its sorted distinct shingle hashes; with fewer than width words one, of all of them."""
    mult = [_U(x) for x in np.random.default_rng(7).integers(1, 1 << 63, width, dtype=np.uint64) | _U(1)]
    n = max(len(w) - width + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += w[k : k + n] * mult[k]
    h = mix(h)
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s >= width:
            out.append(np.unique(h[s : e - width + 1]))
        elif e > s:
            short = _U(e - s)
            for x in w[s:e]:
                short = mix(np.array([short * mult[0] + x], np.uint64))[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
