"""Vectorised words and shingles over UTF-8 bytes.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
A word's hash is a polynomial of its bytes modulo 2**64, taken from running
sums over a whole piece of text, then mixed. All tables come from a rule.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_M = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random value for each byte, upper case as lower; which bytes are in words."""
    i = np.arange(256, dtype=np.uint64)
    i = np.where((i >= 65) & (i <= 90), i + np.uint64(32), i)
    blank = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
    return mix((i + np.uint64(1)) * np.uint64(_M)), ~blank


_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        _powers[:] = []
        for base in (_M, pow(_M, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word."""
    value, inside = _bytes()
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(inside[raw].astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, inverse = _power(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(value[raw] * p[: len(raw)], out=total[1:])
    return start, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of the words of each text, in order."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    todo: list[int] = []
    size = 0

    def flush() -> None:
        if not todo:
            return
        lengths = np.array([len(texts[i]) + 1 for i in todo])
        start, hashes = _hash_piece(b"\n".join([texts[i] for i in todo]))
        cuts = np.searchsorted(start, np.cumsum(lengths)[:-1])
        for i, part in zip(todo, np.split(hashes, cuts), strict=True):
            out[i] = part
        todo.clear()

    for i, text in enumerate(texts):
        if len(text) > PIECE:  # cut between words
            parts, at = [], 0
            while at < len(text):
                end = min(len(text), at + PIECE)
                while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
                    end += 1
                parts.append(_hash_piece(text[at:end])[1])
                at = end
            out[i] = np.concatenate(parts)
            continue
        if size + len(text) + 1 > PIECE:
            flush()
            size = 0
        todo.append(i)
        size += len(text) + 1
    flush()
    return out


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles as ascending hashes; fewer words make one shingle, none make none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < n:
        h = np.uint64(len(words))
        for w in words:
            h = mix(np.array([(int(h) * 3 + int(w)) & _MASK], dtype=np.uint64))[0]
        return np.array([h], dtype=np.uint64)
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        h = mix(h * np.uint64(_M) + words[j : len(words) - n + 1 + j])
    return np.unique(h)
