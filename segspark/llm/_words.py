"""Vectorised hashing of words and word windows over whole Arrow string columns.

A word is a maximal run of bytes that are not in a separator set, after A-Z became a-z.
All non-ASCII bytes are word bytes, so working on UTF-8 bytes equals working on
characters.  A word's hash is a polynomial over random byte values modulo 2**64,
finalised by a bijective mixer.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Separators of the corpus contracts.
WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.ones(256, dtype=bool)
NON_ALNUM[0x30:0x3A] = NON_ALNUM[0x41:0x5B] = NON_ALNUM[0x61:0x7B] = False
NON_ALNUM[0x80:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE_VALUE[0x41:0x5B] = _BYTE_VALUE[0x61:0x7B]

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, base, dtype=_U)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=_U)
    return have[:n]


class Words:
    """The words of consecutive texts: ``starts`` (byte), ``hashes``, ``text`` (row), ``counts``."""

    __slots__ = ("starts", "hashes", "text", "counts", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITESPACE):
        n_texts, n = len(offsets) - 1, len(data)
        inside = ~separators[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        begin[edges] = inside[edges]
        self.starts = np.flatnonzero(begin)
        if len(self.starts):
            values = _BYTE_VALUE[data]
            values *= _power(_BASE, n, "up")
            values[~inside] = 0
            sums = np.add.reduceat(values, self.starts)
            sums *= _power(_INVERSE, n, "down")[self.starts]
            self.hashes = mix(sums)
        else:
            self.hashes = np.empty(0, _U)
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.text, minlength=n_texts).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` words and whether the window lies in one text."""
    h, n = words.hashes, len(words.hashes) - size + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, bool)
    out = h[:n].copy()
    for i in range(1, size):
        out *= _U(0xD6E8FEB86659FD93)
        out += h[i : i + n]
    return mix(out + _U(size)), words.text[:n] == words.text[size - 1 :]


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct window hashes; a text with fewer words has its whole
    sequence as one, a text without words an empty set."""
    hashes, whole = window_hashes(words, size)
    out = []
    for i in range(len(words.counts)):
        lo, n = words.first[i], words.counts[i]
        if n >= size:
            x = np.sort(hashes[lo : lo + n - size + 1])
            if len(x) > 1:
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
        elif n:
            x = _U(0)
            for w in words.hashes[lo : lo + n]:
                x = mix(np.array([x ^ w], _U) + _U(n))[0]
            x = np.array([x], _U)
        else:
            x = np.empty(0, _U)
        out.append(x)
    return out
