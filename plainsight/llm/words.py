"""Hashes of the words of many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Words are runs of bytes other than the white space 0x20 and 0x09 to 0x0D.
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 1 << 23:  # one very long text does not stay in memory
            _POWERS[base] = have
    return have[:n]


def byte_class(*ranges: tuple[int, int], inside: bool = True) -> np.ndarray:
    """Which of the 256 bytes lie in the ranges (ends included), or in none of them."""
    table = np.full(256, not inside)
    for first, last in ranges:
        table[first : last + 1] = inside
    return table


@dataclass(frozen=True)
class Words:
    """All words of some texts: lowered bytes, where words start and end there, hashes, and texts' first words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    at: np.ndarray


def tokenized(texts: pa.Array, in_word: np.ndarray = _IN_WORD) -> Words:
    """The words of texts, runs of bytes that ``in_word`` holds; words of two texts never touch.

    A-Z are lowered. A missing text has no words. A word's hash is a polynomial of its
    bytes, taken from running sums over all texts, and mixed.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    offsets = offsets - low
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    data = _LOWERED[np.frombuffer(texts.buffers()[2], np.uint8)[low : low + n]]
    inside = in_word[data]
    breaks = np.zeros(n + 1, bool)
    breaks[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~breaks[:n]
    after = np.concatenate([inside[1:], [False]]) & ~breaks[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts]
    return Words(data, starts, ends, mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each text's words start (one more entry than texts)."""
    words = tokenized(texts)
    return words.hashes, words.at


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size`` words in a row, sorted in each text, and where each text's start.

    A text with fewer words has one: all its words. A text without words has none.
    """
    words, at = hashed_words(texts)
    n_words = np.diff(at)
    n = np.where(n_words == 0, 0, np.maximum(n_words - size + 1, 1))
    owner = np.repeat(np.arange(len(n)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[:-1][owner]
    used = np.minimum(n_words[owner], size)
    h = mix(used.astype(np.uint64))
    for k in range(size):
        inside = k < used
        step = mix(h * np.uint64(_BASE) + words[np.minimum(first + k, max(len(words) - 1, 0))]) if len(words) else h
        h = np.where(inside, step, h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(n) + 1))
