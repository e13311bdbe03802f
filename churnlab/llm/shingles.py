"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch.

Works on the UTF-8 bytes: the white space of the contract and A-Z are
single bytes there. A word's hash is a polynomial over its bytes modulo
2**64, read off prefix sums over the whole batch, then mixed; a shingle's
hash combines the hashes of its words in order, with their number.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words; products wrap."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_POWERS = _powers(1)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the number of the text it is in.

    ``data``: bytes of all texts, a blank after each; ``starts``: where each
    text begins.
    """
    global _POWERS
    if len(_POWERS[0]) < len(data) + 1:
        _POWERS = _powers(len(data) + 1)
    blank = SPACE[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _POWERS
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
        h = (sums[last] - sums[first]) * down[first]
        h = mix64(h + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, first, side="right") - 1


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and offsets.

    A text of fewer words gives one shingle, its whole sequence; one without
    words gives none.
    """
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    h, doc = word_hashes(data, ends - lengths)
    n = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(n) - n
    span = np.minimum(n, words)
    shingles = np.where(n == 0, 0, n - span + 1)
    owner = np.repeat(np.arange(len(texts)), shingles)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + begin[owner]
    with np.errstate(over="ignore"):
        s = span[owner].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        for j in range(words):
            inside = j < span[owner]
            s = np.where(inside, mix64(s * BASE + h[np.where(inside, at + j, 0)]) if len(h) else s, s)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[fresh], owner[fresh]
    return s, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
