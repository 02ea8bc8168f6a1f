"""Word shingles of whole texts as hashed multisets, in numpy over batches of texts."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_PLACE = np.array([(0x9E3779B97F4A7C15 * (2 * j + 1)) & (2**64 - 1) | 1 for j in range(64)], U64)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); works in place on its own copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        got = np.ones(size, U64)
        got[1:] = U64(base)
        _POWERS[base] = got = np.multiply.accumulate(got)
    return got[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (a run of bytes that aren't ASCII white space) of the texts in turn, and each text's count."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(raw):
        return np.empty(0, U64), np.zeros(len(texts), np.int64)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    inside = np.concatenate(([0], (~WHITE[raw]).view(np.int8), [0]))
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    summed = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _powers(_BASE, len(raw)), out=summed[1:])
    hashes = mix((summed[ends] - summed[starts]) * _powers(_INVERSE, len(raw))[starts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends_of))))
    return hashes, counts


def _sorted_shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each text's shingles in order, how many each text has, and where a key differs from the one before in its text.

    A text of fewer than ``words`` words is one shingle, a text without words has none.
    """
    hashes, counts = word_hashes(texts)
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    n = len(hashes)
    padded = np.concatenate((hashes, np.zeros(words, U64)))
    left = np.repeat(firsts + counts, counts) - np.arange(n)  # words from here to the text's end
    joined = np.zeros(n, U64)
    for j in range(words):
        part = padded[j : j + n] * _PLACE[j]
        joined += part if j == 0 else np.where(left > j, part, U64(0))
    whole = (left >= words) | (np.repeat(counts, counts) == left)
    made = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    keys = mix(joined[whole & ((left >= words) | (np.repeat(counts, counts) < words))])
    at = np.concatenate(([0], np.cumsum(made)))
    for i, j in zip(at, at[1:]):
        if j - i > 1:
            keys[i:j].sort()
    fresh = np.ones(len(keys), bool)
    if len(keys):
        fresh[1:] = keys[1:] != keys[:-1]
        fresh[at[:-1][made > 0]] = True
    return keys, made, fresh


def shingle_counts(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each text's distinct shingles, how often each occurs (float), and how many each text has."""
    keys, made, fresh = _sorted_shingles(texts, words)
    begun = np.flatnonzero(fresh)
    ends = np.searchsorted(begun, np.concatenate(([0], np.cumsum(made))))
    return keys[begun], np.diff(np.append(begun, len(keys))).astype(np.float64), np.diff(ends)


def shingle_units(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit keys of each text's shingles, and how many each text has.

    The n-th occurrence of a shingle is a unit of its own, so the multiset is a set of units and the
    weighted Jaccard similarity of two texts is the Jaccard similarity of their units. Equal texts
    have equal units in equal order.
    """
    keys, made, fresh = _sorted_shingles(texts, words)
    begun = np.flatnonzero(fresh)
    nth = np.arange(len(keys)) - np.repeat(begun, np.diff(np.append(begun, len(keys))))
    return mix(keys + nth.astype(U64) * U64(0x9E3779B97F4A7C15)), made
