"""Word shingles and MinHash signatures of whole texts, by Arrow batch.

Words are runs without white space, in lower case. Texts of fewer than
``SIZE`` words have one shingle, all their words; texts without words have none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 5
HASHES = 128
_CHUNK = 1 << 16  # shingles hashed at once, so that they stay in the cache

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of each word, words per text)``; a null text has no words."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    encoded = flat.dictionary_encode()
    words = np.asarray(encoded.dictionary.to_pylist(), dtype=object)
    index = encoded.indices.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    kept = (words != "")[index] if len(words) else np.zeros(0, bool)
    return hashes[index][kept], np.bincount(owner[kept], minlength=len(counts))


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(shingle hashes, shingles per text)``, repeats included."""
    number = np.where(counts >= SIZE, counts - SIZE + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    at = np.repeat(first - np.concatenate([[0], np.cumsum(number)])[:-1], number)
    at = at + np.arange(len(at))
    left = np.repeat(np.minimum(counts, SIZE), number)  # words in the shingle
    padded = np.concatenate([words, np.zeros(SIZE, np.uint64)])
    value = left.astype(np.uint64)
    for k in range(SIZE):
        value = value + np.where(k < left, padded[at + k] * _PLACE[k], np.uint64(0))
    return mix(value), number


def fingerprints(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over words and their places; equal for equal sequences."""
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = (np.arange(len(words)) - np.repeat(first, counts)).astype(np.uint64)
    one = mix(words + place * np.uint64(0x9E3779B97F4A7C15))
    two = mix(words * np.uint64(0xD6E8FEB86659FD93) + mix(place))
    return _sums(one, counts), _sums(two, counts)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        out[full] = np.add.reduceat(values, starts[full])
    return out


def signatures(values: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One byte of each MinHash, a row per text that has shingles.

    Two texts agree in a byte with probability ``J + (1 - J) / 256``.
    """
    number = number[number > 0]
    out = np.empty((len(number), HASHES), np.uint8)
    ends = np.cumsum(number)
    row = done = 0
    while row < len(number):
        stop = max(row + 1, int(np.searchsorted(ends, done + _CHUNK, "right")))
        chunk = values[done:ends[stop - 1]]
        starts = ends[row:stop] - number[row:stop] - done
        for k in range(HASHES):
            least = np.minimum.reduceat((chunk * _A[k] + _B[k]) >> np.uint64(16), starts)
            out[row:stop, k] = (mix(least) & np.uint64(255)).astype(np.uint8)
        row, done = stop, int(ends[stop - 1])
    return out
