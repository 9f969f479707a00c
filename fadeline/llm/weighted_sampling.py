"""TF-IDF shingles of a text, their weighted Jaccard similarity, and samples of them.

A shingle is five words in a row (all words of a shorter text).  Its weight is the
number of times it occurs times the mean inverse document frequency of its words.
Frequencies are kept by 2**16 hash buckets of words, so their size does not
depend on the corpus.

Improved consistent weighted sampling draws for each shingle and each of the
hash functions r and c from Gamma(2, 1) and b from [0, 1), takes the step
t = floor(ln(weight) / r + b) and lets the shingle with the smallest
c * exp(-r * (t - b + 1)) win.  Two texts draw the same pair (shingle, t) with a
probability that is their weighted Jaccard similarity.  The draws come from tables
of 2**16 entries at places that depend on the shingle and the function.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash

from fadeline.llm.text import words

SHINGLE, BUCKET_BITS, DRAW_BITS = 5, 16, 16
BANDS, ROWS = 12, 4

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    draws = np.random.default_rng(20)
    n = 1 << DRAW_BITS
    r = draws.gamma(2.0, 1.0, n)
    factors = draws.integers(1 << 62, (1 << 64) - 1, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    return r.astype(np.float32), np.log(draws.gamma(2.0, 1.0, n)).astype(np.float32), draws.random(n).astype(np.float32), factors


R, LOG_C, B, FACTORS = _tables()


def word_hashes(text: str | None) -> np.ndarray:
    own = words(text or "")
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


#: Words in a smaller share of documents weigh as much as those in this share.
RAREST = 0.1


def idf(n_documents: int, frequency: np.ndarray) -> np.ndarray:
    """Inverse document frequency of each bucket: from 0.69 for a word in every
    document to 2.4 for one in a tenth of them or fewer.  Beyond that rarity tells
    nothing more here: an edit that brings in a new word would else weigh more than
    the text it leaves alone, and copies would lower the weight of what they share."""
    n = max(1, n_documents)
    return np.log1p(n / np.maximum(RAREST * n, np.minimum(n, frequency)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FINAL
    return x ^ (x >> np.uint64(31))


def profile(text: str | None, bucket_idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text as 64-bit hashes, rising, and their weights."""
    hashes = word_hashes(text)
    n = min(SHINGLE, len(hashes))
    if not n:
        return hashes, np.zeros(0)
    weight_of = bucket_idf[buckets(hashes)]
    places = len(hashes) - n + 1
    shingles, weights = hashes[:places].copy(), weight_of[:places].copy()
    for i in range(1, n):
        shingles = mixed(shingles * _MIX + hashes[i : i + places])
        weights += weight_of[i : i + places]
    shingles, first, times = np.unique(shingles, return_index=True, return_counts=True)
    return shingles, weights[first] / n * times


def similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of smaller weights over that of larger ones."""
    _, a, b = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    if not len(a):
        return 0.0
    shared = float(np.minimum(one[1][a], other[1][b]).sum())
    return shared / (float(one[1].sum()) + float(other[1].sum()) - shared)


def samples(shingles: np.ndarray, weights: np.ndarray, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The winning shingle of each hash function and its step; for at least one shingle."""
    best = np.full(len(FACTORS), np.inf, np.float32)
    shingle, step = np.zeros(len(FACTORS), np.uint64), np.zeros(len(FACTORS), np.int64)
    log_weight = np.log(weights).astype(np.float32)
    functions = np.arange(len(FACTORS))
    for begin in range(0, len(shingles), at_once):
        own = shingles[begin : begin + at_once]
        place = ((own[:, None] * FACTORS) >> np.uint64(64 - DRAW_BITS)).astype(np.int32)
        r, b = R[place], B[place]
        t = np.floor(log_weight[begin : begin + at_once, None] / r + b)
        value = LOG_C[place] - r * (t - b + np.float32(1))
        winner = value.argmin(axis=0)
        value = value[winner, functions]
        better = value < best
        best[better], shingle[better] = value[better], own[winner[better]]
        step[better] = t[winner, functions][better].astype(np.int64)
    return shingle, step


def bands(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A hash of the samples of each band; none for a text without shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    shingle, step = samples(shingles, weights)
    drawn = mixed(shingle * _MIX + step.astype(np.uint64)).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mixed(out * _MIX + drawn[:, i])
    return out.view(np.int64)
