"""Words, and weighted shingles of words, as numpy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = re.compile(r"\w+")
#: Words of a shingle, and the similarity from which documents are near duplicates.
SHINGLE, SIMILAR = 5, 0.8

_GOLDEN, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], dtype=np.uint64)
_cache: dict[str, int] = {}
_CACHE_WORDS = 1 << 15


def words(text: str | None) -> list[str]:
    """The lower-case runs of letters, digits and underscores."""
    return WORDS.findall((text or "").lower())


def word_hashes(tokens: list[str]) -> np.ndarray:
    out = np.empty(len(tokens), dtype=np.uint64)
    if len(_cache) > _CACHE_WORDS:
        _cache.clear()
    known = _cache
    for i, x in enumerate(tokens):
        h = known.get(x)
        if h is None:
            h = known[x] = xxhash.xxh3_64_intdigest(x)
        out[i] = h
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_hashes(tokens: list[str], n: int = SHINGLE) -> np.ndarray:
    """The hash of every run of n words, in order; of all the words where there
    are fewer; nothing where there are none."""
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    n = min(n, len(tokens))
    h = word_hashes(tokens)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out += h[k : k + len(out)] * _POWERS[k]
    return mix(out)


def weighted_shingles(tokens: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, and how often each occurs."""
    return np.unique(shingle_hashes(tokens, n), return_counts=True)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d); equal
    weights make it the Jaccard similarity. Two empty bags have 0."""
    ids = np.union1d(a[0], b[0])
    x, y = np.zeros(len(ids)), np.zeros(len(ids))
    x[np.searchsorted(ids, a[0])] = a[1]
    y[np.searchsorted(ids, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # by ascending x/y: from an element on, the share in x is the larger one
    above = x.sum() - np.concatenate(([0.0], np.cumsum(x)[:-1]))
    below = np.concatenate(([0.0], np.cumsum(y)[:-1]))
    both = (x > 0) & (y > 0)
    return float((1.0 / (above[both] / x[both] + below[both] / y[both])).sum())


def prob_min_hash(ids: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The ProbMinHash signature: each element has arrivals of a Poisson process
    at the rate of its weight, each arrival falls in one register, and each
    register keeps the element that came first. Elements whose next arrival is
    later than every register's first one end early. The share of equal
    registers of two signatures estimates the probability Jaccard similarity."""
    first = np.full(registers, np.inf)
    kept = np.zeros(registers, dtype=np.uint64)
    rate = weights.astype(float)
    time = np.zeros(len(ids))
    step = 0
    while len(ids):
        ahead = max(1, -(-2 * registers // len(ids)))
        tick = np.arange(step + 1, step + ahead + 1, dtype=np.uint64) * _GOLDEN
        seed = mix(ids[:, None] + tick[None, :])
        gap = -np.log(((seed >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / rate[:, None]
        arrival = time[:, None] + np.cumsum(gap, axis=1)
        register = (mix(seed + _MIX_A) % np.uint64(registers)).astype(np.int64)
        came, where = arrival.ravel(), register.ravel()
        who = np.repeat(ids, ahead)
        better = np.flatnonzero(came < first[where])
        better = better[np.argsort(-came[better], kind="stable")]
        first[where[better]], kept[where[better]] = came[better], who[better]  # the last assignment is the earliest arrival
        step += ahead
        active = arrival[:, -1] < first.max()
        ids, rate, time = ids[active], rate[active], arrival[active, -1]
    return kept
