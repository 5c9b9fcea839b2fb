"""Words, word hashes and windows of many texts at once, as NumPy arrays over their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidewire.llm.common import mix64

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and the odd base of the polynomial hash.
BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, kept for later calls."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


@dataclass(slots=True)
class Words:
    """Words of n documents, in order: place in the bytes, length in bytes, document, 64-bit hash; and words per document."""

    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    counts: np.ndarray


def words_of(raw: np.ndarray, offsets: np.ndarray, *, lower: bool = False, hashes: bool = True) -> Words:
    n = len(offsets) - 1
    inside = ~IS_SPACE[raw]
    edge = np.empty(len(raw) + 1, bool)
    if len(raw):
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        first = offsets[1:-1]
        first = first[(first > 0) & (first < len(raw))]
        split = np.unique(first[inside[first] & inside[first - 1]])  # a word that ends with a text and one that starts the next
        places = np.flatnonzero(edge)
        if len(split):
            places = np.sort(np.concatenate([places, split, split]))
    else:
        places = np.zeros(0, np.int64)
    start, end = places[::2], places[1::2]
    doc = np.searchsorted(offsets, start, side="right") - 1
    counts = np.bincount(doc, minlength=n).astype(np.int64)
    hashed = np.zeros(0, np.uint64)
    if hashes and len(start):
        length = end - start
        within = np.flatnonzero(inside)
        values = BYTE_VALUE[LOWER[raw[within]] if lower else raw[within]]
        first = np.cumsum(length) - length
        values *= powers(int(length.max()))[np.arange(len(within)) - np.repeat(first, length)]
        hashed = mix64(np.add.reduceat(values, first) ^ length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(start, end - start, doc, hashed, counts)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word windows within documents: (hash, document, index of the first word)."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = words.hash[: n - k + 1].copy()
    for i in range(1, k):
        h *= BASE
        h ^= h >> np.uint64(29)
        h += words.hash[i : n - k + 1 + i]
    same = words.doc[: n - k + 1] == words.doc[k - 1 :]
    at = np.flatnonzero(same)
    return mix64(h[at]), words.doc[at], at


#: Windows and words are told apart by this many bits of their hash within a document; the document stands above them.
HASH_BITS = 52
MOST_DOCS = 1 << (64 - HASH_BITS)
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)


def distinct_per_doc(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, value & HASH_MASK) pairs, sorted, and how often each occurs; documents are below MOST_DOCS."""
    if not len(value):
        return doc.astype(np.int64), value, np.zeros(0, np.int64)
    both = (doc.astype(np.uint64) << np.uint64(HASH_BITS)) | (value & HASH_MASK)
    both.sort()
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    found = both[at]
    return (found >> np.uint64(HASH_BITS)).astype(np.int64), found & HASH_MASK, np.diff(np.append(at, len(both)))
