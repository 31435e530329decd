"""Sets of word shingles as sorted 64-bit hashes, and their circulant MinHash signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from heddle.llm.chunks import coded

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """The hashes of each text's words with A-Z in lower case; every distinct word is hashed once."""
    codes, ends, distinct = coded(pc.ascii_lower(texts))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
    return np.split(hashes[codes] if len(codes) else np.zeros(0, np.uint64), ends[:-1]) if len(ends) else []


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all windows; a shorter sequence is one shingle; none has an empty set."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(width, n)
    total = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        total = (total * MULTIPLIER) ^ mix(hashes[j : n - size + 1 + j] + np.uint64(j))
        total = mix(total)
    return np.unique(total)


def permutation(x: np.ndarray, key: int) -> np.ndarray:
    """A permutation of the 32-bit universe, keyed."""
    k = np.uint32(key)
    x = x ^ k
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def circulant_signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """h_k = min over the set of pi(sigma(x) - k mod 2^32): two permutations, the second circularly shifted by k."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), coordinates), np.uint32)
    at = np.flatnonzero(sizes)
    start = 0
    while start < len(at):
        stop, total = start, 0
        while stop < len(at) and (stop == start or total < 60_000):
            total += sizes[at[stop]]
            stop += 1
        part = at[start:stop]
        sigma = permutation(np.concatenate([sets[i] for i in part]).astype(np.uint32), 0x51ED270B)
        cuts = np.concatenate(([0], np.cumsum(sizes[part])[:-1]))
        for k in range(coordinates):
            out[part, k] = np.minimum.reduceat(permutation(sigma - np.uint32(k), 0x2545F491), cuts)
        start = stop
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    n, k = signatures.shape
    bands = signatures.reshape(n, k // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64), (n, k // rows)).copy()
    for j in range(rows):
        key = mix(key * MULTIPLIER + bands[:, :, j])
    return key.view(np.int64)


def set_key(values: np.ndarray) -> bytes:
    """The set's name: SHA-256 of all its sorted members."""
    return hashlib.sha256(np.ascontiguousarray(values)).digest()
