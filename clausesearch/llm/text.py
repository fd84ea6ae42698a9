"""Vectorised word handling on Arrow batches, shared by the operators of this package.

A word is a maximal run of letters and digits, in lower case. Batches are tokenised with Arrow
kernels; only the distinct words of a batch are hashed one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than texts) and the flat array of words. A null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(clean, " "), " ")
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    full = pc.not_equal(flat, "")
    if not pc.all(full).as_py():
        keep = full.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        flat = flat.filter(full)
    return offsets, flat


def hash_words(flat: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word."""
    if len(flat) == 0:
        return np.zeros(0, np.uint64)
    d = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
    return table[d.indices.to_numpy()]


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment, modulo 2**64; an empty segment gives 0."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def ngram_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie within a segment, and the offsets of the runs."""
    total = len(words)
    sizes = np.maximum(np.diff(offsets) - (n - 1), 0)
    out = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if total < n or out[-1] == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    h = np.zeros(total - n + 1, np.uint64)
    for i in range(n):
        h = mix(h * M1 + words[i : total - n + 1 + i] + np.uint64(i + 1))
    starts = np.repeat(offsets[:-1] - out[:-1], sizes) + np.arange(out[-1])
    return h[starts], out
