"""Sets of word shingles of whole texts, vectorised over Arrow batches.

Words are what [\\x20\\x09-\\x0D] separates, A-Z lowered; a text's set holds its distinct shingles of `width` words, or its
whole sequence as one if it has fewer, or nothing if it has no words. Shingles are 64-bit hashes: with s shingles in all, about
s * s / 2**65 pairs of different ones are taken as equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from florilege.llm.common import mix, utf8, word_hashes

WIDTH = 5


def sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of all texts, sorted by row and shingle, without repeats."""
    data, offsets = utf8(texts)
    words, first = word_hashes(data, offsets)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(texts)), counts)
    sizes = np.where((counts > 0) & (counts < width), 1, np.maximum(counts - width + 1, 0))
    starts = np.cumsum(sizes) - sizes
    out_row, out = np.repeat(np.arange(len(texts)), sizes), np.zeros(int(sizes.sum()), np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    n = len(words) - width + 1
    if n > 0:
        code = np.zeros(n, np.uint64)
        for k in range(width):
            code = mix(code + words[k : k + n] + np.uint64(k + 1))
        long = np.ones(len(out), bool)
        long[starts[short]] = False
        out[long] = code[row[:n] == row[width - 1 :]]
    if len(short):
        code = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            code[has] = mix(code[has] + words[first[short[has]] + k] + np.uint64(k + 101))
        out[starts[short]] = code
    for a, b in zip(starts[sizes > 1].tolist(), (starts + sizes)[sizes > 1].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out_row[1:] != out_row[:-1]) | (out[1:] != out[:-1])
    return out_row[new], out[new]


def signatures(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number per text that equal sets share."""
    total = np.zeros(n, np.uint64)
    size = np.bincount(row, minlength=n)
    full = size > 0
    if full.any():
        starts = (np.cumsum(size) - size)[full]
        total[full] = mix(np.add.reduceat(mix(code ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts) + size[full].astype(np.uint64))
    return total.view(np.int64)


def minhashes(row: np.ndarray, code: np.ndarray, n: int, k: int) -> np.ndarray:
    """k minima per text under k orders (zeros for empty sets)."""
    out = np.zeros((n, k), np.uint64)
    size = np.bincount(row, minlength=n)
    full = size > 0
    if full.any():
        starts = (np.cumsum(size) - size)[full]
        for j in range(k):
            out[full, j] = np.minimum.reduceat(mix(code + np.uint64(0x5851F42D4C957F2D * (j + 1) % (1 << 64))), starts)
    return out.view(np.int64)


def overlaps(a: pa.Array, b: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: sizes of both texts' sets and of what they share."""
    n = len(a)
    (ra, ca), (rb, cb) = sets(a, width), sets(b, width)
    na, nb, both = np.bincount(ra, minlength=n), np.bincount(rb, minlength=n), np.zeros(n, np.int64)
    ends = zip(np.cumsum(na).tolist(), na.tolist(), np.cumsum(nb).tolist(), nb.tolist(), strict=True)
    for k, (ea, sa, eb, sb) in enumerate(ends):
        merged = np.concatenate([ca[ea - sa : ea], cb[eb - sb : eb]])
        merged.sort()
        both[k] = np.count_nonzero(merged[1:] == merged[:-1])
    return na, nb, both
