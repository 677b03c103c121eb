"""Word shingle sets of whole Arrow text columns, without a loop per document.

A chunk of documents is one byte array.  Words are `[^\\x20\\x09-\\x0D]+` of the
UTF-8 bytes with A-Z lower-cased; no byte of a multi-byte character is a
separator, so cutting bytes equals cutting characters.  A word's hash is a
polynomial over randomised byte values mod 2**64, taken from one prefix sum; a
shingle's hash combines its words' hashes.  Both are fixed functions of the
content, alike on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER_VALUE = BYTE_VALUE[_LOWER]
_POSITION = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept for the worker's life."""
    key = "inv" if inverse else "fwd"
    got = _powers.get(key)
    if got is None or len(got) < n:
        size = max(n, CHUNK_BYTES + 1)
        step = np.full(size, _BASE_INV if inverse else _BASE, dtype=np.uint64)
        step[0] = 1
        got = np.multiply.accumulate(step)
        if size <= 4 * CHUNK_BYTES:      # a very long document's powers are not kept
            _powers[key] = got
    return got[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P[i] = sum of values[j] * base**j for j < i; has one element more."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Content hash of the spans [start, end), alike wherever they stand."""
    inv = powers(len(prefix), inverse=True)
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about `limit` bytes; a
    longer text is a run of its own.  NULL reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(off, off[row] + limit, side="right")) - 1)
        yield row, raw[off[row]:off[last]], off[row:last + 1] - off[row]
        row = last


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each document (one
    element more than there are documents)."""
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(off), dtype=np.int64)
    space = _SPACE[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[off] = True
    begins = ~space
    begins[1:] &= space[:-1] | cut[1:-1]
    ends = ~space
    ends[:-1] &= space[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the first word of each document."""
    start, end, first = word_spans(raw, off)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), first
    prefix = prefix_hash((_LOWER_VALUE if lower else BYTE_VALUE)[raw])
    return span_hash(prefix, start, end), first


def ngram_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each document's `width`-word shingles in order of position, and
    the document of each.  Fewer words than `width`: the whole sequence as one;
    no words: none."""
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), n)
    begin = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    length = np.minimum(count, width)[doc]
    total = length.astype(np.uint64)
    padded = np.concatenate((words, np.zeros(width, dtype=np.uint64)))
    for k in range(width):
        part = padded[begin + k] * _POSITION[k]
        total = total + (part if k == 0 else np.where(k < length, part, np.uint64(0)))
    return mix(total), doc


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingles, sorted within each document, and the
    first one of each document (one element more)."""
    words, first = word_hashes(raw, off)
    h, doc = ngram_hashes(words, first, width)
    if len(h):
        ends = np.searchsorted(doc, np.arange(len(off)))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            h[a:b].sort()
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(off)))
