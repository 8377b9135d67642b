"""Words and word shingles of Arrow text batches as 64-bit hashes, with numpy.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A word's hash is a polynomial over random byte values,
taken from prefix sums, so a whole block of texts is hashed without a loop over words. Memory stays near
100 bytes per input byte of a block (256 KB) plus 16 bytes per word of a batch, whatever a text's length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Ship this module with the task, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
BLOCK = 1 << 18
SLICE_BYTES = 4 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_VALUE = np.random.default_rng(71).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                   0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK * 2, n)
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that end at a separator or at the end."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + BLOCK, n)
        while end < n and not _SEPARATOR[data[end]]:
            found = np.flatnonzero(_SEPARATOR[data[end:end + 4096]])
            end += int(found[0]) if len(found) else min(4096, n - end)
        yield start, end
        start = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _blocks(data):
        block = data[a:b]
        edges = np.ones(len(block) + 2, dtype=np.int8)
        edges[1:-1] = _SEPARATOR[block]
        change = np.flatnonzero(edges[1:] != edges[:-1])
        s, e = change[0::2], change[1::2]
        up, down = _power_tables(len(block))
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[block] * up[:len(block)], out=sums[1:])
        h = (sums[e] - sums[s]) * down[s]
        hashes.append(mix(h + (e - s).astype(np.uint64)))
        starts.append(s + a)
    word_starts = np.concatenate(starts)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    first = np.searchsorted(word_starts, bounds)
    return np.concatenate(hashes), np.diff(first)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and their number per text.

    A text of 1 to width-1 words has its whole sequence as its one shingle, a text without words has none.
    """
    n = len(words)
    steps = _STEPS[:width]
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, n)):
        total[:n - k] += words[k:] * steps[k]
    ends = np.cumsum(counts)
    begins = ends - counts
    per_text = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    keep = np.zeros(n + 1, dtype=np.int64)
    np.add.at(keep, begins[counts > 0], 1)
    np.add.at(keep, (begins + per_text)[counts > 0], -1)
    chosen = np.cumsum(keep[:n]).astype(bool)
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[begins[i]:ends[i]]
        total[begins[i]] = (own * steps[:len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(total[chosen]), per_text


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values.copy()
    ordered = np.sort(values)
    keep = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=keep[1:])
    return ordered[keep]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column's values, also of a table without rows, which has no chunks."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.to_numpy(zero_copy_only=False)


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to limit at most; a larger row stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in slices([len(t) for t in texts]):
        words, counts = word_hashes(texts[a:b])
        shingles, per_text = shingle_hashes(words, counts, width)
        at = 0
        for n in per_text.tolist():
            yield distinct(shingles[at:at + n])
            at += n
