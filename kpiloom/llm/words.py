"""Word and shingle hashes of whole Arrow batches, vectorised, for use inside tasks.

Texts are read as the UTF-8 bytes of their Arrow column.  A word is a maximal
run of bytes other than 0x20 and 0x09-0x0D, and its 64-bit hash comes from
differences of one polynomial prefix sum over the batch.  A null text counts as
empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes (a longer text alone),
#: which bounds the memory of a task by a multiple of its longest text.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C17  # odd, and one less is twice an odd number
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


#: One random-looking value per byte; in FOLDED, A-Z have those of a-z.
EXACT = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
FOLDED = EXACT.copy()
FOLDED[ord("A") : ord("Z") + 1] = EXACT[ord("a") : ord("z") + 1]

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_FACTORS = mix(np.arange(1, 65, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            np.cumprod(table, out=table)
            _powers[k] = table
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of rows of about SLICE_BYTES: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
            last = min(max(last, row + 1), batch.num_rows, row + 4096)
            yield batch.slice(row, last - row), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
            row = last


def prefix_sums(data: np.ndarray, values: np.ndarray = EXACT) -> np.ndarray:
    """Polynomial prefix sums; with range_hash they give the hash of any range."""
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(values[data] * powers(len(data))[0], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), the same wherever they stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every maximal run of bytes that are ``inside``, and the first run of every text (one more at the end)."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = True, ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    before[edges] = True
    after = np.empty_like(inside)
    after[-1], after[:-1] = True, ~inside[1:]
    after[edges - 1] = True
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return start, end, np.searchsorted(start, offsets)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges [start, end) as a binary column."""
    sizes = end - start
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    taken = data[np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(taken)])


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word, and the first word of every text (one more at the end)."""
    return runs(~SPACE[data], offsets)


def words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray = FOLDED):
    """(hash, start, end) of every word, and the first word of every text."""
    start, end, first = spans(data, offsets)
    return range_hash(prefix_sums(data, values), start, end), start, end, first


def shingles(hashes: np.ndarray, first: np.ndarray, n: int, whole_short: bool = False):
    """Hashes of all runs of ``n`` words within a text, and the first of each text.

    With ``whole_short`` a text of one to n-1 words has its whole sequence as
    its only run.
    """
    total, counts = len(hashes), np.diff(first)
    runs = max(total - n + 1, 0)
    out = np.zeros(total, dtype=U64)
    for k in range(n):
        out[:runs] += hashes[k : k + runs] * _FACTORS[k]
    keep = np.arange(total) + n <= np.repeat(first[1:], counts)
    out = mix(out)
    if whole_short:
        for text in np.flatnonzero((counts > 0) & (counts < n)):
            at, size = first[text], counts[text]
            parts = np.append(hashes[at : at + size] * _FACTORS[:size], _FACTORS[32 + size])
            out[at : at + 1] = mix(parts.sum(dtype=U64, keepdims=True))
            keep[at] = True
        sizes = np.where(counts < n, np.minimum(counts, 1), counts - n + 1)
    else:
        sizes = np.maximum(counts - n + 1, 0)
    return out[keep], np.concatenate([[0], np.cumsum(sizes)]), np.flatnonzero(keep)


def sum_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]
