"""Whole texts as flat byte arrays: the vectorised base of the text operators.

A batch of documents is one ``uint8`` array and the offsets of its documents. Words are the maximal runs of bytes
outside 0x20 and 0x09-0x0D. Hashes are 64 bits wide, computed from prefix sums of a polynomial and then mixed, so
that one pass over the bytes serves all substrings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Work is done on pieces of about so many bytes, which keeps the temporary arrays of a task small.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is far faster here than np.unique(), which hashes them."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each, at least one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def portions(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """Rows of batches in slices of about ``limit`` bytes of a text column, at least one row; nothing is copied.

    Spark sends batches of up to 64 MB; what is made of one at a time should not be a multiple of that. What a batch
    left behind is given back before the next one comes.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for lo, hi in pieces(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), limit):
            yield batch.slice(lo, hi - lo)
        del batch
        pa.default_memory_pool().release_unused()


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial's base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n + 1:
        size = max(n + 1, PIECE + (1 << 16))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = power_tables(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], from its prefix_sums()."""
    _, down = power_tables(len(sums) - 1)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the offsets of each document's words among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each document and the offsets of each document's.

    A document with fewer words, but at least one, has its whole word sequence as its only shingle.
    """
    count = np.diff(of)
    sizes = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_of = np.concatenate([[0], np.cumsum(sizes)])
    if not out_of[-1]:
        return np.zeros(0, U64), out_of
    n = len(words)
    run = np.zeros(n, U64)
    for k in range(width):
        run[: n - k] = run[: n - k] * U64(0xD6E8FEB86659FD93) + words[k:]
    run = mixed(run + U64(width))
    at = np.arange(out_of[-1]) - np.repeat(out_of[:-1], sizes) + np.repeat(of[:-1], sizes)
    out = run[at]
    for d in np.flatnonzero((count > 0) & (count < width)):
        whole = U64(0)
        with np.errstate(over="ignore"):
            for w in words[of[d] : of[d + 1]]:
                whole = whole * U64(0xD6E8FEB86659FD93) + w
            out[out_of[d]] = mixed(np.array([whole + U64(count[d])], U64))[0]
    return out, out_of


def sums_by(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[of[1:]] - total[of[:-1]]
