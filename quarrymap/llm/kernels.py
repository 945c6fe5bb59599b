"""Vectorised text kernels shared by the Arrow-batched operators.

A batch of texts is handled as one byte buffer with row offsets, so that
tokenising and hashing are numpy passes over the buffer, not Python loops over
words. Texts are lower-cased UTF-8; a word is a maximal run of ASCII letters,
ASCII digits and bytes above 0x7F. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one vectorised pass works on; a longer text is a pass of its own.
BLOCK_BYTES = 2 << 20
#: Rows of a pass at most: short texts take more memory by what is made of a row than by their bytes.
BLOCK_ROWS = 4096

_BASE = U64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE_INVERSE = U64(_inverse(int(_BASE)))
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[0x80:] = True
for _range in (b"09", b"az", b"AZ"):
    _IS_WORD[_range[0] : _range[1] + 1] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(which: str) -> np.ndarray:
    """Powers 0..BLOCK_BYTES of the hash base or of its inverse, modulo 2**64."""
    if which not in _powers:
        steps = np.full(BLOCK_BYTES + 1, _BASE if which == "up" else _BASE_INVERSE, dtype=np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and their offsets (one more than rows); nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    large = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def row_blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows whose sizes sum to about ``limit``; every row is in exactly one."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + limit, "right"))))
        yield at, to
        at = to


class Words(NamedTuple):
    start: np.ndarray  # first byte
    end: np.ndarray  # one past the last byte
    row: np.ndarray  # row of the block
    hash: np.ndarray  # 64-bit hash of the bytes


def _sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums, from which any byte range of at most BLOCK_BYTES bytes hashes in constant time."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[buf] * _power_table("up")[: len(buf)], out=out[1:])
    return out


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges are in order and don't overlap. Memory beside the result is that of BLOCK_BYTES bytes."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + BLOCK_BYTES, "right")))
        if int(end[j - 1]) - base <= BLOCK_BYTES:
            sums, s, e = _sums(buf[base : int(end[j - 1])]), start[i:j] - base, end[i:j] - base
            out[i:j] = (sums[e] - sums[s]) * _power_table("down")[s]
        else:  # one range longer than a block: the same sum, piece by piece
            total, power = 0, 1
            step = pow(int(_BASE), BLOCK_BYTES, 1 << 64)
            for at in range(base, int(end[i]), BLOCK_BYTES):
                total += int(_sums(buf[at : min(at + BLOCK_BYTES, int(end[i]))])[-1]) * power
                power = power * step % (1 << 64)
            out[i] = np.uint64(total % (1 << 64))
        i = j
    return mix64(out)


def words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of a block, in order."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    inside = _IS_WORD[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[inner < len(buf)]
    begins[inner] = inside[inner]
    inner = inner[inner > 0]
    ends[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(start, end, row, range_hashes(buf, start, end))


def shingles(w: Words, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``size`` words; a text of fewer words is one shingle, one of none has none."""
    n = len(w.row)
    if not n:
        return w.row, w.hash
    counts = np.bincount(w.row, minlength=rows)
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    m = max(0, n - size + 1)
    code = w.hash[:m].copy()
    for k in range(1, size):
        code = code * _BASE + w.hash[k : k + m]
    whole = w.row[:m] == w.row[size - 1 :] if m else np.zeros(0, bool)
    row, code = w.row[:m][whole], mix64(code[whole])
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] = extra[has] * _BASE + w.hash[first[short][has] + k]
        row, code = np.concatenate([row, short]), np.concatenate([code, mix64(extra ^ U64(0x5DEECE66D))])
        order = np.argsort(row, kind="stable")
        row, code = row[order], code[order]
    return row, code


def segments(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and row of each run of equal rows in a sorted array."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return starts, row[starts]


def distinct(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, code), sorted."""
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list a row out of flat values."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a 2-d array as bytes."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize if matrix.ndim == 2 else 0
    ends = (np.arange(len(matrix) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(matrix.tobytes())])


def from_binary_rows(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """The inverse of binary_rows for non-null rows of ``width`` values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), dtype)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.view(dtype).reshape(len(column), width)


def text_blocks(texts: pa.Array, lower: bool = True, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for each block of an Arrow column."""
    buf, offsets = text_buffer(texts, lower)
    for a, b in row_blocks(np.diff(offsets), limit, rows):
        yield a, b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
