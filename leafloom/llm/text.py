"""Whole-batch text kernels over Arrow buffers.

Texts are handled as the UTF-8 bytes of an Arrow string column; words, their hashes and the hashes of runs of words are
computed for many documents at once with numpy, without making a Python object for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; a longer document is handled alone.
BLOCK = 1 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the bytes inside the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: `[^\x20\x09-\x0D]+`
NOT_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise and modulo 2**64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(0x632BE59BD9B4E019)) * U(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = (n + (1 << 18)) >> 18 << 18  # in steps, so that little is kept beyond a block
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, U(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES = [Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)]
_WORDS = [Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)]
_TABLES = [seeded(1, 256), seeded(2, 256)]


@dataclass
class Block:
    """Some consecutive texts of a batch: rows `first` to `last`, their bytes, and offsets into those."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # no such function in this C library
    _trim = None


def release() -> None:
    """Gives memory that isn't used back to the system: a worker that waits for its next task holds little beside its modules."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Splits a column into runs of rows of at most `limit` bytes, or of one row; then releases memory."""
    data, at = buffers(column)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Block(first, last, data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last
    release()


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    #: the row of the block that a word stands in, and each row's first word (one more than rows)
    doc: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(block: Block, kind: np.ndarray = NOT_BLANK) -> Words:
    """The maximal runs of bytes of a class inside each text."""
    inside = kind[block.data]
    opens, closes = inside.copy(), inside.copy()
    if len(inside):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = block.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(opens)
    first = np.searchsorted(start, block.offsets)
    return Words(start, np.flatnonzero(closes) + 1, np.repeat(np.arange(len(block)), np.diff(first)), first)


def word_hashes(data: np.ndarray, w: Words, lane: int = 0) -> np.ndarray:
    """A 64-bit hash for each word; two lanes are independent."""
    with np.errstate(over="ignore"):
        up, down = _BYTES[lane].get(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_TABLES[lane][data] * up[:-1], out=total[1:])
        return mix((total[w.end] - total[w.start]) * down[w.start] + (w.end - w.start).astype(U) * U(0x2545F4914F6CDD1D))


def run_hashes(h: np.ndarray, first: np.ndarray, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive words inside one row, and the place of each run's first word."""
    if len(h) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    room = np.maximum(np.diff(first) - k + 1, 0)
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room) + np.arange(room.sum())
    return span_hashes(h, at, at + k, lane), at


def span_hashes(h: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of the words from begin to end (excluded); equal for equal sequences of words."""
    with np.errstate(over="ignore"):
        up, down = _WORDS[lane].get(len(h) + 1)
        total = np.zeros(len(h) + 1, U)
        np.cumsum(h * up[:-1], out=total[1:])
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U) * U(0x9FB21C651E98DF25))


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64))


_CODEC = "zstd"


def pack(x: np.ndarray) -> bytes:
    """An integer or float array as compressed byte planes, with its length and width in front."""
    x = np.ascontiguousarray(x)
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, _CODEC, asbytes=True) if len(x) else (0).to_bytes(8, "little")


def unpack(b: bytes, dtype) -> np.ndarray:
    n, dtype = int.from_bytes(b[:8], "little"), np.dtype(dtype)
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(b[8:], n * dtype.itemsize, _CODEC, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n)
