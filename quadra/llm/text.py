"""Word spans and word-sequence hashes over Arrow string columns, vectorised over whole batches.

A word is a maximal run of bytes other than space and \\x09-\\x0D in the UTF-8 text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Seeds of the two independent hashes of a word, and odd factors (fixed values).
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LEFT, _RIGHT = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
#: Bytes up to which a word is hashed eight at a time with all others; longer ones go through XXH64.
_LONG = 64
_KEEP = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def release() -> None:
    """Give memory that a task has freed back to the system: workers are used again, and Arrow and malloc keep what they have had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and each row's offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches between rows so that each holds about `most` bytes of text; a longer text is a slice by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
    release()


class Words:
    """The words of a string column: byte ranges, and where each row's words begin."""

    def __init__(self, column: pa.Array, lower: bool = False, letters: bool = False):
        """lower: A-Z to a-z. letters: a word is a run of letters, digits and non-ASCII bytes instead."""
        data, offsets = buffers(column)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        if letters:
            inside = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
        else:
            inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, offsets)  # row r has the words rows[r]:rows[r + 1]

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def hashes(self, k: int = 0, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word (of its first `most` bytes). Every eight bytes go through `mix`, so equal sums or powers of
        bytes do not make equal hashes; words of up to eight bytes never collide with others of their length."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        sizes = ends - self.starts
        raw = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        h = mix(sizes.astype(U) + U(SEEDS[k]))
        live = np.arange(len(sizes))
        for at in range(0, _LONG, 8):
            h[live] = mix(h[live] + (eight[self.starts[live] + at] & _KEEP[np.minimum(sizes[live] - at, 8)]) * _RIGHT)
            live = live[sizes[live] > at + 8]
            if not len(live):
                return h
        for w in live.tolist():
            h[w] = xxhash.xxh64_intdigest(self.data[self.starts[w] : ends[w]], SEEDS[k])
        return h

    def windows(self, size: int, k: int = 0, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, start in row) of each run of `size` words within a row."""
        each = self.hashes(k) if hashes is None else hashes
        at, row, start = spread(np.maximum(self.counts - size + 1, 0), self.rows[:-1])
        return runs_of(each, size)[at], row, start


def runs_of(each: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` neighbours: runs of 1, 2, 4, ... are joined pairwise, each time through `mix`."""
    out, done, n, now = None, 0, 1, each
    while True:
        if size & n:
            out = now if out is None else pair(out[: max(0, len(now) - done)], now[done:][: len(out)])
            done += n
        n *= 2
        if n > size:
            return out
        now = pair(now[: max(0, len(now) - n // 2)], now[n // 2 :])


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    return mix(mix(a * _LEFT + U(1)) + b)


def spread(counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins[r] + i, r, i) for each r and each i < counts[r]."""
    row = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return begins[row] + step, row, step


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """pmod(xxhash64(id), buckets) of Spark SQL, for long ids."""
    p1, p2, p3, p4, p5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = U(42 + int(p5) + 8) ^ (_turn(np.ascontiguousarray(ids, np.int64).view(U) * p2, 31) * p1)
    h = _turn(h, 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return (h ^ (h >> U(32))).view(np.int64) % buckets


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not among `taken`, whatever their case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name
