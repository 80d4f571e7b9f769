"""Columns of integers as bytes, for exchanges that would be too large as a row for each value.

A map task packs what it has for one bucket into one row. Values are stored as byte planes (all lowest
bytes, then the next), so that Spark's shuffle compression removes the planes that are mostly zero.
"""

from __future__ import annotations

import struct

import numpy as np


def planes(x: np.ndarray, width: int | None = None) -> bytes:
    """Unsigned integers as byte planes; width: bytes kept of each (default: as many as the largest needs)."""
    x = np.ascontiguousarray(x, np.uint64)
    if width is None:
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    raw = x.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(raw.T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    width = b[0]
    raw = np.frombuffer(b, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view(np.uint64)


def zigzag(x: np.ndarray) -> np.ndarray:
    """Signed to unsigned, small magnitudes to small values."""
    x = np.asarray(x, np.int64)
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(1)) ^ (np.uint64(0) - (x & np.uint64(1)))).view(np.int64)


def deltas(x: np.ndarray) -> bytes:
    """Any int64 column, as differences."""
    x = np.asarray(x, np.int64)
    return planes(zigzag(np.diff(x, prepend=np.int64(0)))) if len(x) else planes(x)


def undeltas(b: bytes) -> np.ndarray:
    return np.cumsum(unzigzag(unplanes(b)))


def join(parts: list[bytes]) -> bytes:
    return struct.pack(f"<B{len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts)


def split(b: bytes) -> list[bytes]:
    n = b[0]
    sizes = struct.unpack_from(f"<{n}I", b, 1)
    at, out = 1 + 4 * n, []
    for size in sizes:
        out.append(b[at : at + size])
        at += size
    return out


def places(doc: np.ndarray, pos: np.ndarray) -> list[bytes]:
    """(document id, position) pairs, best sorted, as two columns."""
    if not len(doc):
        return [planes(pos), planes(pos), planes(pos)]
    new = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1 if doc[0] > np.iinfo(np.int64).min else doc[0] + 1))
    step = np.diff(np.asarray(pos, np.int64), prepend=np.int64(0))
    step[new] = pos[new]
    return [deltas(doc[new]), planes(np.diff(new, append=len(doc))), planes(zigzag(step))]


def unplaces(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ids, sizes, step = undeltas(parts[0]), unplanes(parts[1]).astype(np.int64), unzigzag(unplanes(parts[2]))
    doc = np.repeat(ids[: len(sizes)], sizes)
    total = np.cumsum(step)
    begin = np.cumsum(sizes) - sizes
    before = np.repeat(total[begin] - step[begin], sizes) if len(sizes) else np.empty(0, np.int64)
    return doc, total - before


def groups(sorted_key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_key):
        return np.empty(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_key[1:] != sorted_key[:-1]) + 1])


def runs(sorted_key: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal values."""
    begins = groups(sorted_key).tolist()
    return list(zip(begins, [*begins[1:], len(sorted_key)], strict=True)) if begins else []
