"""Number arrays in few bytes, and keyed requests that many batches put to hash ranges.

Operators over word sequences shuffle billions of hashes. A batch of documents sends each range of the hash
space one blob of sorted hashes, stored as differences of as many bytes as the largest one needs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread uint64 values over all bits (a finaliser of the splitmix kind)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers: width, count, then their bytes by significance."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width]
    return struct.pack("<BI", width, len(values)) + planes.T.tobytes()


def pack_sorted(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values, dtype=U64)
    return pack(np.diff(values, prepend=U64(0)))


def pack_listed(values: np.ndarray) -> bytes:
    """Values that repeat: each once, then their places among these."""
    own, at = np.unique(values, return_inverse=True)
    return pack_sorted(own) + pack(at)


class Reader:
    """Reads arrays back in the order in which they were packed."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def ints(self) -> np.ndarray:
        width, n = struct.unpack_from("<BI", self.data, self.at)
        self.at += 5
        out = np.zeros((n, 8), dtype=np.uint8)
        out[:, :width] = np.frombuffer(self.data, dtype=np.uint8, count=width * n, offset=self.at).reshape(width, n).T
        self.at += width * n
        return out.view("<u8").reshape(-1)

    def sorted(self) -> np.ndarray:
        return np.cumsum(self.ints(), dtype=U64)

    def listed(self) -> np.ndarray:
        own, at = self.sorted(), self.ints().astype(np.int64)
        return own[at]


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range, of equal widths, that each hash of 64 bits falls into; it ascends with the hash."""
    return (((hashes >> U64(32)) * U64(ranges)) >> U64(32)).astype(np.int64)


def runs(ranges: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run in an ascending array."""
    if not len(ranges):
        return
    starts = np.flatnonzero(np.append(True, np.diff(ranges) != 0))
    for s, e in zip(starts, [*starts[1:], len(ranges)], strict=True):
        yield int(ranges[s]), int(s), int(e)
