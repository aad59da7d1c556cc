"""Words and shingles of whole Arrow batches, hashed with numpy.

A word is a run of bytes other than space and 0x09-0x0D.  A batch is cut into
pieces of at most ``PIECE`` bytes of text (or one longer text), so memory is
bounded by the longest text.  Hashes have 64 bits: among n different words or
shingles about n * n / 2**65 pairs collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = np.uint64
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, dtype=_U64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


@dataclass
class Piece:
    """Consecutive rows of a batch: ``first`` is the row number of the first."""

    first: int
    data: np.ndarray      # bytes of all texts, lower-cased on request
    offsets: np.ndarray   # rows + 1
    starts: np.ndarray    # of words
    ends: np.ndarray
    row: np.ndarray       # of each word, counted from ``first``

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def word_bounds(self) -> np.ndarray:
        """For each row the number of its first word; one more at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def word_hashes(self) -> np.ndarray:
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=_U64)
        np.cumsum((self.data.astype(_U64) + _U64(1)) * up[:len(self.data)], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(raw + (self.ends - self.starts).astype(_U64) * _U64(0xD6E8FEB86659FD93))


def pieces(column: pa.Array, lower: bool = True) -> Iterator[Piece]:
    """Cut a string column into pieces; a null is an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("")
    if len(column) == 0:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        data = raw[offsets[first]:offsets[last]]
        yield _split(first, _LOWER[data] if lower else data, offsets[first:last + 1] - offsets[first])
        first = last


def _split(first: int, data: np.ndarray, offsets: np.ndarray) -> Piece:
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Piece(first, data, offsets, starts, ends, np.searchsorted(offsets, starts, side="right") - 1)


def sequence_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; the size is part of the hash."""
    n = len(words) - size + 1
    total = np.full(max(n, 0), (size * 0xA24BAED4963EE407) & ((1 << 64) - 1), dtype=_U64)
    for j in range(size if n > 0 else 0):
        total += words[j:j + n] * _U64((pow(_BASE, 3 * j + 3, 1 << 64)) | 1)
    return mix(total)


def shingle_sets(piece: Piece, size: int = 5) -> Iterator[np.ndarray]:
    """For each row its distinct shingles, sorted.

    Fewer words than ``size`` make one shingle of all words; no word makes none.
    """
    words, bounds = piece.word_hashes(), piece.word_bounds()
    runs = sequence_hash(words, size)
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - start >= size:
            yield np.unique(runs[start:end - size + 1])
        elif end > start:
            yield sequence_hash(words[start:end], end - start)
        else:
            yield np.zeros(0, dtype=_U64)
