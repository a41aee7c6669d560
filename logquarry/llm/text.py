"""Texts of Arrow batches as bytes: blocks, word spans and hashes (numpy, inside tasks)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

MASK = (1 << 64) - 1
# glibc only; elsewhere freed memory is left to the allocator.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
# Texts of one block, in bytes. A longer text is a block of its own.
BLOCK = 8 << 20
# Bytes hashed at once; a longer segment is hashed in one go.
PIECE = 1 << 19


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (splitmix64 finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return splitmix(step + np.uint64(seed))


class Hasher:
    """Hashes of byte segments: sum of table[byte] * base**position modulo 2**64, then mixed.

    The table is random per seed, so two different segments collide with probability about 2**-60.
    """

    def __init__(self, seed: int):
        self.table = _stream(seed, 256)
        base = int(_stream(seed ^ 0x5DEECE66D, 1)[0]) & ~7 | 5
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = (np.full(n, x, np.uint64) for x in (self.base, self.inverse))
            up[0] = down[0] = 1
            np.cumprod(up, out=up)
            np.cumprod(down, out=down)
            if n > 2 * PIECE:
                return up, down
            self.up, self.down = up, down
        return self.up, self.down

    def segments(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash per [start, end); segments are in order and do not overlap."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            stop = int(ends[j - 1])
            up, down = self._powers(stop - base + 1)
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(self.table[data[base:stop]] * up[: stop - base], out=sums[1:])
            first, last = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[last] - sums[first]) * down[first]
            i = j
        return splitmix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_HASHERS: dict[int, Hasher] = {}


def hasher(seed: int = 1) -> Hasher:
    if seed not in _HASHERS:
        _HASHERS[seed] = Hasher(seed)
    return _HASHERS[seed]


def windows(hashes: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (empty if there are fewer)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = splitmix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[i : i + m] + np.uint64(seed))
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if not len(offs):
        offs = np.zeros(1, np.int64)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Return freed memory to the system: workers outlive tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def blocks(batches: Iterable[pa.RecordBatch], column: str, size: int = BLOCK) -> Iterator[pa.Table]:
    """Cut and join batches so that each table holds about ``size`` bytes of text."""
    held: list[pa.RecordBatch] = []
    full = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        row = 0
        while row < len(batch):
            done = int(ends[row - 1]) if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, done + size - full, "right")))
            held.append(batch.slice(row, stop - row))
            full += int(ends[stop - 1]) - done
            row = stop
            if full >= size or row < len(batch):
                yield pa.Table.from_batches(held)
                held, full = [], 0
                give_back()
    if held:
        yield pa.Table.from_batches(held)
    give_back()


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of the maximal runs of bytes with ``inside[byte]``.

    A run never reaches over the end of a text. The third array has one entry more than texts.
    """
    mask = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    opens = mask.copy()
    opens[1:] &= ~mask[:-1] | cut[1:-1]
    closes = mask.copy()
    closes[:-1] &= ~mask[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# ASCII letters in lower case; all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(outside: Iterable[int]) -> np.ndarray:
    inside = np.ones(256, bool)
    inside[list(outside)] = False
    return inside


# White space as the text rules name it: space and 9 to 13.
SPACE = [32, *range(9, 14)]
NOT_SPACE = byte_set(SPACE)
# Letters and digits of lower-cased ASCII, and every byte of a longer code point.
ALNUM = byte_set([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, after one byte with their width."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return bytes([values.itemsize]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(blob: bytes) -> np.ndarray:
    dtype = np.dtype(f"<u{blob[0]}")
    flat = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8)
    return np.ascontiguousarray(flat.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def smallest(values: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the smallest unsigned type."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def pack_deltas(ordered: np.ndarray) -> bytes:
    """Ascending unsigned integers as compressed differences."""
    ordered = ordered.astype(np.uint64)
    return pack(smallest(np.diff(ordered, prepend=np.zeros(1, np.uint64))))


def unpack_deltas(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob).astype(np.uint64), dtype=np.uint64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] items, then the same for the next start."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before, lengths)


def schema(text: str, more: DataFrame) -> StructType:
    """The columns of a schema text, then those of a frame."""
    return StructType([*StructType.fromDDL(text).fields, *more.schema.fields])
