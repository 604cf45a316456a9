"""Vectorised primitives over the UTF-8 bytes of Arrow string columns.

Everything works on a flat byte array plus row offsets, a bounded number of bytes at a time, so a worker's
memory follows the block size (and the longest single text), not the batch or the partition.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def tidy(run: Callable) -> Callable:
    """A function of record batches that gives memory back when its partition ends: workers are reused by other stages."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return runs


def trim() -> None:
    """Returns freed memory of Arrow and of the C library to the machine."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column as large_string with nulls as empty texts."""
    return batch.column(name).cast(pa.large_string()).fill_null("")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array; offsets start at 0."""
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``limit`` bytes, or one row."""
    data, offs = flat(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift-multiply) over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums of a polynomial byte hash modulo 2**64; ``span_hash`` reads any substring's hash from them."""
    values = _VALUES[LOWER] if lower else _VALUES
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end), independent of where they lie."""
    return mix64((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes other than ASCII white space; runs never cross rows."""
    solid = ~_SPACE[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = offs[(offs < len(data))]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[edge] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    after[edge[edge > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1
