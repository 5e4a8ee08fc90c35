"""Text as every operator here sees it: ASCII case folding, words, hashes of words.

The column functions stay in the JVM.  The array functions take a batch's UTF-8 bytes
as they lie in Arrow memory and hash every word in a few vectorised passes, without
making Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = "\\x20\\x09-\\x0D"
#: Bytes of text worked on at once.
SLICE = 1 << 20

A, B, C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def fold(text: Column) -> Column:
    """Lower-case A-Z only; null is empty.  ``lower`` does the same on pure ASCII, faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(folded: Column, separators: str = BLANK) -> Column:
    """The runs between separator characters, as an array without empty entries."""
    return F.array_remove(F.split(folded, f"[{separators}]+"), "")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * A
    h = (h ^ (h >> np.uint64(27))) * B
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A random odd 64-bit value for each byte, the same for A-Z and a-z."""
    values = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
    values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64, and of its inverse."""
    base = int(C)
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)


def slices(ids: pa.Array, text: pa.Array, most: int = SLICE) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of consecutive rows, about ``most`` bytes each; null texts are empty.

    A longer text makes a slice of its own.
    """
    text = text.cast(pa.large_binary())
    if text.null_count:
        text = text.fill_null(b"")
    if len(text) == 0:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield ids.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _IS_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; ``separator`` tells for each byte whether it separates."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, after = first[:-1].copy(), first[1:].copy()
    before[1:] |= gap[:-1]
    after[:-1] |= gap[1:]
    starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Hasher:
    """64-bit hashes of spans of one slice of bytes, A-Z as a-z: a polynomial over the bytes, then spread."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(max(SLICE, 1 << max(len(data) - 1, 0).bit_length()))
        self.total = np.empty(len(data) + 1, np.uint64)
        self.total[0] = 0
        np.take(_byte_values(), data, out=self.total[1:])
        self.total[1:] *= up[: len(data)]
        np.cumsum(self.total[1:], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * C)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Hasher(data)(starts, ends)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
