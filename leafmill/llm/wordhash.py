"""Words of whole Arrow text columns as numpy arrays of 64-bit hashes.

Texts are cut at separator bytes without making a Python object for each word: a
polynomial over the bytes is summed once, and the hash of a word (or of a run of
words) is the difference of two prefix sums, times the inverse of the power at its
start. UTF-8 keeps every byte of a multi-byte character above 0x7F, so cutting bytes
is the same as cutting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so that it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [\x20\x09-\x0D] separates words.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: [\x00-\x2F\x3A-\x60\x7B-\x7F] separates words, after lower-casing A-Z.
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept by the worker."""
    if len(_powers["up"]) < n:
        n = max(n, CHUNK_BYTES + 1024)
        for name, base in (("up", BASE), ("down", INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_A
    x ^= x >> np.uint64(29)
    x *= MIX_B
    x ^= x >> np.uint64(32)
    return x


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; values must not hold the same digit 0 as nothing."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def second(values: np.ndarray) -> np.ndarray:
    """Other digits for the same words: with them and the first ones, ranges() tells runs of words apart by 128 bits."""
    return mix(values ^ MIX_B) | np.uint64(1)


class Words:
    """The words of the documents first..last of a column.

    hashes, starts, ends: of each word (byte places in data); bounds: words of document
    i are bounds[i]:bounds[i + 1]; data: the bytes, lower-cased if asked for.
    """

    __slots__ = ("first", "last", "data", "hashes", "starts", "ends", "bounds", "offsets")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, first: int, separators: np.ndarray, lower: bool):
        n = len(raw)
        self.first, self.last, self.offsets = first, first + len(offsets) - 1, offsets
        self.data = LOWER[raw] if lower else raw
        inside = np.zeros(n + 2, dtype=bool)
        np.logical_not(separators[self.data], out=inside[1:-1])
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True  # a word never runs over the end of a document
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = ranges(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends) if n else np.zeros(0, np.uint64)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of n consecutive words from each word on, and whether one document holds them all."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, dtype=bool)
        at = np.arange(count)
        owner = self.owners()
        return ranges(self.hashes | np.uint64(1), at, at + n), owner[:count] == owner[n - 1 :]

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about limit bytes; a longer document is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(column, separators: np.ndarray, lower: bool) -> Iterator[Words]:
    """The words of every document of a text column, in runs of bounded size."""
    raw, offsets = text_buffers(column)
    for a, b in pieces(offsets):
        yield Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, separators, lower)
