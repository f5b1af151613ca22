"""Vectorised word hashing over the UTF-8 bytes of an Arrow string column.

A word is a maximal run of bytes other than ASCII white space, so no Python object is made per word. Hashes are 64-bit
polynomial hashes of the word's bytes, mixed; they do not depend on the batch a text came in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


class Texts:
    """Some whole texts as one byte array; text i lies in data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, breaks: np.ndarray = SPACE) -> Words:
        return Words(self, breaks)


class Words:
    """Words of ``Texts``: start and end byte, hash, and the range of words of each text."""

    def __init__(self, texts: Texts, breaks: np.ndarray):
        data, offsets = texts.data, texts.offsets
        self.texts = texts
        inside = ~breaks[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        self._sums, self._down = sums, down
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start to end."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def __len__(self) -> int:
        return len(self.start)


def chain(hashes: np.ndarray, offsets: tuple[int, ...], n: int) -> np.ndarray:
    """For each of n positions the hash of the words at the given offsets from it, in order."""
    total = np.zeros(max(n, 0), dtype=np.uint64)
    for off in offsets:
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[off : off + len(total)]
    return mix(total + np.uint64(len(offsets)))


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles; with fewer words, the whole sequence; without words, nothing."""
    full = chain(words.hash, tuple(range(k)), len(words) - k + 1)
    for lo, hi in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if hi - lo >= k:
            yield np.unique(full[lo : hi - k + 1])
        elif hi > lo:
            yield chain(words.hash[lo:hi], tuple(range(hi - lo)), 1)
        else:
            yield np.empty(0, dtype=np.uint64)


def slices(column: pa.Array, lower: bool = True, limit: int = 1 << 19) -> Iterator[tuple[int, int, Texts]]:
    """Cuts a string column between texts into slices of about ``limit`` bytes: first row, row after the last, texts.

    Nulls count as empty texts. A text longer than the limit makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, what = column.buffers()
    ends = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(what, dtype=np.uint8) if what is not None else np.empty(0, dtype=np.uint8)
    lengths = np.diff(ends)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, lengths)
    lo = 0
    total = np.concatenate([[0], np.cumsum(lengths)])
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, side="right")) - 1)
        if (np.diff(ends[lo : hi + 1]) == lengths[lo:hi]).all():
            data = raw[ends[lo] : ends[hi]]
        else:
            data = np.concatenate([raw[ends[i] : ends[i] + lengths[i]] for i in range(lo, hi)])
        yield lo, hi, Texts(LOWER[data] if lower else data, total[lo : hi + 1] - total[lo])
        lo = hi


def texts_of(values: list[str | None], lower: bool = True) -> Texts:
    """All values as one ``Texts``, for short lists and tests."""
    parts = [(v or "").encode("utf-8", "replace") for v in values]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    return Texts(LOWER[data] if lower else data, offsets)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(h).view(np.int64)
