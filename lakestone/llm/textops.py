"""Vectorised words, hashes and shingles of Arrow text columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_BYTES = np.arange(256)
#: A-Z lower-cased, other bytes as they are.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_LOWER_VALUES = LOWER.astype(U64) + U64(1)
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
WORD_BYTES = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_BYTES >= 128)
#: Bytes of tokens [^\x20\x09-\x0D]+.
TOKEN_BYTES = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal input gives equal output, close input far output."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Tables(dict):
    """A cache that stays where it is: copies sent to tasks are empty."""

    def __reduce__(self):
        return _Tables, ()


_TABLES = _Tables()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for n bytes at least."""
    size = max([1 << max(16, (n - 1).bit_length()), *(x for x in _TABLES if x <= STRETCH + 2)])  # a longer one does as well
    if size not in _TABLES:
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, U64), np.full(size, _BASE_INV, U64)
            up[0] = down[0] = 1
            found = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        _TABLES.clear()
        _TABLES[size] = found
    return _TABLES[size]


#: Bytes of a stretch: just below a power of two, which the tables of hash powers are as long as.
STRETCH = (1 << 21) - 2


def pieces(texts: pa.Array, limit: int = STRETCH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) of stretches of about ``limit`` bytes; null is empty.

    A longer text is a stretch of its own.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, stop, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


class Words:
    """The words of a stretch of texts: ``start`` and ``end`` bytes, 64-bit ``hash`` and, per text, ``first`` word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, members: np.ndarray = WORD_BYTES):
        n = len(data)
        inside = members[data] if n else np.zeros(0, bool)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        with np.errstate(over="ignore"):
            up, down = powers(n + 1)
            self._sum = np.zeros(n + 1, U64)
            np.cumsum(_LOWER_VALUES[data] * up[:n], dtype=U64, out=self._sum[1:])
            self._down = down
            self.hash = mix((self._sum[self.end] - self._sum[self.start]) * down[self.start]
                            + (self.end - self.start).astype(U64))

    def prefix_hash(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word (of all of a shorter one)."""
        end = np.minimum(self.end, self.start + size)
        with np.errstate(over="ignore"):
            return mix((self._sum[end] - self._sum[self.start]) * self._down[self.start] + U64(size << 32))

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive word hashes from each position, without regard to texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    base, many = 0xD6E8FEB86659FD93, len(hashes)
    with np.errstate(over="ignore"):
        # Horner's sum of a run from the sums of its halves, bit by bit of ``size``.
        out, held = hashes, 1
        for bit in bin(size)[3:]:
            out = out[:many - 2 * held + 1] * U64(pow(base, held, 1 << 64)) + out[held:]
            held *= 2
            if bit == "1":
                out = out[:many - held] * U64(base) + hashes[held:]
                held += 1
    return mix(out)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingle of each text): all ``size``-word shingles; a text of fewer words, but not none, has one."""
    count = words.count()
    each = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    first = np.concatenate(([0], np.cumsum(each)))
    out = np.empty(first[-1], U64)
    whole = grams(words.hash, size)
    long_texts = np.flatnonzero(count >= size)
    if len(long_texts):
        at = np.repeat(words.first[:-1][long_texts] - first[:-1][long_texts], each[long_texts])
        slots = np.repeat(first[:-1][long_texts], each[long_texts])
        ramp = np.arange(len(slots)) - np.repeat(np.concatenate(([0], np.cumsum(each[long_texts])[:-1])), each[long_texts])
        out[slots + ramp] = whole[slots + ramp + at]
    for k in range(1, size):
        texts = np.flatnonzero(count == k)
        if len(texts):
            acc = np.full(len(texts), k, U64)
            with np.errstate(over="ignore"):
                for j in range(k):
                    acc = acc * U64(0xD6E8FEB86659FD93) + words.hash[words.first[:-1][texts] + j]
            out[first[:-1][texts]] = mix(acc)
    return out, first
