"""Vectorised words and shingles over Arrow string columns.

Words are found on UTF-8 bytes (both word definitions only name ASCII separators), hashed by a
polynomial of their lower-cased bytes modulo 2**64 and finished with a 64-bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words between ASCII white space
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: bytes of words of letters and digits, every non-ASCII character included (after LOWER)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = []
#: bytes of text worked on at once, beyond a single longer document
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finisher)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        del _powers[:]
        for base in (_P, _P_INV):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows whose texts hold about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and per document the index of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    low = LOWER[data]
    inside = kind[low]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    first = off[:-1]
    before[first[first < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after)
    return span_hashes(low, start, end + 1), np.searchsorted(start, off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans are not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row, in order.

    A text of fewer words has its whole sequence as its one shingle; no words, none.
    """
    k = [mix(np.array([j + 1], dtype=np.uint64) * _P)[0] | np.uint64(1) for j in range(size)]
    for row, data, off in chunks(column):
        h, at = words(data, off, NOT_SPACE)
        full = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for j in range(size):
            full += h[j : j + len(full)] * k[j]
        full = mix(full)
        for i in range(len(off) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= size:
                s = np.sort(full[a : b - size + 1])
                if len(s) > 1:
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
                yield row + i, s
            elif b > a:
                with np.errstate(over="ignore"):
                    one = np.uint64(b - a)
                    for j in range(a, b):
                        one += h[j] * k[j - a]
                    yield row + i, mix(np.array([one], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            else:
                yield row + i, np.zeros(0, np.uint64)
