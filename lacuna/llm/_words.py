"""Words, word hashes and word shingles of whole Arrow string columns, computed with numpy on the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes of the two word definitions in use.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection with full avalanche)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_GOLD = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=U) * U(_GOLD))
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_COEF = mix(np.arange(1001, 1006, dtype=U) * U(_GOLD)) | U(1)
#: Positions whose powers a worker keeps; those of a longer text are made for it alone.
KEPT = (1 << 20) + 1
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers at least of the base and of its inverse."""

    def made(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, dtype=U)
        steps[0] = 1
        return np.cumprod(steps)

    if n > KEPT:
        return made(_BASE, n), made(_BASE_INVERSE, n)
    if not _powers:
        _powers[:] = made(_BASE, KEPT), made(_BASE_INVERSE, KEPT)
    return _powers[0], _powers[1]


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts with at most `most` bytes, or one longer text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, in order, and for each text the number of words before it (one more at the end)."""
    size = len(data)
    if not size:
        return np.zeros(0, dtype=U), np.zeros(len(offsets), dtype=np.int64)
    data = _LOWER[data]
    inside = word[data]
    cut = offsets[(offsets > 0) & (offsets < size)]
    before = np.empty(size, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(size, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _power(size + 1)
    total = np.empty(size + 1, dtype=U)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[:size], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * U(_GOLD))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one shingle; no word none."""
    if len(hashes) >= k:
        m = len(hashes) - k + 1
        runs = np.zeros(m, dtype=U)
        for j in range(k):
            runs += hashes[j : j + m] * _COEF[j % 5] * U(2 * (j // 5) + 1)
        runs = mix(runs)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            n = b - a
            yield mix(np.array([int((hashes[a:b] * _COEF[np.arange(n) % 5]).sum(dtype=U)) ^ (n << 56)], dtype=U))
        else:
            yield np.zeros(0, dtype=U)
