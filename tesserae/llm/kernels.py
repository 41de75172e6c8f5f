"""Vectorised byte and word kernels over Arrow string columns.

Everything here works on one Arrow batch at a time, in slices of bounded size,
so that a worker's memory does not follow the number or the length of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that a kernel holds at once, a little below a power of two; a longer text is a slice of its own.
SLICE_BYTES = (1 << 20) - 64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so that all bits of a sum count."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random 64-bit value for each byte, from the finaliser.
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Digits, ASCII letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            out = np.empty(size, U64)
            out[0], have, step = 1, 1, base
            while have < size:
                out[have : 2 * have] = out[:have] * U64(step)
                have, step = 2 * have, step * step & _MASK
            _powers[name] = out
    return _powers["up"][:n], _powers["down"][:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) over a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` bytes, and the place of each text's first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    is_in = inside[data]
    start = is_in.copy()
    start[1:] &= ~is_in[:-1]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    start[cut] = is_in[cut]
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = is_in[cut]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; fewer than n give none. Runs across texts are the caller's to drop."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    up, _ = powers(n)
    m = len(hashes) - n + 1
    out = hashes[:m] * up[0]
    for j in range(1, n):
        out += hashes[j : j + m] * up[j]
    return mix(out + U64(n))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles, lower-cased; a shorter text is one shingle."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets, ~SPACE)
    hashes = word_hashes(low, starts, ends)
    runs = grams(hashes, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            yield grams(hashes[a:b], b - a)
        else:
            yield np.zeros(0, U64)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, joined."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
