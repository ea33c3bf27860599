"""Words of whole texts as 64-bit hashes, computed over Arrow batches with NumPy.

A word's hash is a polynomial over its bytes modulo 2**64 (differences of a running sum), finished by a mixing step,
so a batch of texts is hashed without a Python loop over words.  Texts are handled in pieces of about 256 KiB, cut
between words; memory beyond the text itself is eight bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15
SPACES = bytes([0x20, *range(0x09, 0x0E)])

#: bytes of words between spaces, and of words of digits, letters and non-ASCII characters
NOT_SPACE = np.array([b not in SPACES for b in range(256)])
ALNUM = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash, bijective."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on ``seed`` alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)


def powers(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * PIECE)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row starts; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches, size: int = 4 << 20):
    """Arrow batches cut to about ``size`` bytes, a longer row alone, so that working arrays stay small."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order (A-Z lower-cased) and, per row, where its words start in them."""
    size, at, found, places = len(data), 0, [], []
    rows = offsets[(offsets > 0) & (offsets < size)]
    while at < size:
        end = min(size, at + PIECE)
        while end < size and inside[data[end]] and inside[data[end - 1]]:  # do not cut a word
            gap = np.flatnonzero(~inside[data[end : end + 65536]])
            end = end + int(gap[0]) if len(gap) else min(size, end + 65536)
        part = data[at:end]
        first = inside[part]
        last = first.copy()
        here = rows[np.searchsorted(rows, at) : np.searchsorted(rows, end)] - at
        open_before = np.zeros(len(part), bool)
        open_before[1:] = first[:-1]
        open_before[here] = False
        closes = np.ones(len(part), bool)
        closes[:-1] = ~first[1:]
        closes[here[here > 0] - 1] = True
        if end < size and end in offsets:
            closes[-1] = True
        start, stop = np.flatnonzero(first & ~open_before), np.flatnonzero(last & closes) + 1
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((LOWER[part] + np.uint64(1)) * up[: len(part)], out=total[1:])
        found.append(mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)))
        places.append(start + at)
        at = end
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    return hashes, np.searchsorted(place, offsets)


def shingle_sets(hashes: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``size``-word shingles; fewer words make one shingle of them all."""
    factor = constants(size, 101)
    n = max(0, len(hashes) - size + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(size):
        runs += hashes[j : j + n] * factor[j]
    runs = mix(runs)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * factor[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out


def hash_one(word: str) -> int:
    """The hash that ``words`` gives one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)]), np.ones(256, bool))[0][0])
