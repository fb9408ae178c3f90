"""Hashes of words and word shingles, computed by numpy over whole Arrow buffers."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

M64 = (1 << 64) - 1
P = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2^64
#: Bytes of text that are hashed at once (a longer text goes alone).
CHUNK = 2_000_000
WIDTH = 5


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _tables():
    byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(P))
    byte[65:91] = byte[97:123]  # A-Z as a-z
    space = np.zeros(256, dtype=bool)
    space[[32, *range(9, 14)]] = True
    return byte, space


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK, 1 << (n - 1).bit_length())
    if size not in _powers:
        def grow(base: int) -> np.ndarray:
            out = np.full(size + 1, base, dtype=np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _powers.clear()
        _powers[size] = grow(P), grow(pow(P, -1, 1 << 64))
    return _powers[size]


def chunks(texts: pa.Array):
    """Slices of a string array with about CHUNK bytes each: (first row, bytes, start of each row in them, and end)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        end = min(end, len(texts))
        yield at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray):
    """Of the bytes of some rows: the hash of each word (A-Z lower-cased), its row, first byte and end."""
    byte, space = _tables()
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    gap = space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([True], gap[:-1])) | edge[:-1]
    after = np.concatenate((gap[1:], [True])) | edge[1:]
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    power, back = _power(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte[data] * power[: len(data)], dtype=np.uint64)))
    h = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(offsets, start, side="right") - 1, start, end


#: One odd factor for each word of a shingle.
_PLACE = mix(np.arange(11, 11 + WIDTH, dtype=np.uint64) * np.uint64(P)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its WIDTH-word shingles; with fewer words, one hash of the whole
    sequence; without words or text, none."""
    out: list[np.ndarray] = []
    for _, data, offsets in chunks(texts):
        h, row, _, _ = words(data, offsets)
        n = np.bincount(row, minlength=len(offsets) - 1)
        first = np.concatenate(([0], np.cumsum(n)))
        if len(h) >= WIDTH:
            m = len(h) - WIDTH + 1
            s = sum((h[j:j + m] * _PLACE[j] for j in range(1, WIDTH)), h[:m] * _PLACE[0])
            s = mix(s)
        for i in range(len(n)):
            a, k = first[i], n[i]
            if k >= WIDTH:
                out.append(np.unique(s[a:a + k - WIDTH + 1]))
            elif k:
                out.append(mix(np.array([sum(int(h[a + j]) * int(_PLACE[j]) for j in range(k)) + int(k) & M64], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out
