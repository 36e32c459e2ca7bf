"""Words and word shingles of many texts as 64-bit hashes, computed by numpy on the UTF-8 bytes.

A word's hash is that of its bytes: a polynomial over random byte values, modulo 2^64, made from
running sums over the whole buffer, then mixed. Hashes depend on the words only, not on batch or task.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Iterator

import numpy as np

SEGMENT = 1 << 18  # bytes hashed at a time, unless a word is longer
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _common_powers() -> tuple[np.ndarray, np.ndarray]:
    return _new_powers(SEGMENT + 1024)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers at least; those for a longer segment are not kept."""
    return _common_powers() if n <= SEGMENT + 1024 else _new_powers(n)


def _segment_words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of a buffer."""
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(buffer) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[buffer] * up[: len(buffer)], dtype=np.uint64)])
    return mix((run[ends] - run[starts]) * down[starts]), starts, ends


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of one text or of texts parted by white space."""
    buffer, at, parts = np.frombuffer(data, np.uint8), 0, []
    while at < len(buffer):
        end = min(at + SEGMENT, len(buffer))
        while end < len(buffer) and not _SPACE[buffer[end]]:
            end += 1
        h, s, e = _segment_words(buffer[at:end])
        parts.append((h, s + at, e + at))
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Lists of texts of about SEGMENT bytes together."""
    piece, size = [], 0
    for t in texts:
        piece.append(t)
        size += len(t) + 1
        if size >= SEGMENT:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several in order; lists of different length give unrelated hashes."""
    out = np.full(len(hashes[0]), len(hashes), np.uint64)
    for h in hashes:
        out = mix(out * np.uint64(0x9DDFEA08EB382D69) + h)
    return out


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles of `size` words: with fewer words the
    whole sequence is one, without words there is none."""
    for piece in pieces(texts):
        h, starts, _ = words_of(b"\n".join(piece))
        cuts = np.cumsum([0, *(len(t) + 1 for t in piece)])
        bounds = np.searchsorted(starts, cuts)
        every = fold([h[k : len(h) - size + 1 + k] for k in range(size)]) if len(h) >= size else h[:0]
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= size:
                yield np.unique(every[a : b - size + 1])
            elif b > a:
                yield fold([h[k : k + 1] for k in range(a, b)])
            else:
                yield h[:0]
