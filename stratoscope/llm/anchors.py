"""Winnowed anchors of byte texts: every string of LENGTH bytes is assigned to the smallest-hashed gram inside it."""

from __future__ import annotations

import numpy as np

LENGTH = 100
GRAM = 32
_PIECE = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
_random = np.random.default_rng(20250117)
TABLES = _random.integers(0, 2**64, (2, 256), dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 2**64))
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= MULTIPLIER
    h ^= h >> np.uint64(29)
    h *= MULTIPLIER
    h ^= h >> np.uint64(32)
    return h


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((BASE, UNBASE)):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b))])
    return _powers[0][:n], _powers[1][:n]


class ByteHashes:
    """64-bit hashes of any stretch of a text, from running sums."""

    def __init__(self, text: np.ndarray, which: int = 0) -> None:
        up, self.down = powers(len(text) + 1)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(TABLES[which][text] * up[: len(text)], out=self.sums[1:])

    def all_of(self, size: int) -> np.ndarray:
        """Of every stretch of so many bytes; only the upper bits are mixed."""
        return (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size, np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive entries."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    blocks = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(rows, width)
    front = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[width - 1 : width - 1 + n])


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """Runs of consecutive strings of ``length`` bytes with one anchor: start, size in bytes, anchor's hash, and the hash of the whole stretch.

    Equal strings have equal anchors at equal offsets, so a string's copies are all found under its anchor's hash.
    """
    found: list[list[np.ndarray]] = []
    whole = np.frombuffer(text, np.uint8)
    for begin in range(0, max(0, len(whole) - length + 1), _PIECE):
        part = whole[begin : begin + _PIECE + length - 1]
        hashes = ByteHashes(part)
        n = len(part) - gram + 1
        h = hashes.all_of(gram) * MULTIPLIER
        at = (sliding_min((h & ~_PLACE) | np.arange(n, dtype=np.uint64), length - gram + 1) & _PLACE).astype(np.int32)
        start = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1]
        size = np.r_[start[1:], len(at)] - start + length - 1
        found.append([start + begin, size, mixed(h[at[start]]), hashes.of(start, size)])
    if not found:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    return [np.concatenate(x) for x in zip(*found, strict=True)]
