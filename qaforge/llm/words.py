"""Words of whole texts and their 64-bit hashes, for a whole Arrow batch at once in numpy.

Texts are handled as UTF-8 bytes. All separators are ASCII, so a cut at a separator never splits a character.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of words that white space (0x20, 0x09-0x0D) ends.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words that anything but digits, letters a-z and bytes beyond ASCII ends (after lower-casing).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of a group of texts: where each begins and ends in `bytes`, its hash, and each text's first word."""

    def __init__(self, texts: pa.Array, of_word: np.ndarray):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.bytes, self.offsets = _LOWER[raw], offsets
        n = len(raw)
        inside = of_word[self.bytes]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:n]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        own = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        self.hash = mix(own + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def __len__(self) -> int:
        return len(self.starts)


def trim() -> None:
    """Give memory that was freed back to the system: workers live on from task to task, with whatever their largest one took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def groups(texts: pa.Array, size: int = 1 << 20):
    """Slices of texts of about so many bytes (a longer text has one of its own), as (first row, slice); memory is trimmed after
    the last."""
    if not len(texts):
        return
    lengths = texts.cast(pa.large_binary())
    offsets = np.frombuffer(lengths.buffers()[1], np.int64, len(texts) + 1, lengths.offset * 8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to
    trim()


def hash_word(word: str) -> int:
    """The hash that Words gives to this (lower-case) word."""
    return int(Words(pa.array([word]), np.ones(256, bool)).hash[0])
