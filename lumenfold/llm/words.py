"""Vectorised word and word-window hashing over batches of UTF-8 texts (numpy).

Words are maximal runs of bytes outside [\\x20\\x09-\\x0D]. All hashes are 64-bit
polynomial sums modulo 2**64 followed by a finalising mix; equal word sequences
always get equal hashes, whatever batch, worker or offset they are found at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

BASE_BYTE = np.uint64(0x9E3779B97F4A7C15)
BASE_BYTE_2 = np.uint64(0xC2B2AE3D27D4EB4F)
BASE_WORD = np.uint64(0xD6E8FEB86659FD93)
BASE_CHECK = np.uint64(0xA0761D6478BD642F)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text whose running sums are held at once.
CHUNK = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below n at least."""
    known = _POWERS.get(int(base))
    if known is None or len(known[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        known = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 1 << 22:
            _POWERS[int(base)] = known
    return known


class Rolling:
    """Hash of any range [s, e) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        up, self.down = _powers(base, len(values) + 1)
        self.sums = np.empty(len(values) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(values * up[: len(values)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        """Of each k consecutive values."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64, salt: np.uint64) -> np.ndarray:
    """A hash of each word, a few words' bytes at a time, so that memory follows the number
    of words. A word longer than `CHUNK` bytes is hashed on its own."""
    out, i = np.empty(len(start), dtype=np.uint64), 0
    while i < len(start):
        stop = int(np.searchsorted(end, start[i] + CHUNK, "right"))
        if stop <= i:
            long = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=int(salt).to_bytes(8, "little"))
            out[i] = int.from_bytes(long.digest(), "little")
            i += 1
            continue
        s, e = start[i:stop] - start[i], end[i:stop] - start[i]
        rolled = Rolling(data[start[i] : end[stop - 1]].astype(np.uint64) + np.uint64(1), base)
        out[i:stop] = mix(rolled.of(s, e) + (e - s).astype(np.uint64) * salt)
        i = stop
    return out


class Words:
    """The words of some texts. first[i]..first[i+1] are those of text i."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
        blank = _SPACE[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.data, self.start, self.end = data, edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
        self.first = np.searchsorted(self.start, begins)
        self.hash = _hash_words(data, self.start, self.end, BASE_BYTE, BASE_CHECK)

    def second_hash(self) -> np.ndarray:
        """Another hash of each word, from its bytes and not from the first one."""
        return _hash_words(self.data, self.start, self.end, BASE_BYTE_2, BASE_WORD)

    def __len__(self) -> int:
        return len(self.start)

    def owner(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(rows: Iterable[tuple], size: int = 1 << 18) -> Iterator[list[tuple]]:
    """Rows whose last field is bytes, in lists of about `size` bytes (a longer text is alone)."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held
