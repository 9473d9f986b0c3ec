"""Vectorised word splitting and hashing of whole texts in numpy, used inside Arrow tasks.

Texts are joined to one byte buffer and cut at separators into blocks of about one MB, so memory follows the block and the
number of words, never a whole partition.  A word's 64-bit hash comes from prefix sums over its bytes, so no Python runs
per word; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALPHANUMERIC = np.ones(256, dtype=bool)
NOT_ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MUL
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        n = max(n, BLOCK_BYTES + 2)
        inverse = np.uint64(pow(int(_MUL), -1, 1 << 64))
        have = np.cumprod(np.full(n, _MUL)), np.cumprod(np.full(n, inverse))
        if n <= 4 * BLOCK_BYTES:
            _POWERS[0] = have
    return have


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values`` times rising powers; the sum of any range follows by difference."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0][:len(values)], out=out[1:])
    return out


def _edges(apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turns = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if len(apart) and not apart[0]:
        turns = np.concatenate([[0], turns])
    if len(apart) and not apart[-1]:
        turns = np.concatenate([turns, [len(apart)]])
    return turns[::2], turns[1::2]


def spans(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separators."""
    return _edges(separators[data])


def _blocks(data: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about BLOCK_BYTES, each right behind a separator; one longer word stays whole."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + BLOCK_BYTES)
        while end < n and not separators[data[end - 1]]:
            found = np.flatnonzero(separators[data[start:end]])
            if len(found):
                end = start + int(found[-1]) + 1
            else:
                more = np.flatnonzero(separators[data[end:end + BLOCK_BYTES]])
                end = end + int(more[0]) + 1 if len(more) else min(n, end + BLOCK_BYTES)
        yield start, end
        start = end


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of one block."""
    sums = prefix(data)
    back = powers(len(data) + 1)[1]
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _MIX)


def split(data: np.ndarray, separators: np.ndarray = SPACES, runs=spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words of a byte buffer; ``runs`` finds the words of a block."""
    parts = []
    for start, end in _blocks(data, separators):
        block = data[start:end]
        s, e = runs(block, separators)
        parts.append((s + start, e + start, hash_ranges(block, s, e)))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (len - size + 1 of them, none if shorter)."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, step = np.empty(n, dtype=np.uint64), BLOCK_BYTES // 2
    for at in range(0, n, step):
        stop = min(n, at + step)
        sums = prefix(word_hashes[at:stop + size - 1])
        back = powers(stop - at + size)[1]
        out[at:stop] = mix((sums[size:] - sums[:stop - at]) * back[:stop - at])
    return out


class Slab:
    """Some texts as one byte buffer with a line feed between them, and the words of each.

    ``lower`` maps A-Z to a-z first.  ``first[i]:first[i + 1]`` are the words of text i; a null text has none.
    """

    def __init__(self, texts: list[str | None] | list[bytes | None], separators: np.ndarray = SPACES, lower: bool = False,
                 runs=spans):
        raw = [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else (x or b"") for x in texts]
        self.buffer = b"\n".join(raw)
        self.data = np.frombuffer(self.buffer, dtype=np.uint8)
        if lower:
            self.data = LOWER[self.data]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.starts, self.ends, self.hashes = split(self.data, separators, runs)
        self.first = np.searchsorted(self.starts, self.begin)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the word windows that lie within one text."""
        hashes = window_hashes(self.hashes, size)
        last = np.repeat(self.first[1:], self.counts())[:len(hashes)]
        at = np.flatnonzero(np.arange(len(hashes)) + size <= last)
        return at, hashes[at]


def slabs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes; a longer row stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_sizes(column) -> np.ndarray:
    """UTF-8 bytes of an Arrow text column, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
