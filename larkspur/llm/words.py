"""Words, their hashes and windows of words over whole batches of texts, in numpy.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``. These are ASCII, so cutting UTF-8
bytes gives the same words as cutting code points. Everything here works on a *block*: whole texts
whose bytes lie one after another. ``blocks`` bounds how many bytes a block has (a longer text is a
block of its own), so memory depends on the longest text, not on the rows of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: Bytes hashed at a time; bounds the 8-byte temporaries that a long text needs.
SEGMENT = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    have = 1
    step = base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        have += more
        step = step * step % (1 << 64)
    return out


#: Odd, so that they have inverses modulo 2**64; one pair for each of the two hash families.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_UP = [_powers(b, SEGMENT + 1) for b in _BASES]
_DOWN = [_powers(pow(b, -1, 1 << 64), SEGMENT + 1) for b in _BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Texts ``first`` to ``first + len(offsets) - 2`` of a batch; ``offsets`` are byte positions in ``data``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: Words before each text, and after the last: text i has words ``word_at[i]`` to ``word_at[i + 1]``.
    word_at: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def left(self) -> np.ndarray:
        """For each word, how many words of its text begin at it or later."""
        return np.repeat(self.word_at[1:], self.counts()) - np.arange(len(self.starts))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each text."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """``texts``: an Arrow array of strings, or of their UTF-8 bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts if pa.types.is_large_binary(texts.type) else texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    _, at, raw = texts.buffers()
    bounds = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        j = min(j, n)
        data = raw[bounds[i] : bounds[j]]
        offsets = bounds[i : j + 1] - bounds[i]
        word = ~SPACE[data]
        before = np.empty(len(word), dtype=bool)
        before[1:] = word[:-1]
        if len(word):
            before[offsets[:-1][offsets[:-1] < len(word)]] = False
            starts = np.flatnonzero(word & ~before)
            after = np.empty(len(word), dtype=bool)
            after[:-1] = word[1:]
            last = offsets[1:] - 1
            after[last[last >= 0]] = False
            ends = np.flatnonzero(word & ~after) + 1
        else:
            starts = ends = np.zeros(0, dtype=np.int64)
        yield Block(i, data, offsets, starts, ends, np.searchsorted(starts, offsets))
        i = j


def word_hashes(block: Block, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; the two families are independent."""
    out = np.empty(len(block.starts), dtype=np.uint64)
    up, down, table = _UP[family], _DOWN[family], _BYTE[family]
    i, n = 0, len(out)
    total = np.zeros(SEGMENT + 1, dtype=np.uint64)
    while i < n:
        begin = int(block.starts[i])
        j = int(np.searchsorted(block.ends, begin + SEGMENT, side="right"))
        if j <= i:  # a word longer than a segment
            out[i] = _long(block.data[begin : block.ends[i]], family)
            i += 1
            continue
        size = int(block.ends[j - 1]) - begin
        np.cumsum(table[block.data[begin : begin + size]] * up[:size], out=total[1 : size + 1])
        s, e = block.starts[i:j] - begin, block.ends[i:j] - begin
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def _long(data: np.ndarray, family: int) -> np.uint64:
    value, place = 0, 1
    for k in range(0, len(data), SEGMENT):
        part = data[k : k + SEGMENT]
        value += int(np.sum(_BYTE[family][part] * _UP[family][: len(part)], dtype=np.uint64)) * place
        place = place * pow(_BASES[family], SEGMENT, 1 << 64) % (1 << 64)
    return np.uint64((value + len(data)) % (1 << 64))


def window_hashes(words: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values; entries whose run leaves a text are to be left out by the caller."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    step = SEGMENT - k
    up, down = _UP[1 - family], _DOWN[1 - family]
    total = np.zeros(SEGMENT + 1, dtype=np.uint64)
    for i in range(0, n, step):
        m = min(step, n - i)
        size = m + k - 1
        np.cumsum(words[i : i + size] * up[:size], out=total[1 : size + 1])
        out[i : i + m] = (total[k : k + m] - total[:m]) * down[:m]
    return mix(out)
