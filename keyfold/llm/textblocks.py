"""Words, lines and hashes of many texts at once, from the UTF-8 buffers of Arrow string columns.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. None of these bytes is part of a
longer UTF-8 sequence, so the bytes can be scanned without decoding them. A byte range is hashed by
eights: each run of eight bytes, read as one number, goes through two rounds of a mixing bijection with
its place between them, and the results are added. Ranges of at most eight bytes and equal length
never collide; for longer ones no structure of the text survives the mixing, so only chance is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
#: Odd constants of two independent hashes: for the number, its place, and the length.
_LANES = tuple(tuple(np.uint64(x) for x in row) for row in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class TextBlock:
    """n texts as one byte array. word_at[i]:word_at[i+1] are the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        word = (data != 0x20) & (data - np.uint8(0x09) > 0x04)
        self.is_word = word
        first, last = word.copy(), word.copy()
        if len(data):
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            edge = offsets[(offsets > 0) & (offsets < len(data))]
            first[edge] = word[edge]
            last[edge - 1] = word[edge - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.word_at = np.searchsorted(self.starts, offsets)
        self._eights: np.ndarray | None = None
        self._words: np.ndarray | None = None

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(sums[self.offsets])

    def per_text_words(self, values: np.ndarray) -> np.ndarray:
        """Sum over the words of each text."""
        kind = np.float64 if values.dtype.kind == "f" else np.int64
        sums = np.concatenate([[0], np.cumsum(values, dtype=kind)])
        return np.diff(sums[self.word_at])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        """64-bit hashes of the byte ranges [starts, ends); lanes 0 and 1 are independent of each other."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        if self._eights is None:  # the eight bytes from every place on, as one little-endian number
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._eights = np.ndarray(len(self.data) + 1, "<u8", padded.data, strides=(1,))
        number, place, length = _LANES[lane]
        size = ends - starts
        x = mix(mix((self._eights[starts] & _KEEP[np.minimum(8, size)]) + number) + place)
        long = np.flatnonzero(size > 8)
        if len(long):  # their other runs
            runs = (size[long] - 1) >> 3
            first = np.cumsum(runs) - runs
            turn = np.arange(1, first[-1] + runs[-1] + 1) - np.repeat(first, runs)
            at = np.repeat(starts[long], runs) + 8 * turn
            left = np.minimum(8, np.repeat(size[long], runs) - 8 * turn)
            y = mix((self._eights[at] & _KEEP[left]) + number)
            y = mix(y + (turn.astype(np.uint64) + np.uint64(1)) * place)
            x[long] += np.add.reduceat(y, first)
        return mix(x + size.astype(np.uint64) * length)

    def word_hashes(self) -> np.ndarray:
        if self._words is None:
            self._words = self.hashes(self.starts, self.ends)
        return self._words

    def other_hashes(self) -> np.ndarray:
        """A second hash of every word. With word_hashes() it tells words of at most eight bytes apart without fail, and longer ones by 128 bits."""
        size = self.ends - self.starts
        out = mix(self.word_hashes() + size.astype(np.uint64) * _LANES[1][2])
        long = np.flatnonzero(size > 8)
        out[long] = self.hashes(self.starts[long], self.ends[long], 1)
        return out

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the \\n-split lines of each text, and the text of each; a text of n breaks has n + 1 lines."""
        breaks = np.flatnonzero(self.data == 10)
        of = np.searchsorted(self.offsets, breaks, side="right") - 1
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        texts = np.concatenate([np.arange(self.n), of])
        order = np.lexsort((starts, texts))
        starts, texts = starts[order], texts[order]
        ends = np.empty_like(starts)
        same = np.zeros(len(starts), bool)
        same[:-1] = texts[:-1] == texts[1:]
        ends[:-1][same[:-1]] = starts[1:][same[:-1]] - 1
        ends[~same] = self.offsets[1:][texts[~same]]
        return starts, ends, texts


def blocks(texts: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, TextBlock]]:
    """(first row, row after the last, block) for runs of rows of at most `most` bytes, or one longer row; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, TextBlock(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b
