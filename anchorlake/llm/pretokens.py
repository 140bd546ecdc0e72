"""Byte-level pre-tokenisation of whole blocks of texts.

The splitting pattern never joins a word to the white space behind it, and in front of a
word takes one plain space at most. So a text falls into units that can be encoded one by
one and remembered: each word with the space before it, and what is left of each run of
white space. The few texts for which this does not hold (other white space than ASCII, or
the text of a special token) are split by the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import regex

from anchorlake.llm.textblocks import range_hashes, sums, words_of

# fixed value: the splitting pattern of the byte-level vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = regex.compile(PATTERN)
# white space beyond ASCII, as the bytes of its UTF-8 form
_OTHER_SPACE = re.compile(
    rb"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
KEPT_UNITS = 300_000


class Units:
    """Units of a block: byte ranges in text order; text ``i`` owns ``first[i]:first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = words_of(data, offsets)
        inner = words.first[:-1][np.diff(words.first) > 0]
        before = np.empty(len(words.start), dtype=np.int64)  # where the space before a word starts
        if len(words.start):
            before[1:] = words.end[:-1]
            before[inner] = offsets[:-1][np.diff(words.first) > 0]
        last = np.full(len(offsets) - 1, -1, dtype=np.int64)
        last[np.diff(words.first) > 0] = words.end[words.first[1:][np.diff(words.first) > 0] - 1]
        tail_start = np.where(last >= 0, last, offsets[:-1])
        has_space = words.start > before
        plain = np.zeros(len(words.start), dtype=bool)
        if len(data):
            plain = has_space & (data[np.maximum(words.start - 1, 0)] == 0x20)
        head_end = words.start - has_space  # all of the run but its last character
        odd = has_space & ~plain
        parts = [
            (before, head_end, head_end > before),
            (head_end, words.start, odd),
            (words.start - plain, words.end, np.ones(len(words.start), dtype=bool)),
            (tail_start, offsets[1:], offsets[1:] > tail_start)]
        start = np.concatenate([s[keep] for s, _, keep in parts])
        end = np.concatenate([e[keep] for _, e, keep in parts])
        order = np.argsort(start, kind="stable")
        self.data, self.start, self.end = data, start[order], end[order]
        self.first = np.searchsorted(self.start, offsets)
        self.first[-1] = len(self.start)
        self.hashes = range_hashes(data, self.start, self.end)

    def bytes(self, unit: int) -> bytes:
        return self.data[self.start[unit]:self.end[unit]].tobytes()


def texts_to_split(data: np.ndarray, offsets: np.ndarray, special: list[str]) -> np.ndarray:
    """Numbers of the texts that must be split by the pattern itself."""
    found = re.compile(b"|".join([_OTHER_SPACE.pattern, *(re.escape(s.encode()) for s in special)]))
    places = [m.start() for m in found.finditer(data.tobytes())]
    return np.unique(np.searchsorted(offsets, places, side="right") - 1).astype(np.int64)


class UnitMemory:
    """Remembers what ``encode`` gives for a unit, under the unit's hash.

    ``encode`` gives a list of whole numbers for each unit of a list; they are kept end to
    end in one pool.
    The memory starts afresh once it holds ``KEPT_UNITS``, which changes no result.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], dtype=np.int32):
        self.encode, self.dtype = encode, dtype
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.pool = np.empty(1 << 16, dtype=self.dtype)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.size = 0

    def look_up(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in the pool for every unit."""
        known, sample, which = np.unique(units.hashes, return_index=True, return_inverse=True)
        if len(self.place) + len(known) > KEPT_UNITS:
            self._clear()
        at = list(map(self.place.get, known.tolist()))
        new = [k for k, place in enumerate(at) if place is None]
        for k, values in zip(new, self.encode([units.bytes(sample[k]) for k in new])):
            at[k] = self._add(int(known[k]), values)
        index = np.array(at, dtype=np.int64)[which] if len(at) else np.zeros(0, np.int64)
        start = self.starts[index]
        return start, self.starts[index + 1] - start

    def _add(self, key: int, values: list[int]) -> int:
        place, end = len(self.place), self.size + len(values)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(end, len(self.pool)), self.dtype)])
        if place + 1 >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
        self.pool[self.size:end] = values
        self.size = self.starts[place + 1] = end
        self.place[key] = place
        return place


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``pool[start[k]:start[k] + length[k]]`` for every ``k``, end to end."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start - (ends - length), length) + np.arange(total)]


def per_text(values: np.ndarray, units: Units) -> np.ndarray:
    return sums(values, units.first)
