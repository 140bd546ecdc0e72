"""Words and hashes of whole Arrow text columns at once, with numpy.

A block is a run of texts laid end to end, as Arrow stores them: ``data`` holds the UTF-8
bytes, ``offsets[i]:offsets[i + 1]`` is text ``i``; a null text is empty. A word is a
maximal run of bytes that are not ASCII white space, so no text needs to be decoded.
Word and shingle identities are 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_ROWS = 256
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240607)
_BYTE_CODE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = int(_RANDOM.integers(0, 2**64, dtype=np.uint64)) | 5
_STEP_INVERSE = pow(_STEP, -1, 2**64)
_WINDOW_STEP = np.uint64(int(_RANDOM.integers(0, 2**64, dtype=np.uint64)) | 5)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Words(NamedTuple):
    """Byte range of every word of a block; text ``i`` owns words ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The text number of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``data`` and ``offsets`` of a string or binary column."""
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


_CACHES: list = []


def worker_cache(build: Callable) -> Callable:
    """Keep what ``build`` gave last for as long as the tasks of a worker process use it."""
    kept = lru_cache(maxsize=1)(build)
    _CACHES.append(kept)
    return kept


def drop_caches(but: tuple = ()) -> None:
    """Free the tables of other operators, and give unused memory back to the machine.

    Worker processes outlive a stage; without this each would hold the tables of every
    operator it ever ran.
    """
    for cache in _CACHES:
        if cache not in but:
            cache.cache_clear()
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or with ``a.b`` the field ``b`` of the struct ``a``."""
    outer, _, inner = name.partition(".")
    return batch.column(outer).field(inner) if inner else batch.column(outer)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", uses: tuple = ()) -> Iterator[
        tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into blocks of at most 256 rows and, beyond one row, 1 MB of text.

    ``uses`` are the worker caches of this task; others are dropped when it begins.
    """
    drop_caches(uses)
    try:
        for batch in batches:
            sizes = np.cumsum(np.diff(text_bytes(column_of(batch, text))[1]))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                fits = int(np.searchsorted(sizes, before + BLOCK_BYTES, side="right")) - at
                block = batch.slice(at, max(1, min(BLOCK_ROWS, fits)))
                yield (block, *text_bytes(column_of(block, text)))
                at += block.num_rows
    finally:
        drop_caches(uses)


def words_of(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes that are not ``between`` words (a flag for each byte value)."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    return _runs(~between[data], edge, offsets)


def _runs(inside: np.ndarray, edge: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes ``inside`` that cross no ``edge``."""
    open_before = np.empty(len(inside), dtype=bool)
    open_after = np.empty(len(inside), dtype=bool)
    if len(inside):
        open_before[0], open_after[-1] = False, False
        open_before[1:], open_after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & ~(open_before & ~edge[:-1]))
    end = np.flatnonzero(inside & ~(open_after & ~edge[1:])) + 1
    return Words(start, end, np.searchsorted(start, offsets))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BREAK, _LETTER, _ALONE = 0, 1, 2
# scripts written without spaces between words
_UNSPACED = [(0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF),
             (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x3035),
             (0x3038, 0x303C), (0x3041, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF),
             (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x1B2FF),
             (0x20000, 0x3FFFF)]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Whether a code point parts words, belongs to one, or is a word of its own."""
    kinds = np.full(0x110000, _BREAK, dtype=np.uint8)
    for code in range(0x80, 0x40000):
        if unicodedata.category(chr(code))[0] in "LMN":
            kinds[code] = _LETTER
    for low, high in _UNSPACED:
        own = kinds[low:high + 1]
        own[own == _LETTER] = _ALONE
    kinds[0x200C:0x200E] = _LETTER  # joiners, inside words
    return kinds


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, number of bytes and code point of every character beyond ASCII."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at]
    size = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
    code = lead.astype(np.int64) & (0x7F >> size)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] = code[more] << 6 | data[at[more] + k] & 0x3F
    return at, size, code


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words]:
    """The bytes in lower case (ASCII and Latin letters), and their runs of letters and digits.

    Characters of scripts written without spaces are words of their own; punctuation and
    signs of every script part words.
    """
    lower = _LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    lower[capital] += 32
    inside = _ALNUM[lower]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    at, size, code = _characters(lower)
    kind = _kinds()[code]
    for k in range(4):
        inside[at[(kind == _BREAK) & (size > k)] + k] = False
    alone = kind == _ALONE
    edge[at[alone]] = edge[at[alone] + size[alone]] = True
    return lower, _runs(inside, edge, offsets)


_POWERS: dict[str, np.ndarray] = {}


def _powers(step: int, n: int) -> np.ndarray:
    """step ** 0 .. step ** n modulo 2 ** 64."""
    have = _POWERS.get(step)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 20), step, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= BLOCK_BYTES:
            _POWERS[step] = have
    return have


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for each pair, from one pass over the bytes."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * _powers(_STEP, n)[:n], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * _powers(_STEP_INVERSE, n)[start])


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and text number of every run of ``size`` words inside one text."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    skipped = first[:-1] - (np.cumsum(count) - count)
    return np.arange(len(text)) + skipped[text], text


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` consecutive word hashes from each start in ``at``."""
    total = hashes[at]
    for k in range(1, size):
        total = total * _WINDOW_STEP + hashes[at + k]
    return mix(total)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for every ``i``, empty ranges included."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
