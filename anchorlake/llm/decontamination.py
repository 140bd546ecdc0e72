"""Benchmark passages in documents, found by random-walk embeddings and verified by edit distance.

Texts are compared as sequences of plain words (lower case, no punctuation; in scripts
without spaces every character is a word). A random walk
reads a window word by word and at each step stays or moves on, as a hash of the step and the
word says; the words it reads are the embedding. Two windows at a small edit distance walk
apart only for a few steps around each edit, so their embeddings have a small Hamming
distance, and sampling a few steps gives the same words with good probability. Repeating
this with other walks reaches the wanted recall for windows of up to ``PIECE`` words. In
longer ones walks drift too far apart, so longer items are cut into even pieces: edits that
are too many for every piece are too many for the item, so one piece at least is within its
own allowed edits. What meets an item or a piece of it is verified by the exact edit
distance of the whole item to the best span of the document.

Pieces too short for any edit are searched for by the hash of all their words.

A window that lacks more of a piece's words than the edits allowed is skipped before its
walk; no piece of its size can match there.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.llm.common import type_of
from anchorlake.llm.registry import query
from anchorlake.llm.textblocks import blocks, mix, plain_words, range_hashes, text_bytes, window_hashes
from anchorlake.session import cut_lineage

SIMILARITY = 0.8      # 1 - edits / words of the item
MIN_WORDS = 1         # an item without a word is in no document
PIECE = 32            # words of an item that are searched for as one
WALKS = 96
SAMPLES = 3
ITEM_BLOCK = 2000     # items searched for in one pass over the documents
SEED = 20240607
_TABLE_BITS = 20


def allowed_edits(words: int, similarity: float) -> int:
    return int((1 - similarity) * words + 1e-9)


def pieces(words: int) -> list[tuple[int, int]]:
    """Start and size of the fewest even pieces of at most ``PIECE`` words."""
    count = -(-words // PIECE)
    cuts = [words * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def best_span(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to any span of ``words``, and that span."""
    item, words = item.tolist(), words.tolist()
    cost, start = [0] * (len(words) + 1), list(range(len(words) + 1))
    for k, word in enumerate(item, 1):
        diagonal, begun = cost[0], start[0]
        cost[0] = k
        for j, other in enumerate(words, 1):
            best, at = diagonal + (word != other), begun
            diagonal, begun = cost[j], start[j]
            if diagonal + 1 < best:
                best, at = diagonal + 1, begun
            if cost[j - 1] + 1 < best:
                best, at = cost[j - 1] + 1, start[j - 1]
            cost[j], start[j] = best, at
    end = min(range(len(cost)), key=cost.__getitem__)
    return cost[end], start[end], end


def _common(item: np.ndarray, words: np.ndarray) -> int:
    """How many words of ``item`` are among ``words``, each as often as it is there."""
    known, times = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return int(np.minimum(times, np.bincount(at[known[at] == words], minlength=len(known))).sum())


def _shared_words(entry: np.ndarray, starts: np.ndarray, stops: np.ndarray, size: int,
                  times: np.ndarray) -> np.ndarray:
    """At most how many words of each window an item can share, using each as often as it does."""
    out = np.zeros(len(starts), dtype=np.int64)
    entry = np.append(entry, np.full(size, len(times) - 1, dtype=entry.dtype))
    for low in range(0, len(starts), 4096):
        rows = entry[starts[low:low + 4096, None] + np.arange(size)]
        left = stops[low:low + 4096] - starts[low:low + 4096]
        short = np.flatnonzero(left < size)
        rows[short] = np.where(np.arange(size) < left[short, None], rows[short], len(times) - 1)
        rows.sort(axis=1)
        place = np.arange(size)[None, :]
        fresh = np.ones(rows.shape, dtype=bool)
        fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
        before = place - np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
        out[low:low + 4096] = (before < times[rows]).sum(axis=1)
    return out


class Walks:
    """The random walks over windows of one size."""

    def __init__(self, size: int):
        random = np.random.default_rng([SEED, size])
        self.size, self.steps = size, 2 * size
        self.factors = random.integers(0, 2**64, (self.steps, WALKS, 1), dtype=np.uint64) | np.uint64(1)
        picked = np.argsort(random.random((WALKS, self.steps)), axis=1)[:, :SAMPLES]
        self.read = np.zeros((self.steps, WALKS), dtype=bool)
        self.read[picked, np.arange(WALKS)[:, None]] = True

    def keys(self, words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """One key per walk and window ``words[start:stop]``; past its end a walk reads nothing."""
        at = np.broadcast_to(starts, (WALKS, len(starts))).copy()
        end = stops[None, :]
        keys = np.broadcast_to(np.arange(1, WALKS + 1, dtype=np.uint64)[:, None], at.shape).copy()
        last = len(words) - 1
        for step in range(self.steps):
            inside = at < end
            word = np.where(inside, words[np.minimum(at, last)], np.uint64(0))
            reads = self.read[step]
            if reads.any():
                keys[reads] = mix(keys[reads] * np.uint64(0x9E3779B97F4A7C15) + word[reads])
            at += ((word * self.factors[step]) >> np.uint64(63)).astype(np.int64) & inside
        return keys


class Exact:
    """Windows of one size that may not have any edit, by the hash of all their words."""

    def __init__(self, size: int):
        self.size = size

    def keys(self, words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return window_hashes(words, starts, self.size)[None, :]


class ItemIndex:
    """The pieces of one block's items by size, with their vocabulary and the keys of their walks."""

    def __init__(self, ids: list, texts: list, similarity: float):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        lower, words = plain_words(data, offsets)
        hashes = range_hashes(lower, words.start, words.end)
        self.ids, self.similarity = ids, similarity
        self.items = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        by_size = defaultdict(list)
        for k, item in enumerate(self.items):
            if len(item) >= MIN_WORDS:
                for start, size in pieces(len(item)):
                    by_size[size].append((k, start))
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(
            self.items[k] for own in by_size.values() for k, start in own if start == 0)]))
        # cell of a hash -> the vocabulary entries in it; entries past the last are unknown words
        self.cells = np.searchsorted(self.vocabulary >> np.uint64(64 - _TABLE_BITS),
                                     np.arange((1 << _TABLE_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.sizes = []
        for size, own in sorted(by_size.items()):
            times = np.zeros(len(self.vocabulary) + 1, dtype=np.int32)  # most uses of a word in one item
            words = [self.items[k][start:start + size] for k, start in own]
            for piece in words:
                words_used, used = np.unique(piece, return_counts=True)
                at = np.searchsorted(self.vocabulary, words_used)
                times[at] = np.maximum(times[at], used)
            walks = Walks(size) if allowed_edits(size, similarity) else Exact(size)
            keys = walks.keys(np.concatenate(words), np.arange(len(own)) * size, (np.arange(len(own)) + 1) * size)
            order = np.argsort(keys, axis=None, kind="stable")
            self.sizes.append((size, times, walks, keys.reshape(-1)[order],
                               np.tile(np.array(own), (len(keys), 1))[order]))

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary entry of every word; unknown words get the number past the last."""
        unknown = len(self.vocabulary)
        cell = (hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        low, high = self.cells[cell], self.cells[cell + 1]
        out = np.full(len(hashes), unknown, dtype=np.int32)
        open_at = np.flatnonzero(low < high)
        while len(open_at):
            entry = low[open_at]
            hit = self.vocabulary[entry] == hashes[open_at]
            out[open_at[hit]] = entry[hit]
            low[open_at] += 1
            open_at = open_at[~hit & (entry + 1 < high[open_at])]
        return out

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], set[tuple]]:
        """Word ranges by (text, item) that hold the span of the item around a window where a walk
        of the window and of a piece of the item reads the same words."""
        found = defaultdict(set)
        entry = self.known(hashes)
        text_end = np.repeat(first[1:], np.diff(first))
        for size, times, walks, keys, owners in self.sizes:
            shared = np.concatenate([[0], np.cumsum((times > 0)[entry], dtype=np.int32)])
            least = size - allowed_edits(size, self.similarity)
            # windows at a text's end are as long as what is left, so that a cut item is met too,
            # also in a text that is shorter than the item
            stop = np.minimum(np.arange(len(hashes)) + size, text_end)
            starts = np.flatnonzero(shared[stop] - shared[:-1] >= least)
            starts = starts[_shared_words(entry, starts, stop[starts], size, times) >= least]
            if not len(starts):
                continue
            seen = walks.keys(hashes, starts, stop[starts])
            low = np.searchsorted(keys, seen, side="left")
            high = np.searchsorted(keys, seen, side="right")
            texts = np.searchsorted(first, starts, side="right") - 1
            for walk, window in zip(*np.nonzero(low < high)):
                for item, start in owners[low[walk, window]:high[walk, window]].tolist():
                    whole, at = len(self.items[item]), int(starts[window]) - start
                    # the window may be off the piece by as much as the piece's own edits
                    off = allowed_edits(whole, self.similarity) + size - least
                    found[int(texts[window]), item].add((at - off, at + whole + off))
        return found

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(text, item id, edits, words of the item, first byte, end byte) of a block, best span each."""
        lower, words = plain_words(data, offsets)
        hashes = range_hashes(lower, words.start, words.end)
        out = []
        for (text, item), ranges in self.candidates(hashes, words.first).items():
            own = self.items[item]
            edits = allowed_edits(len(own), self.similarity)
            regions = []
            for low, high in sorted(ranges):
                low, high = max(words.first[text], low), min(words.first[text + 1], high)
                if regions and low <= regions[-1][1] and high - regions[-1][0] <= 4 * len(own):
                    regions[-1][1] = max(high, regions[-1][1])
                else:
                    regions.append([low, high])
            spans = [(edits + 1, 0, 0)]
            for low, high in regions:
                if _common(own, hashes[low:high]) >= len(own) - edits:
                    distance, a, b = best_span(own, hashes[low:high])
                    spans.append((distance, low + a, low + b))
                    if distance == 0:
                        break
            distance, a, b = min(spans)
            if distance <= edits and b > a:
                base = offsets[text]
                out.append((text, self.ids[item], distance, len(own),
                            int(words.start[a] - base), int(words.end[b - 1] - base)))
        return sorted(out, key=lambda m: (m[0], m[4], m[5]))


def item_blocks(items: DataFrame, similarity: float, size: int = ITEM_BLOCK):
    """Indexes of the items, one block at a time; the driver holds one block only."""
    ids, texts = [], []
    ordered = items.where("text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    for row in ordered.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        if len(ids) == size:
            yield ItemIndex(ids, texts, similarity)
            ids, texts = [], []
    if ids:
        yield ItemIndex(ids, texts, similarity)


_MATCH = "item_id {item}, edits int, item_words int, start_byte int, end_byte int"


def contaminated_spans(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, edits, item_words, span.

    An item is found where its words and those of a span of the document differ by at most
    (1 - similarity) times the item's words; the best span is given, the first of equal ones,
    as byte offsets of the UTF-8 text. Items that allow no edit, as those of one to four words,
    are found as they are. Null texts and items, and items without a word, match nothing.
    Repeated rows, of documents or items, give repeated rows. Other columns are ignored;
    empty tables give an empty result.
    """
    doc_type, item_type = type_of(docs, "doc_id"), type_of(items, "item_id")
    schema = f"doc_id {doc_type}, " + _MATCH.format(item=item_type)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def search(index: ItemIndex):
        def find(batches):
            for block, data, offsets in blocks(batches):
                found = index.matches(data, offsets)
                if found:
                    where, *columns = zip(*found)
                    names = ["item_id", "edits", "item_words", "start_byte", "end_byte"]
                    yield pa.RecordBatch.from_arrays(
                        [block.column("doc_id").take(pa.array(where, pa.int64())),
                         pa.array(columns[0]), *(pa.array(c, pa.int32()) for c in columns[1:])], ["doc_id", *names])
        return find

    out = None
    for index in item_blocks(items, similarity):
        part = cut_lineage(texts.mapInArrow(search(index), schema))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_contamination(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no item is found.

    Rows stay where they are, so nothing is shuffled and rows with equal or null ids are
    judged by their own text. Null texts stay.
    """
    kept = docs
    for index in item_blocks(items, similarity):
        def keep(batches, index=index):
            for block, data, offsets in blocks(batches):
                clean = np.ones(block.num_rows, dtype=bool)
                clean[[m[0] for m in index.matches(data, offsets)]] = False
                yield block.filter(pa.array(clean))
        kept = kept.mapInArrow(keep, docs.schema)
    return kept


@query("op7_decontamination")
def op7(t):
    return contaminated_spans(t.documents, t.benchmark)
