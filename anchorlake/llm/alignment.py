"""Alignment of the token ids of two tokenizers on the same texts.

Every text is encoded whole by both, a byte-level vocabulary (A) and a piece vocabulary (B).
Tokens that begin with a space are marks; where a mark of A and a mark of B begin at the same
byte, both have a token end there too, which makes it an anchor. Anchors cut a text into short
windows of token ids, most of them one word. How the tokens of a window group depends on its
two id tuples alone, so each pair of tuples is worked out once and remembered.

Id pairs whose tokens end together are links. Links are counted over the whole corpus; the
counts of the most frequent pairs, a bounded number, are looked up in the tasks, and only the
rarer ones go through a join.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.llm import pretokens as pre
from anchorlake.llm.common import type_of
from anchorlake.llm.packing import Encoder
from anchorlake.llm.prefix_counts import tokenizer_path
from anchorlake.llm.registry import query
from anchorlake.llm.textblocks import blocks, mix, range_hashes, sums, worker_cache
from anchorlake.session import cut_lineage

BYTES, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
KEPT_WINDOWS = 100_000
HOT_PAIRS = 500_000    # pairs whose counts every task looks up: 17 bytes each
WHOLE_CHARS = 1 << 16  # longer texts are encoded by B in parts where that changes nothing
_SPACE_MARK = "▁"


class Vocabulary:
    """The bytes of every token, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.marked = np.array([t[:1] == b" " for t in tokens])

    def spells(self, ids: np.ndarray, first: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts are what their tokens spell? Text ``i`` owns ``ids[first[i]:first[i + 1]]``."""
        sizes = np.diff(offsets)
        fits = sums(self.length[ids], first) == sizes
        own = ids[np.repeat(fits, np.diff(first))]
        spelt = pre.gather(self.pool, self.start[own], self.length[own])
        same = spelt == data[np.repeat(fits, sizes)]
        fits[np.flatnonzero(fits)] = sums(~same, np.concatenate([[0], np.cumsum(sizes[fits])])) == 0
        return fits


class PieceEncoder:
    """Ids of texts by a piece vocabulary, which puts a space in front of each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.vocabulary = Vocabulary([
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(_SPACE_MARK, " ").encode()
            for k, p in enumerate(pieces)])
        # no piece reaches over the start of a space run, so texts can be cut there
        self.parts = not any(_SPACE_MARK in p.lstrip(_SPACE_MARK) for p in pieces)

    def cut(self, text: str) -> list[str]:
        """Parts that encode to the ids of ``text``, each without the space it begins with."""
        out, at, look = [], 0, WHOLE_CHARS
        while self.parts and len(text) - at > WHOLE_CHARS:
            space = text.find(" ", look)
            if space < 0 or space + 1 == len(text):  # an empty part would get no space
                break
            if text[space - 1] in (" ", _SPACE_MARK):
                look = space + 1
                continue
            out.append(text[at:space])
            at, look = space + 1, space + 1 + WHOLE_CHARS
        return [*out, text[at:]]

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        parts = [self.cut(t) if t else [] for t in texts]
        ids = self.model.encode(list(chain.from_iterable(parts)), num_threads=1)
        sizes = sums(np.fromiter(map(len, ids), np.int64, len(ids)),
                     np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes


def shared_ends(a_length: np.ndarray, a_first: np.ndarray, b_length: np.ndarray, b_first: np.ndarray):
    """Window, tokens of A and tokens of B of every end that both share, for many windows at once.

    Window ``k`` holds the A tokens ``a_first[k]:a_first[k + 1]`` and the B tokens likewise;
    both cover the same bytes, so ends counted through all windows compare directly.
    """
    _, in_a, in_b = np.intersect1d(np.cumsum(a_length), np.cumsum(b_length), assume_unique=True, return_indices=True)
    window = np.searchsorted(a_first, in_a, side="right") - 1
    return window, in_a + 1 - a_first[window], in_b + 1 - b_first[window]


def _ranges(ids: np.ndarray, first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some windows end to end, and their bounds."""
    size = np.diff(first)[some]
    return pre.gather(ids, first[:-1][some], size), np.concatenate([[0], np.cumsum(size)])


class WindowMemory:
    """Remembers under the two id tuples of a window after how many tokens of A and B its groups end.

    It starts afresh once it holds ``KEPT_WINDOWS``, which changes no result.
    """

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b = a, b
        self._clear()

    def _clear(self) -> None:
        self.place: dict[tuple[bytes, bytes], int] = {}
        self.first = np.zeros(1, dtype=np.int64)  # groups of the window in place k: first[k]:first[k + 1]
        self.ends = np.zeros((2, 0), dtype=np.int32)

    def look_up(self, a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray):
        """Number of groups of each window, and the ends of all groups, counted from their window's start."""
        spans = lambda ids, first: range_hashes(ids.view(np.uint8), 4 * first[:-1], 4 * first[1:])
        hashes = mix(spans(a, a_first)) ^ spans(b, b_first)
        _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) + len(sample) > KEPT_WINDOWS:
            self._clear()
        raw_a, raw_b, place, new = a.tobytes(), b.tobytes(), self.place, []
        at = np.empty(len(sample), dtype=np.int64)
        bounds = (4 * x[sample + k] for x in (a_first, b_first) for k in (0, 1))
        for k, (a0, a1, b0, b1) in enumerate(zip(*(x.tolist() for x in bounds))):
            key = raw_a[a0:a1], raw_b[b0:b1]
            known = place.get(key)
            if known is None:
                known = place[key] = len(place)
                new.append(k)
            at[k] = known
        if new:
            self._add(a, a_first, b, b_first, sample[new])
        start, size = self.first[at[which]], np.diff(self.first)[at[which]]
        return size, pre.gather(self.ends[0], start, size), pre.gather(self.ends[1], start, size)

    def _add(self, a, a_first, b, b_first, new: np.ndarray) -> None:
        a, a_first = _ranges(a, a_first, new)
        b, b_first = _ranges(b, b_first, new)
        window, in_a, in_b = shared_ends(self.a.length[a], a_first, self.b.length[b], b_first)
        size = np.bincount(window, minlength=len(new))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.ends = np.concatenate([self.ends, np.stack([in_a, in_b]).astype(np.int32)], axis=1)


class Decimals:
    """Writes ids in decimal, each with one sign behind it."""

    def __init__(self, size: int):
        parts = [b"%d," % k for k in range(size)]
        self.pool = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.length = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def groups(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray):
        """``a1,a2|b1;a3|b2,b3;`` for groups that end at the given tokens, and where each group's text ends."""
        sizes = [np.diff(end, prepend=0) for end in (a_end, b_end)]
        ids = np.empty(len(a) + len(b), dtype=np.int64)
        ids[np.arange(len(a)) + np.repeat(b_end - sizes[1], sizes[0])] = a
        ids[np.arange(len(b)) + np.repeat(a_end, sizes[1])] = b
        length = self.length[ids]
        out, ends = pre.gather(self.pool, self.start[ids], length), np.cumsum(length)
        out[ends[a_end + b_end - sizes[1] - 1] - 1] = ord("|")
        out[ends[a_end + b_end - 1] - 1] = ord(";")
        return out.tobytes(), ends[a_end + b_end - 1]


class Aligner:
    """Both tokenizers, and the windows seen so far."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.a, self.b = Encoder(bytes_path), PieceEncoder(pieces_path)
        with open(bytes_path, "rb") as file:
            token = {int(rank): base64.b64decode(raw) for raw, rank in map(bytes.split, file)}
        self.a_tokens = Vocabulary([token.get(k, b"") for k in range(max(token) + 1)])
        self.memory = WindowMemory(self.a_tokens, self.b.vocabulary)
        self.decimals = Decimals(max(len(self.a_tokens.length), len(self.b.vocabulary.length)))

    def ids(self, data: np.ndarray, offsets: np.ndarray):
        """``space + text`` by A and ``text`` by B: ids and bounds, none where they do not spell it."""
        some = np.diff(offsets) > 0
        spaced = np.insert(data, offsets[:-1][some], 0x20)
        spaced_at = offsets + np.concatenate([[0], np.cumsum(some)])
        raw = data.tobytes()
        a, a_size = self.a.block(spaced, spaced_at)
        b, b_size = self.b.block([raw[x:y].decode() for x, y in zip(offsets[:-1], offsets[1:])])
        a = a.astype(np.int32, copy=False)
        bounds = lambda size: np.concatenate([[0], np.cumsum(size)])
        right = some & self.a_tokens.spells(a, bounds(a_size), spaced, spaced_at) \
            & self.b.vocabulary.spells(b, bounds(b_size), spaced, spaced_at)
        return (a[np.repeat(right, a_size)], bounds(a_size * right),
                b[np.repeat(right, b_size)], bounds(b_size * right))

    def block(self, data: np.ndarray, offsets: np.ndarray):
        """Per text: tokens of A and of B, the groups as text, and the links, with their bounds."""
        a, a_first, b, b_first = self.ids(data, offsets)
        texts = len(offsets) - 1
        n_a, n_b = np.diff(a_first), np.diff(b_first)
        if not len(a):
            return n_a, n_b, [None] * texts, np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
        marks = []
        for ids, vocabulary in ((a, self.a_tokens), (b, self.b.vocabulary)):
            length = vocabulary.length[ids]
            token = np.flatnonzero(vocabulary.marked[ids])
            marks.append((token, (np.cumsum(length) - length)[token]))
        (a_token, a_start), (b_token, b_start) = marks
        _, in_a, in_b = np.intersect1d(a_start, b_start, assume_unique=True, return_indices=True)
        a_cut, b_cut = np.append(a_token[in_a], len(a)), np.append(b_token[in_b], len(b))
        size, a_end, b_end = self.memory.look_up(a, a_cut, b, b_cut)
        a_end, b_end = a_end + np.repeat(a_cut[:-1], size), b_end + np.repeat(b_cut[:-1], size)
        # every text begins with an anchor, the space in front of it
        bounds = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(a_cut[:-1], a_first)]
        spelt, spelt_end = self.decimals.groups(a, a_end, b, b_end)
        spelt_end = np.concatenate([[0], spelt_end])[bounds].tolist()
        groups = [spelt[x:y - 1].decode() if y > x else None for x, y in zip(spelt_end[:-1], spelt_end[1:])]
        return n_a, n_b, groups, a[a_end - 1].astype(np.int64) << 32 | b[b_end - 1], bounds


@worker_cache
def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """One aligner for each worker process and pair of files."""
    return Aligner(bytes_path, pieces_path)


def _counted(links: np.ndarray, bounds: np.ndarray):
    """Distinct links of each text, how often each stands there, and bounds."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((links, text))
    text, links = text[order], links[order]
    new = np.ones(len(links), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (links[1:] != links[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(links)))
    return links[at], times, np.searchsorted(text[at], np.arange(len(bounds)))


def align_tokens(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    """One row per document: row, doc_id, n_a, n_b, groups, n_groups, pairs and times.

    groups lists the shared cuts as ``a1,a2|b1;a3|b2,b3``. pairs holds the distinct links
    (id of A << 32 | id of B of tokens that end together), times how often the document has
    each. Null and empty texts, and texts that their tokens of A or B do not spell with a
    space in front, have no tokens: null groups and empty arrays. ``row`` tells rows apart,
    also with repeated or null ids; other columns are ignored, and an empty table gives an
    empty one. The paths are a rank file (A) and a piece model (B) every executor can read.
    """
    bytes_path = bytes_path or tokenizer_path(BYTES)
    pieces_path = pieces_path or tokenizer_path(PIECES)

    def align(batches):
        row = TaskContext.get().partitionId() << 33
        for block, data, offsets in blocks(batches, uses=(aligner,)):
            n_a, n_b, groups, links, bounds = aligner(bytes_path, pieces_path).block(data, offsets)
            pairs, times, at = _counted(links, bounds)
            at = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + block.num_rows)), block.column("doc_id"), pa.array(n_a),
                 pa.array(n_b), pa.array(groups, pa.string()), pa.array(np.diff(bounds)),
                 pa.ListArray.from_arrays(at, pa.array(pairs)),
                 pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))],
                ["row", "doc_id", "n_a", "n_b", "groups", "n_groups", "pairs", "times"])
            row += block.num_rows

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        align, f"row long, doc_id {type_of(docs, 'doc_id')}, n_a long, n_b long, groups string, n_groups long, "
               "pairs array<long>, times array<int>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, count and best (is it its B id's highest count?) over all documents, stored.

    The highest counts are one row per id of B, so at most as many as B has tokens.
    """
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = cut_lineage(each.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("count")))
    own = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(own.alias("b")).agg(F.max("count").alias("most"))
    return cut_lineage(counts.withColumn("b", own).join(F.broadcast(most), "b").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")))


def _frequent(counts: DataFrame, most: int):
    """A count that at most ``most`` pairs reach, and those pairs, sorted."""
    level = F.floor(F.log2("count")).cast("int")
    levels = sorted(counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect(), reverse=True)  # <= 64
    least, reached = 0, 0
    for r in levels:
        reached += r.n
        if reached > most:
            least = 1 << (r.l + 1)
            break
    table = counts.where(F.col("count") >= least).toArrow()
    pair, count, best = (table.column(c).to_numpy() for c in ("pair", "count", "best"))
    order = np.argsort(pair)
    return least, (pair[order], count[order], best[order])


def with_link_scores(aligned: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` with n_best and count_sum: links that are best for their id of B, and all counts summed.

    Both tables are stored. Counts that at most ``hot_pairs`` pairs reach are looked up where
    the documents lie. A pair below holds less than 2 / hot_pairs of all links, so the join
    that scores the others has no hot key.
    """
    least, frequent = _frequent(counts, hot_pairs)
    shared = aligned.sparkSession.sparkContext.broadcast(frequent)

    def score(batches):
        known, count, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            first = pairs.offsets.to_numpy().astype(np.int64)
            own, n = (c.values.to_numpy(zero_copy_only=False)[first[0]:first[-1]] for c in (pairs, times))
            first = first - first[0]
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            hit = known[at] == own if len(known) else np.zeros(len(own), dtype=bool)
            at, n = np.where(hit, at, 0), n.astype(np.int64)
            total = sums(np.where(hit, count[at], 0) * n, first) if len(known) else np.zeros(len(first) - 1, np.int64)
            top = sums(np.where(hit, best[at], False) * n, first) if len(known) else total
            rest = pa.array(np.concatenate([[0], np.cumsum(~hit)])[first].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(top), pa.array(total), pa.ListArray.from_arrays(rest, pa.array(own[~hit])),
                 pa.ListArray.from_arrays(rest, pa.array(n[~hit]))], ["row", "n_best", "count_sum", "pairs", "times"])

    looked_up = aligned.select("row", "pairs", "times").mapInArrow(
        score, "row long, n_best long, count_sum long, pairs array<long>, times array<long>")
    if least:
        looked_up = cut_lineage(looked_up)
        rare = looked_up.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
            "row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
        scored = rare.join(counts.where(F.col("count") < least), "pair").select(
            "row", (F.col("count") * F.col("times")).alias("count_sum"),
            F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"))
        looked_up = looked_up.select("row", "n_best", "count_sum").unionByName(scored)
    sums_of = looked_up.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(sums_of, "row", "left")


@query("op13_token_alignment")
def op13(t):
    digest = F.when(F.col("groups").isNull(), F.lit("")).otherwise(F.sha2(F.col("groups"), 256))
    aligned = cut_lineage(align_tokens(t.documents).withColumn("groups_sha256", digest).drop("groups"))
    return with_link_scores(aligned, link_counts(aligned)).select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
