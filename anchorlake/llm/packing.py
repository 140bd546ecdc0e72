"""Packing token ids into fixed-length sequences, best fit decreasing.

Texts are encoded, texts longer than a sequence are cut into pieces without loss, and the
pieces of a block of documents are packed together, longest first, each into the fullest
sequence it still fits. Open sequences are counted by free space in the leaves of a segment
tree, so the least sufficient space is found by one walk down the tree. Packing needs no
shuffle: a block is as many documents in a row of one input split as hold ``BLOCK_TOKENS``.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.llm import pretokens as pre
from anchorlake.llm.common import type_of
from anchorlake.llm.registry import query
from anchorlake.llm.textblocks import blocks, worker_cache

TOKENIZER = "byte_bpe_50k.tiktoken"
SEQUENCE = 2048
PADDING = 50256       # the id the vocabulary leaves free
BLOCK_TOKENS = 1 << 20
ROWS_OUT = 256


class Encoder:
    """Token ids of whole blocks of texts; units seen before are looked up."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.plain = tiktoken.Encoding("plain", pat_str=pre.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memory = pre.UnitMemory(
            lambda units: [self.plain.encode_ordinary(u.decode()) for u in units])

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block end to end, and how many each text has."""
        units = pre.Units(data, offsets)
        start, length = self.memory.look_up(units)
        ids = pre.gather(self.memory.pool, start, length)
        sizes = pre.per_text(length, units)
        odd = pre.texts_to_split(data, offsets, [])
        if not len(odd):
            return ids, sizes
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for i in odd:
            parts[i] = np.array(self.plain.encode_ordinary(
                data[offsets[i]:offsets[i + 1]].tobytes().decode()), dtype=ids.dtype)
        return np.concatenate(parts), np.array([len(p) for p in parts])


@worker_cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


class OpenSequences:
    """Open sequences by free space, with a segment tree over the spaces that occur."""

    def __init__(self, sequence: int):
        self.leaves = 1 << sequence.bit_length()
        self.count = [0] * (2 * self.leaves)  # open sequences under each node
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, space: int, sequence: int) -> None:
        self.at[space].append(sequence)
        self._change(space, 1)

    def _change(self, space: int, by: int) -> None:
        node = space + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove a sequence with the least free space of at least ``least``."""
        count, node = self.count, least + self.leaves
        if not count[node]:
            while True:  # up to the first right neighbour that holds something
                if node & (node + 1) == 0:
                    return None
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:
                node <<= 1
                node += not count[node]
        space = node - self.leaves
        self._change(space, -1)
        return space, self.at[space].pop()


def best_fit_decreasing(lengths: np.ndarray, sequence: int) -> np.ndarray:
    """The sequence number of every piece; pieces of equal length go in order."""
    out = np.empty(len(lengths), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int(np.searchsorted(-lengths[order], -sequence, side="right"))
    out[order[:full]] = np.arange(full)
    opened, new = OpenSequences(sequence), full
    for piece in order[full:].tolist():
        length = int(lengths[piece])
        found = opened.take(length)
        if found is None:
            found, new = (sequence, new), new + 1
        out[piece] = found[1]
        if found[0] > length:
            opened.add(found[0] - length, found[1])
    return out


def _pieces(sizes: np.ndarray, sequence: int):
    """Document, start inside the document and length of every piece."""
    count = -(-sizes // sequence)
    document = np.repeat(np.arange(len(sizes)), count)
    within = (np.arange(len(document)) - np.repeat(np.cumsum(count) - count, count)) * sequence
    return document, within, np.minimum(sizes[document] - within, sequence)


def pack_block(ids: np.ndarray, sizes: np.ndarray, sequence: int, padding: int) -> dict[str, np.ndarray]:
    """Packed sequences of one block: the id and position matrices and their segments."""
    document, within, length = _pieces(sizes, sequence)
    place = best_fit_decreasing(length, sequence)
    order = np.lexsort((np.arange(len(place)), place))
    document, within, length, place = document[order], within[order], length[order], place[order]
    rows = int(place[-1]) + 1 if len(place) else 0
    running = np.cumsum(length)
    first = np.searchsorted(place, np.arange(rows + 1))
    base = np.concatenate([[0], running])[first[:-1]]
    offset = running - length - base[place]
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(int(running[-1]) if len(running) else 0) - np.repeat(running - length, length)
    target = np.repeat(place * sequence + offset, length) + inside
    matrix = np.full(rows * sequence, padding, dtype=np.int32)
    matrix[target] = ids[np.repeat(starts[document] + within, length) + inside]
    position = np.zeros(rows * sequence, dtype=np.int32)
    position[target] = inside
    return {"ids": matrix.reshape(rows, sequence), "positions": position.reshape(rows, sequence), "first": first,
            "ends": offset + length, "document": document, "within": within}


_SCHEMA = ("pack_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, "
           "doc_ids array<{id}>, doc_starts array<long>")


def _batches(packed: dict, doc_ids: pa.Array, number: int):
    """Record batches of packed sequences, numbered from ``number``."""
    first, ends = packed["first"], packed["ends"]
    for low in range(0, len(first) - 1, ROWS_OUT):
        high = min(low + ROWS_OUT, len(first) - 1)
        a, b = first[low], first[high]
        bounds = first[low:high + 1] - a
        cut = np.insert(ends[a:b], bounds[:-1], 0)
        seg_at = pa.array((bounds + np.arange(len(bounds))).astype(np.int32))
        doc_at = pa.array(bounds.astype(np.int32))
        ids = packed["ids"][low:high].astype("<u4")
        positions = packed["positions"][low:high].astype("<u4")
        tokens = ends[first[low + 1:high + 1] - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(number + low, number + high)), pa.array(tokens.astype(np.int32)),
             pa.array([r.tobytes() for r in ids], pa.binary()), pa.array([r.tobytes() for r in positions], pa.binary()),
             pa.ListArray.from_arrays(seg_at, pa.array(cut.astype(np.int32))),
             pa.ListArray.from_arrays(doc_at, doc_ids.take(pa.array(packed["document"][a:b]))),
             pa.ListArray.from_arrays(doc_at, pa.array(packed["within"][a:b].astype(np.int64)))],
            ["pack_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_starts"])


def pack_documents(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE,
                   padding: int = PADDING) -> DataFrame:
    """Packed sequences of all documents, one row each.

    input_ids and position_ids are the sequence's row of the two matrices, ``sequence``
    little-endian 32-bit numbers each, filled up with ``padding`` and 0; position_ids start
    again at 0 with each segment. cu_seqlens are the segments' bounds, from 0 to n_tokens.
    Segment k holds the tokens of document doc_ids[k] from token doc_starts[k] on, so the
    documents can be put together again without loss. pack_id is unique; it numbers the
    sequences within an input split.

    Null and empty texts have no tokens and no segment. A repeated row is packed as often as
    it occurs, other columns are ignored, and an empty table gives an empty one.
    ``tokenizer`` is the path of a rank file that every executor can read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)

    def pack(batches):
        number = TaskContext.get().partitionId() << 33
        held, tokens = [], 0

        def packed():
            ids, sizes, names = (x for x in zip(*held))
            result = pack_block(np.concatenate(ids), np.concatenate(sizes), sequence, padding)
            yield from _batches(result, pa.concat_arrays(names), number)

        for block, data, offsets in blocks(batches, uses=(encoder,)):
            ids, sizes = encoder(tokenizer).block(data, offsets)
            held.append((ids, sizes, block.column("doc_id")))
            tokens += len(ids)
            if tokens >= BLOCK_TOKENS:
                for out in packed():
                    number += out.num_rows
                    yield out
                held, tokens = [], 0
        if held:
            yield from packed()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        pack, _SCHEMA.format(id=type_of(docs, "doc_id")))


def segments(packed: DataFrame) -> DataFrame:
    """doc_id, start, and the token ids of every segment, read back from packed sequences."""
    def read(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("input_ids", "cu_seqlens", "doc_ids", "doc_starts")]
            rows = [(doc, start, np.frombuffer(ids, "<u4")[a:b].tolist())
                    for ids, cut, docs, starts in zip(*columns)
                    for doc, start, a, b in zip(docs, starts, cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.schema.field("doc_ids").type.value_type),
                 pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
                ["doc_id", "start", "ids"])

    kind = packed.schema["doc_ids"].dataType.elementType.simpleString()
    return packed.mapInArrow(read, f"doc_id {kind}, start long, ids array<int>")


@query("op3_packed_tokens")
def op3(t):
    return pack_documents(t.documents)
