"""Exact token counts of every prefix, by dynamic programming over a byte-pair vocabulary.

In byte-pair encoding every beginning of an encoding is itself the encoding of the bytes it
covers, and an encoding is right exactly if each two neighbouring tokens are what their joined
bytes encode to. So one last token per prefix is enough: the last token of a prefix is the
one suffix that stands rightly behind the last token of the prefix before it, and the count
is one more than the count there. Any question about a budget is then a look-up.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.llm import pretokens as pre
from anchorlake.llm.registry import query
from anchorlake.llm.textblocks import blocks, worker_cache

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
KEPT_PIECES = 300_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_symbol() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies, and the bytes they stand for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixCounter:
    """Token counts of texts and of all their prefixes for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbol = _byte_of_symbol()
        raw = lambda token: bytes(symbol[c] for c in token)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.id_of = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (raw(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[self.id_of[left], self.id_of[right]] = rank, self.id_of[left + right]
        self.tree = self._tree()
        self.parts = self._parts()
        self.fits: dict[int, bool] = {}
        self.previous: tuple[bytes, list[int], list[int]] = b"", [-1], [0]
        self.totals: dict[str, int] = {}
        self.splits = pre.SPLIT
        self.memory = pre.UnitMemory(self.unit_totals)

    def _tree(self) -> dict:
        """Tokens by their bytes from the last: byte -> [token or -1, the same for the byte before]."""
        tree: dict = {}
        for token, number in self.id_of.items():
            below, node = tree, None
            for byte in reversed(token):
                node = below.setdefault(byte, [-1, {}])
                below = node[1]
            node[0] = number
        return tree

    def _parts(self) -> dict[int, tuple[int, int]]:
        """The two tokens each token is merged from, by the merge of lowest rank."""
        parts: dict[int, tuple[int, int]] = {}
        for (left, right), (_, token) in self.rank.items():
            parts.setdefault(token, (left, right))
        return parts

    def _fit(self, left: int, right: int) -> bool:
        """Is (left, right) what the joined bytes of the two tokens encode to?

        It is not if, while both are still being merged, a token at the end of the left one
        would join a token at the start of the right one before either grows.
        """
        edge_left, edge_right = [left], [right]  # ends of the two tokens, largest first
        while edge_left[-1] in self.parts:
            edge_left.append(self.parts[edge_left[-1]][1])
        while edge_right[-1] in self.parts:
            edge_right.append(self.parts[edge_right[-1]][0])
        never = len(self.rank)
        made = lambda t: self.rank[self.parts[t]][0]  # noqa: E731  the rank at which t arises
        i, j = len(edge_left) - 1, len(edge_right) - 1
        while True:
            grow_left = made(edge_left[i - 1]) if i else never
            grow_right = made(edge_right[j - 1]) if j else never
            join = self.rank.get((edge_left[i], edge_right[j]), (never,))[0]
            # of equal neighbours the left one merges first, also with the same rank
            if join < never and join < grow_left and join <= grow_right:
                return False
            if not i and not j:
                return True
            if grow_left <= grow_right:
                i -= 1
            else:
                j -= 1

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of ``piece[:k]`` for k = 0 .. len(piece); ``piece`` is one pre-token.

        What the piece asked for before began with in the same way is not computed again.
        """
        known, last, count = self.previous
        same, size = 0, min(len(known), len(piece))
        while same < size and known[same] == piece[same]:
            same += 1
        del last[same + 1:], count[same + 1:]
        fits, tree = self.fits, self.tree
        for end in range(same, len(piece)):
            below, start = tree, end
            while True:
                token, below = below[piece[start]]
                if token >= 0:
                    if not start:
                        break
                    pair = last[start] << 32 | token
                    right = fits.get(pair)
                    if right is None:
                        right = fits[pair] = self._fit(last[start], token)
                    if right:
                        break
                start -= 1
            last.append(token)
            count.append(count[start] + 1)
        if len(fits) > 1_000_000:
            fits.clear()
        self.previous = piece, last, count
        return count

    def piece_total(self, piece: str) -> int:
        total = self.totals.get(piece)
        if total is None:
            total = self.prefix_counts(piece.encode())[-1]
            if len(self.totals) >= KEPT_PIECES:
                self.totals.clear()
            self.totals[piece] = total
        return total

    def unit_totals(self, units: list[bytes]) -> list[list[int]]:
        """Tokens of each unit; units that begin alike are counted one after the other."""
        out: dict[bytes, list[int]] = {}
        for unit in sorted(units):
            out[unit] = [self.unit_total(unit)]
        return [out[unit] for unit in units]

    def unit_total(self, unit: bytes) -> int:
        return sum(map(self.piece_total, self.splits.findall(unit.decode())))

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """``text`` cut at special tokens, which count as one token each."""
        if not any(s in text for s in self.special):
            return [(text, False)]
        cut = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
        return [(piece, k % 2 == 1) for k, piece in enumerate(cut) if piece]

    def total(self, text: str) -> int:
        """Tokens of a text."""
        return sum(1 if special else self.unit_total(piece.encode())
                   for piece, special in self.segments(text))

    def table(self, text: str) -> np.ndarray:
        """Tokens of ``text[:k]`` for every k from 0 to its length in characters.

        A prefix that ends inside white space is split anew from where that space begins;
        one that ends inside a special token counts its characters as ordinary text.
        """
        out = np.zeros(len(text) + 1, dtype=np.int64)
        count = at = 0
        plain, before = "", 0  # the text since the last special token, and the tokens before it
        for piece, special in self.segments(text):
            if special:  # its characters but the last join the text before it
                inner = before + self._plain_table(plain + piece[:-1])[len(plain) + 1:]
                out[at + 1:at + len(piece)] = inner
                count += 1
                plain, before = "", count
            else:
                plain, before = piece, count
                inner = count + self._plain_table(piece)
                out[at + 1:at + len(piece) + 1] = inner[1:]
                count = int(inner[-1])
            at += len(piece)
            out[at] = count
        return out

    def _plain_table(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, dtype=np.int64)
        done = start = space = 0  # tokens before ``start``; tokens of the space right before it
        lead = ""
        for piece in self.splits.findall(text):
            counts = [*self.prefix_counts(piece.encode())]
            size = 0
            for k, char in enumerate(piece, 1):
                size += len(char.encode())
                out[start + k] = done + counts[size]
                if (lead and piece[:k].isspace()) or (k < len(piece) and "'" in piece[:k]):
                    out[start + k] = done - space + self.unit_total((lead + piece[:k]).encode())
            start += len(piece)
            done += counts[-1]
            lead, space = (piece, counts[-1]) if piece.isspace() else ("", 0)
        return out

    def fitting(self, text: str, limit: int) -> int:
        """Characters of the longest prefix that has at most ``limit`` tokens."""
        return int(np.flatnonzero(self.table(text) <= limit)[-1])

    def block_totals(self, data: np.ndarray, offsets: np.ndarray, limit: int):
        """Tokens of every text of a block, and the characters that fit into ``limit``."""
        units = pre.Units(data, offsets)
        start, _ = self.memory.look_up(units)
        each = self.memory.pool[start].astype(np.int64)
        running = np.concatenate([[0], np.cumsum(each)])
        base = running[units.first[:-1]]
        total = running[units.first[1:]] - base
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        fit = lead[offsets[1:]] - lead[offsets[:-1]]
        text_of = lambda i: data[offsets[i]:offsets[i + 1]].tobytes().decode()
        for i in pre.texts_to_split(data, offsets, self.special):
            total[i] = self.total(text_of(i))
            if total[i] > limit:
                fit[i] = self.fitting(text_of(i), limit)
            base[i] = -1
        for i in np.flatnonzero((total > limit) & (base >= 0)):
            # the last unit that ends within the limit, then the prefixes of what follows
            unit = int(np.searchsorted(running, base[i] + limit, side="right")) - 1
            near = max(units.first[i], unit - 2)
            stop = min(units.first[i + 1], unit + 2)
            piece = data[units.start[near]:units.end[stop - 1]].tobytes().decode()
            inside = self.table(piece)
            fit[i] = lead[units.start[near]] - lead[offsets[i]] + np.flatnonzero(
                inside <= limit - (running[near] - base[i]))[-1]
        return total, fit


@worker_cache
def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and file."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, limit_chars.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read;
    limit_chars is the length of the longest prefix with at most ``limit`` tokens. A null
    text counts as empty: no bytes, no tokens. Repeated rows give repeated rows, other
    columns of ``docs`` are ignored, and an empty table gives an empty one.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)

    def count(batches):
        for block, data, offsets in blocks(batches, uses=(counter,)):
            total, fit = counter(path).block_totals(data, offsets, limit)
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total),
                pa.array(total > limit), pa.array(fit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, "
               "n_tokens long, over_limit boolean, limit_chars long")


def prefix_tables(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and ``steps``: how the count changes with each character, one signed byte each.

    The running sum of the first k bytes is the exact number of tokens of the first k
    characters, so any question about limits is answered from this column alone. Null texts
    count as empty; repeated rows give repeated rows, other columns are ignored, and an empty
    table gives an empty one.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)

    def tables(batches):
        for block, data, offsets in blocks(batches, uses=(counter,)):
            raw = data.tobytes()
            steps = [np.diff(counter(path).table(raw[a:b].decode())).astype(np.int8).tobytes()
                     for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(steps, pa.binary())], ["doc_id", "steps"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        tables, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, steps binary")


def longest_prefixes(tables: DataFrame, limits: list[int]) -> DataFrame:
    """doc_id, limit, and the characters of the longest prefix with at most so many tokens.

    Answered from ``prefix_tables`` for any number of limits; no text is encoded again.
    """
    def answer(batches):
        for batch in batches:
            counts = [np.concatenate([[0], np.cumsum(np.frombuffer(s, np.int8), dtype=np.int64)])
                      for s in batch.column("steps").to_pylist()]
            for limit in limits:
                chars = [int(np.flatnonzero(c <= limit)[-1]) if limit >= 0 else 0 for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([limit] * len(chars), pa.int64()), pa.array(chars, pa.int64())],
                    ["doc_id", "limit", "chars"])

    kind = tables.schema["doc_id"].dataType.simpleString()
    return tables.mapInArrow(answer, f"doc_id {kind}, limit long, chars long")


@query("op9_token_counts")
def op9(t):
    return count_tokens(t.documents)
