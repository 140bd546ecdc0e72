"""Fill-in-the-middle examples: prefix, middle and suffix of a text in another order.

A text is a row of units, words of ASCII letters and single other characters, and is cut
after two drawn numbers of units. Its bytes are laid into fixed blocks. One Fenwick tree
over the blocks holds how many units begin in each, another how many code points do; a cut
goes down both by binary lifting to the block in which the next unit begins, and only that
block is looked through. All trees of a run of texts lie end to end, so all cuts go down at
once.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.llm.common import type_of
from anchorlake.llm.registry import query
from anchorlake.llm.textblocks import blocks

SEED = "1"
RATE = 90             # per cent of the texts that are cut
SUFFIX_FIRST = 20     # per cent of those that begin with the suffix
CUT_BLOCK = 4096      # bytes

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Marks(NamedTuple):
    """What stands before each part; a text that holds one of them is left as it is."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Does a unit begin at a byte?"""
    letter = _LETTER[data]
    inside = np.zeros(len(data), dtype=bool)
    inside[1:] = letter[1:] & letter[:-1]
    inside[offsets[:-1][offsets[:-1] < len(data)]] = False
    return ((data & 0xC0) != 0x80) & ~inside


class BlockTrees:
    """Fenwick trees of the texts of a run: units and code points by text block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int = CUT_BLOCK):
        self.starts, self.leads = unit_starts(data, offsets), (data & 0xC0) != 0x80
        self.offsets, self.size = offsets, size
        self.blocks = -(-np.diff(offsets) // size)        # blocks of each text
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        number = np.arange(self.first[-1]) - np.repeat(self.first[:-1], self.blocks)
        at = np.repeat(offsets[:-1], self.blocks) + number * size
        self.units = self._tree(self.starts, at, number + 1)
        self.points = self._tree(self.leads, at, number + 1)
        self.n_units, self.n_points = (
            np.add.reduceat(np.append(x, 0), np.append(offsets[:-1], len(data)))[:-1] * (np.diff(offsets) > 0)
            for x in (self.starts.astype(np.int64), self.leads.astype(np.int64)))

    @staticmethod
    def _tree(flags: np.ndarray, at: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Node ``k`` of a text (from 1) holds the sum of its last ``k & -k`` blocks up to the ``k``-th."""
        if not len(at):
            return np.zeros(0, dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum(np.add.reduceat(flags.astype(np.int64), at))])
        block = np.arange(1, len(at) + 1)
        return upto[block] - upto[block - (node & -node)]

    def cuts(self, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first ``units`` units of each text end: bytes and code points from its start."""
        block, units_left = np.zeros(len(text), dtype=np.int64), units.astype(np.int64)
        points = np.zeros(len(text), dtype=np.int64)
        step = 1 << int(self.blocks.max(initial=1)).bit_length()
        while step:
            at = self.first[text] + block + step - 1
            can = block + step <= self.blocks[text]
            below = np.where(can, self.units[np.where(can, at, 0)], 0) if len(self.units) else 0
            go = can & (below <= units_left)
            units_left = units_left - np.where(go, below, 0)
            points += np.where(go, self.points[np.where(go, at, 0)], 0) if len(self.points) else 0
            block += np.where(go, step, 0)
            step >>= 1
        place = np.minimum(block * self.size, np.diff(self.offsets)[text])
        for k in np.flatnonzero(block < self.blocks[text]):  # the unit that follows begins in this block
            low = self.offsets[text[k]] + place[k]
            high = min(low + self.size, self.offsets[text[k] + 1])
            inside = int(np.flatnonzero(self.starts[low:high])[units_left[k]])
            place[k] += inside
            points[k] += np.count_nonzero(self.leads[low:low + inside])
        return place, points


def draws(doc_ids: list, seed: str) -> np.ndarray:
    """Four numbers per document: the first 8-digit groups of sha256 of ``seed:id`` (a null id is empty)."""
    digests = [hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).digest()[:16] for d in doc_ids]
    return np.frombuffer(b"".join(digests), dtype=">u4").reshape(-1, 4).astype(np.int64)


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
                   marks: Marks = Marks()) -> DataFrame:
    """One row per document: doc_id, n units, form, prefix_chars, middle_chars and output.

    form is ``plain`` (the text itself, with null for both lengths), ``psm`` (prefix, suffix,
    middle) or ``spm`` (suffix, prefix, middle), each part behind its mark. Empty and null
    texts, texts that hold a mark, and a drawn share of the others stay plain. The draws
    depend on the id alone, so repeated rows come out alike; other columns are ignored, and
    an empty table gives an empty one.
    """
    prefix, suffix, middle = (m.encode() for m in marks)

    def cut(batches):
        for block, data, offsets in blocks(batches):
            trees = BlockTrees(data, offsets)
            texts, n = np.arange(block.num_rows), trees.n_units
            h = draws(block.column("doc_id").to_pylist(), seed)
            ends = h[:, :2] % (n + 1)[:, None]
            low, low_points = trees.cuts(texts, ends.min(axis=1))
            high, high_points = trees.cuts(texts, ends.max(axis=1))
            raw, form, out = data.tobytes(), [], []
            for k in texts:
                text = raw[offsets[k]:offsets[k + 1]]
                if h[k, 2] % 100 >= rate or not text or any(m in text for m in (prefix, suffix, middle)):
                    form.append("plain")
                    out.append(text)
                    continue
                a, b, c = text[:low[k]], text[low[k]:high[k]], text[high[k]:]
                psm = h[k, 3] % 100 >= suffix_first
                form.append("psm" if psm else "spm")
                out.append(b"".join([prefix, a, suffix, c, middle, b] if psm else [suffix, c, prefix, a, middle, b]))
            plain = np.array([f == "plain" for f in form], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(n), pa.array(form, pa.string()),
                 pa.array(low_points, mask=plain), pa.array(high_points - low_points, mask=plain),
                 pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        cut, f"doc_id {type_of(docs, 'doc_id')}, n long, form string, prefix_chars long, middle_chars long, "
             "output string")


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The exact text of an output; no text that was cut holds a mark, so each stands there once."""
    body = F.substring(output, len(marks.prefix) + 1, F.length(output))
    other = F.substring(output, len(marks.suffix) + 1, F.length(output))
    part = lambda text, mark, k: F.split_part(text, F.lit(mark), F.lit(k))
    psm_rest, spm_rest = part(body, marks.suffix, 2), part(other, marks.prefix, 2)
    return (F.when(form == "psm", F.concat(part(body, marks.suffix, 1), part(psm_rest, marks.middle, 2),
                                           part(psm_rest, marks.middle, 1)))
            .when(form == "spm", F.concat(part(spm_rest, marks.middle, 1), part(spm_rest, marks.middle, 2),
                                          part(other, marks.prefix, 1)))
            .otherwise(output))


_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix,
    coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""


@query("op11_fill_middle", _SQL)
def op11(t):
    return fill_in_middle(t.documents).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
