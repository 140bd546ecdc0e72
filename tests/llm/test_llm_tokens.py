"""Token counts and packing against the tokenizer libraries and exact round trips."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import AWKWARD, prose

from anchorlake.llm import packing, prefix_counts
from anchorlake.llm.textblocks import text_bytes

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = ["the", "'re", "'s", " ", "  ", "\n", "\t", "é", "日本", "123", "!!", "<|endoftext|>", " ", "　",
          "a", "''", " '", "x'll", "😀", "-", "_", "\x1c", "\u0085"]


@pytest.fixture(scope="module")
def counter():
    return prefix_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def odd_texts(n, seed=3):
    draw = random.Random(seed)
    return ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 12))) for _ in range(n)]


def test_block_totals_are_the_librarys(counter, library):
    texts = odd_texts(1500) + [t or "" for t in AWKWARD] + [prose(k, 80) for k in range(20)]
    for low in range(0, len(texts), 200):
        part = texts[low:low + 200]
        totals, _ = counter.block_totals(*text_bytes(pa.array(part)), 10**9)
        assert totals.tolist() == [library(t) for t in part]


def test_every_prefix_counts_as_if_encoded_alone(counter, library):
    for text in odd_texts(150, 5) + [prose(1, 12), "it's  we'll\n\n x"]:
        assert counter.table(text).tolist() == [library(text[:k]) for k in range(len(text) + 1)], text


def test_many_special_tokens_take_linear_time(counter, library):
    import time

    part = "word and  <|endoftext|>ab it's <|endoftext|>"
    assert counter.table(part * 3).tolist() == [library((part * 3)[:k]) for k in range(3 * len(part) + 1)]
    began = time.process_time()
    assert counter.table(part * 2500)[-1] == library(part * 2500)
    assert time.process_time() - began < 5


def test_stored_prefixes_answer_any_limit(awkward, documents, library):
    docs = documents([(k, t) for k, t in enumerate(odd_texts(40, 9) + [prose(4, 30), None, ""])])
    stored = prefix_counts.prefix_tables(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = prefix_counts.longest_prefixes(stored, [0, 3, 50]).collect()
    assert len(got) == 3 * len(texts)
    for r in got:
        text = texts[r.doc_id]
        assert r.chars == max(k for k in range(len(text) + 1) if library(text[:k]) <= r.limit)
    assert prefix_counts.longest_prefixes(prefix_counts.prefix_tables(awkward), [5]).count() == awkward.count()
    assert prefix_counts.prefix_tables(awkward.limit(0)).count() == 0


def test_longest_prefix_within_a_limit(counter, library):
    texts = odd_texts(300, 7) + [prose(2, 40)]
    _, fit = counter.block_totals(*text_bytes(pa.array(texts)), 6)
    for text, chars in zip(texts, fit):
        assert chars == max(k for k in range(len(text) + 1) if library(text[:k]) <= 6)


def test_count_tokens_of_awkward_documents(awkward, library):
    got = prefix_counts.count_tokens(awkward).collect()
    assert len(got) == awkward.count()
    texts = {r.doc_id: r.text or "" for r in awkward.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            text = texts[r.doc_id]
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), library(text))
            assert r.over_limit == (r.n_tokens > 1024) and 0 <= r.limit_chars <= len(text)
    assert prefix_counts.count_tokens(awkward.limit(0)).count() == 0


def test_best_fit_decreasing_is_what_a_plain_search_gives():
    draw = random.Random(11)
    for _ in range(40):
        lengths = np.array([draw.randint(1, 16) for _ in range(draw.randint(1, 60))])
        place = packing.best_fit_decreasing(lengths, 16)
        space = {}
        for piece in np.argsort(-lengths, kind="stable"):
            open_spaces = sorted(s for s in space.values() if s >= lengths[piece])
            mine = place[piece]
            assert space.get(mine, 16) == (open_spaces[0] if open_spaces else 16)
            space[mine] = space.get(mine, 16) - lengths[piece]
            assert space[mine] >= 0


def test_packing_loses_nothing(awkward):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    packed = packing.pack_documents(awkward, sequence=64).cache()
    rows = packed.collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.start, r.ids) for r in packing.segments(packed).collect())
    want = []
    for r in awkward.collect():
        ids = plain.encode_ordinary(r.text or "")
        want += [(r.doc_id is None, r.doc_id or 0, k, ids[k:k + 64]) for k in range(0, len(ids), 64)]
    assert got == sorted(want)
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(positions) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
        assert (ids[r.n_tokens:] == packing.PADDING).all()
    assert packing.pack_documents(awkward.limit(0)).count() == 0
    packed.unpersist()
