"""Fill-in-the-middle cuts, personal data and token alignment against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import AWKWARD, prose
from pyspark.sql import functions as F

from anchorlake.llm import alignment, fill_middle, personal_data
from anchorlake.llm.prefix_counts import _byte_of_symbol
from anchorlake.llm.textblocks import BLOCK_BYTES, text_bytes

LONG = "été " * (BLOCK_BYTES // 4) + "\n\nthe end <x> 10.0.0.1 a.b@c.de"  # more than one block
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def mixed(parts, n, most, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, most))) for _ in range(n)]


@pytest.fixture
def long_documents(documents):
    return documents([(1, LONG), (2, "short one"), (3, LONG), (4, None), (None, "no id"), (2, "short one")])


# fill in the middle

@pytest.mark.parametrize("size", [1, 3, 16, 4096])
def test_every_cut_is_where_the_units_end(size):
    texts = mixed(["a", "bc", " ", "é", "日", "😀", "Z", "1", "\n"], 60, 50, 1) + ["", prose(1, 40)]
    trees = fill_middle.BlockTrees(*text_bytes(pa.array(texts)), size)
    for k, text in enumerate(texts):
        units = UNIT.findall(text)
        assert (trees.n_units[k], trees.n_points[k]) == (len(units), len(text))
        counts = np.arange(len(units) + 1)
        at, points = trees.cuts(np.full(len(counts), k), counts)
        heads = ["".join(units[:c]) for c in counts]
        assert points.tolist() == [len(h) for h in heads] and at.tolist() == [len(h.encode()) for h in heads]


def middle_by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    low, high = sorted([h[0] % (len(units) + 1), h[1] % (len(units) + 1)])
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_fill_in_middle_is_what_a_plain_cut_gives(documents, awkward, long_documents):
    texts = mixed(["word ", "<P>", "<", "S", ">", "<M", "é", "\n", "x1"], 300, 12, 2)
    for docs in (documents(list(enumerate(texts))), awkward, long_documents):
        out = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
        key = lambda r: tuple((v is not None, v) for v in r)
        got = sorted((tuple(r) for r in out.collect()), key=key)
        want = sorted(((r.doc_id, *middle_by_hand(r.doc_id, r.text), r.text or "") for r in docs.collect()), key=key)
        assert got == want
    assert fill_middle.fill_in_middle(awkward.limit(0)).count() == 0


def test_fill_in_middle_with_other_shares_and_marks(documents):
    marks = fill_middle.Marks("[pre]", "[suf]", "[mid]")
    docs = documents([(k, prose(k, 20) + "<P>") for k in range(200)])
    out = fill_middle.fill_in_middle(docs, "s", 100, 100, marks)
    back = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in back} == {"spm"}
    assert sorted(r.back for r in back) == sorted(r.text for r in docs.collect())


# personal data

def base_by_hand(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(?:\.[0-9]+){3}", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9](?:[ -]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][ ().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)]
    return sorted((m.start(), k, m.end()) for k, (rule, valid) in enumerate(rules)
                  for m in re.finditer(rule, text) if valid(m.group()))


PARTS = ["@", ".", "-", "+", "a", "Z", "0", "1", "255", "3.", " ", "(", ")", "%", "é", "1.2.3.4", "4111111111111111",
         "+1 (743) 555-3824", "a.b@c.de", "\n", "٣", "mailto:", "://", "account ", "IBAN "]


def test_base_spans_are_those_of_the_patterns():
    for text in mixed(PARTS, 20_000, 25, 5):
        assert [s for s in personal_data.spans_of(text) if s[1] < len(personal_data.BASE)] == base_by_hand(text), text


@pytest.mark.parametrize("text, found", [
    ("IBAN: DE89 3704 0044 0532 0130 00 and more", [("account", "DE89 3704 0044 0532 0130 00")]),
    ("iban GB82 WEST 1234 5698 7654 32 THE end", [("account", "GB82 WEST 1234 5698 7654 32")]),
    ("IBAN DE88 3704 0044 0532 0130 00", []),
    ("GB82 WEST 1234 5698 7654 32", []),
    ("Account number: 1234-5678-90.", [("account", "1234-5678-90")]),
    ("account no. 12345678x, accountant 12345678, account 12345", []),
    ("ssn 123-45-6789 but SSN: 000-12-3456", [("account", "123-45-6789")]),
    ("passport No: X1234567", [("account", "X1234567")]),
    ("see http://bob:pw@host/x", [("address", "http://bob:pw@host")]),
    ("ftp://10.0.0.1:21/a", [("address", "ftp://10.0.0.1:21"), ("ip", "10.0.0.1")]),
    ("http://[::1]/ http://host.com/a@b", [("address", "http://[::1]")]),
    ("mailto:a.b@c.de?x", [("address", "mailto:a.b@c.de"), ("email", "a.b@c.de")]),
    ("tel:+1-234-567-8901;x", [("address", "tel:+1-234-567-8901"), ("phone", "+1-234-567-8901")]),
    ("hotel:12345 sip:me@here", [("address", "sip:me@here")]),
])
def test_spans_that_the_anchors_add(text, found):
    assert [(personal_data.KINDS[k], text[a:b]) for a, k, b in personal_data.spans_of(text)] == found


@pytest.mark.parametrize("part", ["1", "1.", "1 ", "a@", "a.", "@", "+1 ", "+(", "://", "mailto:", "http://a@",
                                  "account ", "IBAN DE89"])
def test_repeated_anchors_take_linear_time(part):
    import time

    def seconds(n):
        began = time.process_time()
        personal_data.spans_of(part * n)
        return time.process_time() - began

    assert seconds(80_000) < 20 * seconds(10_000) + 0.5


def test_personal_data_of_documents(documents, awkward, long_documents):
    for docs in (documents(list(enumerate(mixed(PARTS, 400, 20, 6)))), awkward, long_documents):
        rows = docs.collect()
        got = personal_data.find_personal_data(docs).collect()
        assert len(got) == len(rows)
        of = {(r.doc_id, tuple(map(tuple, r.spans))) for r in got}
        for r in rows:
            want = tuple((personal_data.KINDS[k], a, b) for a, k, b in personal_data.spans_of(r.text or ""))
            assert (r.doc_id, want) in of
    assert personal_data.find_personal_data(awkward.limit(0)).count() == 0


def test_texts_without_personal_data(documents, awkward):
    docs = documents([(1, "write a.b@c.de or call +1 (743) 555-3824!"), (2, None), (3, "mailto:a.b@c.de?x"), (4, "")])
    clean = personal_data.without_personal_data(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {
        1: "write [EMAIL] or call [PHONE]!", 2: None, 3: "[ADDRESS]?x", 4: ""}
    assert personal_data.without_personal_data(awkward).count() == awkward.count()


# token alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKEN_PARTS = ["the", "'re", "'s", " ", "  ", "\n", "\t", "é", "日本", "123", "!!", "<|endoftext|>", "<s>", "</s>", "<unk>",
               "▁", "　", "a", "''", " '", "x'll", "😀", "-", "_", "\x1c", "\u0085", "\x00", "<0x41>"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def aligned_by_hand(libraries, text):
    """n_a, n_b, groups as text, and links of one text, or None if it has no tokens."""
    a, b = libraries
    symbol, whole = _byte_of_symbol(), (" " + (text or "")).encode()
    e = a.encode(whole.decode(), add_special_tokens=False)
    tokens = [[(i, bytes(symbol[c] for c in s)) for i, s in zip(e.ids, e.tokens)],
              [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
               for i in b.encode(text or "") for p in [b.id_to_piece(i)]]]
    if not text or any(b"".join(x[1] for x in side) != whole for side in tokens):
        return None
    ends = [dict(zip(np.cumsum([len(x[1]) for x in side]).tolist(), range(1, len(side) + 1))) for side in tokens]
    groups, links, at = [], [], [0, 0]
    for cut in sorted(ends[0].keys() & ends[1].keys()):
        upto = [e[cut] for e in ends]
        parts = [[x[0] for x in side[x0:x1]] for side, x0, x1 in zip(tokens, at, upto)]
        groups.append("|".join(",".join(map(str, p)) for p in parts))
        links.append((parts[0][-1], parts[1][-1]))
        at = upto
    return len(tokens[0]), len(tokens[1]), ";".join(groups), links


def test_groups_are_those_of_all_shared_ends(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "WHOLE_CHARS", 40)     # B encodes in parts
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 2000)  # and the memory starts afresh
    one = alignment.Aligner(public_tokenizers.path(alignment.BYTES), public_tokenizers.path(alignment.PIECES))
    texts = mixed(TOKEN_PARTS, 1500, 14, 3) + AWKWARD + [prose(k, 100) for k in range(20)] + [prose(9, 5000)]
    seen = 0
    for low in range(0, len(texts), 100):
        part = texts[low:low + 100]
        n_a, n_b, groups, links, bounds = one.block(*text_bytes(pa.array(part)))
        for k, text in enumerate(part):
            want = aligned_by_hand(libraries, text) or (0, 0, None, [])
            own = links[bounds[k]:bounds[k + 1]].tolist()
            assert (n_a[k], n_b[k], groups[k]) == want[:3], text
            assert [(x >> 32, x & 0xFFFFFFFF) for x in own] == want[3]
            seen += want[2] is not None
    assert seen > 500


@pytest.mark.parametrize("hot_pairs", [0, 30, alignment.HOT_PAIRS])
def test_link_scores_whatever_the_number_of_frequent_pairs(documents, awkward, libraries, hot_pairs):
    from collections import Counter

    from anchorlake.session import cut_lineage

    for docs in (documents([(k % 50, t) for k, t in enumerate(mixed(TOKEN_PARTS, 120, 14, 8) + [prose(2, 300)])]),
                 awkward):
        rows = [(r.doc_id, aligned_by_hand(libraries, r.text)) for r in docs.collect()]
        count = Counter(link for _, found in rows if found for link in found[3])
        most = Counter()
        for (_, b), n in count.items():
            most[b] = max(most[b], n)
        want = []
        for doc_id, found in rows:
            own = found[3] if found else []
            want.append((doc_id, *(found[:3] if found else (0, 0, None)), len(own),
                         sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own)))
        stored = cut_lineage(alignment.align_tokens(docs))
        out = alignment.with_link_scores(stored, alignment.link_counts(stored), hot_pairs)
        got = [tuple(r) for r in out.select("doc_id", "n_a", "n_b", "groups", "n_groups", "n_best", "count_sum").collect()]
        key = lambda r: tuple((v is not None, v) for v in r)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_alignment_of_empty_and_long_tables(documents, long_documents):
    from anchorlake.session import cut_lineage

    for docs in (documents([]), documents([(1, None), (2, "")]), long_documents):
        stored = cut_lineage(alignment.align_tokens(docs))
        out = alignment.with_link_scores(stored, alignment.link_counts(stored))
        assert out.count() == docs.count()
        assert out.where("n_groups > 0").count() == docs.where("text <> ''").count()
