"""WARC derivatives and preference pairs."""

import gzip
import hashlib
import re

from anchorlake.llm import preference_pairs, warc_derivatives


def pages(rows):
    return rows("page_id long, url string, html string, date string, text string",
                (1, "http://a.example/", "<html><head><title>A &amp; B</title><style>x{}</style></head><body><p>One<br>two "
                 "<b>th</b>ree</p><script>var t='</p>';</script><!-- no --><div>caf&eacute; &#8217;s &lt;tag&gt;</div></body>", "x", "y"),
                (2, None, None, None, None), (3, "http://b.example/", "", "x", "y"), (4, "u", "a < b &amp;amp; c", None, None),
                (1, "http://a.example/", "<p>other</p>", "x", "y"), (1, "http://a.example/", "<p>other</p>", "x", "y"))


def test_derivatives_are_linked_and_digested(rows):
    got = warc_derivatives.derivatives(warc_derivatives.responses_of(pages(rows))).collect()
    assert len(got) == 12
    text = {(r.page_id, r.block) for r in got if r.warc_type == "conversion"}
    assert (1, "A & B\nOne\ntwo three\ncafé ’s <tag>") in text and (2, "") in text and (3, "") in text
    assert (4, "a < b &amp; c") in text
    for r in got:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.content_length == len(r.block.encode())
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and f"WARC-Block-Digest: {r.block_digest}\r\n" in r.header
        assert ("WARC-Target-URI" in r.header) == (r.target_uri is not None)
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
    conversions = {r.record_id for r in got if r.warc_type == "conversion"}
    for r in got:
        if r.warc_type == "metadata":
            assert r.concurrent_to in conversions and r.source_digest in r.block
            assert "source-Content-Type: text/html" in r.block
    assert len({r.record_id for r in got}) == 10  # the repeated row repeats its two records
    assert warc_derivatives.derivatives(warc_derivatives.responses_of(pages(rows).limit(0))).count() == 0


def test_written_files_hold_whole_records(rows, tmp_path):
    records = warc_derivatives.derivatives(warc_derivatives.responses_of(pages(rows))).coalesce(1)
    warc_derivatives.write_warc(records, str(tmp_path / "out"))
    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "out").glob("part-*")))
    at = n = 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)$", head).group(1))
        at += len(head) + 4 + size
        assert data[at:at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == 12


def test_common_prefix_is_rendered_once(rows):
    turns = rows(
        "conv_id long, turn long, role string, text string, pair_id int, prompt string",
        (0, 0, "user", "hi", 1, "p"), (0, 1, "assistant", "hello", 1, "p"), (0, 2, "user", "more", 1, "p"),
        (1, 2, "user", "other", 1, "p"), (1, 1, "assistant", "hello", 1, "p"), (1, 0, "user", "hi", 1, "p"),
        (1, 3, "assistant", "yes", 1, "p"), (4, 0, "user", "alone", 1, "p"), (6, 0, "user", "same", 1, "p"),
        (7, 0, "user", "same", 1, "p"), (8, 0, None, None, 1, "p"), (9, None, "", "", 1, "p"),
        (9, 1, "assistant", "x", 1, "p"), (None, 0, "user", "nowhere", 1, "p"))
    got = {r.pair_id: r for r in preference_pairs.preference_pairs(turns, preference_pairs.neighbours(turns)).collect()}
    assert sorted(got) == [0, 4, 6, 8]
    first = got[0]
    assert first.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n" and first.prompt_turns == 2
    assert first.chosen == "<|user|>\nmore<|end|>\n" and first.chosen_mask_starts == []
    trained = [first.rejected[a:b] for a, b in zip(first.rejected_mask_starts, first.rejected_mask_ends)]
    assert first.rejected == "<|user|>\nother<|end|>\n<|assistant|>\nyes<|end|>\n" and trained == ["yes<|end|>\n"]
    assert got[4].rejected is None and got[4].prompt == "" and got[4].chosen == "<|user|>\nalone<|end|>\n"
    assert got[6].prompt_turns == 1 and got[6].chosen == got[6].rejected == ""
    assert got[8].prompt_turns == 1 and got[8].rejected == "<|assistant|>\nx<|end|>\n"
    empty = turns.limit(0)
    assert preference_pairs.preference_pairs(empty, preference_pairs.neighbours(empty)).count() == 0
