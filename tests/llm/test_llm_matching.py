"""Near duplicates, decontamination and the pipeline against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import prose

from anchorlake.llm import components, decontamination, near_duplicates
from anchorlake.llm.textblocks import plain_words, range_hashes, text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edited(text, edits, seed):
    draw, words = random.Random(seed), text.split(" ")
    for k in draw.sample(range(len(words)), edits):
        words[k] = f"changed{draw.randrange(10**6)}"
    return " ".join(words)


def shingle_set(text):
    words = WORD.findall(text or "")
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(201, 200), (202, 201)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_samples_agree_as_often_as_weighted_sets_overlap():
    draw = np.random.default_rng(9)
    ids = np.sort(draw.integers(0, 2**56, 400, dtype=np.uint64))
    weight = np.where(draw.random(400) < 0.3, 1 + np.log(draw.integers(1, 9, 400)), near_duplicates.IDF_TOP)
    other = np.where(draw.random(400) < 0.1, weight * 1.7, weight)
    a, b = np.arange(0, 340), np.arange(40, 400)
    shared = np.minimum(weight[40:340], other[40:340]).sum()
    want = shared / (weight[a].sum() + other[b].sum() - shared)
    rows, near_duplicates_rows = near_duplicates.BANDS * near_duplicates.ROWS, near_duplicates.ROWS
    try:
        near_duplicates.BANDS, near_duplicates.ROWS = rows, 1  # every sample its own band
        keys = near_duplicates.band_keys(
            np.concatenate([ids[a], ids[b]]), np.concatenate([weight[a], other[b]]), np.array([0, len(a)]))
    finally:
        near_duplicates.BANDS, near_duplicates.ROWS = rows // near_duplicates_rows, near_duplicates_rows
    assert abs((keys[0] == keys[1]).mean() - want) < 4 * (want * (1 - want) / rows) ** 0.5


def test_near_duplicates_against_all_pairs(documents):
    base = [prose(k, 120) for k in range(12)]
    data = [(k, t) for k, t in enumerate(base)]
    data += [(100 + 10 * k + e, edited(t, e, k + e)) for k, t in enumerate(base) for e in (1, 2, 3, 9)]
    data += [(500 + k, base[k % 3]) for k in range(30)] + [(700 + k, edited(base[4], 2, k)) for k in range(60)]
    data += [(900, None), (901, None), (902, ""), (903, ""), (904, "only four words here"),
             (905, "only four words here"), (906, "only four other words"), (0, base[0]), (None, base[1])]
    docs = documents(data)
    got = near_duplicates.near_duplicates(docs).collect()
    assert len(got) == len(data)
    classes = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    sets = {i: shingle_set(t) for i, t in data if i is not None and i < 900}
    near = collections.defaultdict(set)
    for a, b in itertools.combinations(sets, 2):
        score = jaccard(sets[a], sets[b])
        if score >= 0.8:
            assert classes[a] == classes[b], (a, b, score)
        if score >= 0.75:
            near[a].add(b)
            near[b].add(a)
    for a in sets:  # whoever shares a class is joined to it by a close text
        others = [b for b in sets if b != a and classes[b] == classes[a]]
        assert not others or near[a] & set(others)
    assert classes[900] == 900 and classes[901] == 901 and classes[903] == 902 == classes[902]
    assert classes[905] == 904 and classes[906] == 906
    sizes = collections.Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] for r in got if r.doc_id not in (900, 901))
    assert next(r for r in got if r.doc_id is None).class_id == 1
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*classes.values()})
    assert near_duplicates.near_duplicates(documents([])).count() == 0 == near_duplicates.keep_one(documents([])).count()


def test_a_group_that_holds_most_rows(documents):
    """Copies of a middle text link through it, not to each other, and are one class."""
    base = prose(77, 200)
    data = [(k, edited(base, 4, k)) for k in range(150)] + [(1000, base)] + [(2000 + k, prose(k, 60)) for k in range(50)]
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(documents(data)).collect()}
    sets = {i: shingle_set(t) for i, t in data}
    linked = [i for i in range(150) if jaccard(sets[i], sets[1000]) >= 0.8]
    assert len(linked) > 100 and all(got[i].class_id == got[1000].class_id for i in linked)
    assert all(got[2000 + k].class_size == 1 for k in range(50))


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_best_span_is_the_best_of_all_spans():
    draw = np.random.default_rng(3)
    for _ in range(60):
        words, item = draw.integers(0, 4, 12), draw.integers(0, 4, draw.integers(1, 6))
        distance, a, b = decontamination.best_span(item, words)
        every = [plain_edits(item.tolist(), words[i:j].tolist()) for i in range(13) for j in range(i, 13)]
        assert distance == min(every) == plain_edits(item.tolist(), words[a:b].tolist())


def damaged(text, edits, draw):
    words = text.split()
    for _ in range(edits):
        at, kind = draw.randrange(len(words)), draw.random()
        if kind < 0.34:
            words[at] = f"other{draw.randrange(10**6)}"
        elif kind < 0.67:
            del words[at]
        else:
            words.insert(at, draw.choice(words))
    return " ".join(words)


def test_walks_reach_their_recall_at_the_last_allowed_edit():
    draw = random.Random(8)
    items = [prose(1000 + k, draw.randint(14, 60)) for k in range(60)]
    index = decontamination.ItemIndex(list(range(60)), items, decontamination.SIMILARITY)
    texts, want = [], []
    for k in range(240):
        item = draw.randrange(60)
        n = len(plain_words(*text_bytes(pa.array([items[item]])))[1].start)
        edits = decontamination.allowed_edits(n, decontamination.SIMILARITY)
        texts.append(f"{prose(k, 50)} {damaged(items[item], edits, draw)} {prose(500 + k, 50)}")
        want.append(item)
    found = {(m[0], m[1]) for m in index.matches(*text_bytes(pa.array(texts)))}
    assert np.mean([(k, item) in found for k, item in enumerate(want)]) >= 0.95


def test_matches_are_those_of_a_search_over_all_spans(documents, spark):
    draw = random.Random(5)
    items = [(k, prose(2000 + k, 15 + k)) for k in range(8)] + [(90, None), (91, ""), (92, "too short here")]
    data = [(k, prose(k, 40)) for k in range(30)]
    data += [(100 + k, f"{prose(k, 20)} {items[k % 8][1].upper()}! {prose(k + 50, 20)}") for k in range(16)]
    data += [(200 + k, f"{prose(k, 9)}\n{damaged(items[k % 8][1], 2, draw)}") for k in range(16)]
    data += [(300, None), (301, ""), (302, items[3][1]), (302, items[3][1]), (None, items[4][1]), (303, items[0][1][:40])]
    docs = documents(data)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontamination.contaminated_spans(docs, bench).collect()

    def plain(text):
        lower, words = plain_words(*text_bytes(pa.array([text or ""])))
        return range_hashes(lower, words.start, words.end)

    want = []
    for i, text in data:
        for item, passage in items:
            a, b = plain(passage), plain(text)
            if len(a) >= decontamination.MIN_WORDS and len(b):
                edits = decontamination.best_span(a, b)[0]
                if edits <= decontamination.allowed_edits(len(a), decontamination.SIMILARITY):
                    want.append((i is None, i or 0, item, edits))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id, r.edits) for r in got) == sorted(want)
    whole = {i: t for i, t in data}
    for r in got:
        if 100 <= (r.doc_id or 0) < 200:
            span = whole[r.doc_id].encode()[r.start_byte:r.end_byte].decode()
            assert span == items[r.item_id][1].upper().rstrip(".")
    clean = decontamination.without_contamination(docs, bench)
    assert clean.columns == docs.columns
    bad = {(r.doc_id is None, r.doc_id or 0) for r in got}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in clean.collect()) == sorted(
        (i is None, i or 0) for i, _ in data if (i is None, i or 0) not in bad)
    assert decontamination.contaminated_spans(documents([]), bench).count() == 0
    assert decontamination.contaminated_spans(docs, bench.limit(0)).count() == 0
    assert decontamination.without_contamination(docs, bench.limit(0)).count() == len(data)


def test_pipeline_stages_do_what_they_say(spark, documents, tmp_path):
    import corpus_pipeline
    from anchorlake.llm.packing import segments

    bench = spark.createDataFrame([(k, prose(2000 + k, 20)) for k in range(3)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(k, prose(k, 60 + k % 40), "en", f"s{k % 4}") for k in range(240)]
    bad = [(1000, "short text", "en", "s1"), (1001, clean[7][1], "en", "s2"), (1002, edited(clean[8][1], 1, 3), "en", "s0"),
           (1003, f"{prose(900, 50)} {prose(2001, 20)} {prose(901, 50)}", "en", "s3"), (1004, None, "en", None)]
    docs = documents(clean + bad).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
        if name == "benchmark decontamination":
            assert {r.doc_id for r in left.collect()} == set(range(240))
    mixed = collections.Counter(r.doc_id for r in left.collect())
    assert set(mixed) <= set(range(240)) and max(mixed.values()) <= 3
    packed = segments(corpus_pipeline.run(spark, str(tmp_path))).collect()
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == mixed


@pytest.mark.parametrize("kind", ["spans", "classes"])
def test_awkward_documents_do_not_stop_the_searches(awkward, spark, kind):
    if kind == "spans":
        bench = spark.createDataFrame([(1, "a word word word word word"), (None, "it's we'll it's we'll it's")],
                                      "item_id long, text string")
        decontamination.contaminated_spans(awkward, bench).collect()
    else:
        got = near_duplicates.near_duplicates(awkward).collect()
        assert len(got) == awkward.count() and sum(r.keep for r in got) >= 1


@pytest.mark.parametrize("at", ["head", "middle", "tail"])
def test_whole_documents_shorter_than_an_item_are_found_in_any_block(at):
    items = [prose(3000 + k, n) for k, n in enumerate((20, 25, 40))]
    index = decontamination.ItemIndex(list(range(3)), items, decontamination.SIMILARITY)
    texts, want = [], []
    for k, item in enumerate(items):
        words = item.split()
        for lost in range(1, decontamination.allowed_edits(len(words), decontamination.SIMILARITY) + 1):
            low = {"head": 0, "middle": 7, "tail": len(words) - lost}[at]
            texts.append(" ".join(words[:low] + words[low + lost:]))
            want.append((k, lost))
    alone = [[m[1:3] for m in index.matches(*text_bytes(pa.array([text])))] for text in texts]
    assert alone == [[w] for w in want]
    block = [t for k, text in enumerate(texts) for t in (text, prose(k, 50))]
    found = index.matches(*text_bytes(pa.array(block)))
    assert [m[:3] for m in found] == [(2 * k, *w) for k, w in enumerate(want)]


@pytest.mark.parametrize("size", [60, 100, 200, 400])
@pytest.mark.parametrize("kind", ["insert", "delete", "change", "mixed"])
def test_long_items_are_found_at_the_last_allowed_edit(size, kind):
    draw = random.Random(size)
    items = [prose(4000 + k, size) for k in range(6)]
    index = decontamination.ItemIndex(list(range(6)), items, decontamination.SIMILARITY)
    edits, texts = decontamination.allowed_edits(size, decontamination.SIMILARITY), []
    for k in range(24):
        words = items[k % 6].split()
        if kind == "mixed":
            words = damaged(items[k % 6], edits, draw).split()
        elif kind == "insert":
            for _ in range(edits):
                words.insert(draw.randrange(len(words)), draw.choice(words))
        else:
            for at in sorted(draw.sample(range(size), edits), reverse=True):
                words[at:at + 1] = [f"other{draw.randrange(10**6)}"] if kind == "change" else []
        texts.append(f"{prose(k, 50)} {' '.join(words)} {prose(500 + k, 50)}")
    found = {m[:2] for m in index.matches(*text_bytes(pa.array(texts)))}
    assert np.mean([(k, k % 6) in found for k in range(24)]) >= 0.99


def test_items_of_few_words_and_of_scripts_without_spaces_are_found():
    items = ["今天天气很好，我们去公园散步吧", "東京は日本の首都です", "สวัสดีครับ ยินดี", "Quo vadis?", "“naïve” — question", "。！"]
    index = decontamination.ItemIndex(list(range(6)), items, decontamination.SIMILARITY)
    texts = ["他说：“今天天气很好，我们去公园散步吧。”然后就走了", "昨日今天天气真好我们去公园散步吧", "はい、東京は日本の首都です。よろしく",
             "ก่อนสวัสดีครับยินดีมาก", "he asked: quo VADIS, then left", "quo vero vadis", "a naïve…question", "。！", "naïve",
             "vadis", "a question quo"]
    found = index.matches(*text_bytes(pa.array(texts)))
    assert [m[:3] for m in found] == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 2, 0), (4, 3, 0), (6, 4, 0)]
    spans = [texts[m[0]].encode()[m[4]:m[5]].decode() for m in found]
    assert spans == [items[0], "今天天气真好我们去公园散步吧", items[1], "สวัสดีครับยินดี", "quo VADIS", "naïve…question"]
    lower, words = plain_words(*text_bytes(pa.array(["한국어 문장。Ça—va“É” a😀b", "日", None, "本"])))
    assert [lower[a:b].tobytes().decode() for a, b in zip(words.start, words.end)] == [
        "한국어", "문장", "ça", "va", "é", "a", "b", "日", "本"]
    assert words.first.tolist() == [0, 7, 8, 8, 9]


def test_a_text_and_its_own_repetitions_are_one_class(documents):
    """Weighted by counts they share 1 / (1 + log times) of their shingles, plainly nearly all."""
    times = (2, 3, 5, 12)
    base = [prose(5000 + k, 80) for k in range(40)]
    data = [(k, t) for k, t in enumerate(base)]
    data += [(1000 + k, " ".join([t] * times[k % 4])) for k, t in enumerate(base)]
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(documents(data)).collect()}
    assert [k for k in range(40) if got[1000 + k].class_id != k] == []
    assert all(r.class_size == 2 for r in got.values())
    assert sorted(r.doc_id for r in near_duplicates.keep_one(documents(data)).collect()) == list(range(40))
