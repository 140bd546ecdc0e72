"""Quality rules, source mixes, quality scores and languages."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from llm_texts import prose

from anchorlake.llm import language_id, quality_rules, quality_score, source_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    """The base counts of one text, the plain way."""
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    inside = {p for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for p in range(k, k + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_rule_counts_equal_a_plain_count(awkward):
    got = quality_rules.quality_rules(awkward).collect()
    assert len(got) == awkward.count()
    texts = {r.doc_id: r.text for r in awkward.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            n, chars, symbols, dup, repeat = counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
                n, chars, symbols, dup, repeat), texts[r.doc_id]
            assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
            assert not (r.base_failed and r.kept)


def test_thresholds_follow_their_group(documents):
    """Marked-up text is an outlier among prose and normal in a source made of it."""
    marked = lambda k: " ".join(w + "##" for w in prose(k, 120).split())
    data = [(k, prose(k, 120), "en", "plain") for k in range(300)]
    data += [(1000 + k, marked(k), "en", "marked") for k in range(300)] + [(2000, marked(5), "en", "plain")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents(data)).collect()}
    assert not got[2000].kept and got[2000].out_of_range == ["symbols_per_word"]
    assert all(r.kept for i, r in got.items() if i != 2000)
    kept = quality_rules.keep_good(documents(data))
    assert kept.columns == documents([]).columns and {r.doc_id for r in kept.collect()} == set(got) - {2000}
    assert quality_rules.quality_rules(documents([])).count() == 0
    assert quality_rules.keep_good(documents([])).count() == 0


def test_sketches_merge_to_the_sketch_of_everything(documents):
    data = [(k, prose(k, 30 + k % 50), "en", f"s{k % 3}") for k in range(90)]
    bucket = lambda df: {(r.measure, r.bucket): r.n for r in df.groupBy("measure", "bucket").sum("n")
                         .withColumnRenamed("sum(n)", "n").collect()}
    measured = quality_rules.text_measures(documents(data))
    parts = [quality_rules.sketches(measured.where(f"doc_id % 2 = {k}")) for k in (0, 1)]
    assert bucket(quality_rules.sketches(measured)) == bucket(parts[0].union(parts[1]))


def test_budgets_are_met_where_lengths_allow_it():
    draw = np.random.default_rng(1)
    for _ in range(200):
        lengths = np.unique(draw.integers(1, 30, draw.integers(1, 6)))
        free = draw.integers(1, 5, len(lengths))
        budget = int(draw.integers(0, int((lengths * free).sum()) + 2))
        sums = {int(np.dot(c, lengths)) for c in itertools.product(*[range(n + 1) for n in free])}
        best = max(s for s in sums if s <= budget)
        program = source_mix._subset_sum(lengths, free, budget)
        assert (program <= free).all() and int(np.dot(program, lengths)) == best
        taken = source_mix.fit_budget(lengths, free, budget)
        assert (taken >= 0).all() and (taken <= free).all() and int(np.dot(taken, lengths)) == best


def water(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes)
    weight = {n: (1, 2, 3)[k % 3] for k, n in enumerate(names)}
    capped, free = {}, set(names)
    while free:
        rest = sum(sizes.values()) - sum(capped.values())
        over = [n for n in free if rest * weight[n] / sum(weight[m] for m in free) > 3 * sizes[n]]
        if not over:
            return capped | {n: rest * weight[n] / sum(weight[m] for m in free) for n in free}
        capped |= {n: 3 * sizes[n] for n in over}
        free -= set(over)
    return capped


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5}, {"a": 0, "b": 7}, {"x": 1}, {f"s{k}": 10 ** (k % 5) for k in range(9)}])
def test_targets_are_the_fixed_point(spark, sizes):
    got = source_mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = water(sizes)
    assert {r.source: pytest.approx(r.target) for r in got.collect()} == want


def test_mix_meets_its_targets_and_reruns_agree(documents, awkward):
    data = [(k, prose(k, 5 + k % 40), "en", ("a", "b", "c", None)[min(k % 7, 3)]) for k in range(400)]
    got = source_mix.mix_sources(documents(data)).collect()
    again = source_mix.mix_sources(documents(data[::-1]).repartition(7)).collect()
    assert sorted(got) == sorted(again) and len(got) == 400
    by_target = collections.defaultdict(int)
    for r in got:
        by_target[r.target, r.source_size] += r.taken
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
    assert all(abs(taken - target) <= 1 for (target, _), taken in by_target.items())
    rows = source_mix.mixed_documents(documents(data))
    assert rows.columns == documents([]).columns
    times = collections.Counter(r.doc_id for r in rows.collect())
    assert times == {r.doc_id: r.taken // r.size for r in got if r.taken}
    odd = source_mix.mix_sources(awkward).collect()
    assert len(odd) == awkward.count()
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in awkward.collect() if r.doc_id is not None}
    assert all(r["size"] == sizes[r.doc_id] for r in odd if r.doc_id is not None)
    assert source_mix.mix_sources(documents([])).count() == 0 == source_mix.mixed_documents(documents([])).count()


def test_quality_scores_tell_junk_from_prose(spark, documents, awkward):
    junk = lambda k: " ".join(w + "&&" for w in prose(k, 60).split()) if k % 2 else "Buy Buy Buy now!! " * 12
    data = [(k, junk(k) if k % 4 == 0 or k % 7 == 0 else prose(k, 40 + k % 60)) for k in range(300)]
    truth = {k: 0 if k % 4 == 0 or k % 7 == 0 else 1 for k in range(300)}
    labels = spark.createDataFrame([(k, q, 0) for k, q in truth.items()] + [(None, 1, 0), (2, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality_score.quality_scores(documents(data), labels).collect()
    assert len(got) == 300
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    # the labels of held-out rows change nothing
    flipped = spark.createDataFrame(
        [(k, 1 - q if zlib.crc32(str(k).encode()) % 3 == 1 else q, 0) for k, q in truth.items()],
        "doc_id long, quality int, toxic int")
    again = quality_score.quality_scores(documents(data), flipped).collect()
    assert {r.doc_id: pytest.approx(r.score) for r in got} == {r.doc_id: r.score for r in again}
    odd = quality_score.quality_scores(awkward, labels).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality_score.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality_score.quality_scores(documents([]), labels).count() == 0


def test_log_densities_are_those_of_the_shrunk_gaussians():
    draw = np.random.default_rng(4)
    size = len(quality_score.STATISTICS)
    x = [draw.normal(size=(60, size)), draw.normal(0.5, 2.0, size=(90, size))]
    model = quality_score.Discriminant(
        np.array([60.0, 90.0]), np.stack([a.sum(axis=0) for a in x]), np.stack([a.T @ a for a in x]))
    z = (np.concatenate(x) - model.center) / model.scale
    logs = []
    own = [np.cov(((a - model.center) / model.scale).T, bias=True) for a in x]
    pooled = (60 * own[0] + 90 * own[1]) / 150
    for prior, mean, cov in zip(model.prior, model.means, own):
        cov = ((1 - quality_score.POOLED - quality_score.DIAGONAL) * cov + quality_score.POOLED * pooled
               + quality_score.DIAGONAL * np.diag(np.diag(pooled)) + quality_score.FLOOR * np.eye(size))
        gap = z - mean
        logs.append(prior - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)
                    - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
    assert np.allclose(model.scores(np.concatenate(x)), want)


GERMAN = "der Hund läuft über die Straße und sieht einen großen Baum im Garten neben dem alten Haus".split()
FRENCH = "le chien traverse la rue et voit un grand arbre dans le jardin près de la vieille maison été".split()


def test_languages_are_told_apart(documents, awkward):
    draw = np.random.default_rng(2)
    data = [(k, " ".join(draw.choice(words, 30)), lang) for k in range(240)
            for words, lang in [((GERMAN, FRENCH)[k % 2], ("de", "fr")[k % 2])]]
    data += [(1000, None, "de"), (1001, "12 34 --", "fr"), (1002, "Hund Baum Haus", None)]
    docs = documents(data)
    model = language_id.fit_languages(docs.where("doc_id % 3 != 1"), size=50)
    got = {r.doc_id: r for r in language_id.identify_languages(docs, model).collect()}
    assert len(got) == len(data)
    assert all(got[k].lang_pred == lang for k, _, lang in data[:240])
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert got[1002].lang_pred == "de" and 0 < got[1002].score <= 1
    far = documents([(1, "zzzz qqqq xxxx zqzq"), (2, " ".join(GERMAN))])
    strict = {r.doc_id: r for r in language_id.identify_languages(far, model, reject=True).collect()}
    assert strict[1].lang_pred == "und" and strict[1].rejected and strict[2].lang_pred == "de"
    odd = language_id.identify_languages(awkward, model).collect()
    assert len(odd) == awkward.count() and {r.lang_pred for r in odd} <= {"de", "fr", "und"}
    assert language_id.fit_languages(documents([])) is None
    assert {r.lang_pred for r in language_id.identify_languages(awkward, None).collect()} == {"und"}


def test_document_frequencies_are_those_of_all_labelled_documents(documents):
    draw = np.random.default_rng(3)
    data = [(k, " ".join(draw.choice(words, 12)), lang) for k in range(90)
            for words, lang in [(GERMAN, "de") if k % 9 else (FRENCH, "fr")]]
    docs = documents(data + [(1000, None, "de")]).union(documents([(1001, "never learnt", None)], lang=None))
    texts = [t for _, t, _ in data]
    counts = language_id.gram_counts(*language_id_bytes(texts))
    want = np.log(91 / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    assert np.allclose(language_id.fit_languages(docs, size=10).idf, want)


def language_id_bytes(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_budgets_are_met_where_any_choice_meets_them():
    draw = random.Random(2)
    for _ in range(200):
        lengths = np.array(sorted(draw.sample(range(1, 30), draw.randint(1, 6))))
        counts = np.array([draw.randint(0, 5) for _ in lengths])
        budget = draw.randint(0, int((lengths * counts).sum()) + 3)
        sums = {0}
        for length, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        take = source_mix.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_budgets_no_sum_can_meet_stay_small():
    import tracemalloc

    lengths, counts = np.arange(2, 3002, 2), np.full(1500, 400)
    budget = int((lengths * counts).sum()) // 2 | 1
    tracemalloc.start()
    for free in (counts, np.append(counts, 0)):
        own = np.append(lengths, 9999) if len(free) > len(lengths) else lengths
        assert budget - int((source_mix.fit_budget(own, free, budget) * own).sum()) == 1
    # no common divisor, and still out of reach: all but one document are even, and it is too long
    own, free = np.append(lengths, budget + 2), np.append(counts, 1)
    assert budget - int((source_mix.fit_budget(own, free, budget) * own).sum()) >= 0
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_quartiles_lean_on_wider_groups_by_count(spark):
    sizes = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 50}
    rows, values = [], {}
    for g, ((lang, source), n) in enumerate(sizes.items()):
        values[lang, source] = [100 * (g + 1) + k % 37 for k in range(n)]
        rows += [(lang, source, 1, v, 0, 0, 0, 1, 0, 1, 0) for v in values[lang, source]]
    kind = "lang string, source string, " + ", ".join(f"{c} long" for c in quality_rules._COUNTS)
    sketch = quality_rules.sketches(spark.createDataFrame(rows, kind))

    def quartile(data, q):
        return sorted(data)[int(np.ceil(q * len(data))) - 1]

    every = sum(values.values(), [])
    got = {(r.lang, r.source): r for r in quality_rules.thresholds(sketch).collect()}
    for (lang, source), own in values.items():
        wide = sum((v for k, v in values.items() if k[0] == lang), [])
        for q, name in ((0.25, "low"), (0.75, "high")):
            lean = (len(wide) * quartile(wide, q) + quality_rules.PRIOR * quartile(every, q)) / (len(wide) + quality_rules.PRIOR)
            want = (len(own) * quartile(own, q) + quality_rules.PRIOR * lean) / (len(own) + quality_rules.PRIOR)
            assert abs(got[lang, source][f"chars_per_word_{name}"] / want - 1) < 0.02
