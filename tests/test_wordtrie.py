import random
import re
import time

from pyspark.sql import functions as F

from anchorlake.operators import textscan
from anchorlake.operators.wordtrie import WordTrie, word_hits, word_regex
from anchorlake.rules import Keyword

PARTS = ["a", "ab", "b", "sex", "es", "-", " ", "  ", "\n", "é", "ó", "日本", "日", "_", "1", "!", "x-y", "buy cheap"]


def texts(n, most, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, most))) for _ in range(n)]


def test_counts_are_those_of_every_words_own_regex():
    words = tuple(dict.fromkeys(["a", "ab", "aba", "b", "sex", "essex", "a-b", "a b", "a-b a", "x-y", "buy cheap", "日", "日本日",
                                 "é", "!", "!a", "- ", "1_", "es-sex"]))
    find, plain = WordTrie(words, False), WordTrie(words, True)
    for text in texts(4000, 14, 1) + ["", "aaa", "日日日日"]:
        want = {k: len(re.findall(word_regex(w), text)) for k, w in enumerate(words)}
        assert find.count(text) == {k: n for k, n in want.items() if n}, text
        assert plain.count(text) == {k: text.count(w) for k, w in enumerate(words) if w in text}, text
    assert WordTrie((), False).count("any") == {}


def test_cost_does_not_grow_with_the_number_of_words():
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(9))
    many = [word() for _ in range(5_000)]
    text = " ".join(word() for _ in range(20_000)) + " " + " ".join(many[:40])

    def seconds(words):
        find = WordTrie(tuple(words), False)
        best = 1e9
        for _ in range(5):
            began = time.process_time()
            assert sum(find.count(text).values()) == 40
            best = min(best, time.process_time() - began)
        return best

    assert seconds(many) < 2.5 * seconds(many[:225])


def test_scans_with_thousands_of_words(spark):
    rules = [Keyword(f"c{k % 3}", f"word{k}x", k == 7) for k in range(3000)]
    df = spark.createDataFrame([(1, "Word5x word5x word8x and word4x"), (2, "word7x"), (3, "swordx"), (4, None), (5, "")],
                               "id int, text string")
    got = {r.id: r for r in textscan.scan_text(df, rules).collect()}
    assert got[1].content_spam and got[1].content_spam_total == 4 and got[1].content_spam_categories == "c2, c1"
    assert got[1].content_spam_keywords == "word5x x2, word4x x1, word8x x1"
    assert got[2].content_spam_unambiguous == "word7x" and got[2].content_spam
    assert not any(got[k].content_spam for k in (3, 4, 5)) and got[4].content_spam_keywords == ""
    hits = {(r.id, r.word, r.hits) for r in textscan.keyword_hits(df, rules).collect()}
    assert hits == {(1, "word5x", 2), (1, "word8x", 1), (1, "word4x", 1), (2, "word7x", 1)}
    assert textscan.scan_text(df, []).where("content_spam").count() == 0
    assert df.limit(0).select(word_hits(F.col("text"), ["a"])).count() == 0
