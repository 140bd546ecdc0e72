"""All rule words of a text in one pass, however many rules there are.

The words are kept in a trie with failure links (Aho-Corasick): every character of a text moves
one step, and every word that ends there is reported, also inside of others. A word with
separators is looked for by its longest part; only where that part is found, the whole word
is matched.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HITS = "array<struct<rule:int,n:int>>"


def word_regex(word: str) -> str:
    """ASCII words begin at a word's edge; hyphens may be spaces or missing, spaces any white space."""
    body = re.escape(word).replace(r"\-", r"[-\s]?").replace(r"\ ", r"\s+")
    return (r"\b" if word.isascii() else "") + body


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


class WordTrie:
    """Finds and counts words in lower-cased texts."""

    def __init__(self, words: tuple[str, ...], plain: bool):
        import ahocorasick

        self.words, self.plain, self.regex = words, plain, {}
        self.machine = ahocorasick.Automaton()
        of_part: dict[str, list[int]] = {}
        for rule, word in enumerate(words):
            parts = [word] if plain else re.split(r"[- ]+", word)
            part = max(parts, key=len)
            if not part:
                if word:  # separators only
                    self.regex[rule] = re.compile(word_regex(word))
                continue
            of_part.setdefault(part, []).append(rule)
            if part != word:
                self.regex[rule] = re.compile(word_regex(word))
        for part, rules in of_part.items():
            self.machine.add_word(part, (len(part), rules))
        self.always = [r for r in self.regex if not re.sub("[- ]", "", words[r])]
        if of_part:
            self.machine.make_automaton()

    def count(self, text: str) -> Counter:
        """How often each word occurs, occurrences of one word not overlapping."""
        found, ends, seen = Counter(), {}, set(self.always)
        for last, (size, rules) in self.machine.iter(text) if len(self.machine) else ():
            start = last - size + 1
            for rule in rules:
                if rule in self.regex:
                    seen.add(rule)
                elif start >= ends.get(rule, 0) and (
                        self.plain or not self.words[rule].isascii()
                        or (start > 0 and _is_word(text[start - 1])) != _is_word(text[start])):
                    found[rule] += 1
                    ends[rule] = last + 1
        for rule in seen:
            times = len(self.regex[rule].findall(text))
            if times:
                found[rule] = times
        return found


@lru_cache(maxsize=8)
def trie(words: tuple[str, ...], plain: bool) -> WordTrie:
    """One trie for each worker process and set of words."""
    return WordTrie(words, plain)


def word_hits(text: Column, words: list[str], plain: bool = False) -> Column:
    """(rule, n) for each word of the list that occurs in a lower-cased text, in list order.

    ``plain`` words count as substrings, others as ``word_regex`` matches them. Null and empty
    texts have no hits.
    """
    given = tuple(words)

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        find = trie(given, plain)
        return texts.map(lambda t: [{"rule": r, "n": n} for r, n in sorted(find.count(t).items())] if t else [])

    return hits(text)
