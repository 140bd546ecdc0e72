"""Text functions: counting, number parsing, stemming, page shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorlake import fixed_values as fixed


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


# ------------------------------------------------------------- cells ---------
def lenient_number(cell: Column, error_is_null: bool = True) -> Column:
    """First number in a cell: '42%' -> 42, '1,234' -> 1234, 'N/A' -> null."""
    blank = "|".join(re.escape(b) for b in fixed.BLANK_NUMBERS + ["ERROR"] * error_is_null if b)
    digits = F.regexp_replace(F.regexp_replace(cell, ",", ""), rf"(?i)^\s*(?:{blank})\s*$", "")
    return F.nullif(F.regexp_extract(digits, r"(-?[0-9]+(?:[.][0-9]+)?)", 1), F.lit("")).try_cast("double")


_HOST_CELL = r"(?:[^\s/?#:@,;\"'<>()]+\.)+[A-Za-z]{2,}"


def looks_like_domain(cell: Column) -> Column:
    """A bare host with an optional scheme and path, or any whole web address."""
    bare = F.trim(F.coalesce(cell, F.lit("")))
    return bare.rlike(rf"^(?i:https?://)?{_HOST_CELL}(?:/[^ ]*)?$") | bare.rlike(r"^https?://[^\s]+$") & bare.contains(" ")


def clean_host_cell(cell: Column) -> Column:
    """A sheet cell to a bare host name; cells with inner spaces give an empty host."""
    from anchorlake.functions.urls import host_of

    bare = F.trim(F.coalesce(cell, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(bare, r'^"+|"+$', ""), r"^'+|'+$", "")
    return F.when((bare == "") | bare.contains(" "), "").otherwise(host_of(F.lower(bare)))


# ---------------------------------------------------------- keywords ---------
WORD_START = r"(?<![\p{L}\p{N}_])"
_GAP = r"[\s\x1c-\x1f\x85\p{Z}]"


def _keyword_body(word: str) -> str:
    return "".join(
        f"(?:-|{_GAP})?" if ch == "-" else f"{_GAP}+" if ch == " " else re.escape(ch)
        for ch in word.lower())


def keyword_pattern(word: str) -> str:
    """Java regex for a keyword, to be matched against lower-cased text.

    ASCII words need a word start in front, so 'sex' does not match 'Essex';
    scripts written without spaces are searched as plain substrings. A hyphen may
    be a hyphen, a space or nothing, and a space any run of whitespace.
    """
    return (WORD_START if word.isascii() else "") + _keyword_body(word)


def contains_any_keyword(low: Column, words: list[str]) -> Column:
    """Does lower-cased text contain any keyword? One regex per script family.

    The word-start test is factored out and the words are grouped by first
    character, which costs a tenth of the plain alternation.
    """
    def grouped(some: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for word in dict.fromkeys(w.lower() for w in some):
            heads.setdefault(word[0], []).append(_keyword_body(word[1:]))
        return "(?:" + "|".join(
            f"{re.escape(head)}(?:{'|'.join(rest)})" for head, rest in heads.items()) + ")"

    ascii_words = [w for w in words if w.isascii()]
    other_words = [w for w in words if not w.isascii()]
    hit = F.lit(False)
    if ascii_words:
        hit = hit | low.rlike(WORD_START + grouped(ascii_words))
    if other_words:
        hit = hit | low.rlike(grouped(other_words))
    return hit


# ---------------------------------------------------------- stemming ---------
def stem_word(word: str) -> str:
    """Stem one configured word. Used for concept lists, never per row."""
    word = word.lower().strip("'-")
    if word in fixed.STEM_TABLE or len(word) <= 4:
        return fixed.STEM_TABLE.get(word, word)
    for suffix in fixed.STEM_SUFFIXES:
        if word.endswith(suffix) and len(word) - len(suffix) >= 4:
            base = word[: -len(suffix)]
            return fixed.STEM_TABLE.get(base, base + "y" if suffix == "ies" else base)
    return word


def words_with_stem(stem: str) -> list[str]:
    """Every word that stems to ``stem``: the finite inverse of ``stem_word``."""
    roots = {stem} | {w for w, s in fixed.STEM_TABLE.items() if s == stem}
    candidates = set(roots) | {r + s for r in roots for s in fixed.STEM_SUFFIXES}
    if stem.endswith("y"):
        candidates.add(stem[:-1] + "ies")
    return sorted(w for w in candidates if stem_word(w) == stem)


def stem(token: Column) -> Column:
    """Stem a token column with table lookups and a chain of suffix tests."""
    word = F.regexp_replace(F.lower(token), r"^['\-]+|['\-]+$", "")
    table = F.create_map(*[F.lit(x) for pair in fixed.STEM_TABLE.items() for x in pair])
    stripped = F.when(F.length(word) <= 4, word)
    for suffix in fixed.STEM_SUFFIXES:
        base = F.left(word, F.length(word) - len(suffix))
        plain = F.concat(base, F.lit("y")) if suffix == "ies" else base
        stripped = stripped.when(
            word.endswith(suffix) & (F.length(word) - len(suffix) >= 4),
            F.coalesce(F.try_element_at(table, base), plain))
    return F.coalesce(F.try_element_at(table, word), stripped.otherwise(word))


def raw_tokens(text: Column) -> Column:
    """Lower-case word tokens of a text, in order, as they stand."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z'\-]*"), F.lit(0))


def tokens(text: Column) -> Column:
    """Stemmed word tokens of a text, in order."""
    return F.transform(raw_tokens(text), stem)


def token_stream(text: Column) -> Column:
    """The same tokens unstemmed, space separated with a space at both ends."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_replace(low, r"[^a-z'\-]+", " ")
    runs = F.concat(F.lit(" "), runs, F.lit(" "))
    return F.regexp_replace(runs, r"['\-]*(?: ['\-]*)+", " ")


def phrase_pattern(phrases: list[str]) -> str | None:
    """Regex over ``token_stream`` matching any phrase under any inflection.

    Each configured word is expanded to the words that share its stem, so the
    page text itself is never stemmed and the match stays one compiled regex.
    """
    alternatives = []
    for phrase in phrases:
        words = re.findall(r"[a-z][a-z'-]*", phrase.lower())
        if words:
            alternatives.append(" ".join(
                "(?:" + "|".join(re.escape(w) for w in words_with_stem(stem_word(word))) + ")"
                for word in words))
    return " (?:" + "|".join(alternatives) + ") " if alternatives else None


# ------------------------------------------------------------ shapes ---------
def title_shape(title: Column) -> Column:
    """Three alphabetically first distinct telling words of a title."""
    letters = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z ]+", " ")
    words = F.filter(F.split(letters, " +"), lambda w: (F.length(w) > 2)
                     & ~w.isin(fixed.TITLE_STOP_WORDS))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, 3), " ")


def generator_shape(generator: Column) -> Column:
    """Generator name without version numbers."""
    bare = F.regexp_replace(F.lower(F.coalesce(generator, F.lit(""))), r"[\d.]+", " ")
    return collapse(bare)


def language_mismatch(lang: Column, expected: list[str]) -> Column:
    """Is the primary language subtag outside the expected ones?"""
    primary = F.trim(F.substring_index(F.lower(F.coalesce(lang, F.lit(""))), "-", 1))
    wanted = [e.lower().strip().split("-")[0] for e in expected]
    if not wanted:
        return F.lit(False)
    return (primary != "") & ~primary.isin(wanted)


# ----------------------------------------------------------- anchors ---------
def anchor_kind(anchor: Column, brands: list[str]) -> Column:
    text = F.lower(collapse(anchor))
    branded = F.lit(False)
    for brand in brands:
        branded = branded | text.contains(brand)
    return (
        F.when((text == "") | (text == fixed.EMPTY_ANCHOR), "image-empty")
        .when(branded, "branded")
        .when(text.rlike("(?i)" + fixed.URLISH_ANCHOR), "naked-url")
        .when(text.isin(fixed.GENERIC_ANCHORS) | (F.length(text) <= 3), "generic")
        .otherwise("keyword")
    )
