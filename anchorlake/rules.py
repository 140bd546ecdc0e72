"""Rule tables that users replace: spam keywords, markers, authority sites.

The defaults are small. Pass a longer list, or load one with ``load_keyword_rules``,
to match your own niche; every scan takes its rules as a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable

from anchorlake import fixed_values as fixed


@dataclass(frozen=True)
class Keyword:
    category: str
    word: str
    unambiguous: bool = False


def keyword_rules(rows: Iterable[tuple]) -> list[Keyword]:
    """Rules from ``(category, word[, unambiguous])`` rows.

    Categories keep the order in which they first appear and their words are
    made contiguous; a word listed twice in a category counts once.
    """
    by_category: dict[str, dict[str, Keyword]] = {}
    for category, word, *rest in rows:
        words = by_category.setdefault(category, {})
        words.setdefault(word, Keyword(category, word, bool(rest and rest[0])))
    return [rule for words in by_category.values() for rule in words.values()]


def load_keyword_rules(path: str) -> list[Keyword]:
    """Rules from a YAML file: category -> words, a leading ``!`` marks an unambiguous word.

    The file is read on the driver; it is configuration, not data.
    """
    import yaml

    with open(path, encoding="utf-8") as file:
        given = yaml.safe_load(file) or {}
    return keyword_rules((category, str(word).lstrip("!"), str(word).startswith("!"))
                         for category, words in given.items() for word in words or [])


def load_authority(path: str) -> dict[str, list[str]]:
    """Group -> sites from a YAML file, for ``authority_dim``."""
    import yaml

    with open(path, encoding="utf-8") as file:
        return {str(group): [str(site) for site in sites or []]
                for group, sites in (yaml.safe_load(file) or {}).items()}


def _words(category: str, plain: str, unambiguous: str) -> list[tuple]:
    return [(category, w.strip()) for w in plain.split(",")] + [(category, w.strip(), True) for w in unambiguous.split(",")]


# A starting set of our own; give complete lists with ``load_keyword_rules``. The second list
# of each category holds words without an innocent reading.
DEFAULT_KEYWORDS = keyword_rules([
    *_words("adult", "porn, escort, striptease, sex chat, webcam girls, erotic massage, nude photos",
            "sex videos free, live sex cams, порно видео"),
    *_words("gambling", "casino, poker, roulette, blackjack, slot machine, sports bet, free spins, odds calculator",
            "situs slot, gacor, deneme bonusu, no deposit bonus, казино, สล็อต, 온라인카지노, 博彩"),
    *_words("medicines", "viagra, weight-loss pills, painkillers online, sleeping pills, miracle cure",
            "no-prescription needed, cheap viagra, buy oxycodone"),
    *_words("money schemes", "quick loan, payday advance, get-rich, binary trading, crypto giveaway",
            "double your bitcoin, guaranteed returns"),
    *_words("link trade", "buy links, link exchange, cloaking, paid guest posts, essay service",
            "buy cheap backlinks, private blog network links"),
    *_words("pirated works", "crack download, torrent, license key generator, full movie download",
            "free keygen download, watch pirated movies"),
    *_words("fake goods", "replica handbags, imitation watches, counterfeit", "fake passports for sale, replica rolex"),
])

DEFAULT_PARKED = list(fixed.PARKED_MARKERS)
DEFAULT_PAID = list(fixed.PAID_LINK_MARKERS)
DEFAULT_DIRECTORY = list(fixed.LINK_DIRECTORY_MARKERS)

# A few sites of broad authority; give your own mapping of group to sites.
DEFAULT_AUTHORITY = {
    "encyclopedias": ["wikipedia.org", "britannica.com", "archive.org"],
    "research": ["arxiv.org", "nature.com", "springer.com"],
    "employers": ["glassdoor.com", "indeed.com"],
    "companies": ["crunchbase.com", "trustpilot.com"],
    "code": ["github.com", "stackoverflow.com"],
    "press": ["bbc.co.uk", "reuters.com"],
}


def authority_rows(groups: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Flatten group -> sites to ``(site, group)``; the first group listing a site keeps it."""
    seen: dict[str, str] = {}
    for group, sites in groups.items():
        for site in sites or []:
            seen.setdefault(str(site).strip().lower(), group)
    return list(seen.items())
