"""URL and domain functions.

Public suffixes come from an explicit table: what national registries offer, and hosting
companies whose customers are sites of their own. ``Suffixes.from_list`` takes a complete
public suffix list instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorlake import fixed_values as fixed


def national_suffixes() -> list[str]:
    return [f"{label}.{country}" for country, labels in fixed.NATIONAL_SUFFIXES.items() for label in labels.split()]


@dataclass(frozen=True)
class Suffixes:
    """Suffixes of two or more labels under which anyone may hold a site.

    A last label alone always counts as a suffix, so single labels need no entry.
    """

    listed: frozenset[str]
    wildcards: frozenset[str] = frozenset()   # every label under one of these makes a suffix,
    exceptions: frozenset[str] = frozenset()  # but for these, which are sites

    @classmethod
    def from_list(cls, lines: Iterable[str]) -> Suffixes:
        """From the lines of a public suffix list, with its ``*.`` and ``!`` rules; comments and
        blanks are skipped."""
        rules = [line.strip().lower().split()[0].strip(".") for line in lines
                 if line.strip() and not line.strip().startswith("//")]
        return cls(frozenset(r for r in rules if "." in r and r[0] not in "*!"),
                   frozenset(r[2:] for r in rules if r.startswith("*.") and r[2:]),
                   frozenset(r[1:] for r in rules if r[0] == "!" and "." in r))

    def pattern(self) -> str:
        """Regex over a host read backwards: group 1 the registered domain, group 2 the suffix.

        The suffixes form a tree of labels from the last one on, so a host is compared with
        the suffixes of its own country only, however many are listed. An exception ends the
        suffix before its own label, a label of its own goes before the wildcard, and the longest
        suffix that leaves one more label wins; addresses match nothing.
        """
        return _backwards(self)


@lru_cache(maxsize=8)
def _backwards(suffixes: Suffixes) -> str:
    tree: dict = {}

    def mark(name: str, sign: str) -> None:
        below = tree
        for label in reversed(name.split(".")):
            below = below.setdefault(label, {})
        below[sign] = {}

    for name in suffixes.listed:
        mark(name, "")
    for name in suffixes.wildcards:
        mark(name, "*")
    for name in suffixes.exceptions:
        mark(name, "!")

    def alternatives(below: dict) -> str:
        options = [node(label, rest) for label, rest in sorted(below.items()) if label not in ("", "*", "!") and (set(rest) - {"!"})]
        return "(?:" + "|".join(options + ["[^.]+"] * ("*" in below)) + ")"

    def node(label: str, rest: dict) -> str:
        kept = sorted(name[::-1] for name, below in rest.items() if name and "!" in below)
        more = [rf"(?=\.(?:{'|'.join(map(re.escape, kept))})(?:\.|$))"] if kept else []
        if any(name == "*" or name and set(below) - {"!"} for name, below in rest.items() if name != "!"):
            more.append(r"\." + alternatives(rest))
        inner = "(?:" + "|".join(more) + ")" + ("?" if "" in rest else "") if more else ""
        return re.escape(label[::-1]) + inner

    # a listed suffix is followed by one more label, or the last label alone is the suffix
    some = alternatives(tree) + r"(?=\.[^.])|" if tree else ""
    return rf"^(?![\d.]+$)(({some}[^.]+)\.[^.]+)(?:\.(.*))?$"


DEFAULT_SUFFIXES = Suffixes(frozenset([*national_suffixes(), *fixed.HOSTED_SUFFIXES]))


def normalize_url(url: Column) -> Column:
    """Trim, drop quotes, and add ``https://`` where no http(s) scheme is given."""
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r'^"+|"+$', "")
    bare = F.regexp_replace(bare, r"^'+|'+$", "")
    return (
        F.when(bare == "", "")
        .when(bare.startswith("http://") | bare.startswith("https://"), bare)
        .otherwise(F.concat(F.lit("https://"), F.regexp_replace(bare, "^/+", "")))
    )


_HOST = (r"(?s)^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*://|(?!.*://))(?:[^/?#]*@)?\[?\.*"
         r"((?<=\[)[^\]/?#]*|[^:/?#\[\]]*?)\.*(?=[\]:/?#]|\s*$)")


def _absolute(url: Column, scheme: str) -> Column:
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    return F.when(trimmed.contains("://"), trimmed).otherwise(F.concat(F.lit(scheme), trimmed))


def host_of(url: Column) -> Column:
    """Lower-case host name; the scheme is optional, port and user info are dropped."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def origin_of(url: Column) -> Column:
    """``scheme://host[:port]``, or empty."""
    return F.regexp_extract(
        _absolute(url, "https://"), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(
        _absolute(url, "https://"), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def is_homepage(url: Column) -> Column:
    """Nothing but slashes after the host, and no query."""
    return _absolute(url, "https://").rlike(
        r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/*(?:\?(?:#.*)?)?(?:#.*)?$")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def same_page(a: Column, b: Column) -> Column:
    """Do two URLs name the same host and path, ignoring a trailing slash?"""
    def key(url: Column) -> Column:
        netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
        return F.concat(netloc, F.lit(" "), F.regexp_replace(path_of(url), "/+$", ""))
    return key(a) == key(b)


def subnet24(ip: Column) -> Column:
    """The /24 block of an IPv4 address, or empty."""
    return (
        F.when(ip.rlike(r"^[^.:]*\.[^.:]*\.[^.:]*\.[^.:]*$"),
               F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")))
        .otherwise("")
    )


def _part(host: Column, suffixes: Suffixes, group: int) -> Column:
    """A group of the suffix pattern, read forwards; a leading ``www`` is no part of a site."""
    bare = F.regexp_replace(host, r"^www\.(?=[^.]+\.)", "")
    return F.reverse(F.regexp_extract(F.reverse(bare), suffixes.pattern(), group))


def registered_of_host(host: Column, suffixes: Suffixes = DEFAULT_SUFFIXES) -> Column:
    """The domain one would buy, e.g. ``uncp.edu.pe``; other hosts as they are."""
    return F.coalesce(F.nullif(_part(host, suffixes, 1), F.lit("")), host)


def suffix_of_host(host: Column, suffixes: Suffixes = DEFAULT_SUFFIXES) -> Column:
    return _part(host, suffixes, 2)


def subdomain_of_host(host: Column, suffixes: Suffixes = DEFAULT_SUFFIXES) -> Column:
    return _part(host, suffixes, 3)


def registered_domain(url: Column, suffixes: Suffixes = DEFAULT_SUFFIXES) -> Column:
    return registered_of_host(host_of(url), suffixes)


def split_host(url: Column, suffixes: Suffixes = DEFAULT_SUFFIXES) -> Column:
    """Struct of subdomain, domain and public suffix for a URL or bare host."""
    host = host_of(url)
    registered, suffix = registered_of_host(host, suffixes), suffix_of_host(host, suffixes)
    return F.struct(
        subdomain_of_host(host, suffixes).alias("subdomain"),
        F.when(suffix == "", registered).otherwise(
            F.left(registered, F.length(registered) - F.length(suffix) - 1)).alias("domain"),
        suffix.alias("suffix"))


def is_real_subdomain(subdomain: Column) -> Column:
    bare = F.regexp_replace(subdomain, "www", "")
    return F.regexp_replace(bare, r"^\.+|\.+$", "") != ""


def is_free_subdomain(host: Column) -> Column:
    """Does the host sit below a free-subdomain or dynamic-DNS provider?"""
    tails = [F.substring_index(host, ".", -n) for n in (2, 3)]
    listed = fixed.FREE_SUBDOMAIN_HOSTS
    by_size = {n: [h for h in listed if h.count(".") == n - 1] for n in (2, 3)}
    hit = F.lit(False)
    for n, tail in zip((2, 3), tails):
        if by_size[n]:
            hit = hit | (tail.isin(by_size[n]) & (F.length(host) > F.length(tail)))
    return hit
