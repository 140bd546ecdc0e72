"""Personal data by anchor expansion.

One Aho-Corasick automaton walks each whole text once and stops at anchors: at-signs, plus
signs, digits, URI schemes and words that announce an identifier. From an anchor a small
parser for that kind expands to the boundaries of the span, to the left and to the right,
and validates it (labels, ranges, Luhn and mod-97 digits). Every parser goes on behind what
it has read, so a text is read a fixed number of times whatever it holds.

Base kinds are leftmost, non-overlapping matches per kind:

* email   ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip      four dotted numbers, each at most 255
* card    12 to 19 digits with single spaces or hyphens between, right by Luhn
* phone   ``+``, 9 to 15 digits with spaces, brackets, dots and hyphens between

Kinds that the anchors add:

* address ``mailto:``, ``sip:``, ``sips:`` and ``xmpp:`` with user@host, ``tel:`` with 5 to 15 digits, and
  ``scheme://`` whose authority names a user or is a numeric host; up to the end of the authority
* account an identifier behind a cue (account, acct, iban, ssn, passport, routing): IBANs right by
  mod 97, social security numbers of a valid form, or 6 to 18 digits behind at most two letters
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.llm.common import type_of
from anchorlake.llm.registry import query
from anchorlake.llm.textblocks import blocks

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
SCHEMES = ("mailto:", "sip:", "sips:", "xmpp:", "tel:")
CUES = ("account", "acct", "iban", "ssn", "passport", "routing")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USER_HOST = re.compile(r"[^\s<>\"@:/?#]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
_TEL = re.compile(r"\+?[0-9](?:[().-]*+[0-9])*+")
_AUTHORITY = re.compile(r"(?:(?P<user>[^\s/?#@\"<>]++)@)?(?P<host>\[[0-9A-Fa-f:.]++\]|[A-Za-z0-9.-]++)(?::[0-9]++)?")
_TO_IDENTIFIER = re.compile(r"s?(?:[ \t]*+(?:[Nn]umber|NUMBER|[Nn]um|[Nn]o|NO|[Nn]r|ID|[Ii]d|#)(?![A-Za-z])\.?)?"
                            r"[ \t]*+[:=#]?[ \t]*+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-?(?!00)[0-9]{2}-?(?!0000)[0-9]{4}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[A-Z]{0,2}(?P<digits>[0-9](?:[ -]?[0-9])*+)(?![A-Za-z0-9])")


@lru_cache(maxsize=1)
def anchors():
    """The automaton; words are found in lower case, in upper case and with a capital."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for sign in ["@", "+", "://"]:
        machine.add_word(sign, (sign, 0))
    for digit in "0123456789":
        machine.add_word(digit, ("digit", 0))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                machine.add_word(form, (kind, len(form)))
    machine.make_automaton()
    return machine


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def passes_iban(compact: str) -> bool:
    turned = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    rest = part.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def _alnum(char: str) -> bool:
    return char.isascii() and char.isalnum()


class Finder:
    """The spans of one text; ``done`` is how far each kind has been read."""

    def __init__(self, text: str):
        self.text, self.spans = text, []
        self.done = dict.fromkeys(KINDS, 0)

    def add(self, kind: str, start: int, end: int) -> None:
        self.spans.append((start, KINDS.index(kind), end))

    def run_left(self, at: int, allowed: frozenset, floor: int) -> int:
        while at > floor and self.text[at - 1] in allowed:
            at -= 1
        return at

    def email(self, at: int) -> None:
        start = self.run_left(at, _LOCAL, self.done["email"])
        domain = _DOMAIN.match(self.text, at + 1) if start < at else None
        if domain:
            self.done["email"] = domain.end()
            self.add("email", start, domain.end())

    def digit(self, at: int) -> None:
        done = self.done
        if at >= done["ip"]:
            chain = _DOTTED.match(self.text, at)
            done["ip"] = chain.end()
            parts = list(_NUMBER.finditer(self.text, at, chain.end()))
            for k in range(0, len(parts) - 3, 4):  # each match of the base pattern takes four numbers
                if all(_small(p.group()) for p in parts[k:k + 4]):
                    self.add("ip", parts[k].start(), parts[k + 3].end())
        if at >= done["card"]:
            chain = _DIGITS.match(self.text, at)
            done["card"] = chain.end()
            digits = _digits(chain.group())
            if 12 <= len(digits) <= 19 and passes_luhn(digits):
                self.add("card", at, chain.end())

    def phone(self, at: int) -> None:
        found = _PHONE.match(self.text, at)
        if found and 9 <= len(_digits(found.group())) <= 15:
            self.add("phone", at, found.end())

    def scheme(self, at: int, size: int) -> None:
        """A scheme without slashes, behind which ``at`` lies."""
        start = at - size
        if start < self.done["address"] or start and self.text[start - 1] in _SCHEME:
            return
        if self.text[start:at].lower() == "tel:":
            found = _TEL.match(self.text, at)
            valid = found and 5 <= len(_digits(found.group())) <= 15
        else:
            valid = found = _USER_HOST.match(self.text, at)
        if valid:
            self.done["address"] = found.end()
            self.add("address", start, found.end())

    def authority(self, at: int) -> None:
        """What stands behind ``://``, which ends at ``at``."""
        start = self.run_left(at - 3, _SCHEME, self.done["address"])
        while start < at - 3 and not self.text[start].isalpha():
            start += 1
        found = _AUTHORITY.match(self.text, at) if start < at - 3 else None
        if not found:
            return
        parts = found["host"].split(".")
        numeric = found["host"][0] == "[" or (
            len(parts) == 4 and all(p.isdigit() and p.isascii() and _small(p) for p in parts))
        if found["user"] or numeric:
            self.done["address"] = found.end()
            self.add("address", start, found.end())

    def cue(self, at: int, size: int) -> None:
        """An announcing word that ends at ``at``."""
        start = at - size
        if start < self.done["account"] or start and self.text[start - 1].isalpha():
            return
        begin = _TO_IDENTIFIER.match(self.text, at).end()
        end = self._iban(begin)
        if end is None:
            found = _SSN.match(self.text, begin)
            if not found and self.text[start:at].lower() != "ssn":
                found = _ACCOUNT.match(self.text, begin)
                found = found if found and 6 <= len(_digits(found["digits"])) <= 18 else None
            end = found.end() if found else None
        if end is not None:
            self.done["account"] = end
            self.add("account", begin, end)

    def _iban(self, begin: int) -> int | None:
        """The end of the longest valid IBAN that ends where a word ends."""
        found = _IBAN.match(self.text, begin)
        if not found:
            return None
        for end in range(found.end(), begin + 14, -1):
            compact = self.text[begin:end].replace(" ", "")
            if len(compact) < 15:
                return None
            if self.text[end - 1] != " " and not _alnum(self.text[end:end + 1] or " ") and passes_iban(compact):
                return end
        return None


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every span, by start, then kind; in code points."""
    finder = Finder(text)
    for last, (anchor, size) in anchors().iter(text):
        if anchor == "digit":
            if last >= finder.done["ip"] or last >= finder.done["card"]:
                finder.digit(last)
        elif anchor == "@":
            finder.email(last)
        elif anchor == "+":
            finder.phone(last)
        elif anchor == "://":
            finder.authority(last + 1)
        elif anchor == "scheme":
            finder.scheme(last + 1, size)
        else:
            finder.cue(last + 1, size)
    return sorted(finder.spans)


def without_spans(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _texts(batches, column: str):
    for block, data, offsets in blocks(batches, column):
        raw = data.tobytes()
        yield block, [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and ``spans``, an array of (kind, start, end) by start, then kind.

    start and end (exclusive) count code points of the whole text. Spans of one kind never
    overlap, those of different kinds may. Null and empty texts have none. Repeated rows
    each get their row, other columns are ignored, and an empty table gives an empty one.
    """
    def find(batches):
        for block, texts in _texts(batches, "text"):
            found = [[(KINDS[k], a, b) for a, k, b in spans_of(t)] for t in texts]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        find, f"doc_id {type_of(docs, 'doc_id')}, spans array<struct<kind: string, start: long, end: long>>")


def without_personal_data(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, every span in ``text`` replaced by its kind.

    A null text stays null; the order of rows and columns is kept, and no row goes.
    """
    def replace(batches):
        for batch in batches:
            for block, texts in _texts(iter([batch]), "text"):
                clean = pa.array([without_spans(t, spans_of(t)) for t in texts], pa.string())
                old = block.column("text")
                if old.null_count:
                    clean = pa.compute.if_else(old.is_valid(), clean, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [clean if c == "text" else block.column(c) for c in block.schema.names], block.schema.names)

    import pyarrow.compute  # noqa: F401  so that the task finds pa.compute

    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(replace, typed.schema)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op12_personal_data")
def op12(t):
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return find_personal_data(t.documents).select(
        "doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))
