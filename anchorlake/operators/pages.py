"""Page parsing and page features.

Only the HTML walk itself runs in Python, over Arrow batches. It emits the raw
pieces of a page (text, meta values, links with where they stand); every other decision
about them is a Spark expression in this module and in ``links.py``.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from html import unescape
from typing import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake import fixed_values as fixed
from anchorlake.config import AuditConfig
from anchorlake.functions import text as X
from anchorlake.functions import urls as U
from anchorlake.rules import DEFAULT_KEYWORDS, Keyword

LINK = ("array<struct<pos:int,href:string,absolute:string,text:string,rel:array<string>,"
        "placement:string,hidden:boolean>>")
PARSED = ("title string, description string, h1 string, generator string, lang string, "
          f"canonical string, meta_robots string, text string, page_error string, links {LINK}")

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)>",
    re.S)
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title"))
_UNSEEN = frozenset(("script", "style", "noscript", "template", "svg"))
_BLOCK = frozenset(
    "p div ul ol li table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 "
    "pre blockquote dl fieldset hr address".split())
# an opening tag ends an open element of these kinds
_ENDS = {"li": ("li",), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"),
         "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "body": ("head",)}
_HIDING = re.compile(fixed.HIDDEN_STYLE, re.I)
_BOILERPLATE = re.compile(fixed.BOILERPLATE_HINTS, re.I)
_CONTENT = re.compile(fixed.CONTENT_HINTS, re.I)
_SCOPE = frozenset(("ul", "ol", "table", "div", "article", "section", "body", "select", "dl", "nav"))


def _squeeze(pieces: list[str]) -> str:
    return _SPACE.sub(" ", " ".join(p for p in (x.strip() for x in pieces) if p))


def walk_page(html: str, url: str) -> dict:
    """One pass over a page's markup: texts, meta values, and links with where they stand."""
    page = dict(title=None, description="", h1=None, generator="", lang="", canonical="",
                meta_robots=[], text=[], links=[])
    stack: list[tuple[str, str, bool]] = []  # name; placement and hiddenness of what is inside
    opened: Counter[str] = Counter()  # open elements by name, so that hopeless searches are skipped
    open_link: dict | None = None
    heading: list[str] | None = None
    hidden = 0
    at, size = 0, len(html)
    stop_at = html.rfind(">") + 1  # no markup ends after this; searching on would be quadratic

    def seen(raw: str) -> None:
        if hidden or not raw.strip():
            return
        words = unescape(raw)
        page["text"].append(words)
        if open_link is not None:
            open_link["text"].append(words)
        if heading is not None:
            heading.append(words)

    def close(count: int) -> None:
        nonlocal hidden, open_link, heading
        for _ in range(count):
            name = stack.pop()[0]
            opened[name] -= 1
            hidden -= name in _UNSEEN
            if name == "a":
                open_link = None
            elif name == "h1" and heading is not None:
                page["h1"], heading = heading, None

    def end_open(kinds: tuple[str, ...], scope: frozenset) -> None:
        if not any(opened[kind] for kind in kinds):
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in kinds:
                close(len(stack) - depth)
                return
            if stack[depth][0] in scope:
                return

    while at < size:
        mark = _MARKUP.search(html, at, stop_at) if at < stop_at else None
        if mark is None:
            seen(html[at:].split("<!--", 1)[0])
            break
        seen(html[at:mark.start()])
        at = mark.end()
        if mark["name"] is None:
            at = size if mark[0].startswith("<!--") and not mark[0].endswith("-->") else at
            continue
        name = mark["name"].lower()
        if mark["end"]:
            if opened[name]:
                depth = next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name)
                close(len(stack) - depth)
            continue
        attrs: dict[str, str] = {}
        for key, quoted, single, bare in _ATTR.findall(mark["attrs"]):
            attrs.setdefault(key.lower(), unescape(quoted or single or bare))
        if name == "html":
            page["lang"] = page["lang"] or attrs.get("lang", "")
        elif name == "meta":
            label = (attrs.get("name") or attrs.get("property") or "").lower()
            content = attrs.get("content", "")
            if label in ("robots", "googlebot"):
                page["meta_robots"].append(content.lower())
            elif attrs.get("name", "").lower() in ("description", "generator"):
                label = attrs["name"].lower()
                page[label] = page[label] or _SPACE.sub(" ", content).strip()
        elif name == "link" and "canonical" in attrs.get("rel", "").lower():
            href = attrs.get("href", "")
            page["canonical"] = page["canonical"] or (urljoin(url, href) if href else "")
        if name in _VOID:
            continue
        if name in _BLOCK:
            end_open(("p",), _SCOPE)
        if name in _ENDS:
            end_open(_ENDS[name], _SCOPE if name not in ("body",) else frozenset())
        if name == "a":
            end_open(("a",), frozenset())
            href = attrs.get("href", "").strip()
            _, place, unseen = stack[-1] if stack else ("", "unknown", False)
            link = dict(text=[], href=href, rel=attrs.get("rel", "").lower().split(),
                        placement=place, hidden=unseen)
            if "href" in attrs and not hidden:
                page["links"].append(link)
                open_link = link
        elif name == "h1" and page["h1"] is None and heading is None:
            heading = []
        _, place, unseen = stack[-1] if stack else ("", "unknown", False)
        stack.append((name, _placement(name, attrs, place), unseen or bool(_HIDING.search(attrs.get("style", "")))))
        opened[name] += 1
        hidden += name in _UNSEEN
        if name in _RAW:
            stop = re.compile("</" + name, re.I).search(html, at)
            raw, at = html[at:stop.start() if stop else size], stop.start() if stop else size
            if name == "title" and page["title"] is None:
                page["title"] = _SPACE.sub(" ", unescape(raw)).strip()
            seen(raw)
    close(len(stack))
    return page


def _placement(name: str, attrs: dict, around: str) -> str:
    """in-content, boilerplate or unknown for what stands in an element: the nearest
    enclosing element that decides it, up to the body."""
    ident = " ".join((attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""))).strip()
    if name in fixed.BOILERPLATE_TAGS or ident and _BOILERPLATE.search(ident):
        return "boilerplate"
    if ident and _CONTENT.search(ident) or name in fixed.CONTENT_TAGS:
        return "in-content"
    return "unknown" if name == "body" else around


def _links(found: list[dict], url: str) -> list[dict]:
    kept = []
    for link in found:
        href = link["href"]
        if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
            continue
        try:
            absolute = urljoin(url, href)
        except ValueError:
            continue
        kept.append(dict(link, pos=len(kept), absolute=absolute, text=_squeeze(link["text"])))
    return kept


def parse_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Replace the HTML column by the parsed pieces of each page."""
    kept = [c for c in pages.columns if c != html_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in pages.schema.fields if f.name != html_col)
    names = [part.strip().split()[0] for part in re.sub(r"<.*>", "", PARSED).split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, html in zip(batch[url_col], batch[html_col]):
                page = walk_page(html or "", url or "")
                rows.append((
                    page["title"] or "", page["description"], _squeeze(page["h1"] or []), page["generator"],
                    page["lang"], page["canonical"], ", ".join(v for v in page["meta_robots"] if v),
                    _squeeze(page["text"]), "" if html and html.strip() else "no content",
                    _links(page["links"], url or "")))
            parsed = pd.DataFrame(rows, columns=names, index=batch.index)
            yield pd.concat([batch[kept], parsed], axis=1)

    return pages.mapInPandas(parse, f"{fields}, {PARSED}")


def readable_pages(pages: DataFrame, content_type_col: str = "content_type") -> DataFrame:
    """Leave out content that is not html, xml or text; an unknown type is read."""
    kind = F.lower(F.coalesce(F.col(content_type_col), F.lit("")))
    return pages.where((kind == "") | kind.rlike("html|xml|text"))


# --- fixed values: byte-order marks, and names that browsers read as another charset
_MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"),
          (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
_READ_AS = {"iso8859-1": "cp1252", "ascii": "cp1252", "gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932",
            "euc_kr": "cp949", "iso8859-9": "cp1254", "tis-620": "cp874"}
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:+-]+)", re.I)
_DECLARED = re.compile(rb"<meta\s[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:+-]+)|^\s*<\?xml\s[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9_.:+-]+)",
                       re.I)
DECLARED_WITHIN = 1024  # where the HTML standard looks for a declaration


def _known(name: str) -> str | None:
    """The codec browsers use for a charset name, if there is one for text."""
    try:
        found = codecs.lookup(name)
    except (LookupError, ValueError):
        return None
    return _READ_AS.get(found.name, found.name) if found._is_text_encoding else None


def charset_of(body: bytes, content_type: str) -> tuple[str, int]:
    """The charset of a page and the size of its byte-order mark.

    In this order: the mark, the header, a declaration in the page, UTF-8 if the bytes are
    that, else Windows-1252.
    """
    for mark, name in _MARKS:
        if body.startswith(mark):
            return name, len(mark)
    named = _CHARSET.search(content_type)
    if named and _known(named[1]):
        return _known(named[1]), 0
    for found in _DECLARED.finditer(body[:DECLARED_WITHIN]):
        name = _known((found[1] or found[2]).decode("ascii"))
        if name:  # a page that can be read as ASCII is not in UTF-16, whatever it says
            return ("utf-8" if name.startswith(("utf-16", "utf-32")) else name), 0
    try:
        body.decode("utf-8")
        return "utf-8", 0
    except UnicodeDecodeError:
        return "cp1252", 0


def decode_body(body: bytes, content_type: str) -> tuple[str, str, int]:
    """Text, charset, and how many runs of bytes could not be decoded and were left out."""
    name, skip = charset_of(body, content_type)
    try:
        return body[skip:].decode(name), name, 0
    except UnicodeDecodeError:
        lost = 0

        def leave_out(error: UnicodeError):
            nonlocal lost
            lost += 1
            return "", error.end

        codecs.register_error("anchorlake.leave_out", leave_out)
        return body[skip:].decode(name, "anchorlake.leave_out"), name, lost


def decoded_pages(pages: DataFrame, body_col: str = "body", content_type_col: str = "content_type") -> DataFrame:
    """Replace the bytes of each page by html, charset and undecodable; a page without bytes is empty."""
    kept = [f for f in pages.schema.fields if f.name != body_col]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [decode_body(bytes(b or b""), t or "") for b, t in zip(batch[body_col], batch[content_type_col])]
            text = pd.DataFrame(read, columns=["html", "charset", "undecodable"], index=batch.index)
            yield pd.concat([batch[[f.name for f in kept]], text], axis=1)

    return pages.mapInPandas(decode, f"{fields}html string, charset string, undecodable int")


def hidden_text(html: Column) -> Column:
    """Does the markup hide anything with inline styles?"""
    return html.rlike("(?i)" + fixed.HIDDEN_STYLE)


def with_indexability(df: DataFrame) -> DataFrame:
    """noindex / nofollow from meta robots, and a canonical pointing elsewhere."""
    robots = F.coalesce(F.col("meta_robots"), F.lit(""))
    return df.withColumns({
        "is_noindex": robots.contains("noindex") | robots.contains("none"),
        "is_nofollow_page": robots.contains("nofollow") | robots.contains("none"),
        "canonical_mismatch": (F.col("canonical") != "")
        & ~U.same_page(F.col("canonical"), F.col("url"))})


def page_features(
    parsed: DataFrame, cfg: AuditConfig, rules: list[Keyword] = DEFAULT_KEYWORDS
) -> DataFrame:
    """All per-page columns of an audit row, from parsed pages.

    Needs ``url`` and, where present, an ``input_target`` column naming the site
    the page should link to; ``cfg.target_site`` otherwise.
    """
    from anchorlake.operators.links import with_link_features
    from anchorlake.operators.relevance import with_relevance
    from anchorlake.operators.textscan import scan_markers, scan_text

    out = with_link_features(with_indexability(parsed), cfg).withColumns({
        "page_title": F.col("title"), "meta_description": F.col("description"),
        "word_count": X.word_count(F.col("text")),
        "lang_mismatch": X.language_mismatch(F.col("lang"), list(cfg.expected_languages))})
    out = scan_text(out, rules, "text", cfg.content_total_hits, cfg.content_category_hits)
    out = scan_markers(out, "text")
    out = with_relevance(
        out, list(cfg.relevance_keywords),
        {k: list(v) for k, v in cfg.relevance_synonyms.items()},
        {"title": "page_title", "h1": "h1", "anchor": "anchor_texts",
         "meta": "meta_description", "body": "text"})
    return out.withColumn("page_parsed", F.col("page_error") == "").drop("text", "links", "title", "description")


# Page columns a home page contributes to the rows of its site.
HOME_FIELDS = {
    "home_url": "url", "home_status_code": "status_code", "home_status_verdict": "status_verdict",
    "home_title": "page_title", "home_word_count": "word_count",
    "home_outbound_links": "outbound_links", "home_lang": "lang", "home_generator": "generator",
    "home_is_noindex": "is_noindex", "home_content_spam": "content_spam",
    "home_content_spam_total": "content_spam_total",
    "home_content_spam_categories": "content_spam_categories",
    "home_parked_markers": "parked_markers", "home_paid_link_markers": "paid_link_markers",
    "home_link_directory_markers": "link_directory_markers",
}


def with_homepage(
    rows: DataFrame, homes: DataFrame, key_source: DataFrame | None = None
) -> DataFrame:
    """Attach each row's site home page, looked up by origin.

    A row that is itself a home page describes its own home. ``homes`` holds home
    pages only (see ``functions.urls.is_homepage``); one is kept per origin.
    """
    from anchorlake.operators.keyed import first_per_key, lookup

    available = {k: v for k, v in HOME_FIELDS.items() if v in homes.columns}
    per_origin = first_per_key(
        homes.select(U.origin_of(F.col("url")).alias("origin"),
                     *[F.col(v).alias(k) for k, v in available.items()]),
        ["origin"], [F.col("home_url")])
    page = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")) \
        if "final_url" in rows.columns else F.col("url")
    own = rows.withColumn("origin", U.origin_of(page)).withColumn(
        "home_same_as_page", U.is_homepage(page))
    joined = lookup(own, per_origin, "origin", key_source=key_source)
    joined = joined.withColumns({
        home: F.when(F.col("home_same_as_page"), F.col(source)).otherwise(F.col(home))
        for home, source in available.items() if source in rows.columns})
    return joined.withColumn(
        "home_checked", F.col("home_same_as_page") | F.col("home_url").isNotNull())
