"""Operator 3: the main text of web pages, by two passes of rules over their blocks.

A page is cut into blocks at block-level tags. The first pass looks at each block alone:
blocks in menus, page headers, footers, sidebars, notices, adverts, forms and reader
comments (by tag, role, class or id) are bad. In ``article`` and ``main`` all others are good
but those that are mostly links and don't end like a sentence: list items and cells like that are
bad, the rest is open. Elsewhere blocks with many links are bad; long ones with many
stop words, or that end like a sentence in any language, are good; short or unclear ones are open.
In the second pass an open block gets the label of its nearest decided neighbours: if both
sides agree that label, else the nearer one, at equal distance the good one if the block has stop
words enough, ends like a sentence or is in an article, and else the bad one; headings go with
what follows them. Inside ``article`` or ``main`` the element's ends count as good neighbours,
elsewhere the page's ends count as bad.

A class or id counts by its whole names: each name between blanks whose words are all of the lists
(``cookie-banner``, ``post-comments``), so that ``share-price`` is no share button. Attributes are read as
HTML does, whatever their length: a quoted value ends at its quote.

The text is the good blocks in page order: character references decoded, white space turned
into one space, ends trimmed, one newline between blocks. ``br`` is white space.

Malformed pages: unclosed elements end with the element around them, a tag that never
closes ends the text, and an advert or notice that is never closed ends where an ``article`` or
``main`` begins. If nothing is good and text stands in forms, forms are read like other elements; if
still nothing is, blocks of more than ``SHORT`` characters are long enough.

Cases: null and empty html, and pages without a good block, have an empty text and 0
characters. Every row has its row in the result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textops import blocks as slices

#: Rules of the first pass: characters of a block, share of stop words, share of characters in links.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS, LINKS_MAIN = 70, 200, 0.30, 0.32, 0.2, 0.5
ENDS, QUOTES = frozenset(".!?…。！？؟।"), "\"'”’“»«)]」』 "
RESULT = "page_id long, url string, text string, n_chars long"

#: Fixed lists. Stop words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is it that for on with as was be by at this are from or an have not but which his they you her a he she we their "
    "der die das und ist ein eine zu mit auf für von nicht sich den dem des im auch es an wie als oder wir nach bei durch "
    "le la les et est un une des du que qui dans pour pas sur avec au ce il ne se en par plus sont "
    "el los las y que se del con por para una su al lo como más pero sus no si".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script|style|noscript|template|title|textarea|svg|iframe|object|select|button"
OUT_TAGS = frozenset("nav footer aside form dialog menu".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets footer comment comments commentlist reply replies disqus respond "
    "share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar copyright disclaimer skip".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: These count only outside an article, where they may hold its headline.
OUT_NAMES_OUTSIDE = frozenset("header masthead banner topbar".split())
#: Words of names that say where or how large, not what.
PLAIN_NAMES = frozenset(
    "site page main global top bottom left right upper lower inner outer primary secondary box bar block wrap wrapper container content area section slot unit item items list "
    "link links button buttons btn icon icons panel group row col column post posts article articles entry story form field input count title heading more js is has no by the and "
    "header banner masthead topbar desktop mobile sticky fixed small large".split())
COMMENT_NAMES = frozenset("comment comments commentlist commentform commenter disqus reply replies respond".split())
#: Elements that a next one of the same kind closes.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
LIST_TAGS = frozenset("li dt dd td th tr ul ol dl menu dir".split())

_VALUE = r"""\s*+=\s*+(?:"(?:[^"]*+)"|'(?:[^']*+)'|[^\s>"'][^\s>]*+)?+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW_TAGS})(?=[\s/>])[^>]*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[\s/]++|[^\s/>=]++(?:{_VALUE})?+|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I)
_ATTR = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
_ATTRS = frozenset("class id role style hidden aria-hidden".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int
    out: bool
    main: int  # number of the article or main element, 0 outside
    heading: bool = False
    listed: bool = False
    label: str = ""


def _unwanted(tag: str, attrs: str, in_main: bool) -> str:
    """Why an element and all in it is no main text; empty if it may be."""
    if tag in OUT_TAGS or (tag == "header" and not in_main):
        return "form" if tag == "form" else tag
    if not attrs:
        return ""
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in _ATTRS:
            continue
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return "hidden"
        if name == "role" and value.lower() in OUT_ROLES:
            return "role"
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            listed = OUT_NAMES if in_main or tag == "article" else OUT_NAMES | OUT_NAMES_OUTSIDE
            for whole in value.split():
                words = {w.lower() for w in _NAME.findall(whole)}
                hit = words & listed
                if not hit or not words <= listed | PLAIN_NAMES | COMMENT_NAMES:
                    continue
                if words & COMMENT_NAMES:
                    return "comment"
                if tag != "article":
                    return min(hit)
    return ""


def page_blocks(page: str, forms: bool = False) -> list[Block]:
    """The blocks of a page, without labels. forms: read forms like other elements."""
    found: list[Block] = []
    parts: list[str] = []
    linked = link = 0
    out_tag, out_depth, out_why = "", 0, ""
    mains: list[str] = []
    main = count = 0
    heading = listed = False

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, linked, bool(out_tag), main, heading, listed))
            parts.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if link:
                linked += len("".join(page[at : m.start()].split()))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                parts.append(" ")
            continue
        ending = bool(m["end"])
        if tag == "a":
            link = 0 if ending else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            close()
            heading = not ending and tag in HEADINGS
            listed = not ending and tag in LIST_TAGS
        if ending:
            if out_tag == tag:
                out_depth -= 1
                if not out_depth:
                    out_tag = ""
            if tag in ("article", "main") and tag in mains:
                while mains.pop() != tag:
                    pass
                if out_why != "comment":
                    out_tag = ""
                main = count if mains else 0
            elif tag == "body":
                out_tag = ""
            continue
        if tag in VOID_TAGS:
            continue
        if out_tag and (out_tag == "p" and block or out_tag == tag and tag in SELF_CLOSING):
            out_tag = ""
        why = _unwanted(tag, m["attrs"], bool(mains))
        if forms and why == "form":
            why = ""
        if tag in ("article", "main"):
            if out_tag and out_why != "comment":
                out_tag = ""
            if not out_tag and not why:
                if not mains:
                    count += 1
                main = count
                mains.append(tag)
        if out_tag:
            out_depth += out_tag == tag
        elif why and not (m["attrs"]).endswith("/"):
            if not block:
                close()
            out_tag, out_depth, out_why = tag, 1, why
    if at < len(page):
        parts.append(page[at:])
    close()
    return found


def _alone(b: Block, long: int = LONG) -> str:
    """good, bad, near (open, but with stop words) or open."""
    n = len(b.text)
    density = b.links / n
    sentence = b.text.rstrip(QUOTES)[-1:] in ENDS
    if b.out:
        return "bad"
    if b.main:
        return "good" if density <= LINKS_MAIN or sentence else "bad" if b.listed else "open"
    if density > LINKS or "©" in b.text:
        return "bad"
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if n < SHORT:
        return "bad" if b.links else "open"
    if stops >= STOP_HIGH:
        return "good" if n > long else "near"
    # the lists are short and of four languages: few stop words alone don't make a block bad
    if sentence:
        return "good" if n > long else "near"
    return "near" if stops >= STOP_LOW else "open"


def label(found: list[Block], long: int = LONG) -> list[Block]:
    """Both passes."""
    for b in found:
        b.label = _alone(b, long)
    n = len(found)
    decided = {"good", "bad"}
    # what is excluded from an article says nothing of its other blocks
    first = ["" if b.main and b.out else b.label for b in found]
    before: list[tuple[int, str]] = []
    last: dict[int, tuple[int, str]] = {}
    for i, b in enumerate(found):
        edge = (i - 1, "good" if b.main else "bad") if not i or found[i - 1].main != b.main else before[-1] if first[i - 1] not in decided else (i - 1, first[i - 1])
        before.append(edge)
    after: list[tuple[int, str]] = [(0, "")] * n
    for i in range(n - 1, -1, -1):
        b = found[i]
        if i == n - 1 or found[i + 1].main != b.main:
            after[i] = (i + 1, "good" if b.main else "bad")
        else:
            after[i] = after[i + 1] if first[i + 1] not in decided else (i + 1, first[i + 1])
    for i, b in enumerate(found):
        if b.label in decided:
            continue
        (p, left), (q, right) = before[i], after[i]
        if left == right:
            b.label = left
        elif b.heading:
            b.label = right
        elif i - p == q - i:
            b.label = "good" if b.main or first[i] == "near" or b.text[-1] in ".!?…" else "bad"
        else:
            b.label = left if i - p < q - i else right
    return found


def main_text(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not page:
        return ""
    found = label(page_blocks(page))
    if not any(b.label == "good" for b in found) and re.search(r"<form\b", page, re.I):
        found = label(page_blocks(page, forms=True))
    if not any(b.label == "good" for b in found):
        found = label(page_blocks(page), SHORT)
    return "\n".join(b.text for b in found if b.label == "good")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """RESULT for each row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, RESULT)
