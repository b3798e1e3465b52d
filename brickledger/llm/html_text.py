"""Main text of HTML pages by two-pass block rules: stop words, length and links decide, short blocks inherit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickledger.llm.shared import with_row

#: Function words of English, German, French and Spanish; an argument of extract_text for other languages.
STOP_WORDS = frozenset(
    """
    the of and to a in is it that was for on are as with his they be at this have from or had by but not what all were
    der die das und ist ein eine in den von zu mit sich des auf für nicht als auch es an er dem im aus bei nach wie
    le la les de des du et est un une dans pour que qui sur pas avec ce il elle au aux en par plus ne se sont son
    el los las y es una del que se por con para no su lo como más pero sus al o este si porque entre cuando muy sin
    """.split()
)
#: Fewer characters do not decide a block.
SHORT = 70
#: Least share of stop words of a decided block, in the article element and elsewhere.
STOPS_INSIDE, STOPS_OUTSIDE = 0.1, 0.2
#: Largest share of characters in links, in the article element and elsewhere.
LINKS_INSIDE, LINKS_OUTSIDE = 0.5, 0.2

_SKIPPED = frozenset(
    "script style noscript template textarea select button svg math iframe object canvas audio video title".split()
)
_BOILERPLATE = frozenset("nav footer aside form header menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that name something other than the article.
_HINTS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsbygoogle adsense banner sponsor sponsored promo promoted promotion
    sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices
    popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended teaser widget
    comment comments disqus replies reply respond toolbar pager pagination copyright disclaimer
    """.split()
)
_NOT_NAMED = frozenset("has with no without is".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXTUAL = _HEADINGS | frozenset("p blockquote pre".split())
_CONTAINERS = _BOILERPLATE | frozenset(
    "body div section article main ul ol dl table tbody thead tfoot tr figure details fieldset center hgroup address".split()
)
_BLOCKS = _CONTAINERS | _TEXTUAL | frozenset("html head li dt dd td th caption figcaption summary legend hr option".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>""")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A run of text between block tags; `boilerplate`: in an element that is none of the article."""

    text: str
    tag: str
    link_chars: int
    boilerplate: bool
    inside: int  # number of the article or main element it stands in, 0 outside


def _markup(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text as ("", "", text), tags as ("<" or "</", name, attributes).

    Comments, declarations and the contents of skipped elements are passed over; what is not closed ends with the page.
    """
    at, end, quoted = 0, len(html), True
    missing: set[str] = set()
    while at < end:
        start = html.find("<", at)
        if start < 0:
            yield "", "", html[at:]
            return
        if start > at:
            yield "", "", html[at:start]
        if html.startswith("<!--", start):
            close = html.find("-->", start + 4)
            at = end if close < 0 else close + 3
            continue
        following = html[start + 1 : start + 2]
        if following in ("!", "?"):
            close = html.find(">", start)
            at = end if close < 0 else close + 1
            continue
        if not (following.isascii() and (following.isalpha() or html[start + 1 : start + 3].lstrip("/").isalpha() and following == "/")):
            yield "", "", "<"
            at = start + 1
            continue
        found = _TAG.match(html, start) if quoted else None
        if not found:  # a quote without its end: from here on quotes are plain characters, so the scan stays linear
            quoted = False
            found = _BARE_TAG.match(html, start)
            if not found:
                return
        at, (slash, name, rest) = found.end(), found.groups()
        name = name.lower()
        if not slash and name in _SKIPPED and not (name in ("svg", "math") and rest.rstrip().endswith("/")):
            close = None if name in missing else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            if close:
                at = close.end()
            else:  # never closed: only the tag goes
                missing.add(name)
            continue
        yield "<" + slash, name, rest


def _named_boilerplate(name: str, rest: str) -> bool:
    if not rest or name in ("html", "body"):
        return False
    for attribute, *values in _ATTRIBUTE.findall(rest):
        attribute, value = attribute.lower(), "".join(values)
        if attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true":
            return True
        if attribute == "role" and value.strip().lower() in _ROLES:
            return True
        if attribute == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if attribute in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in _NAME.findall(one)}
                if words & _HINTS and not words & _NOT_NAMED and not (name == "main" or name == "article" and not words & {"comment", "comments", "reply", "related", "teaser", "ad", "sponsored", "promo"}):
                    return True
    return False


def blocks(html: str) -> list[Block]:
    """The blocks of a page in their order, white space made single, blocks without text left out."""
    found: list[Block] = []
    open_: list[tuple[str, bool, int]] = []  # tag, boilerplate, number of the article element
    parts: list[tuple[str, bool]] = []
    articles = links = 0
    block_tag, block_state = "", (False, 0)

    def state() -> tuple[bool, int]:
        return open_[-1][1:] if open_ else (False, 0)

    def flush(tag: str) -> None:
        nonlocal block_tag, block_state
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len("".join(t.split())) for t, in_link in parts if in_link)
                found.append(Block(text, block_tag, linked, *block_state))
            parts.clear()
        block_tag, block_state = tag, state()

    for kind, name, rest in _markup(html):
        if not kind:
            parts.append((unescape(rest), links > 0))
        elif name == "br":
            parts.append((" ", False))
        elif name == "a":
            links = max(0, links + 1) if kind == "<" else max(0, links - 1)
            links = min(links, 1)  # links do not nest
        elif kind == "<":
            named = _named_boilerplate(name, rest)
            if name in _BLOCKS:
                # A paragraph ends at the next block, an item at the next item.
                while open_ and (open_[-1][0] == "p" or open_[-1][0] == name == "li"):
                    open_.pop()
            if name in _BLOCKS or named:
                bad, inside = state()
                if name in ("article", "main"):
                    around = {tag for tag, _, _ in open_}
                    if name == "main" or bad and around & {"form", "nav", "header"} and not around & {"aside", "footer"}:
                        bad = False
                    bad = bad or named
                    if not bad:
                        articles += not inside
                        inside = inside or articles
                    links = 0
                else:
                    bad = bad or named or name in _BOILERPLATE and not (name == "header" and inside)
                if name not in _VOID and (name in _CONTAINERS or named or name == "li"):
                    flush("")  # what came before belongs to the outer element
                    open_.append((name, bad, inside))
                flush(name)
        else:
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if at is not None:
                flush("")
                del open_[at:]
            if at is not None or name in _BLOCKS:
                flush(open_[-1][0] if open_ else "")
    flush("")
    return found


def main_text(html: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The article's blocks, joined by line feeds; see extract_text."""
    page = blocks(html or "")
    if not page:
        return ""
    inside = any(b.inside and not b.boilerplate for b in page)
    shares = []
    for b in page:
        words = _WORD.findall(b.text.lower()) if len(b.text) >= SHORT and not b.boilerplate else []
        shares.append(sum(w in stop_words for w in words) / len(words) if words else 0.0)
    # A page without stop words is in no known language: there length and links decide alone.
    known = any(s >= STOPS_INSIDE for s in shares)
    labels: list[bool | None] = []
    for b, share in zip(page, shares, strict=True):
        linked = b.link_chars / max(1, len(b.text.replace(" ", "")))
        if b.boilerplate or inside and not b.inside:
            labels.append(False)
        elif linked > (LINKS_INSIDE if b.inside else LINKS_OUTSIDE) and not (b.inside and b.tag in _HEADINGS):
            labels.append(False)
        elif len(b.text) < SHORT:
            labels.append(None)
        elif share >= (STOPS_INSIDE if b.inside else STOPS_OUTSIDE) or not known:
            labels.append(True)
        else:
            labels.append(None if b.inside or share >= STOPS_OUTSIDE / 2 else False)
    if True not in labels and not inside:  # nothing but short blocks
        return "\n".join(b.text for b, label in zip(page, labels, strict=True) if label is None)
    before, after = _nearest(page, labels), _nearest(page[::-1], labels[::-1])[::-1]
    kept = []
    for i, (b, label) in enumerate(zip(page, labels, strict=True)):
        if label is None:
            (left, far_left), (right, far_right) = before[i], after[i]
            if left == right:
                label = left
            elif b.tag in _HEADINGS and not b.inside:  # a heading goes with what it stands above
                label = right
            elif far_left == far_right:
                label = b.inside > 0 or b.tag in _TEXTUAL
            else:
                label = left if far_left < far_right else right
        if label:
            kept.append(b.text)
    return "\n".join(kept)


def _nearest(page: list[Block], labels: list[bool | None]) -> list[tuple[bool, int]]:
    """For each block the label of the nearest decided block before it and the distance to that.

    The edge of an article element counts as a decided part of the article, the edge of the page as none.
    """
    out, label, at, inside = [], False, -1, 0
    for i, b in enumerate(page):
        if b.inside != inside:
            label, at = (True, i - 1) if b.inside else (label, at)
            inside = b.inside
        out.append((label, i - at))
        if labels[i] is not None:
            label, at = labels[i], i
    return out


def extract_text(
    pages: DataFrame, html: str = "html", stop_words: frozenset[str] = STOP_WORDS
) -> DataFrame:
    """(row, text) for every row: the main text of the whole html; a projection, no shuffle.

    First pass: blocks in navigation, headers, footers, asides, forms, dialogs, hidden elements and elements named for
    adverts, notices, sidebars, comments and the like are none of the article, nor are blocks mostly of links; blocks of
    SHORT characters or more with enough stop words are.  Where a page has an article or main element, only its blocks
    can be.  Second pass: blocks still undecided take the label of the nearest decided neighbour, the edges of an article
    element counting as decided; at equal distance they stay in an article element, or as paragraph or heading.
    Scripts, styles, comments and form controls are dropped, character references decoded; a line break is white space.

    Null and empty html and pages of boilerplate alone: the empty text.  Truncated markup ends with the page.  Nothing is
    cut off.  Repeated rows are each extracted; `row` holds the input's columns.  Tables without rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), stop_words) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    rows = with_row(pages, html=F.col(html))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")


def op11_html_text(spark, sf_dir):
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = extract_text(pages.select("page_id", "url", F.col("html")))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
