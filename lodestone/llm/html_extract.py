"""Main text of HTML pages by line-block distribution.

Markup is stripped to a list of text blocks in page order; blocks inside elements that are never an article (scripts,
navigation, forms, comments and the like, by element or by the words of their class, id or role) are boilerplate.
Text lengths are summed over sliding windows of blocks; the surge is where the window sum first rises over a
threshold, the dive where it falls back, and the text between the first surge and the last dive is kept.  An <article>
or <main> element is evidence: its blocks at the edges, too short for a surge of their own, are kept too, and text outside
it stays if it surges.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is no part of an article, and those whose content isn't markup.
DROPPED = frozenset("head title script style noscript template nav header footer aside form button select option textarea iframe object svg canvas menu dialog datalist label input".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay in the line; every other one ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Words of class, id or role that mark boilerplate.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside complementary "
    "header masthead footer contentinfo comment comments disqus reply replies cookie cookies consent gdpr notice notices popup modal overlay dialog newsletter subscribe subscription signup login search form "
    "share sharing social related recommended toolbar widget copyright skip pagination pager".split()
)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What is left of a tag: quoted values may hold its end.  Possessive, so that a failure is one pass.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_LONG_NUMBER = re.compile(r"&#0*+[0-9]{8,};?")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")
#: A start tag of the key's kind ends an open one of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _marked(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    for name, *values in _ATTR.findall(attrs):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and "true" in values:
            return True
        if name in ("class", "id", "role") and not MARKED.isdisjoint(_WORD.findall("".join(values).lower())):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", "".join(values).lower()):
            return True
    return False


def _unescape(text: str) -> str:
    """Character references decoded; a number beyond all characters is the replacement character."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(start, end, kind, slash, name, attributes) of the markup in page order; kind is tag, data (CDATA) or skip.

    One pass: what isn't found to the end of the page once is not looked for again.  Once quotes don't balance up to the end,
    a tag ends at its first >.  After a yield the caller may send the place to go on from.
    """
    at, missing, loose = 0, set(), False

    def find(what: str, begin: int) -> int:
        if what in missing:
            return -1
        if (k := page.find(what, begin)) < 0:
            missing.add(what)
        return k

    while (at := find("<", at)) >= 0:
        kind, slash, name, attrs, end = "skip", "", "", "", -1
        if page.startswith("<!--", at):
            end = find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
        elif page.startswith("<![CDATA[", at) and (end := find("]]>", at + 9)) >= 0:
            kind, end = "data", end + 3
        elif page.startswith(("<!", "<?"), at):
            end = find(">", at) + 1 or -1
        elif m := _NAME.match(page, at):
            kind, slash, name = "tag", m[1], m[2]
            end = find(">", m.end())
            attrs = page[m.end() : end] if end >= 0 else ""
            if end >= 0 and not loose and (attrs.count('"') % 2 or attrs.count("'") % 2):
                if rest := _REST.match(page, m.end()):
                    end = rest.end() - 1
                    attrs = page[m.end() : end]
                else:
                    loose = True
            end = end + 1 or -1
        if end < 0:
            at += 1
            continue
        sent = yield at, end, kind, slash, name, attrs
        at = sent or end


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside an article or main element, boilerplate by markup) of every block in page order, in one pass."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements that matter: (tag, boilerplate)
    text: list[str] = []
    dropped = inside = 0
    open_tags: Counter[str] = Counter()

    def end() -> None:
        if text:
            if line := _SPACES.sub(" ", _unescape("".join(text))).strip():
                out.append((line, inside > 0, dropped > 0))
            text.clear()

    def close(k: int) -> None:
        nonlocal dropped, inside
        for t, b in stack[k:]:
            dropped -= b
            inside -= t in ("article", "main")
            open_tags[t] -= 1
        del stack[k:]

    at, tokens, go_on = 0, _tokens(page), None
    while True:
        try:
            start, stop, kind, slash, name, attrs = tokens.send(go_on)
        except StopIteration:
            text.append(page[at:])
            break
        go_on = None
        text.append(page[at:start])
        at = stop
        if kind == "data":
            text.append(html.escape(page[start + 9 : stop - 3], quote=False))
        if kind != "tag":
            continue
        tag = name.lower()
        if tag in INLINE and not (stack and stack[-1][0] == tag) and (slash or not _marked(tag, attrs)):
            if tag == "br":
                text.append(" ")
            continue
        end()
        if slash:
            if open_tags[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag in VOID or attrs.endswith("/") and tag not in ("p", "div", "article", "main", "section"):
            continue
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = page.find(">", m.end()) + 1 if m else 0
            go_on = at = at or len(page)
            continue
        if tag in CLOSES and stack and stack[-1][0] in CLOSES[tag] or tag == "p" and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in ("body", "html"):
            continue
        b = _marked(tag, attrs)
        stack.append((tag, b))
        open_tags[tag] += 1
        dropped += b
        inside += tag in ("article", "main")
    end()
    return out


def line_blocks(lengths: list[int], width: int, surge: int, dive: int) -> tuple[int, int]:
    """[first, end) of the lines between the first surge and the last dive; (0, 0) if no window surges.

    window[i] is the sum of `width` lines from i on.  A region opens at a line of some length whose window reaches
    `surge` and ends before the first window that falls to `dive` or less.
    """
    n = len(lengths)
    total = [0]
    for x in lengths:
        total.append(total[-1] + x)
    window = [total[min(n, i + width)] - total[i] for i in range(n)]
    first, end, at = n, 0, 0
    while at < n:
        if window[at] < surge or not lengths[at]:
            at += 1
            continue
        stop = at
        while stop < n and window[stop] > dive:
            stop += 1
        first, end = min(first, at), stop
        at = max(stop, at + 1)
    return min(first, end), end


def main_text(page: str, width: int = 3, surge: int = 80, dive: int = 0) -> str:
    """The page's article: its blocks, each with single spaces, joined by two newlines."""
    found = blocks(page)
    lengths = [0 if b else len(t) for t, _, b in found]
    first, end = line_blocks(lengths, width, surge, dive)
    if first == end:  # too little text for a surge: all that isn't boilerplate
        first, end = 0, len(found)
    tagged = [i for i, (_, a, b) in enumerate(found) if a and not b]
    if tagged:
        first, end = min(first, tagged[0]), max(end, tagged[-1] + 1)
    return "\n\n".join(t for t, _, b in found[first:end] if not b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x or "") for x in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_html(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of `pages` (page_id, url, html; others are ignored).

    A null or empty html, or one without text outside boilerplate, gives the empty string.  Pages are independent, so
    there is no shuffle; repeated rows give repeated results.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
