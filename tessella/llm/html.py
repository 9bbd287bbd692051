"""Operator 10: main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: the runs of text between block
boundaries.  Each line has a text-to-tag ratio, its characters outside links over its tags; lines
in structural boilerplate (navigation, forms, scripts, hidden parts ...) have the ratio 0.
Ratios are smoothed by a Gaussian along the page and split in two clusters by a threshold; the
upper cluster marks content.  The region taken is the article or main element that holds marked
lines, or else the innermost element around nearly all of them; from it come all lines that are not boilerplate, short
ones too.  Outside an article, lines in the lower cluster that consist of links go as well.

Class names and ids only weigh in (``HINTS``).  A name hints if each of its parts names boilerplate (or, as in "ad-box", a ``NEUTRAL`` part), or one
part does so beyond doubt (``SURE``), unless another part denies it ("no-ads").  An element with such a name goes, but for one that holds an article or main element or nearly
all text of the upper cluster; reader comments go in any case.  In an element one part of whose name hints ("related-work") ratios
count ``WEAK`` of their value, and only lines in the lower cluster go.  If nothing were left, hints don't count.

Malformed markup is read as the parser of the standard library reads it: unknown declarations are comments.  Memory follows the page's length, however deeply its
elements are nested.  A null page, an empty one and one without such lines give the empty text.  Repeated rows each give
a row; empty tables none; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
DROPPED = frozenset("script style noscript template nav footer aside form button select option textarea iframe object svg canvas dialog menu head title audio video map".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidenav widget widgets menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments commentlist disqus respond replies related recommended share sharing social login search pagination pager skip toolbar".split()
)
SURE = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored cookie cookies gdpr popup newsletter sidebar sidenav navbar breadcrumb breadcrumbs pagination toolbar".split())
NEUTRAL = frozenset("area bar block body bottom box button buttons container content form icons inner item items left link links list message outer page panel post posts primary reader right row secondary section site slot small sub text top unit user wide wrap wrapper".split())
DENIED = frozenset("closed disabled enabled has hide hides is no non not off on open with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
REMARKS = frozenset("comment comments commentlist disqus replies respond".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split())
SIGMA, WEAK = 1.0, 0.3
KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-3, 4)]


class Line:
    __slots__ = ("text", "tags", "link", "at", "dropped")

    def __init__(self, text: str, tags: int, link: int, at: int):
        self.text, self.tags, self.link, self.at, self.dropped = text, tags, link, at, False


class _Element:
    """``parent``: place of the parent in the page's list; ``inside``: it is, or stands in, an article or main
    element; ``dropped`` and ``weak`` hold for all that it contains."""

    __slots__ = ("tag", "parent", "main", "inside", "dropped", "hint", "weak")

    def __init__(self, tag: str, parent: int, main: bool, inside: bool, dropped: bool, hint: str, weak: bool):
        self.tag, self.parent, self.main, self.inside, self.dropped, self.hint, self.weak = tag, parent, main, inside, dropped, hint, weak


def hint_of(tag: str, names: str, inside: bool) -> str:
    """What a class and id attribute says: "remarks", "strong", "weak" or nothing."""
    if tag in ("html", "body", "main"):
        return ""
    out = ""
    for name in names.lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        known = [x for x in parts if x in HINTS or (not inside and x in ("header", "topbar"))]
        if not known or DENIED & set(parts):
            continue
        if REMARKS & set(parts):
            return "remarks"
        if tag == "article":
            continue
        if SURE & set(parts) or all(x in HINTS or x in NEUTRAL or x in known for x in parts):
            out = "strong"
        out = out or "weak"
    return out


class Lines(HTMLParser):
    """Collects the lines of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.elements = [_Element("", -1, False, False, False, "", False)]
        self.stack: list[int] = [0]
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.tags = self.link = 0

    def parse_html_declaration(self, i: int) -> int:
        # What is neither a comment nor a document type is a comment up to the next ">".
        if not self.rawdata[i : i + 9].lower().startswith(("<!--", "<!doctype")):
            end = self.rawdata.find(">", i + 2)
            return end + 1 if end >= 0 else len(self.rawdata)
        return super().parse_html_declaration(i)

    def read(self, html: str) -> list[Line]:
        try:
            self.feed(html)
            self.close()
        except AssertionError:
            # What the parser gives up on is read as text, without tags.
            line, column = self.getpos()
            at = sum(len(x) + 1 for x in html.split("\n")[: line - 1]) + column
            self.handle_data(unescape(re.sub(r"<[^>]*>?", " ", html[at:])))
        self._end_line()
        return self.lines

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, min(self.link, len(text)), self.stack[-1]))
        self.parts, self.tags, self.link = [], 0, 0

    def _dropped(self, tag: str, attrs: dict[str, str], inside: bool) -> bool:
        if tag in DROPPED or (tag == "header" and not inside):
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
            return True
        if attrs.get("role", "").strip().lower() in ROLES:
            return True
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close("p", {"button", "table", "td", "th", "article", "section", "div"})
        if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for t in same:
                self._close(t, {"ul", "ol", "dl", "table", "select", "menu"})
        if tag not in INLINE:
            self._end_line()
        if tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        known = {k: v or "" for k, v in attrs}
        main = tag in ("article", "main") or known.get("role", "").strip().lower() in ("main", "article")
        above = self.elements[self.stack[-1]]
        hint = hint_of(tag, f"{known.get('class', '')} {known.get('id', '')}", above.inside)
        self.elements.append(_Element(tag, self.stack[-1], main, above.inside or main, above.dropped or self._dropped(tag, known, above.inside), hint, above.weak or hint == "weak"))
        self.stack.append(len(self.elements) - 1)
        self.open[tag] += 1

    def _tag(self, k: int) -> str:
        return self.elements[self.stack[k]].tag

    def _pop(self, k: int) -> None:
        self.open.subtract(self._tag(i) for i in range(k, len(self.stack)))
        del self.stack[k:]

    def _close(self, tag: str, stop: set[str]) -> None:
        if self.open[tag] <= 0:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self._tag(k) == tag:
                self._end_line()
                self._pop(k)
                return
            if self._tag(k) in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        there = self.open[tag] > 0
        if tag == "p" and not there:
            self._end_line()
            return
        self.tags += 1
        inline = tag in INLINE
        for k in range(len(self.stack) - 1, 0, -1) if there else ():
            if self._tag(k) == tag:
                if not inline:
                    self._end_line()
                self._pop(k)
                return
            if inline and self._tag(k) not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.open["a"] > 0:
            self.link += len(data.strip())


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian smoothing; the kernel is renormalised at the ends."""
    n, out = len(ratios), []
    for i in range(n):
        total = weight = 0.0
        for d, k in enumerate(KERNEL, i - 3):
            if 0 <= d < n:
                total += k * ratios[d]
                weight += k
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Between the two clusters of the values' logarithms (two means, from the extremes)."""
    logs = [math.log1p(v) for v in values]
    low, high = min(logs), max(logs)
    if high - low < 1e-9:
        return math.expm1(low) if low > 0 else 1e-9
    for _ in range(50):
        cut = (low + high) / 2
        a, b = [x for x in logs if x < cut], [x for x in logs if x >= cut]
        new = (sum(a) / len(a) if a else low), (sum(b) / len(b) if b else high)
        if new == (low, high):
            break
        low, high = new
    return math.expm1((low + high) / 2)


def _ratios(lines: list[Line], elements: list[_Element]) -> list[float]:
    return smoothed([0.0 if x.dropped else (WEAK if elements[x.at].weak else 1) * (len(x.text) - x.link) / max(1, x.tags) for x in lines])


def _held(lines: list[Line], elements: list[_Element], sizes: list[int]) -> list[int]:
    """Per element, the sizes of the lines in it, at any depth; parents stand before their children."""
    held = [0] * len(elements)
    for x, n in zip(lines, sizes, strict=True):
        held[x.at] += n
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
    return held


def _settle(lines: list[Line], elements: list[_Element]) -> None:
    """Lines in hinted elements are dropped, but for elements that hold an article or main element
    or nearly all text of the upper cluster: these are wrappers of the content, whatever their name."""
    if not any(e.hint in ("strong", "remarks") for e in elements):
        return
    values = _ratios(lines, elements)
    cut = threshold(values)
    held = _held(lines, elements, [len(x.text) if v >= cut and not x.dropped else 0 for x, v in zip(lines, values, strict=True)])
    mains = _held(lines, elements, [int(elements[x.at].inside and not x.dropped) for x in lines])
    bad = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        wraps = e.hint == "strong" and ((not e.inside and mains[i] > 0) or (held[0] and held[i] >= 0.9 * held[0]))
        bad[i] = bad[e.parent] or (e.hint in ("strong", "remarks") and not wraps)
    if any(not x.dropped and not bad[x.at] for x in lines):
        for x in lines:
            x.dropped = x.dropped or bad[x.at]


def extract(html: str | None) -> str:
    """The main text of a page, its lines joined by line feeds."""
    parser = Lines()
    lines, elements = parser.read(html or ""), parser.elements
    for x in lines:
        x.dropped = elements[x.at].dropped
    if all(x.dropped for x in lines):
        return ""
    _settle(lines, elements)
    values = _ratios(lines, elements)
    cut = threshold(values)
    marked = [v >= cut and not x.dropped for x, v in zip(lines, values, strict=True)]
    if not any(marked):
        marked = [not x.dropped for x in lines]
    sizes = [len(x.text) if m else 0 for x, m in zip(lines, marked, strict=True)]
    held = _held(lines, elements, sizes)
    # Outermost article and main elements with marked lines; else the innermost element around nearly all of them.
    region = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        region[i] = region[e.parent] or (e.main and held[i] > 0)
    article = any(region)
    if not article:
        around = max((i for i, e in enumerate(elements) if (e.tag in ("body", "div", "section") or not i) and held[i] >= 0.9 * held[0]), default=0)
        for i, e in enumerate(elements):
            region[i] = i == around or (i > 0 and region[e.parent])
    out = []
    for x, v in zip(lines, values, strict=True):
        low = v < cut and (elements[x.at].weak or (not article and 2 * x.link > len(x.text)))
        if region[x.at] and not x.dropped and not low:
            out.append(x.text)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = [extract(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages(page_id, url, html)``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


