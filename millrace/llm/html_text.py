"""Main text of web pages.

The standard library's parser streams events. Block elements begin lines; each line counts its text characters
and the tags that fell into it, the lines' text-to-tag ratios are smoothed by a Gaussian kernel, and lines above
a threshold (a share of the standard deviation) form clusters. Lines of a cluster that reach the threshold by themselves
are its core; text is weighed by core lines alone.

The clusters choose the region. Where articles hold at least half of the weight, they are it (those in main, if such are
among them; or main itself, if it has weight around them); else main, if that holds half. Else it is the deepest
element that holds all of the weight, without boxes of no weight before the first core line or after the last, and
without lists and tables there whose text is mostly links: what no cluster vouches for. All other lines of the region
are kept, short ones too, but for what is never content: menus, headers, footers, sidebars, notices, adverts, forms, reader comments,
scripts and styles, known by element, role, or a class or id all of whose words say so (`cookie-notice`, `post-comments`; not
`share-price`). What is marked so around all articles, or a form around nearly all weight, is marked in error.

Defined results: a null or empty page, or one without text, gives the empty string; unclosed and stray tags are
read as browsers do, an unclosed comment ends at the next bracket; nothing is cut from long pages, and all steps are linear in their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page.
RAW = frozenset("script style noscript template head title svg canvas iframe object audio video map datalist".split())
#: Elements that never hold content, with all that is in them.
DROPPED = frozenset("nav header footer aside form button select textarea option dialog menu fieldset label".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements too small to be a content region.
LEAVES = HEADINGS | {"p", "li", "blockquote", "pre"}
LISTS = frozenset("ul ol dl table".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id (split at anything but letters and digits, and at changes of case) that mark what is no content.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs"
    " sidebar sidebars aside rail footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login"
    " comment comments commentlist respond disqus reply replies discussion reviews share sharing social related recommended recommendations trending pagination pager widget widgets toolbar skip skiplink copyright disclaimer form search searchbox toc"
    .split()
)
#: Words that say nothing beside one of these.
GENERIC = frozenset(
    "box boxes container wrapper wrap block blocks area section sections content contents body inner outer list items item bar panel slot unit zone module group row col column link links button buttons text title label"
    " top bottom left right main page site global primary secondary mobile desktop fixed sticky message icons icon media post posts article articles story stories user users reader readers fb facebook twitter google more hero to the a"
    .split()
)
#: Elements that close an open one of the given names when they start.
CLOSES = {
    **{t: frozenset({"p"}) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}),
}
#: Elements beyond which none of these is closed.
WALLS = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table", "tr"}), "th": frozenset({"table", "tr"})}
PLAIN_WALLS = frozenset("body html article section div main nav aside header footer form table td th ul ol li blockquote figure button object".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_TAG = re.compile(r"<[a-zA-Z/!?]")
_COMMENT_END = re.compile(r"--!?>")


def _marked(attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether attributes mark an element as no content; inside: of an article or main, where headers hold titles."""
    for name, value in attrs:
        if not value:
            if name == "hidden":
                return True
            continue
        if name in ("class", "id"):
            for token in value.split():
                words = [w for w in map(str.lower, _PARTS.findall(token)) if w not in GENERIC and not w.isdigit()]
                if words and all(w in WORDS and not (inside and w == "header") for w in words):
                    return True
        elif name == "role" and value.strip().lower() in ROLES:
            return True
        elif name == "aria-hidden" and value.strip().lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        elif name == "hidden":
            return True
    return False


class _Lines(HTMLParser):
    """Collects lines (text, tags, open elements) of what may be content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # element and its number
        self.open: Counter[str] = Counter()  # how often each element is on the stack
        self.parent, self.name = [0], ["#root"]  # by number; parents have lower numbers
        self.blocks: list[tuple[int, int]] = []  # height and number of the block elements on the stack
        self.raw: list[int] = []  # heights of the stack at which elements without text began
        self.hidden: list[int] = []  # and marked inline elements
        self.marked: set[int] = set()  # block elements that are no content
        self.lines: list[tuple[str, int, int]] = []  # text, tags, number of the innermost block element
        self.linked: list[int] = []  # by line: characters that are links
        self.parts: list[str] = []
        self.tags = self.count = self.links = 0
        self.block = 0
        self.unclosed = False  # whether a comment has no end

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, self.block))
            self.linked.append(self.links)
            self.tags = 0
        self.parts, self.links = [], 0

    def pop_to(self, height: int) -> None:
        if self.blocks and self.blocks[-1][0] >= height:
            self.end_line()
        self.open.subtract(t for t, _ in self.stack[height:])
        del self.stack[height:]
        for heights in (self.raw, self.hidden):
            while heights and heights[-1] >= height:
                heights.pop()
        while self.blocks and self.blocks[-1][0] >= height:
            self.blocks.pop()
        self.block = self.blocks[-1][1] if self.blocks else 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in CLOSES and any(self.open[t] for t in CLOSES[tag]):
            walls = WALLS.get(tag, PLAIN_WALLS)
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in CLOSES[tag]:
                    self.pop_to(k)
                    if tag not in ("td", "th", "tr"):
                        break
                elif self.stack[k][0] in walls:
                    break
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.end_line()
        if tag in VOID:
            return
        self.count += 1
        self.parent.append(self.stack[-1][1] if self.stack else 0)
        self.name.append(tag)
        inside = self.open["article"] + self.open["main"] > 0
        self.stack.append((tag, self.count))
        self.open[tag] += 1
        if tag in RAW:
            self.raw.append(len(self.stack) - 1)
        elif tag not in ("html", "body", "article", "main") or tag == "article" and inside:
            if tag in DROPPED and not (tag == "header" and inside) or attrs and _marked(attrs, inside):
                if tag in INLINE:
                    self.hidden.append(len(self.stack) - 1)
                else:
                    self.marked.add(self.count)
        if tag not in INLINE:
            self.blocks.append((len(self.stack) - 1, self.count))
            self.block = self.count

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "iframe", "svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.pop_to(k)
                return
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.raw or self.hidden:
            return
        if self.open["header"] and self.open["article"] + self.open["main"] and not any(self.open[h] for h in HEADINGS):
            return
        self.parts.append(data)
        if self.open["a"]:
            self.links += len(data)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """Comments end at their end mark; where there is none, at the next bracket, and no later comment is searched for one."""
        if not self.unclosed and (m := _COMMENT_END.search(self.rawdata, i + 2)):
            return m.end()
        self.unclosed = True
        end = self.rawdata.find(">", i + 4)
        return end + 1 if end >= 0 else -1

    def read(self, html: str) -> None:
        """The whole page. After the last bracket no tag is complete: text up to where one starts is the end."""
        end = html.rfind(">") + 1
        self.feed(html[:end])
        self.close()
        rest = html[end:]
        if rest and not self.cdata_elem:
            m = _TAG.search(rest)
            self.handle_data(unescape(rest[: m.start()] if m else rest))
        self.end_line()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections as <![if ...]> end at the next bracket, whatever they are."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Values after a Gaussian kernel of three sigmas on either side; weights are normalised at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d in range(max(-reach, -i), min(reach, len(values) - 1 - i) + 1):
            w = kernel[d + reach]
            total += w * values[i + d]
            weight += w
        out.append(total / weight)
    return out


def clustered(lines: list[tuple[str, int, int]], sigma: float = 1.0, share: float = 0.5) -> tuple[list[int], list[int]]:
    """(lines of clusters, their core): numbers of the lines whose smoothed text-to-tag ratio reaches `share` of the smoothed ratios' standard deviation, and of those whose own does too."""
    ratios = [len(text) / max(1, tags) for text, tags, _ in lines]
    smooth = smoothed(ratios, sigma)
    mean = sum(smooth) / len(smooth)
    limit = share * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    inside = [i for i, x in enumerate(smooth) if x >= limit]
    return inside, [i for i in inside if ratios[i] >= limit]


def _below(page: _Lines, roots: set[int]) -> list[bool]:
    """Whether each element is one of the roots or inside one."""
    out = [0 in roots]
    for n in range(1, page.count + 1):
        out.append(n in roots or out[page.parent[n]])
    return out


def _weights(page: _Lines, lines: list[int]) -> list[int]:
    """Characters of the lines, by element that holds them."""
    weight = [0] * (page.count + 1)
    for i in lines:
        weight[page.lines[i][2]] += len(page.lines[i][0])
    for n in range(page.count, 0, -1):
        weight[page.parent[n]] += weight[n]
    return weight


def _excluded(page: _Lines, core: list[int]) -> list[bool]:
    """Whether each element is no content. If all articles and mains of a page are inside marked elements, or nearly all weight is inside a form, these are marked in error."""
    if not page.marked:
        return [False] * (page.count + 1)
    weight = _weights(page, core)
    page.marked -= {n for n in page.marked if page.name[n] == "form" and weight[n] >= 0.9 * weight[0] > 0}
    off = _below(page, page.marked)
    named = [n for n in range(1, page.count + 1) if page.name[n] in ("article", "main") and n not in page.marked]
    if named and all(off[n] for n in named):
        for n in named:
            while n:
                n = page.parent[n]
                page.marked.discard(n)
        off = _below(page, page.marked)
    return off


def _region(page: _Lines, off: list[bool], core: list[int]) -> list[int]:
    """Numbers of the lines that are content."""
    kept = [i for i, (_, _, block) in enumerate(page.lines) if not off[block]]
    core = [i for i in core if not off[page.lines[i][2]]] or kept
    if not core:
        return []
    weight = _weights(page, core)
    outer = {kind: {n for n in range(1, page.count + 1) if page.name[n] == kind and not off[n]} for kind in ("article", "main")}
    in_article, in_main = _below(page, outer["article"]), _below(page, outer["main"])
    held = lambda inside: 2 * sum(len(page.lines[i][0]) for i in core if inside[page.lines[i][2]]) >= weight[0]
    if held(in_article):
        chosen = {n for n in outer["article"] if in_main[n]}
        if any(weight[n] for n in chosen):
            inside = _below(page, chosen)
            around = any(in_main[page.lines[i][2]] and not inside[page.lines[i][2]] for i in core)
            inside = in_main if around else inside
        else:
            inside = in_article
        return [i for i in kept if inside[page.lines[i][2]]]
    if held(in_main):
        return [i for i in kept if in_main[page.lines[i][2]]]
    best = 0
    for n in range(1, page.count + 1):  # numbers rise with depth along a chain
        if weight[n] == weight[0] and page.name[n] not in LEAVES:
            best = n
    inside = _below(page, {best})
    # The outermost element of no weight around each element (itself included), below the region.
    empty = [0] * (page.count + 1)
    links, chars = [0] * (page.count + 1), [0] * (page.count + 1)
    for n in range(1, page.count + 1):
        empty[n] = empty[page.parent[n]] or (n if inside[n] and n != best and not weight[n] else 0)
    for i in kept:
        e = empty[page.lines[i][2]]
        links[e] += page.linked[i]
        chars[e] += len(page.lines[i][0])
    first, last = core[0], core[-1]

    def stays(i: int) -> bool:
        if not inside[page.lines[i][2]]:
            return False
        e = empty[page.lines[i][2]]
        if not e or first < i < last or page.name[e] in LEAVES:
            return True
        return page.name[e] in LISTS and 2 * links[e] < chars[e]

    return [i for i in kept if stays(i)]


def extract_text(html: str | None, sigma: float = 1.0, share: float = 0.5) -> str:
    """The main text of one page; its blocks in page order, joined by one space."""
    if not html:
        return ""
    page = _Lines()
    page.read(html)
    if not page.lines:
        return ""
    core = clustered(page.lines, sigma, share)[1]
    return " ".join(page.lines[i][0] for i in _region(page, _excluded(page, core), core))


def main_text(html: Column, sigma: float = 1.0, share: float = 0.5) -> Column:
    """extract_text as a column; sigma and share set the smoothing and threshold."""

    @F.pandas_udf("string")
    def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([extract_text(h, sigma, share) for h in batch], dtype=object)

    return extract(html)


def extract_pages(df: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """df with the main text of `html` in a column `into` (one of that name is replaced). One map over the rows, no shuffle."""
    return df.withColumn(into, main_text(F.col(html)))
