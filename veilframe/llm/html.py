"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; blocks become lines with their
text, its links and the tags met.  Each line's ratio of text to tags - linked
text is no text, lines of an article or main element count more - is smoothed by
a Gaussian over its neighbours and the ratios are split in two clusters by the
threshold between their means.  On every page the lines of the upper cluster
choose the content regions: the article elements that hold some, else the main
elements, else the innermost container with most of their text and what stands
beside it in the same parent.  A region is kept whole: headings and short paragraphs between content lines are part of it.

Elements that are never article text (menus, forms, scripts, notices, adverts,
comments of readers ...) are told by name, role, class or id and leave no lines;
of parts of an article that only a part of their name hints at, those go that
hold no line of the upper cluster.

Reading a page takes time in proportion to its length, however deep its elements
are nested, closed or not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches

# Element names of HTML.
SILENT = frozenset("script style noscript template head title iframe object svg math canvas select textarea button datalist audio video map nav footer aside form dialog menu".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag ends, and those beyond which it ends none.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
CONTAINERS = ("article", "main", "section", "div", "td", "body")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
_HINT = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|menu|navbar|nav|navigation|breadcrumbs?|sidebar|side-bar|aside|footer|foot|masthead|site-header|topbar|comments?|commentlist|disqus|respon[ds]e?s?|replies|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|social|share|sharing|related|recommended|widget|toolbar|pagination|pager|skip|hidden|copyright|legal|disclaimer)(?:$|[-_\s\d])", re.I)
#: Names that are a hint as a whole word, or hold one that no article part is named by.
_PLAIN_HINT = re.compile(r"(?:^|\s)(?:notice|related|recommended|banner|legal|copyright|disclaimer|widget|share|social|promo|skip|hidden|popup|modal)(?:$|\s)|(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|comments?|commentlist|disqus|respon[ds]e?s?|replies|cookies?|consent|gdpr|newsletter|subscribe|signup|login|nav\w*|menu|sidebar|side-bar|footer|breadcrumbs?|sharing|pagination|pager|toolbar)(?:$|[-_\s\d])", re.I)
_SPACE = re.compile(r"\s+")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: How much more a line's ratio counts inside an article or main element.
SEMANTIC = 4.0
#: Lines that a line's smoothed ratio looks at on each side, in standard deviations of SIGMA lines.
SIGMA = 1.0


class _Lines(HTMLParser):
    """Lines of one page: [text, characters in links, tags, container, heading]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.stack: list[str] = []
        self.open: Counter[str] = Counter()  # elements on the stack, by name
        self.quiet: Counter[str] = Counter()  # those of the silent part
        self.silent = 0  # depth at which silence began
        self.where = [0]  # containers, innermost last
        self.parent = {0: -1}
        #: Of each container, the outermost article and main element it lies in; -1 for none.
        self.article, self.main = {0: -1}, {0: -1}
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0
        self.heading = False
        self.doubtful: set[int] = set()

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip() if self.text else ""
        if text:
            self.lines.append([text, self.linked, self.tags, self.where[-1], self.heading])
        self.text, self.tags, self.linked = [], 0, 0

    def _implied_end(self, tag) -> None:
        """Closes what a start tag ends without an end tag: the open paragraph, and the item, row or cell before."""
        for name in reversed(self.stack):
            if name in BLOCK:
                if name == "p":
                    self._close("p")
                break
        for name in reversed(self.stack) if tag in ENDS and any(self.open[n] for n in ENDS[tag]) else ():
            if name in ENDS[tag]:
                self._close(name)
            if name in ENDS[tag] or name in HOLDS[tag]:
                break

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            if not self.silent:
                self.end_line()
            self._implied_end(tag)
        if self.silent:
            if tag not in VOID:
                self._push(tag)
            return
        if tag in BLOCK:
            self.heading = tag in _HEADINGS
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        self._push(tag)
        if tag == "a":
            self.links += 1
        inside = self.open["article"] or self.open["main"]
        hinted = bool(attrs) and self._hinted(tag, attrs)
        doubtful = hinted and inside and tag in CONTAINERS and self._doubtful(attrs)
        if tag in SILENT or hinted and not doubtful or tag == "header" and not inside:
            self.silent = len(self.stack)
            self.quiet = Counter((tag,))
        elif tag in CONTAINERS:
            new, around = len(self.parent), self.where[-1]
            self.parent[new] = around
            for kind, outermost in (("article", self.article), ("main", self.main)):
                outermost[new] = new if tag == kind and outermost[around] < 0 else outermost[around]
            self.where.append(new)
            if doubtful:
                self.doubtful.add(new)

    def _hinted(self, tag, attrs) -> bool:
        for name, value in attrs:
            if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name in ("class", "id") and value and tag not in ("body", "html", "article", "main") and _HINT.search(value):
                return True
            if name == "itemtype" and value and value.rstrip("/").endswith("/Comment"):
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def _doubtful(self, attrs) -> bool:
        """Hinted at by a part of longer names only, as in ``related-work``: its text decides."""
        names = " ".join(v for k, v in attrs if k in ("class", "id") and v)
        return not any(k not in ("class", "id") for k, _ in attrs) and not _PLAIN_HINT.search(names)

    def _push(self, tag) -> None:
        self.stack.append(tag)
        self.open[tag] += 1
        if self.silent:
            self.quiet[tag] += 1

    def _close(self, tag) -> None:
        while self.open[tag]:
            top = self.stack.pop()
            self.open[top] -= 1
            if self.silent:
                self.quiet[top] -= 1
                if len(self.stack) < self.silent:
                    self.silent = 0  # text before a silent part goes on behind it
            else:
                if top == "a":
                    self.links = max(0, self.links - 1)
                if top in CONTAINERS and len(self.where) > 1:
                    self.where.pop()
            if top == tag:
                break

    def handle_endtag(self, tag):
        if self.silent:
            # an end tag that isn't of the silent part leaves it only if it closes the element around it
            if self.quiet[tag] or tag in BLOCK and tag != "p":
                self._close(tag)
            return
        if tag in BLOCK:
            self.end_line()
            self._close(tag)
            self.heading = False
        else:
            self.tags += 1
            if tag in self.stack[-8:]:
                self._close(tag)

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def ratios(lines: list[list], counts: list[float], sigma: float = SIGMA) -> np.ndarray:
    """Smoothed text-to-tag ratio of each line, times what the line counts; linked text is no text."""
    raw = np.array([k * max(0, len(t) - linked) / max(1, tags) for (t, linked, tags, _, _), k in zip(lines, counts)])
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(raw)), kernel)[reach : reach + len(raw)]
    return np.convolve(raw, kernel)[reach : reach + len(raw)] / weight


def threshold(values: np.ndarray) -> float:
    """Between the means of the two clusters that one-dimensional 2-means finds; one cluster has no threshold."""
    low, high = values.min(), values.max()
    if high <= 2 * low:
        return -1.0
    for _ in range(20):
        cut = (low + high) / 2
        new = values[values <= cut].mean(), values[values > cut].mean()
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(page: str | None) -> str:
    """The article's blocks, one a line; empty for null, empty or textless pages."""
    if not page:
        return ""
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    smooth = ratios(lines, [SEMANTIC if parser.article[x[3]] >= 0 or parser.main[x[3]] >= 0 else 1.0 for x in lines])
    chosen = smooth > threshold(smooth)
    weight = _subtrees(parser, lines, chosen)
    # a doubtful part of an article goes with all it holds where no line of it is chosen
    gone = {-1: False}
    for c in range(len(parser.parent)):
        gone[c] = gone[parser.parent[c]] or c in parser.doubtful and not weight[c]
    for outermost in (parser.article, parser.main):
        regions = {outermost[x[3]] for x, c in zip(lines, chosen) if c} - {-1}
        if regions:
            return "\n".join(x[0] for x in lines if outermost[x[3]] in regions and not gone[x[3]])
    return "\n".join(x[0] for x in _majority(parser, lines, weight))


def _subtrees(parser: _Lines, lines: list[list], chosen: np.ndarray) -> list[int]:
    """Per container: characters of chosen lines, without those of links, in it and all containers below."""
    weight = [0] * len(parser.parent)
    for x, c in zip(lines, chosen):
        if c:
            weight[x[3]] += max(0, len(x[0]) - x[1])
    for c in range(len(weight) - 1, 0, -1):  # containers are numbered from the outermost in
        weight[parser.parent[c]] += weight[c]
    return weight


def _majority(parser: _Lines, lines: list[list], weight: list[int]) -> Iterator[list]:
    """Lines of the innermost container with more than half of the chosen text, and of what stands beside it in the same parent.

    All is kept whole, but for lines of nothing but links; where it is the page itself, so are
    those of its parts that hold chosen lines.
    """
    region = 0
    for c in range(1, len(weight)):  # an inner one comes behind its outer one, and only one of two beside holds most
        if 2 * weight[c] > weight[0] and parser.parent[c] == region:
            region = c
    region = max(0, parser.parent[region]) or region  # titles and short parts stand beside what is longest
    outer = region == 0
    part = [-1] * len(weight)  # the region's own part a container lies in; the region is its own
    part[region] = region
    for c in range(region + 1, len(weight)):
        around = part[parser.parent[c]]
        part[c] = c if around == region and outer else around
    for x in lines:
        mine = part[x[3]]
        if mine < 0 or mine != region and not weight[mine]:
            continue
        if x[1] < len(x[0]) or x[4]:
            yield x


def extract(pages: DataFrame) -> DataFrame:
    """op3: page_id, url, text, n_chars of every whole page.

    Null or empty html has empty text; repeated rows stay; columns other than page_id, url and html are not read.
    Pages may be of any length and depth.
    """

    def one(f: dict[str, list]) -> Iterator[dict[str, list]]:
        text = [main_text(h) for h in f["html"]]
        yield {"page_id": f["page_id"], "url": f["url"], "text": text, "n_chars": [len(t) for t in text]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return by_batches(rows, lambda: one, "page_id long, url string, text string, n_chars long")
