"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catloom.llm.common import map_batches, raw

SPACE = re.compile(r"\s+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title svg math iframe object canvas select option textarea datalist".split())
ASIDE = set("nav footer header aside form button dialog menu fieldset label input".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Tags that end an open paragraph (or item) when the page leaves out its end tag.
CLOSES = {"p": {"p"} | BLOCKS - {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
          "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
MARK_WORDS = (
    r"(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|"
    r"alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|comments?|disqus|"
    r"replies|respond|sidebar|side-bar|widget|related|recommended|breadcrumbs?|menu|nav(?:bar|igation)?|footer|header|"
    r"masthead|toolbar|pagination|pager|skip|toc|tags?|byline-share)"
)
#: A class or id is a mark if it begins or ends with such a word, and does not tell what the page has around it.
MARK = re.compile(rf"{MARK_WORDS}(?:[-_\d].*)?|.*[-_]{MARK_WORDS}\d*", re.I)
LAYOUT = re.compile(r"(?:has|with|without|no|not|is|show|hide|hides)[-_].*|.*[-_](?:fixed|sticky|open|closed|enabled|disabled|layout|wrapper|page)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
MAIN_MARK = re.compile(r"(?:^|[-_ ])(?:article|post|entry|story|main)?[-_]?(?:body|content|text|article)(?:$|[-_ ])", re.I)


#: Weight of the lines of regions that the page declares as main content.
PRIOR = 2.0


@dataclass
class Line:
    """One block of text: its characters, those inside links, the tags met in it, and the container it stands in."""

    text: str
    linked: int
    tags: int
    region: int
    boxes: tuple[int, ...] = ()  # open elements that only look like an aside
    main: bool = False  # inside main, article or their role


@dataclass
class _Open:
    tag: str
    dropped: bool
    region: int
    boxes: tuple[int, ...] = ()
    main: bool = False


@dataclass
class PageLines(HTMLParser):
    """Turns parser events into lines. Handles end tags that are missing, crossed or surplus."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.parts: list[str] = []
        self.linked = self.tags = self.links_open = 0
        self.regions = ["page"]  # kind of each region; regions are numbered as they begin
        self.group = [0]  # outermost declared region around each region, or the region itself
        self.line_top = _Open("", False, 0)
        self.boxes = 0

    def _top(self) -> _Open:
        return self.stack[-1] if self.stack else _Open("", False, 0)

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append(Line(text, self.linked, self.tags, self.line_top.region, self.line_top.boxes, self.line_top.main))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in BLOCKS or tag in HIDDEN:
            while self.stack and tag in CLOSES.get(self.stack[-1].tag, ()):
                self._pop()
            self._end_open_paragraph(tag)
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        above = self._top()
        marks = {k: v or "" for k, v in attrs}
        dropped = above.dropped or tag in HIDDEN or self._aside(tag, marks) or tag not in BLOCKS and self._marked(tag, marks)
        region = above.region
        kind = self._main_kind(tag, marks)
        if not dropped and (kind or tag in ("section", "div", "td", "ul", "ol", "table", "main", "article", "dl")):
            self.regions.append(kind or "inner" if self._inside_main(above) else kind or "box")
            region = len(self.regions) - 1
            self.group.append(self.group[above.region] if self._inside_main(above) else region)
        boxes = above.boxes
        if not dropped and tag in BLOCKS and self._marked(tag, marks):
            boxes, self.boxes = (*boxes, self.boxes), self.boxes + 1
        role = marks.get("role", "").lower() in ("main", "article") or marks.get("itemprop", "").lower() == "articlebody"
        self.stack.append(_Open(tag, dropped, region, boxes, above.main or tag in ("main", "article") or role))
        if tag == "a":
            self.links_open += 1

    def _end_open_paragraph(self, tag: str) -> None:
        """An open p also ends below inline tags left open in it."""
        if tag not in BLOCKS:
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == "p":
                while len(self.stack) > at:
                    self._pop()
                return
            if self.stack[at].tag in BLOCKS:
                return

    def _inside_main(self, above: _Open) -> bool:
        return self.regions[above.region] in ("main", "inner")

    def _aside(self, tag: str, marks: dict[str, str]) -> bool:
        if tag in ASIDE - {"form"} or marks.get("role", "").lower() in ROLES or "hidden" in marks:
            return True
        if marks.get("aria-hidden", "").lower() == "true":
            return True
        style = marks.get("style", "").replace(" ", "").lower()
        if "display:none" in style or "visibility:hidden" in style:
            return True
        return False

    def _marked(self, tag: str, marks: dict[str, str]) -> bool:
        """Forms, and classes or ids that tell an aside. Blocks of this kind are judged by what they hold, at the end of the page."""
        if tag in ("html", "body", "main", "article") or tag in HEADINGS:
            return False
        names = CAMEL.sub("-", f"{marks.get('class', '')} {marks.get('id', '')}").split()
        return tag == "form" or any(MARK.fullmatch(name) and not LAYOUT.fullmatch(name) for name in names)

    def kept(self) -> list[Line]:
        """Lines outside marked boxes. A box that holds all the main content, or most of the unlinked text of a page without, is no aside."""
        unlinked = lambda lines: sum(max(0, len(x.text) - x.linked) for x in lines)
        inside: dict[int, list[Line]] = {}
        for line in self.lines:
            for box in line.boxes:
                inside.setdefault(box, []).append(line)
        total, main, cleared = unlinked(self.lines), any(x.main for x in self.lines), set()
        for box in sorted(inside):  # outer boxes first
            if main and any(x.main and cleared.issuperset(x.boxes) for x in self.lines):
                break
            if any(x.main for x in inside[box]) if main else 2 * unlinked(inside[box]) > total:
                cleared.add(box)
        return [x for x in self.lines if cleared.issuperset(x.boxes)]

    def _main_kind(self, tag: str, marks: dict[str, str]) -> str:
        if tag in ("article", "main") or marks.get("role", "").lower() in ("main", "article"):
            return "main"
        if marks.get("itemprop", "").lower() == "articlebody":
            return "main"
        if tag in ("div", "section") and any(MAIN_MARK.search(CAMEL.sub("-", marks.get(n, ""))) for n in ("class", "id")):
            return "main"
        return ""

    def _pop(self) -> None:
        last = self.stack.pop()
        if last.tag in BLOCKS:
            self.flush()
        if last.tag == "a":
            self.links_open -= 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "p" and not any(o.tag == "p" for o in self.stack):
            return self.flush()
        if tag in VOID or not any(o.tag == tag for o in self.stack):
            return None
        if tag not in BLOCKS:  # a crossed inline end tag closes nothing outside its block
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at].tag == tag:
                    if tag == "a":
                        self.links_open -= 1
                    del self.stack[at]
                    return None
                if self.stack[at].tag in BLOCKS:
                    return None
        while self.stack:
            done = self.stack[-1].tag == tag
            self._pop()
            if done:
                break
        return None

    def handle_data(self, data):
        top = self._top()
        if top.dropped or not data:
            return
        if not self.parts:
            self.line_top = top
        self.parts.append(data)
        if self.links_open:
            self.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the borders repeat their own weight."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[reach: reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[reach: reach + len(values)]


def split_threshold(values: np.ndarray, rounds: int = 50) -> float:
    """Border between two clusters of one-dimensional values (two means); 0 if they do not differ."""
    low, high = float(values.min()), float(values.max())
    for _ in range(rounds):
        border = (low + high) / 2
        upper = values >= border
        if upper.all() or not upper.any():
            return 0.0
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: bytes) -> str:
    """Text of the content regions of a page.

    Lines are the blocks of the page outside menus, headers, footers, forms, scripts and boxes marked
    as adverts, notices or comments. Each line has the ratio of its unlinked characters to its
    tags, smoothed over its neighbours; two-means clustering of the logarithms gives a threshold, and a
    region belongs to the content if one of its lines reaches it and it is not mostly links. A region that the page
    declares as main content is decided with all regions inside it, and its lines count ``PRIOR`` times; no region
    is taken for its name alone. A region is kept or dropped whole, so a short paragraph of the article is never lost.
    """
    page = PageLines()
    page.feed(html.decode("utf-8", "replace"))
    page.close()
    while page.stack:
        page._pop()
    page.flush()
    lines = page.kept()
    if not lines:
        return ""
    own = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    declared = np.array([page.regions[x.region] in ("main", "inner") for x in lines])
    ratio = np.log1p(smooth(own)) + np.where(declared, np.log(PRIOR), 0)
    border = split_threshold(ratio)
    linked: Counter[tuple] = Counter()
    size: Counter[tuple] = Counter()
    reached: set[int] = set()
    for line, value in zip(lines, ratio, strict=True):
        group = page.group[line.region]
        for name in {("region", line.region), ("group", group)}:
            linked[name] += line.linked
            size[name] += len(line.text)
        if value >= border:
            reached.add(group)

    def content(region: int) -> bool:
        names = ("group", page.group[region]), ("region", region)
        if page.regions[region] == "main":
            names = names[:1]
        return page.group[region] in reached and all(2 * linked[name] <= size[name] for name in names)

    return " ".join(x.text for x in lines if content(x.region))


def extract_pages(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars. Null or empty html, or a page without content, gives an empty text.

    Pages are independent: repeated rows give repeated results, and nothing is cut whatever its length.
    """
    source = pages.select(F.col(id).cast("long").alias("_id"), F.col(url).cast("string").alias("_url"), F.col(html).alias("_html"))

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[tuple]:
            for row, address, content in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True
            ):
                text = main_text(content)
                yield row, address, text, len(text)
        return work

    return map_batches(source, "_id long, _url string, text string, n_chars long", make).select(
        F.col("_id").alias(id), F.col("_url").alias(url), "text", "n_chars"
    )
