"""HTML main-text extraction by text-to-tag ratio.

The standard library's parser streams events. Block elements cut the page into lines, each with its decoded text, the
tags met in it and the sections it lies in. All lines that a reader sees take part in the clustering, those of menus, forms
or footers too; but lines under elements that are boilerplate by tag or role can never be content. A class or id only marks
an element as boilerplate: the mark falls where the element holds an article or nearly all of the text that clusters high
(comments and the like only if nothing else clusters high), and ``article`` and ``main`` are never marked by name.

The ratio of text characters to tags is, on a log scale, smoothed with a Gaussian and clustered into two levels (a threshold
half way between the cluster means, moved until it rests). The high lines choose the region: ``article`` and ``main`` elements
that they fill, as long as these hold most of the high text. Else it is the innermost section that holds nine tenths of the
text of the high lines, and beside it and the sections around it the sections of mostly high lines and single high lines. All
lines of these regions are kept, short ones too; only where the whole body is the region, sections of several mostly low
lines at its two ends are menus. Without a high line there is no text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SIGMA = 1.0
PLENTY = 100  # characters a tag; more say no more
APART = 1.0  # levels of logs that are no further apart are one level
NEARLY = 0.9  # of the text of the high lines
MENU = 3  # lines at least
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
                  "p pre search section summary table tbody td tfoot th thead title tr ul".split())
SECTION = frozenset("article body div main section td".split())
CHOSEN = frozenset(("article", "main"))
BOILERPLATE = frozenset("annotation annotation-xml aside audio button canvas datalist dialog embed footer form frame frameset head iframe input "
                        "label menu nav noscript object option script search select style svg template textarea "
                        "title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
                  "status toolbar".split())
NAMES = frozenset("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
                  "comments commentlist consent cookie cookies discussion disqus footer gdpr header masthead menu modal "
                  "nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
                  "promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor "
                  "sponsored subscribe subscription teaser toolbar widget".split())
#: boilerplate that a reader does not see, or not as text: it does not take part in the clustering either
UNSEEN = frozenset("annotation annotation-xml audio canvas datalist embed frame frameset head iframe input noscript object script "
                   "style svg template title video".split())
CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
          "th": ("tr", "table"), "option": ("select",)}
HEADERS = frozenset(("header", "masthead", "banner"))
#: names whose elements hold other articles than the page's own
OTHERS = frozenset("comment comments commentlist discussion disqus recommended related replies reply respond teaser".split())
#: parts of a name that tell how a page is laid out or what is open on it: 'with-sidebar', 'menu-open', 'tag-ads'
STATES = frozenset("active category closed collapsed disabled enabled expanded has is layout no not off on open opened tag "
                   "tagged template visible with without".split())
NEVER = -1  # the mark of seen boilerplate: it is clustered with the other lines, and never falls
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNFINISHED = re.compile(r"<[/!?A-Za-z][^<>]*\Z")  # a tag that the page's end cuts off


class Lines(HTMLParser):
    """Events to lines: text, tags, section numbers from the outside in, chosen section or 0, pieces.

    Pieces are None, or (data, marks) where some of the line lies in elements that are marked as boilerplate by name.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple, int, list | None]] = []
        #: tag, section number or 0, unseen, nearest chosen, marks by name or NEVER
        self.open: list[tuple[str, int, bool, int, tuple]] = []
        self.text: list[tuple[str, tuple]] = []
        self.others: list[bool] = []  # of every mark: its name is one of OTHERS
        self.starts: list[tuple[str, tuple]] = []  # of every article and main: tag, marks around it
        self.tags = self.sections = self.body = 0

    def flush(self) -> None:
        text = " ".join("".join([data for data, _ in self.text]).split())
        if text:
            path = tuple(x[1] for x in self.open if x[1])
            pieces = self.text if any(marks for _, marks in self.text) else None
            self.lines.append((text, self.tags, path, self.open[-1][3] if self.open else 0, pieces))
        if text or self.tags > 8:
            self.tags = 0
        self.text = []

    def _close_to(self, at: int) -> None:
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
            for at in range(len(self.open) - 1, -1, -1):  # an open paragraph ends here, and so does an item's sibling
                name = self.open[at][0]
                if name == "p" or (tag in CLOSES and name == tag):
                    self._close_to(at)
                    break
                if name in SECTION or name in CLOSES.get(tag, ()) or (name in BLOCK and tag not in CLOSES):
                    break
        elif tag == "br":
            self.text.append((" ", ()))
        self.tags += 1
        if tag in VOID:
            return
        above = self.open[-1] if self.open else ("", 0, False, 0, ())
        chosen = above[3]
        number = 0
        if tag in SECTION:
            self.sections += 1
            number = self.sections
            if tag == "body":
                self.body = number
            if tag in CHOSEN:
                chosen = number
        inside = any(x[0] in CHOSEN for x in self.open)  # a header there is the article's own
        marks = above[4]
        unseen = above[2] or tag in UNSEEN
        bad = NEVER in marks or tag in BOILERPLATE or (tag == "header" and not inside)
        if attrs and not unseen and tag not in ("html", "body"):
            unseen, role = _hidden(attrs)
            bad = bad or unseen or role
            names = () if bad or tag in CHOSEN else _boilerplate_names(attrs, HEADERS if inside else frozenset())
            if names:
                marks = (*marks, len(self.others))
                self.others.append(not OTHERS.isdisjoint(names))
        if bad and NEVER not in marks:
            marks = (*marks, NEVER)
        if tag in CHOSEN and not bad and not unseen:
            self.starts.append((tag, marks))
        self.open.append((tag, number, unseen, chosen, marks))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag:
                self._close_to(at)
                return
            if name in SECTION and tag not in BLOCK:  # a stray end of something inline
                return

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][2]):
            self.text.append((data, self.open[-1][4] if self.open else ()))

    def without_marks(self) -> set[int]:
        """Marks that fall: around main; around an article, unless its name is one of OTHERS and other articles are free."""
        free = {m for tag, marks in self.starts for m in marks if m != NEVER and (tag == "main" or not self.others[m])}
        if self.starts and not any(free.issuperset(marks) for _, marks in self.starts):
            free = {m for _, marks in self.starts for m in marks if m != NEVER}
        return free

    def kept(self, free: set[int], high: np.ndarray) -> list[tuple]:
        """(line, high) of the lines, without what stands under a mark that is not free."""
        found = []
        for line, h in zip(self.lines, high):
            if line[4]:
                text = " ".join("".join([data for data, marks in line[4] if free.issuperset(marks)]).split())
                line = (text, *line[1:])
            if line[0]:
                found.append((line, h))
        return found


def _hidden(attrs: list) -> tuple[bool, bool]:
    """Whether the attributes hide the element, and whether they give it a boilerplate role."""
    hidden = role = False
    for name, value in attrs:
        value = (value or "").lower()
        hidden |= (name == "hidden" or name == "aria-hidden" and value == "true"
                   or name == "style" and "display:none" in value.replace(" ", ""))
        role |= name == "role" and value in ROLES
    return hidden, role


def _boilerplate_names(attrs: list, but: frozenset) -> list[str]:
    """Boilerplate names that begin or end a class or id."""
    found = []
    for name, value in attrs:
        for token in (value or "").split() if name in ("class", "id") else ():
            words = _NAME.findall(_CAMEL.sub(" ", token).lower())
            if words and STATES.isdisjoint(words):
                found += [w for w in (words[0], words[-1]) if w in NAMES and w not in but]
    return found


def threshold(x: np.ndarray) -> float:
    """Half way between the means of the low and the high values, moved until it rests."""
    t = x.mean()
    for _ in range(50):
        low, high = x[x < t], x[x >= t]
        if not len(low):
            return t
        new = (low.mean() + high.mean()) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    near = np.convolve(np.ones(len(x)), kernel, mode="full")[r:r + len(x)]
    return np.convolve(x, kernel, mode="full")[r:r + len(x)] / near  # at the ends the weights there are share the whole


def high_lines(lines: list[tuple]) -> np.ndarray:
    """Which lines the clustering puts into the level of more text for a tag."""
    if not lines:
        return np.zeros(0, dtype=bool)
    ratio = np.array([len(line[0]) / max(1, line[1]) for line in lines])
    x = smoothed(np.log1p(np.minimum(ratio, PLENTY)))
    high = x >= threshold(x)
    if not high.all() and x[high].mean() - x[~high].mean() < APART:
        high[:] = True
    return high


def _clustered_free(parser: Lines, free: set[int], high: np.ndarray) -> set[int]:
    """Marks of elements that hold nine tenths of the text of all high lines that may be content, in several lines.

    A single line's mark only falls if no other line is high, and one of OTHERS only if no article either is outside it:
    neither a notice nor comments become the article by their length.
    """
    weight: dict[int, int] = {}
    lines_of: dict[int, set[int]] = {}
    total = 0
    for i, (line, h) in enumerate(zip(parser.lines, high)):
        for data, marks in (line[4] or ((line[0], ()),)) if h else ():
            if NEVER not in marks:
                n = len(" ".join(data.split()))
                total += n
                for m in marks:
                    weight[m] = weight.get(m, 0) + n
                    lines_of.setdefault(m, set()).add(i)
    alone = not any(free.issuperset(marks) for _, marks in parser.starts)
    return {m for m, w in weight.items() if (alone and w == total if parser.others[m] else
                                             w == total or w >= NEARLY * total and len(lines_of[m]) > 1)}


def _chosen(lines: list[tuple], high: np.ndarray) -> set[int]:
    """The articles and mains that the clusters fill: mostly high text, or half of all high text. They set the region's ends.

    None if high text outside of them outweighs what is in them.
    """
    weight: dict[int, int] = {}
    size: dict[int, int] = {}
    for line, h in zip(lines, high):
        weight[line[3]] = weight.get(line[3], 0) + len(line[0]) * h
        size[line[3]] = size.get(line[3], 0) + len(line[0])
    total = sum(weight.values())
    found = {s for s, w in weight.items() if s and w and (2 * w >= size[s] or 2 * w >= total)}
    return found if 2 * sum(weight[s] for s in found) >= total else set()


def main_text(html: str | None) -> str:
    """The blocks of the main content in page order, joined by newlines; empty if there are none."""
    parser = Lines()
    parser.feed(_UNFINISHED.sub("", html or ""))
    parser.close()
    parser.flush()
    free = parser.without_marks()
    high = high_lines(parser.lines)
    kept = parser.kept(free | _clustered_free(parser, free, high), high)
    lines, high = [line for line, _ in kept], np.array([h for _, h in kept], dtype=bool)
    if not high.any():  # boilerplate may be all that clusters high: what is left is clustered by itself
        high = high_lines(lines)
    if not high.any():
        return ""
    chosen = _chosen(lines, high)
    if chosen:
        return "\n".join(line[0] for line in lines if line[3] in chosen)
    # characters of the high lines, and of all lines, in each section
    weight: dict[int, int] = {}
    size: dict[int, int] = {}
    count: dict[int, int] = {}
    total = 0
    for (text, _, path, _, _), h in zip(lines, high):
        total += len(text) * h
        for s in path:
            weight[s] = weight.get(s, 0) + len(text) * h
            size[s] = size.get(s, 0) + len(text)
            count[s] = count.get(s, 0) + 1
    deep = [s for s, w in weight.items() if w >= NEARLY * total]
    if not deep:
        return "\n".join(line[0] for line in lines)
    best = max(deep)  # each of them lies in the one before
    around = set(deep)

    parts = {line[2][1] for line in lines if best == parser.body and line[2][:1] == (best,) != line[2]}
    texts = [s for s in parts if 2 * weight[s] >= size[s]]
    menus = {s for s in parts if texts and count[s] >= MENU and 2 * weight[s] < size[s]
             and not min(texts) < s < max(texts)}

    def content(path: tuple, h: bool) -> bool:
        if best in path:
            return menus.isdisjoint(path)
        beside = next((s for s in path if s not in around), None)
        return h if beside is None else 2 * weight[beside] >= size[beside]

    return "\n".join(line[0] for line, h in zip(lines, high) if content(line[2], h))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The ``keep`` columns and (text, n_chars) for every page.

    Null, empty and textless pages have the empty text; broken markup is read as far as the parser can tell; nothing of
    the kept regions is dropped or cut, however long. Repeated rows each return a row.
    """
    clash = {"text", "n_chars"}.intersection(c.lower() for c in keep)
    if clash:
        raise ValueError(f"kept columns {sorted(clash)} have the names of results: rename them first")
    src = pages.select(F.struct(*keep).alias("_at"), F.col(html_col).alias("_html"))

    def kernel(texts: list) -> list[pa.Array]:
        out = [main_text(t) for t in texts]
        return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

    found = map_texts(src, "_at", "_html", "text string, n_chars bigint", kernel)
    return found.select("_at.*", "text", "n_chars")
