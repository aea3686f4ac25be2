"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; each block of a page is a line with its text and its number of tags.  A
line's ratio is its running text per tag: text inside links doesn't run, nor does any in parts that are never
content (menus, headers, footers, asides, forms, notices, adverts, reader comments, by element, role or class).
The ratios are smoothed with a Gaussian, and lines above the threshold (the smoothed ratios' standard deviation, at
most their mean) are seeds.  Seeds cluster by the section that holds them (article or main, or for the lines outside
of those the innermost container of nearly all their seeds).  Every article or main with seeds is a content region; the
container is one where its seeds weigh more than half of all.  All lines of a region whose ratio isn't zero stay, short
paragraphs and headings included, and so do lines of links alone, but for three list items or more in a row, which are a
menu.  Outside of the regions a line stays if it is a seed and its own ratio passes the threshold too.

Nulls, empty pages and pages without running text give an empty text; an empty table gives an empty result.  Whole pages are
parsed, however long or deep: the work grows with the page.  Repeated rows are extracted one by one.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside form dialog menu".split())
UNSEEN = frozenset("script style noscript template head title select button textarea iframe svg object canvas".split())  # no text at all
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div body td".split())
SECTIONS = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Words of class or id that mark a part as none of the article's, where they are the last word of a name ...
MARKS = frozenset(
    """ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies
    disqus footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices notification notifications
    pagination popup promo promotion recommendations recommended related replies reply respond share sharing sidebar signup social
    sponsor sponsored sponsors subscribe teaser teasers toolbar topbar widget widgets""".split()
)
#: ... but for words that only say how it is laid out.
LAYOUT = frozenset(
    """area bar block body bottom box buttons col column container content group holder icons inner item items left line link links list media middle outer
    panel right row section slot text top unit wrap wrapper""".split()
)
NAME_PARTS = re.compile(r"[-_\d]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none")
SIGMA = 1.0
MENU = 3  # lines of links alone in a row
NEARLY = 0.9  # of the seeds


class Line:
    __slots__ = ("text", "tags", "running", "barred", "item", "section")

    def __init__(self, section: int):
        self.text, self.tags, self.running, self.barred, self.item, self.section = [], 0, 0, False, False, section


def _named(name: str) -> bool:
    """Whether a name of a class or id ends in a mark, layout words aside: `cookie-notice-box`, not `notice-of-sale`."""
    parts = [p.lower() for p in NAME_PARTS.split(name) if p]
    while len(parts) > 1 and parts[-1] in LAYOUT:
        parts.pop()
    return bool(parts) and parts[-1] in MARKS


def _marked(tag: str, a: dict[str, str | None]) -> bool:
    """Whether the attributes of an element say that it is none of the article's."""
    if (a.get("role") or "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    names = f"{a.get('class') or ''} {a.get('id') or ''}".split()
    return any(_named(n) for n in names) or "style" in a and HIDDEN.search(a["style"] or "") is not None


class Lines(HTMLParser):
    """Streams a page into lines: one per block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int]] = []  # tag, 1 if it starts a part that is never content (2: without text), section
        self.count: dict[str, int] = {}  # how many of each tag are open
        self.barred = self.unseen = 0
        self.links = 0
        self.lines: list[Line] = []
        self.sections: list[tuple[str, int]] = [("root", -1)]
        self.now = Line(0)

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not wanted

    def _section(self) -> int:
        return self.open[-1][2] if self.open else 0

    def cut(self) -> None:
        if self.now.text:
            self.lines.append(self.now)
            self.now = Line(self._section())
        else:
            self.now.section = self._section()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        now = self.now
        if tag in VOID:
            if tag == "hr":
                self.cut()
            elif tag == "br" and not self.unseen:
                now.text.append(" ")
            self.now.tags += 1
            return
        block = tag in BLOCKS
        if block:
            self._close_p(tag)
            self.cut()
        bar = 2 if tag in UNSEEN else 1 if tag in NEVER else 0
        if not bar and not self.barred:
            if attrs:
                bar = int(_marked(tag, dict(attrs)))
            if tag == "header" and not bar:
                bar = int(not any(self.count.get(t) for t in SECTIONS))
        section = self.open[-1][2] if self.open else 0
        if tag in CONTAINERS:
            self.sections.append((tag, section))
            section = len(self.sections) - 1
        self.open.append((tag, bar, section))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.barred += bar == 1
        self.unseen += bar == 2
        if tag == "a":
            self.links += 1
        if block:
            self.now.section = section
        self.now.tags += 1

    def _close_p(self, tag: str) -> None:
        """A block's start ends an open paragraph (with what is open inside it), as browsers do."""
        for i in range(len(self.open) - 1, -1, -1):
            t = self.open[i][0]
            if t == "p" or (t in HEADINGS and tag in HEADINGS):
                self._pop(i)
                self.cut()
                return
            if t in BLOCKS or t in ("table", "button", "object"):
                return

    def _pop(self, at: int) -> None:
        while len(self.open) > at:
            tag, bar, _ = self.open.pop()
            self.count[tag] -= 1
            self.barred -= bar == 1
            self.unseen -= bar == 2
            self.links -= tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.now.tags += 1
        block = tag in BLOCKS
        if self.count.get(tag):
            for i in range(len(self.open) - 1, -1, -1):
                t = self.open[i][0]
                if t == tag:
                    if block:
                        self.cut()
                    self._pop(i)
                    break
                if t in BLOCKS and not block:
                    break  # an inline end tag does not reach across the block around it
        if block:
            self.cut()

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        if data:
            now = self.now
            if not now.text:
                now.section, now.barred, now.item = self._section(), self.barred > 0, self.count.get("li", 0) > 0
            now.text.append(data)
            if not self.links and not self.barred:
                now.running += len(data.strip())


_REACH = max(1, int(2 * SIGMA + 0.5))
_KERNEL = np.exp(-0.5 * (np.arange(-_REACH, _REACH + 1) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()


def smooth(x: list[float]) -> np.ndarray:
    """`x` under a Gaussian, its ends carried on."""
    return np.convolve([x[0]] * _REACH + x + [x[-1]] * _REACH, _KERNEL, mode="valid")


def ratios(lines: list[tuple[str, Line]]) -> list[float]:
    """Running text per tag of each line."""
    return [x.running / max(1, x.tags) for _, x in lines]


def lines_of(html: str) -> tuple[list[tuple[str, Line]], list[tuple[str, int]]]:
    """(lines with text, sections with the number of the section around)."""
    p = Lines()
    p.feed(html)
    p.close()
    p.cut()
    return [(t, x) for x in p.lines if (t := " ".join("".join(x.text).split()))], p.sections


def extract(html: str | None) -> str:
    """The main text: blocks in page order, joined by an empty line."""
    rows, sections = lines_of(html or "")
    if not rows:
        return ""
    raw = ratios(rows)
    ratio = smooth(raw)
    threshold = min(float(ratio.std()), float(ratio.mean()))
    seed = [r >= threshold and own > 0 for r, own in zip(ratio.tolist(), raw)]
    inside = regions(sections, [(x.section, len(t)) for (t, x), yes in zip(rows, seed) if yes])
    out, menu = [], []
    for (t, x), own, yes in zip(rows, raw, seed):
        if not inside[x.section] and not (yes and own >= threshold) or x.barred and own == 0:
            continue
        if own == 0 and x.item:
            menu.append(t)
            continue
        out += menu if len(menu) < MENU else []  # a few items of links alone are text, more are a menu
        out.append(t)
        menu = []
    return "\n\n".join(out + (menu if len(menu) < MENU else []))


def regions(sections: list[tuple[str, int]], seeds: list[tuple[int, int]]) -> list[bool]:
    """Which sections are content, by the sections and lengths of the seeds; a section comes after the one around it."""
    n = len(sections)
    weight, rest = [0] * n, [0] * n  # the seeds inside, and those of them outside of article and main
    named = [False] * n
    for i, (tag, up) in enumerate(sections):
        named[i] = tag in SECTIONS or up >= 0 and named[up]
    for s, length in seeds:
        weight[s] += length
        if not named[s]:
            rest[s] += length
    total = sum(length for _, length in seeds)
    for i in range(n - 1, 0, -1):
        weight[sections[i][1]] += weight[i]
        rest[sections[i][1]] += rest[i]
    # An article that holds nearly all of what is around it stands for that.
    inner = [0] * n
    for i in range(n - 1, 0, -1):
        up = sections[i][1]
        inner[up] += weight[i] if sections[i][0] in SECTIONS else inner[i]
    chosen = [sections[i][0] in SECTIONS and weight[i] > 0 and inner[i] < NEARLY * weight[i] for i in range(n)]
    around = -1
    if 2 * rest[0] > total:
        around = max(i for i in range(n) if not named[i] and rest[i] >= NEARLY * rest[0])
    inside = [False] * n
    for i, (_, up) in enumerate(sections):
        inside[i] = chosen[i] or i == around or up >= 0 and inside[up]
    return inside


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url string, text string, n_chars long")
