"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams events; block elements cut the page into lines, each with
its text, the tags met in it and its place in the element tree. The text-to-tag ratios are smoothed
by a Gaussian and split in two clusters by a threshold. Names and kinds of elements are evidence of
boilerplate only as far as the clusters agree: an element that holds most text of the upper cluster
is none, nor is a name whose elements do. Without the lines of boilerplate the ratios are clustered
again; the regions of the upper cluster choose the element that holds the content, and every line
of that element that is not boilerplate is kept, however short.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTHING_RADIUS = 2
# A line's smoothed ratio above this share of the standard deviation is content.
THRESHOLD_DEVIATIONS = 1.0
# Share of the chosen text that an element must hold to be the content's.
CORE_SHARE = 0.95

# Share of the upper cluster's text above which an element or a name is no boilerplate, and the same
# for readers' comments, which can be longer than the article.
MOST_SHARE = 0.5
COMMENT_SHARE = 0.95

# Elements whose text is never shown.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas textarea select".split())
# Elements that are not the article.
BOILERPLATE = frozenset("nav header footer aside form menu dialog button fieldset".split())
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split()
)
# Words of class and id names of elements that are not the article.
BOILERPLATE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation
    menu breadcrumb breadcrumbs sidebar header masthead topbar footer cookie cookies consent gdpr notice alert popup
    modal overlay newsletter subscribe subscription signup login share sharing social related recommended
    recommendations comment comments commentlist reply replies respond disqus widget pagination pager toolbar skip
    copyright""".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist reply replies respond disqus".split())
# First words of a name that tell what an element has or has not, not what it is.
TELLING = frozenset("no not non without has have with is if hide hidden".split())
# Beside these words a header is the article's own.
OWN_HEADER = frozenset("entry post article story content title headline".split())
# Kinds of elements that may also stand around a whole page.
AROUND_PAGES = frozenset("<form> <fieldset> <header> <role>".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th
    thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body html blockquote".split())
# A start tag of the key ends an open element of the values, as browsers do.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
# Elements that a head may hold; any other one closes it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def boilerplate_words(names: str) -> set[str]:
    """The words of class or id names that are evidence of boilerplate."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in _NAME_WORDS.findall(name)]
        if words and words[0] not in TELLING:
            found.update(w for w in words if w in BOILERPLATE_NAMES and (w != "header" or OWN_HEADER.isdisjoint(words)))
    return found


class Line:
    """Text between two block borders."""

    __slots__ = ("parts", "tags", "place", "hidden", "mark")

    def __init__(self, place: int, hidden: bool, mark: int):
        self.parts: list[str] = []
        self.tags = 0
        self.place = place
        self.hidden = hidden
        self.mark = mark


class PageLines(HTMLParser):
    """Lines of one page, in page order, and the containers they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Open elements: name, whether text is silent, whether it is hidden, container, mark.
        self.open: list[tuple[str, bool, bool, int, int]] = [("", False, False, -1, -1)]
        self.named: Counter[str] = Counter()
        # Name and outer container of each container; outer ones come first.
        self.names: list[str] = []
        self.outer: list[int] = []
        # Elements with evidence of boilerplate: the evidence, and the next such element around.
        self.evidence: list[frozenset[str]] = []
        self.around: list[int] = []
        self.lines: list[Line] = []
        self._cut()

    def _cut(self) -> None:
        _, _, hidden, place, mark = self.open[-1]
        if self.lines and not self.lines[-1].parts:
            self.lines.pop()
        self.lines.append(Line(place, hidden, mark))

    def _close(self, at: int) -> None:
        gone = self.open[at:]
        del self.open[at:]
        self.named.subtract(entry[0] for entry in gone)
        if any(entry[0] in BLOCKS for entry in gone):
            self._cut()

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            # An unknown declaration is skipped like a comment.
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag, attrs):
        self.lines[-1].tags += 1
        if self.named["head"] > 0 and (tag == "body" or (self.open[-1][0] == "head" and tag not in IN_HEAD)):
            self._close(next(k for k in range(len(self.open) - 1, 0, -1) if self.open[k][0] == "head"))
        if tag in VOID:
            if tag == "br":
                self.lines[-1].parts.append(" ")
            elif tag == "hr":
                self._cut()
            return
        if tag in CLOSES or (tag in BLOCKS and self.named["p"]):
            for at in range(len(self.open) - 1, 0, -1):
                name = self.open[at][0]
                if name in CLOSES.get(tag, ()) or (name == "p" and tag in BLOCKS):
                    self._close(at)
                    break
                if name in BLOCKS:
                    break
        _, silent, hidden, place, mark = self.open[-1]
        told = {key: value or "" for key, value in attrs}
        found = {f"<{tag}>"} if tag in BOILERPLATE else set()
        if told.get("role", "").lower() in BOILERPLATE_ROLES:
            found.add("<role>")
        if tag not in ("html", "body", "main", "article"):
            found |= boilerplate_words(told.get("class", "")) | boilerplate_words(told.get("id", ""))
            unseen = "hidden" in told or told.get("aria-hidden", "").lower() == "true"
            hidden = hidden or unseen or _UNSEEN.search(told.get("style", "")) is not None
        if found:
            self.evidence.append(frozenset(found))
            self.around.append(mark)
            mark = len(self.evidence) - 1
        if tag in CONTAINERS:
            self.names.append(tag)
            self.outer.append(place)
            place = len(self.names) - 1
        self.open.append((tag, silent or tag in SILENT, hidden, place, mark))
        self.named[tag] += 1
        if tag in BLOCKS:
            self._cut()
            self.lines[-1].tags = 1

    def handle_endtag(self, tag):
        self.lines[-1].tags += 1
        if self.named[tag] > 0:
            at = next(k for k in range(len(self.open) - 1, 0, -1) if self.open[k][0] == tag)
            self._close(at)

    def handle_data(self, data):
        if self.open[-1][0] == "head" and data.strip():
            self._close(len(self.open) - 1)
        if not self.open[-1][1]:
            self.lines[-1].parts.append(data)


def smoothed(ratios: np.ndarray, radius: int = SMOOTHING_RADIUS) -> np.ndarray:
    """Gaussian smoothing with mirrored ends."""
    at = np.arange(-radius, radius + 1)
    kernel = np.exp(-(at ** 2) / (2.0 * radius))
    kernel /= kernel.sum()
    padded = np.pad(ratios, radius, mode="symmetric") if len(ratios) else ratios
    return np.convolve(padded, kernel, mode="valid") if len(ratios) else ratios


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines lie in the upper cluster of smoothed ratios."""
    smooth = smoothed(ratios)
    level = min(THRESHOLD_DEVIATIONS * smooth.std(), smooth.mean()) if len(smooth) else 0.0
    return smooth >= max(level, 1e-9)


def boilerplate(parser: PageLines, lines: list[tuple[str, int, int, int]]) -> list[bool]:
    """For each marked element whether its lines are boilerplate: it is marked, and the upper cluster
    agrees that it, and all elements of one of its names, hold no more than their share. Navigation, footers and
    the like are boilerplate whatever they hold."""
    marks = len(parser.evidence)
    chosen = content_lines(np.array([len(text) / max(tags, 1) for text, tags, *_ in lines]))
    weight, total = [0] * marks, 0
    named: Counter[str] = Counter()
    whole: list[frozenset[str]] = []
    for evidence, around in zip(parser.evidence, parser.around):
        whole.append(evidence | whole[around] if around >= 0 else evidence)
    for (text, _, _, mark), wanted in zip(lines, chosen):
        if wanted:
            total += len(text)
            if mark >= 0:
                weight[mark] += len(text)
                for word in whole[mark]:
                    named[word] += len(text)
    for mark in range(marks - 1, -1, -1):
        if parser.around[mark] >= 0:
            weight[parser.around[mark]] += weight[mark]

    def most(words: frozenset[str]) -> float:
        if any(w[0] == "<" and w not in AROUND_PAGES for w in words):
            return total
        return (MOST_SHARE if words.isdisjoint(COMMENT_NAMES) else COMMENT_SHARE) * total

    out: list[bool] = []
    for evidence, around, held in zip(parser.evidence, parser.around, weight):
        # The kind of an element speaks for itself alone, a name for all elements that have it.
        left = [w for w in evidence if w[0] == "<" or named[w] <= most(frozenset([w]))]
        out.append((around >= 0 and out[around]) or (bool(left) and held <= most(evidence)))
    return out


def main_text(html: str | None) -> str:
    """Main text of a page; empty for a NULL or empty page and for one without content."""
    parser = PageLines()
    parser.feed(html or "")
    parser.close()
    shown = [
        (text, line.tags, line.place, line.mark)
        for line in parser.lines if not line.hidden and (text := " ".join("".join(line.parts).split()))
    ]
    dropped = boilerplate(parser, shown) if parser.evidence else []
    lines = [(text, tags, place) for text, tags, place, mark in shown if mark < 0 or not dropped[mark]]
    if not lines:
        return ""
    chosen = content_lines(np.array([len(text) / max(tags, 1) for text, tags, _ in lines]))
    # The innermost article or main elements of the chosen lines are content as a whole, or the
    # outermost ones where the inner ones lack some of their chosen text; without them, the innermost element above nearly all of the chosen text is: smoothing also lifts a
    # short line beside long ones.
    names, outer = parser.names, parser.outer
    weight, holds = [0] * len(names), [False] * len(names)
    for (text, _, place), wanted in zip(lines, chosen):
        if wanted and place >= 0:
            weight[place] += len(text)
    inner = set()
    for place in range(len(names) - 1, -1, -1):
        article = names[place] in ("article", "main") and weight[place] > 0
        if article and not holds[place]:
            inner.add(place)
        if outer[place] >= 0:
            weight[outer[place]] += weight[place]
            holds[outer[place]] |= holds[place] or article
    total = sum(len(text) for (text, *_), wanted in zip(lines, chosen) if wanted)
    held = sum(weight[p] for p in inner)
    # Outer ones hold what the inner ones hold, and more: the inner ones take their place only when
    # they hold nearly all of it.
    outermost = set()
    above = [False] * len(names)
    for place in range(len(names)):
        article = names[place] in ("article", "main") and weight[place] > 0
        up = outer[place] >= 0 and above[outer[place]]
        if article and not up:
            outermost.add(place)
        above[place] = up or article
    around = sum(weight[p] for p in outermost)
    if inner and held >= 0.5 * total and held >= CORE_SHARE * around:
        homes = inner
    elif outermost and around >= 0.5 * total:
        homes = outermost
    else:
        homes = {max((p for p, w in enumerate(weight) if w >= CORE_SHARE * total), default=-1)}
    inside = [False] * len(names)
    for place in range(len(names)):
        inside[place] = place in homes or (outer[place] >= 0 and inside[outer[place]])
    return " ".join(text for text, _, place in lines if homes == {-1} or (place >= 0 and inside[place]))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``.

    A NULL or empty ``html`` and a page without content give an empty text. Every row is parsed by
    itself, so repeated rows and NULL ids need no rule; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
