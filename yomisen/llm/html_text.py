"""Main text of web pages: parser events to lines, text-to-tag ratios, smoothing and threshold clustering.

The standard library's parser streams a page's events.  Block elements end
lines; each line knows its characters, those of them in links, its tags and the
element it lies in (one number; elements know their parent and which lines they
hold, so a page costs its length however deep it nests).

The lines' ratios of text (without links) to tags are smoothed with a Gaussian
over all lines.  Small priors then weigh them: headings and lines in articles
more, lines that are mostly links less, lines in suspect elements (menus, footers,
forms and the like, by element, role, or a class or id made of such words) least.
Lines above a threshold cluster into regions, and every region is kept.  A region
takes in the rest of what it lies in: the lines of an element of which it is the
larger part, but not sections of it that no region touches; all of an article; the
headings right above it.  A suspect element that holds nearly all the page's text
isn't suspect: names of wrappers hide nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks

#: Element names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video head title".split())
BOILERPLATE = frozenset("nav footer aside menu dialog button select textarea option".split())
#: Elements that are boilerplate unless they hold the page.
WRAPPING = frozenset("header form fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of class and id values that name boilerplate, and words that may stand beside them in one value.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " side rail footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social comment comments disqus discussion reply replies respond related recommended widget toolbar pagination pager skip form search"
    " copyright legal disclaimer".split()
)
BESIDE_WORDS = frozenset(
    "site page global top bottom left right first last upper lower box list item items section area block wrapper wrap container inner outer bar row col"
    " column slot unit panel text link links thread user reader main primary secondary post posts and the".split()
)
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold blocks that need not belong together.
SECTIONS = frozenset("html body article main section div center aside footer header nav form fieldset dialog details".split())
#: What may lie in a head; anything else ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements that an opening tag of the same kind ends.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIGMA = 1.5
#: Lines of a table's cell that make it a part of the layout.
CELL_LINES = 3
#: Priors: what the smoothed ratio of a line is multiplied by.
IN_HEADING, IN_ARTICLE, IN_LINKS, IN_SUSPECT = 2.0, 2.0, 0.2, 0.02
#: Part of a line that makes it one of links; parts of an element, an article and the body that make the rest of it belong to a region.
LINKED, LARGER_PART, ARTICLE_PART, BODY_PART = 0.5, 0.5, 0.3, 0.8
#: A suspect element isn't, if the text outside all suspect ones is less than this part of its own (text in articles counts fourfold),
#: or if there is none and it holds half as much as the fullest.
OUTSIDE = 0.25
_WORD = re.compile(r"[a-z]+")

CLEAR, NAMED, FIRM = 0, 1, 2


def suspicion(tag: str, attrs: list[tuple[str, str | None]], inside_content: bool) -> int:
    """Whether an element is boilerplate by its kind or role (``FIRM``), by a name that may be a wrapper's (``NAMED``), or not (``CLEAR``)."""
    if tag in BOILERPLATE:
        return FIRM
    if tag in ("body", "html", *CONTENT):
        return CLEAR
    if tag in WRAPPING and not (tag == "header" and inside_content):
        return NAMED
    for key, value in attrs:
        if key == "role" and (value or "").lower() in BOILERPLATE_ROLES:
            return FIRM
        if key in ("class", "id"):
            for token in (value or "").lower().split():
                words = _WORD.findall(token)
                if any(w in BOILERPLATE_WORDS for w in words) and all(w in BOILERPLATE_WORDS or w in BESIDE_WORDS for w in words):
                    return NAMED
    return CLEAR


def is_hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for key, value in attrs:
        value = (value or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


class Page(HTMLParser):
    """Collects lines (text, tags, characters in links, element) and elements (tag, parent, suspicion, first line and end)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.linked: list[int] = []
        self.element: list[int] = []
        # element 0 is the page itself
        self.kind, self.parent, self.suspect, self.first, self.end, self.unseen = ["html"], [0], [CLEAR], [0], [-1], [False]
        self.content, self.article = [0], [0]  # the outermost article or main, and the outermost article around
        self.stack = [0]
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.n_tags = self.n_linked = 0
        self.in_link = False

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.texts.append(text)
                self.tags.append(self.n_tags)
                self.linked.append(min(self.n_linked, len(text)))
                self.element.append(self.stack[-1])
                self.n_tags = 0
            self.parts, self.n_linked = [], 0

    def _pop(self) -> None:
        number = self.stack.pop()
        self.end[number] = len(self.texts)
        self.open[self.kind[number]] -= 1
        self.in_link = False

    def _top(self) -> str:
        return self.kind[self.stack[-1]]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.n_tags += 1
        if self._top() == "head" and tag not in HEAD and tag not in ("head", "html"):
            self._pop()  # its end tag was left out
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.in_link = True
        if tag in BLOCKS:
            self._end_line()
        if tag in VOID:
            return
        if tag in SELF_CLOSING and self._top() in SELF_CLOSING[tag]:
            self._pop()
        elif tag in BLOCKS and tag != "p" and self._top() == "p":
            self._pop()
        top = self.stack[-1]
        unseen = tag in UNSEEN or is_hidden(attrs)
        suspect = suspicion(tag, attrs, self.content[top] > 0)
        if tag not in BLOCKS:
            if not unseen and not suspect:
                return  # inline: opens no element
            self.parts.append(" ") if unseen else self._end_line()
        number = len(self.kind)
        self.kind.append(tag)
        self.parent.append(top)
        self.suspect.append(suspect)
        self.first.append(len(self.texts))
        self.end.append(-1)
        self.unseen.append(unseen or self.unseen[top])
        self.content.append(self.content[top] or (number if tag in CONTENT else 0))
        self.article.append(self.article[top] or (number if tag == "article" else 0))
        self.stack.append(number)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "svg", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.n_tags += 1
        if tag == "a":
            self.in_link = False
        if not self.open[tag]:
            return
        if tag not in UNSEEN:
            self._end_line()
        while self._top() != tag:
            self._pop()
        self._pop()

    def handle_data(self, data: str) -> None:
        if self._top() == "head" and data.strip():
            self._pop()
        if not self.unseen[self.stack[-1]]:
            self.parts.append(data)
            if self.in_link:
                self.n_linked += len(data)

    def finish(self) -> Page:
        self._end_line()
        while self.stack:
            self._pop()
        return self


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends count as often as they are asked for."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _sections(page: Page) -> np.ndarray:
    """The innermost section around each element, itself included; a cell of a few lines is part of the table's."""
    out = np.zeros(len(page.kind), np.int64)
    for i in range(1, len(out)):
        own = page.kind[i] in SECTIONS or page.suspect[i] or (page.kind[i] == "td" and page.end[i] - page.first[i] >= CELL_LINES)
        out[i] = i if own else out[page.parent[i]]
    return out


def _boilerplate(page: Page, element: np.ndarray, mass: np.ndarray, in_content: np.ndarray) -> np.ndarray:
    """Which lines lie in suspect elements, but for those that hold nearly all of the page's text."""
    n = len(page.kind)
    nearest = np.zeros(n, np.int64)  # the innermost suspect element around each, itself included
    outer = np.zeros(n, np.int64)  # of a suspect element, the suspect one around it
    for i in range(1, n):
        outer[i] = nearest[page.parent[i]]
        nearest[i] = i if page.suspect[i] else outer[i]
    weight = mass * np.where(in_content, 4, 1)
    own = np.bincount(nearest[element], weight, n)
    holds = own.copy()  # with suspect elements within that have been named only
    inner: dict[int, list[int]] = {}
    for i in range(n - 1, 0, -1):
        if page.suspect[i]:
            inner.setdefault(int(outer[i]), []).append(i)
            if page.suspect[i] != FIRM:
                holds[outer[i]] += holds[i]
    cleared = np.zeros(n, bool)
    outside, queue = own[0], [(-holds[i], i) for i in inner.get(0, ()) if page.suspect[i] != FIRM]
    heapify(queue)
    most = -queue[0][0] if queue else 0.0
    while queue and (outside < OUTSIDE * -queue[0][0] or (not own[0] and queue[0][0] <= -LARGER_PART * most)):
        _, i = heappop(queue)  # the fullest first; what lies in it is judged next
        cleared[i] = True
        outside += own[i]
        for j in inner.get(i, ()):
            if page.suspect[j] != FIRM:
                heappush(queue, (-holds[j], j))
    held = np.zeros(n, bool)
    for i in range(1, n):
        held[i] = held[page.parent[i]] or (page.suspect[i] != CLEAR and not cleared[i])
    return held[element]


def regions(score: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Clusters of neighbouring lines that reach the threshold."""
    edge = np.diff((score >= threshold).astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def select(page: Page) -> list[str]:
    """The lines of all content regions, and of what they lie in."""
    n = len(page.texts)
    if not n:
        return []
    element = np.array(page.element)
    length, linked = np.array([len(x) for x in page.texts], np.float64), np.array(page.linked, np.float64)
    tags = np.array(page.tags, np.float64)
    content, article, section = (np.array(x)[element] for x in (page.content, page.article, _sections(page)))
    heading = np.array([k in HEADINGS for k in page.kind])[element]
    of_links = linked >= LINKED * length
    suspect = _boilerplate(page, element, length - linked, content > 0)
    ratio = smoothed((length - linked) / (tags + 1))
    prior = np.where(heading, IN_HEADING, 1) * np.where(content > 0, IN_ARTICLE, 1) * np.where(of_links, IN_LINKS, 1)
    score = ratio * prior * np.where(suspect, IN_SUSPECT, 1)
    if suspect.all() or not score.any():
        return []
    chosen = np.zeros(n, bool)
    for a, b in regions(score, min(ratio.std(), score.max())):
        chosen[a:b] = True
    chosen &= ~suspect
    # what the regions lie in: sections of which they are the larger part, then articles
    body = np.array([k in ("html", "body") for k in page.kind])[section]
    for group, part, members in (
        (section, np.where(body, BODY_PART, LARGER_PART), ~suspect & ~(body & of_links)),
        (article, np.full(n, ARTICLE_PART), ~suspect & (article > 0)),
    ):
        whole = np.bincount(group, length * members, len(page.kind))
        taken = np.bincount(group, length * (members & chosen), len(page.kind))
        chosen |= members & (taken[group] > 0) & (taken[group] >= part * whole[group])
    below = False
    for i in range(n - 1, -1, -1):  # a heading belongs to what it stands above
        chosen[i] |= heading[i] and below and not suspect[i]
        below = chosen[i]
    return [page.texts[i] for i in np.flatnonzero(chosen)]


def main_text(html: str | None) -> str:
    """The main text of a page, blocks joined by newlines; empty if none."""
    if not html:
        return ""
    # what never closes is text: the parser would look for its end again and again
    closed = html.rfind("-->") + 1
    html = html[:closed] + html[closed:].replace("<!--", " ")
    ended = html.rfind(">") + 1
    page = Page()
    page.feed(html[:ended])
    page.close()
    if tail := html[ended:]:
        page.handle_data(unescape(tail))
    return "\n".join(select(page.finish()))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``.

    Null and empty pages give an empty text; broken markup is read as far as it
    goes, and what never closes is text; a page costs its length however it nests;
    repeats repeat; no rows give none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in EXTRACTED.split(", ")])

    return pages.select("page_id", "url", "html").mapInArrow(run, EXTRACTED)
