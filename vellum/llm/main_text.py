"""Main text of web pages by text-to-tag ratios.

The standard library's parser is fed a page in pieces; its events become blocks (the lines of a
page without its markup), each with its text, its count of tags and the elements it stands in.
A block's ratio is its text's length per tag; blocks inside menus, forms, adverts and the like have
none, and such elements within a line are left out of its text. Elements are known by their tags and by
names in class, id and role; a name says nothing of an element that holds most of the page's text, nor one
that may be a subject's (related-work, share-price, discussion) of a part of the content region whose text
is of the high cluster. Both are known only after parsing: such a page is parsed again with those
elements' names disregarded. The ratios are smoothed by a Gaussian along the page and cut in two by threshold clustering.
The content region is then made whole: an article or main that holds nearly all of the high cluster's
text is taken, else the innermost sectioning element that does, widened to the outermost one around it
that adds no part of the page's frame (menu, header, footer, sidebar). All its blocks that are not
excluded are the main text, short ones too. A page whose region is its whole body keeps what lies between
the first and last high block. Such regions go on up to the page's frame, to lines of links, or to blocks
of the low cluster that have a tag every few characters, at least two in a row.

Defined results: null, empty and text-free pages give an empty string; repeated rows give repeated
results; an empty table gives no rows; pages of any length are read whole; only three columns of
the input are read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches, small_batches

CHUNK = 1 << 16
SIGMA = 1.5
#: Share of the high cluster's text that the content element must hold.
MOST = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split()
)
SPACES = frozenset("br td th wbr img input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never an article's.
NOT_TEXT = frozenset("head title script style noscript template nav footer aside form button select textarea iframe object svg canvas audio video menu dialog map".split())
#: Of these, the ones that stand within a line and may hold blocks, which do not end that line.
_WITHIN = frozenset("button select object svg canvas audio video iframe".split())
#: Names in class, id and role that mark parts of a page beside its article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related replies reply responses search share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements and names of the page's frame, which a content region is never widened over.
FRAME = frozenset("banner contentinfo header masthead menu nav navbar navigation sidebar".split())
#: Share of a line's characters that stand in links, from which on it is a line of links.
LINKED = 0.7
#: Of the marks, those of readers' contributions, which may be longer than the article they stand below.
TALK = frozenset("comment comments discussion disqus replies reply responses".split())
#: Share of the page's text from which on a name doesn't exclude an element.
WRAPS = 0.5
#: Shares of a part's text in the high cluster, at least, and in links, at most, for its ratio to say that it is content.
OF_HIGH, OF_LINKS = 0.5, 0.3
#: Words that add nothing to a mark in a name; any other makes it the name of a subject (related-work, share-price).
PLAIN = frozenset("area article articles bar block body bottom box btn button buttons col container content count for global group head heading icon icons inner item items label left lg link links list main md module more navbar nested outer page panel popular post posts primary recent region right row secondary section share sidebar site small sm stories story the thread title top widget wrap wrapper".split())
#: Marks that are headings of articles as well, alone too.
ALSO_HEADINGS = frozenset(("discussion",))
_NAME = re.compile(r"[a-z]+")
#: What a name has or lacks says nothing of the element itself: has-sidebar, page-with-comments, no-ads.
_MODIFIED = re.compile(r"(?:(?<=\s)|^|(?<=[-_]))(?:has|with|without|no)[-_]\S*")
#: Names of a header that belongs to an article, wherever it stands.
_OF_ARTICLE = re.compile(r"(?:^|\s)(?:post|entry|article|story|content)[-_]+header(?=\s|$)")
_A_HEADER = re.compile(r"(?:^|\s)(?:\S+[-_])?header(?=\s|$)")
#: Characters per tag, beyond the tags of a block's own element, under which a low block is markup rather than text.
DENSE, OWN_TAGS = 12, 3
#: Elements that may hold the content region; a list, table, quotation or listing is a part of it.
_HOLDERS = frozenset(("html", "body", "article", "main", "section", "div"))
#: Elements that an opening article or main ends if their own end is missing.
_ENDED = frozenset(("nav", "header", "footer", "form", "menu"))


def _hidden(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return tag not in ("html", "body")
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _names(attrs: list[tuple[str, str | None]]) -> set[str]:
    """Names in class, id and role, without modifiers."""
    found: set[str] = set()
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            found.update(_NAME.findall(_MODIFIED.sub(" ", value.lower())))
    return found


def _marks(tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
    """The marks that a tag's names bear."""
    if not attrs or tag in ("html", "body"):
        return set()
    names = _names(attrs)
    if tag in ("article", "main"):
        names &= {"comment", "comments", "reply", "replies", "related", "sidebar", "ad", "ads", "advert", "sponsored"}
    return names & MARKS


def _of_subject(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether every name with a mark may as well be that of a subject, so that the ratio must decide."""
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for one in _MODIFIED.sub(" ", value.lower()).split():
                words = _NAME.findall(one)
                if (marked := MARKS.intersection(words)) and not marked <= ALSO_HEADINGS and all(w in PLAIN or w in MARKS or len(w) < 3 for w in words):
                    return False
    return True


def _header_of(attrs: list[tuple[str, str | None]], pattern: re.Pattern) -> bool:
    return any(name in ("class", "id") and value and pattern.search(value.lower()) for name, value in attrs)


def _framed(attrs: list[tuple[str, str | None]]) -> bool:
    return not FRAME.isdisjoint(_names(attrs))


class BlockParser(HTMLParser):
    """Collects blocks: (text, tags, ids of the open elements, excluded, links if it is a line of links, inside the page's frame, excluded by a tag, characters in links)."""

    def __init__(self, wraps: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.wraps = wraps  # ids of elements whose names are disregarded
        self.marks: dict[int, set[str]] = {}  # of elements that their names exclude
        self.subjects: set[int] = set()  # of these, the ones that may be content by their names
        self.stack: list[tuple[str, int, bool, bool, bool, bool, bool]] = []  # tag, id, excluded, header of an article, link, frame, excluded by a tag
        self.blocks: list[tuple[str, int, tuple[int, ...], bool, int, bool, bool, int]] = []
        self.names: dict[int, str] = {}
        self.parts: list[str] = []
        self.dropped: list[str] = []  # the block's pieces in excluded elements
        self.tags = self.n = self.links = self.linked = self.dropped_linked = 0

    def flush(self) -> None:
        if self.parts or self.dropped:
            text = " ".join("".join(self.parts).split())
            excluded = not text
            if excluded:
                text = " ".join("".join(self.dropped).split())
            if text:
                links = self.links if self.linked >= LINKED * len(text) and not excluded else 0
                frame, by_tag = self.stack[-1][5:] if excluded and self.stack else (False, False)
                self.blocks.append((text, max(1, self.tags), tuple(s[1] for s in self.stack), excluded, links, frame, by_tag, self.dropped_linked if excluded else self.linked))
            self.parts, self.dropped = [], []
            self.tags = self.links = self.linked = self.dropped_linked = 0

    def _excluded(self) -> bool:
        if not self.stack:
            return False
        top = self.stack[-1]
        return top[2] or (top[3] and not any(s[0] in HEADINGS for s in self.stack))

    def _within(self) -> bool:
        return bool(self.stack and self.stack[-1][2]) and any(s[0] in _WITHIN for s in self.stack)

    def _pop_to(self, k: int) -> None:
        self.flush()
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and not self._within():
            self.flush()
            for k in range(len(self.stack) - 1, -1, -1):  # a paragraph ends at the next block, an item at the next item
                open_tag = self.stack[k][0]
                if open_tag == "p" or (open_tag == tag and tag in ("li", "tr", "dt", "dd", "option")):
                    self._pop_to(k)
                    break
                if open_tag in BLOCKS:
                    break
            if tag in ("article", "main") and not _hidden(tag, attrs) and (tag == "main" or self.n + 1 in self.wraps or not _marks(tag, attrs)):
                for k, s in enumerate(self.stack):
                    if s[0] in _ENDED:
                        self._pop_to(k)
                        break
        elif tag in SPACES:
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        self.n += 1
        by_tag = bool(self.stack and self.stack[-1][6]) or tag in NOT_TEXT or _hidden(tag, attrs)
        in_header = bool(self.stack and self.stack[-1][3])
        marks = _marks(tag, attrs) if self.n not in self.wraps else set()
        in_article = (tag == "header" or "header" in marks) and any(s[0] in ("article", "main") for s in self.stack)
        if tag == "header":
            if in_article:
                in_header = True
            else:
                by_tag = True
        elif marks == {"header"} and _header_of(attrs, _A_HEADER if in_article else _OF_ARTICLE):
            in_header, marks = True, set()
        if marks:
            self.marks[self.n] = marks
            if not by_tag and _of_subject(attrs):
                self.subjects.add(self.n)
        excluded = by_tag or bool(marks) or bool(self.stack and self.stack[-1][2])
        if tag in BLOCKS:
            self.names[self.n] = tag
        link = tag == "a" or bool(self.stack and self.stack[-1][4])
        frame = bool(self.stack and self.stack[-1][5]) or (excluded and (tag in FRAME or _framed(attrs)))
        self.stack.append((tag, self.n, excluded, in_header, link, frame, by_tag))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        within = self._within()
        if tag in BLOCKS and not within:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if (tag in BLOCKS and not (within and any(s[0] in _WITHIN for s in self.stack[:k]))) or (tag in NOT_TEXT and not any(map(str.strip, self.parts))):
                    self._pop_to(k)
                else:  # an element within a line leaves the text around it one block
                    del self.stack[k:]
                break
            if tag not in BLOCKS and self.stack[k][0] in BLOCKS:
                break  # an inline end tag ends nothing outside its block
        if tag in SPACES:
            self.parts.append(" ")

    def handle_data(self, data):
        if self._excluded():
            self.dropped.append(data)
            if self.stack and self.stack[-1][4]:
                self.dropped_linked += len(data)
            return
        self.parts.append(data)
        if self.stack and self.stack[-1][4]:
            self.links += 1
            self.linked += len(data)

    def close(self):
        super().close()
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma) + 1
    kernel = np.exp(-np.square(np.arange(-reach, reach + 1) / sigma) / 2)
    total = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The cut of the values into two clusters, by two means from the extremes."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        above = values >= cut
        if above.all() or not above.any():
            return cut if not above.all() else float(values.min())
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _high(ratios: np.ndarray) -> np.ndarray:
    smooth = smoothed(ratios)
    high = (smooth >= threshold(smooth)) & (ratios > 0)
    return high if high.any() else ratios > 0


def _parsed(html: str, wraps: frozenset[int] = frozenset()) -> BlockParser:
    parser = BlockParser(wraps)
    for k in range(0, len(html), CHUNK):
        parser.feed(html[k : k + CHUNK])
    parser.close()
    return parser


def _wrappers(parser: BlockParser) -> frozenset[int]:
    """Elements excluded by name that hold most of the page's text by the ratio, names left aside.

    An article or main outside such an element is the page's text instead, and readers' contributions
    are not, however long they are, unless the element has the page's title, article or main in it too.
    """
    blocks = [b for b in parser.blocks if not b[6]]
    if not parser.marks or not blocks:
        return frozenset()
    high = _high(np.array([0.0 if b[6] else len(b[0]) / b[1] for b in parser.blocks]))
    total, mass = 0, dict.fromkeys(parser.marks, 0)
    for b, is_high in zip(parser.blocks, high):
        if is_high:
            total += len(b[0])
            for element in b[2]:
                if element in mass:
                    mass[element] += len(b[0])
    content = _content_by_ratio(parser, high)
    found = {e for e, m in mass.items() if m and m >= WRAPS * total}
    if not found:
        return frozenset(content)
    own = ("article", "main", "h1")
    places = [(b[2], {parser.names[e] for e in b[2] if parser.names.get(e) in own and e not in parser.marks}) for b in blocks]
    outside = [set(path) for path, kinds in places if kinds & {"article", "main"} and parser.marks.keys().isdisjoint(path)]
    inside = {e for path, kinds in places if kinds for e in path}
    return frozenset(e for e in found if e in content or all(e in path for path in outside) and (e in inside or parser.marks[e].isdisjoint(TALK))) | content


def _content_by_ratio(parser: BlockParser, high: np.ndarray) -> set[int]:
    """Parts of the content region that a name alone excludes, a subject's by its words, though their text is of the high cluster.

    The region is the innermost element that holds nearly all of that cluster, names left aside. Parts that
    hold others marked as readers' contributions are such contributions.
    """
    if not parser.subjects:
        return set()
    text, of_high, links, region, total, path_of = {}, {}, {}, {}, 0, {}
    for b, is_high in zip(parser.blocks, high):
        if b[6]:
            continue
        n = len(b[0])
        total += n * bool(is_high)
        for k, e in enumerate(b[2]):
            if e in parser.subjects:
                text[e], of_high[e], links[e] = text.get(e, 0) + n, of_high.get(e, 0) + n * bool(is_high), links.get(e, 0) + b[7]
                path_of.setdefault(e, b[2][:k])
            if parser.names.get(e) in _HOLDERS:
                region[e] = region.get(e, 0) + n * bool(is_high)
    inner = max((e for e, m in region.items() if m >= MOST * total), default=None)
    talk = {e for e, marks in parser.marks.items() if not marks.isdisjoint(TALK)}
    told = {e for b in parser.blocks for e in parser.subjects.intersection(b[2]) if talk.intersection(b[2][b[2].index(e) + 1 :])}
    inside = lambda e: inner in path_of[e] or any(parser.names.get(x) in ("article", "main") and x not in parser.marks for x in path_of[e])
    return {e for e in text if e not in told and inside(e) and of_high[e] >= OF_HIGH * text[e] and links[e] <= OF_LINKS * text[e]}


def main_text(html: str | None) -> str:
    html = html or ""
    parser = _parsed(html)
    if wraps := _wrappers(parser):
        parser = _parsed(html, wraps)
    blocks = parser.blocks
    open_blocks = [b for b in blocks if not b[3]]
    if not open_blocks:
        return ""
    ratios = np.array([0.0 if b[3] else len(b[0]) / b[1] for b in blocks])
    high = _high(ratios)
    dense = _dense(parser, high)
    mass: dict[int, int] = {}
    total = 0
    for b, is_high in zip(blocks, high):
        if is_high:
            total += len(b[0])
            for element in b[2]:
                if element in parser.names:
                    mass[element] = mass.get(element, 0) + len(b[0])
    holders = [e for e, m in mass.items() if m >= MOST * total and parser.names[e] in _HOLDERS]
    if whole := [e for e in holders if parser.names[e] in ("article", "main")]:
        inner = max(whole)  # ids grow inwards along a path
        return "\n".join(b[0] for b in open_blocks if inner in b[2])
    inner = max((e for e in holders if parser.names[e] not in ("html", "body")), default=None)
    if inner is None:
        at = np.flatnonzero(high)
        first, last = int(at[0]), int(at[-1])
    else:
        first, last = _widened(parser, inner, dense)
    while first and not _ends_region(blocks, first - 1, dense):
        first -= 1
    while last + 1 < len(blocks) and not _ends_region(blocks, last + 1, dense):
        last += 1
    return "\n".join(b[0] for b in blocks[first : last + 1] if not b[3])


def _dense(parser: BlockParser, high: np.ndarray) -> np.ndarray:
    """Blocks of the low cluster, headings aside, that are markup with little text and stand next to one like them."""
    blocks = parser.blocks
    tags = np.array([b[1] for b in blocks]) - OWN_TAGS
    alone = ~high & (tags > 0) & (np.array([len(b[0]) for b in blocks]) < DENSE * tags) & ~np.array([b[3] or any(parser.names.get(e) in HEADINGS for e in b[2]) for b in blocks])
    beside = np.zeros(len(blocks), bool)
    beside[1:] |= alone[:-1]
    beside[:-1] |= alone[1:]
    return alone & beside


def _ends_region(blocks: list[tuple], k: int, dense: np.ndarray) -> bool:
    """Whether block ``k`` is of the page's frame, dense markup, or a line of a menu: of several links, or of one next to others."""
    if dense[k]:
        return True
    if not blocks[k][4]:
        return blocks[k][5]
    return blocks[k][4] > 1 or any(0 <= j < len(blocks) and blocks[j][4] for j in (k - 1, k + 1))


def _widened(parser: BlockParser, inner: int, dense: np.ndarray) -> tuple[int, int]:
    """First and last block of the outermost element around ``inner`` that adds no frame or dense markup, and no menu before it."""
    blocks = parser.blocks
    path = next(b[2] for b in blocks if inner in b[2])
    around = set(path[: path.index(inner) + 1])
    spans: dict[int, tuple[int, int]] = {}
    for k, b in enumerate(blocks):
        for element in b[2]:
            if element not in around:
                break  # the rest of the path is not around ``inner`` either
            spans[element] = spans.get(element, (k, k))[0], k
    first, last = spans[inner]
    for element in reversed(path[: path.index(inner)]):
        name = parser.names.get(element)
        if name in ("html", "body"):
            break
        if name not in _HOLDERS:
            continue
        start, stop = spans[element]
        if any(_ends_region(blocks, k, dense) for k in range(start, first)) or any(b[5] for b in blocks[last + 1 : stop + 1]) or dense[last + 1 : stop + 1].any():
            break
        first, last = start, stop
    return first, last


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""

    def run(it):
        for batch in batches(it):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    small_batches(pages.sparkSession)
    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
