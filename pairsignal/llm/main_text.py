"""Main text of web pages by tag-path ratios.

Every piece of text has the path of tags from the root to it. Per path the text length and the punctuation are added up
and divided by the number of pieces with that path; both ratios are smoothed along the page, fused by their product and
compared with a threshold from their spread. The paths over it are content; standing in an article or main is a vote
for a block. What stands between content inside one element belongs to it, as do the headings before it. What belongs
to menus and the like by its element is out beforehand. Forms and what a class or id names a notice, an advert and the
like are out too, as long as enough of the content stands outside them: names never remove most of a page.
"""

from __future__ import annotations

import html as entities
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements of the HTML standard by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math select object canvas audio video".split())
EMPTY = frozenset("svg math".split())  # of these, the ones that "/>" ends
NEVER = frozenset("head nav aside footer button dialog menu fieldset label datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html article section div main aside nav td th".split())
CELLS = frozenset("td th".split())  # a paragraph ends at them, a list item or row does not

# Class or id names of what is not the article: a whole name, or one whose parts are such words and words of place.
_COMMENT = "comments?|commentlist|respond|replies|reply|disqus"
_NOISE = (
    "ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|"
    "masthead|topbar|site-header|page-header|cookies?|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|"
    f"widgets?|toolbar|pagination|pager|tags|search|skip|hidden|{_COMMENT}"
)
_PLACE = "list|area|box|wrap|wrapper|container|section|block|bar|item|links?|icons?|buttons?|form|left|right|top|bottom|primary|secondary|main|site|page|posts?|articles?|thread|media|[0-9]+"
NOISE = re.compile(rf"(?:(?:{_PLACE})[_-]+)*(?:{_NOISE})(?:[_-]+(?:{_NOISE}|{_PLACE}))*", re.I)
COMMENT = re.compile(rf"(?:^|[\s_-])(?:{_COMMENT})(?=$|[\s_-])", re.I)
REST, REST_NAMED = 1 / 3, 0.1  # the least share of the content outside forms and such names; with an article or main in it, or beside comments
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOTE = 2.0  # what standing in an article or main is worth
ENDS = re.compile(r""">|=\s*["']""")  # a quote opens a value after an equals sign only
NAME = re.compile(r"[^\s/>]*")
LONG = re.compile(r"&#([0-9]{4000,});?")  # more digits than Python reads as a number
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，]")


class _Element:
    __slots__ = ("tag", "parent", "path", "out", "named", "names", "comment", "inner", "block", "article", "heading", "title", "near", "depth")

    def __init__(self, tag: str, parent: _Element | None, path: int, place: int, out: bool, names: list[str] | None = None):
        self.tag, self.parent, self.path, self.depth = tag, parent, path, parent.depth + 1 if parent else 0
        self.named = names is not None  # a name or a form: out if the content allows it
        self.names = names or []
        self.comment = any(COMMENT.search(n) for n in self.names)
        self.out = out or parent is not None and parent.out
        # What the elements around it say is handed down, so nothing walks up a deep page: the nearest element with a name
        # against it, the nearest block, what it stands in, and the places in the stack of the nearest p, li and the like.
        self.inner: _Element | None = self if self.named else parent and parent.inner
        self.block: _Element = self if tag in BLOCK or parent is None else parent.block
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.heading = tag in HEADINGS or parent is not None and parent.heading
        self.title = tag == "h1" or parent is not None and parent.title
        near: dict[str, int] = parent.near if parent else {}
        if tag in SCOPE and near:
            near = {t: k for t, k in near.items() if t != "p"} if tag in CELLS else {}
        self.near = {**near, tag: place} if tag == "p" or tag in CLOSES else near

    def holder(self) -> _Element:
        """What holds the block that it belongs to."""
        return self.block if self.block.tag in ("", "html", "body") else self.block.parent


def _noise(tag: str, attrs: str, parent: _Element) -> bool:
    if tag in NEVER or tag == "header" and not parent.article:
        return True
    if tag in ("html", "body", "article", "main") or not attrs.strip():
        return False
    if HIDDEN.search(attrs) and tag not in BLOCK - {"div", "section", "p", "ul"}:
        return True
    return False


def _names(tag: str, attrs: str) -> list[str] | None:
    """The names that speak against an element (none for a form), or None if nothing does."""
    if tag in ("html", "body", "article", "main") or not attrs.strip() and tag != "form":
        return None
    values = (" ".join(filter(None, m.groups())) for m in NAMED.finditer(attrs))
    found = [name for value in values for name in value.split() if NOISE.fullmatch(name)]
    return found if found or tag == "form" else None


class _TagEnds:
    """Where the tag that is open at a place ends: at the next ">" outside quotes.

    A quote opens a value after an equals sign only, and one that nothing closes is a character like others. Each quote's
    answer is kept, so that all tags of a page together read it about once, also if none of them ever ends.
    """

    def __init__(self, page: str):
        self.page = page
        self.marks = array("q", (m.end() - 1 for m in ENDS.finditer(page)))
        self.known = array("q", [-2]) * len(self.marks)

    def after(self, place: int) -> int:
        """The place of the ending ">", or -1."""
        seen, end = [], -1
        k = bisect_left(self.marks, place)
        while k < len(self.marks):
            end = self.known[k]
            if end != -2:
                break
            seen.append(k)
            mark = self.marks[k]
            if self.page[mark] == ">":
                end = mark
                break
            closing = self.page.find(self.page[mark], mark + 1)
            k = bisect_right(self.marks, closing, k) if closing >= 0 else k + 1
        else:
            end = -1
        for k in seen:
            self.known[k] = end
        return end


def _pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """The page in order as (kind, text or tag, attributes); kind is text, open or close. Comments and what only scripts,
    styles and the like hold are passed over. What begins like a tag and never ends is text."""
    ends = _TagEnds(page)
    at, closed = 0, True  # closed: some ">" may follow
    while (start := page.find("<", at)) >= 0:
        if start > at:
            yield "text", page[at:start], ""
        at = start
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[at + 1:at + 2] in ("!", "?"):
            end = page.find(">", at) if closed else -1
            closed = end >= 0
            if closed:
                at = end + 1
                continue
        close = page.startswith("/", at + 1)
        letter = page[at + 1 + close:at + 2 + close]
        end = ends.after(at + 1) if letter.isascii() and letter.isalpha() else -1
        if end < 0:
            yield "text", "<", ""
            at += 1
            continue
        name = NAME.match(page, at + 1 + close, end)
        tag, attrs = name[0].lower(), page[name.end():end]
        at = end + 1
        if not close and tag in RAW:
            if not (tag in EMPTY and attrs.endswith("/")):
                last = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = last.end() if last else len(page)
            continue
        yield "close" if close else "open", tag, attrs
    if at < len(page):
        yield "text", page[at:], ""


def _plain(text: str) -> str:
    """Text with character references decoded and white space as single spaces."""
    if "&#" in text:
        text = LONG.sub(lambda m: f"&#{m[1].lstrip('0') or 0};" if len(m[1].lstrip("0")) < 4000 else "\ufffd", text)
    return " ".join(entities.unescape(text).split())


def _blocks(page: str) -> list[tuple[_Element, str]]:
    """The blocks of a page in order: the element that holds each, and its text."""
    paths: dict[tuple[int, str], int] = {}  # a path is numbered by its parent's number and its tag
    root = _Element("", None, 0, 0, False)
    stack = [root]
    count: Counter[str] = Counter()  # open elements per tag
    out: list[tuple[_Element, str]] = []
    held: list[str] = []
    owner = root

    def end() -> None:
        nonlocal held, owner
        if held:
            text = _plain("".join(held))
            if text:
                out.append((owner, text))
        held, owner = [], stack[-1]

    def cut(place: int) -> None:
        while len(stack) > place:
            count[stack.pop().tag] -= 1

    for kind, piece, attrs in _pieces(page):
        if kind == "text" or piece == "br":
            if not stack[-1].out:
                if not held:
                    owner = stack[-1]
                held.append(piece if kind == "text" else " ")
            continue
        tag = piece
        if tag in BLOCK:
            end()
        if kind == "close":
            if count[tag]:
                while stack[-1].tag != tag:
                    cut(len(stack) - 1)
                cut(len(stack) - 1)
            owner = stack[-1]
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:  # a block ends an open paragraph, and what is open inside it
            cut(stack[-1].near.get("p", len(stack)))
        if tag in CLOSES:
            near = stack[-1].near
            cut(max((near[t] for t in CLOSES[tag] if t in near), default=len(stack)))
        if not attrs.endswith("/") or tag in BLOCK:
            parent = stack[-1]
            path = paths.setdefault((parent.path, tag), len(paths) + 1)
            stack.append(_Element(tag, parent, path, len(stack), _noise(tag, attrs, parent), _names(tag, attrs)))
            count[tag] += 1
        owner = stack[-1]
    end()
    return out


def _content(blocks: list[tuple[_Element, str]]) -> np.ndarray:
    """Which blocks stand on paths over the threshold."""
    number: dict[int, int] = {}
    path = np.array([number.setdefault(e.path, len(number)) for e, _ in blocks])
    length = np.array([len(t) for _, t in blocks], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for _, t in blocks], float)
    nodes = np.bincount(path)
    ratio = (np.bincount(path, length) / nodes)[path]
    dots = (np.bincount(path, marks) / nodes)[path]
    kernel = np.array([0.06, 0.24, 0.4, 0.24, 0.06])
    fused = np.convolve(np.pad(ratio, 2, "edge"), kernel, "valid") * np.convolve(np.pad(1 + dots, 2, "edge"), kernel, "valid")
    strong = np.bincount(path, fused) / nodes
    vote = np.array([VOTE if e.article else 1.0 for e, _ in blocks])
    return strong[path] * vote >= min(fused.std() * 0.5, strong.max())


def _between(blocks: list[tuple[_Element, str]], content: np.ndarray) -> np.ndarray:
    """The blocks to return: content, what stands between two blocks of it in an element that holds both, and headings.

    Body holds everything, so there only blocks between two of its own children count. A heading belongs to the content
    that follows it with at most other headings between; the first heading of the highest level to all content.
    """
    chosen = content.copy()
    places = np.flatnonzero(content).tolist()
    for i, j in zip(places, places[1:]):
        if j == i + 1:
            continue
        common = _common(blocks[i][0], blocks[j][0])
        if common.tag not in ("", "html", "body") or blocks[i][0].holder() is blocks[j][0].holder() is common:
            chosen[i + 1:j] = True  # an element that holds both is open all the while
    heads = np.array([e.heading for e, _ in blocks])
    for k in np.flatnonzero(heads & ~chosen)[::-1].tolist():
        chosen[k] = k + 1 < len(blocks) and bool(chosen[k + 1])
    title = next((k for k, (e, _) in enumerate(blocks) if e.title), None)
    if title is not None and places and title < places[0]:
        chosen[title] = True
    return chosen


def _common(one: _Element, other: _Element) -> _Element:
    """The innermost element that holds both; `one` stands before `other`."""
    if one.depth > other.depth:
        one, other = other, one
    while other.depth > one.depth:
        other = other.parent
    while one is not other:
        one, other = one.parent, other.parent
    return one


def _without_named(blocks: list[tuple[_Element, str]]) -> list[tuple[_Element, str]]:
    """The blocks outside forms and elements with a name against them.

    If too little of the content stands outside, the elements that hold most of it count as content, the largest first
    and all of the same path and names with it; comments come last. Only outermost elements are taken; the named ones
    inside an element that was taken are outermost from then on.
    """
    if not any(e.inner for e, _ in blocks):
        return blocks
    weights = [len(t) if good else 0 for (_, t), good in zip(blocks, _content(blocks))]
    total = sum(weights)
    own: dict[_Element, list[int]] = {}  # blocks by the nearest named element
    order: dict[_Element, int] = {}  # named elements by their first block
    rest, holds = 0, False
    for k, ((e, _), w) in enumerate(zip(blocks, weights)):
        if e.inner is None:
            rest, holds = rest + w, holds or bool(w) and e.article
            continue
        own.setdefault(e.inner, []).append(k)
        x = e.inner
        while x is not None and x not in order:
            order[x] = k
            x = x.parent.inner
    held = {x: sum(weights[k] for k in own.get(x, ())) for x in order}
    inside: dict[_Element, list[_Element]] = {}
    for x in sorted(order, key=lambda x: -x.depth):
        outer = x.parent.inner
        if outer is not None:
            held[outer] += held[x]
            inside.setdefault(outer, []).append(x)
    heap: list[tuple[bool, int, int, int, _Element]] = []
    alike: dict[tuple, list[_Element]] = {}  # outermost elements of one path and names

    def outermost(x: _Element) -> None:
        heappush(heap, (x.comment, -held[x], order[x], x.depth, x))
        alike.setdefault((x.path, *x.names), []).append(x)

    for x in order:
        if x.parent.inner is None:
            outermost(x)
    while heap:
        first = heappop(heap)[-1]
        if not first.named:
            continue
        if not held[first] or rest >= (REST_NAMED if holds or first.comment else REST) * total:
            break
        for x in alike.pop((first.path, *first.names)):
            x.named = False
            for k in own.get(x, ()):
                rest, holds = rest + weights[k], holds or bool(weights[k]) and blocks[k][0].article
            for y in inside.get(x, ()):
                outermost(y)
    return [block for block in blocks if block[0].inner is None or not block[0].inner.named]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line; empty if there is none."""
    blocks = _without_named(_blocks(page or ""))
    if not blocks:
        return ""
    chosen = _between(blocks, _content(blocks))
    return "\n\n".join(text for (_, text), good in zip(blocks, chosen) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null or empty page has an empty text. A page is read whole by one task, in time that grows with its length, however
    deep or broken its markup; pages do not depend on each other, so repeated rows and null ids are rows like others.
    Other columns are not read.
    """
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=schema.fieldNames())

    read = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(work, schema)
    return read.withColumn("n_chars", F.char_length("text").cast("long"))
