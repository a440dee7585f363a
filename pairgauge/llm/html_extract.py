"""HTML extraction with site template removal.

Pages are parsed into an element tree that forgives unclosed tags, in time linear in the page. Every
block element's subtree is hashed from its tags and text; Spark counts the hashes per host, over
pages of distinct content, and subtrees that recur on many pages of their host are deleted:
MIN_PAGES pages, however many the host has, or MARKED_PAGES if the element's own class or id hints
at a menu, advert, notice or the like. Pages are told apart by the smallest hash of their
paragraphs (a MinHash of one), so that copies and near copies of one page count once and do not
make its article look like a template.

A host with too few pages has no counts to go by, so some parts go by themselves: elements that
HTML gives such a meaning (nav, footer, aside, form, script, roles, hidden parts), and elements
named as a whole class or id by a word of SURE, unless they hold most of the text (half of the
page's, or nine tenths of the content root's). If a page has
an article or main element, the one with most text is the content root: only its text counts, and
its paragraphs, headings and list items are never taken for templates. What encloses the root is
never deleted, whatever it is called.

Character references are decoded, white space inside a block becomes one space, and the blocks
follow in page order, one a line. Null and empty pages give an empty text; a page without any
content gives one too. Repeated rows give a result each; null ids and urls are kept (pages without
a host count as one host). An empty table gives an empty result. Only the three columns named are
read, so extra columns and their names do not matter. A tag that the page ends in is dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, few, table

#: A subtree is a template from so many distinct pages of its host, however many pages the host has.
MIN_PAGES = 4
#: The same for an element that its own name, tag or place says is no article.
MARKED_PAGES = 2
#: Words of a block that tells pages apart, if a page has such blocks.
TELLING_WORDS = 5

# fixed values of HTML: void elements, elements of raw text, and elements that make blocks
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea noscript template iframe title svg math".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: Elements that a start tag of theirs does not close across.
WALLS = {"table", "ul", "ol", "dl", "div", "section", "article", "body", "select", "menu"}
IN_HEAD = set("base link meta title style script noscript template".split())
NO_CONTENT = set("nav footer aside form button select dialog menu head object canvas audio video".split()) | RAW
NO_ROLE = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
#: Whole class names or ids that mark an element as no article.
SURE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar "
    "social share sharing comment comments disqus respond reply replies related recommended widget pagination pager login signup".split()
)
#: Parts of class names that no class of an article's own parts has.
SURE_PART = set("advert adverts advertisement cookie cookies gdpr navbar breadcrumb breadcrumbs sidebar footer masthead comments disqus newsletter pagination".split())
ROOT = {"article", "main"}
CONTAINERS = set("div section aside ul ol dl table figure details center fieldset".split())

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
# nothing is given back, so a tag without an end costs one pass over the rest of the page
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_TELLING = re.compile(r"class|id|role|style|hidden", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Names of wrappers that tell what else the page has.
_ABOUT = re.compile(r"(?:has|with|without|no)[^a-z0-9]")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}

STRONG, SURELY, HINT = 3, 2, 1


class Element:
    """tag, parent's number, hash of the subtree, size of its text, first block and end, how it is
    marked, and whether it is a possible content root, lies in one, or is excluded."""

    __slots__ = ("tag", "parent", "parts", "hash", "size", "lo", "hi", "mark", "root", "inside", "out")

    def __init__(self, tag: str, parent: int, mark: int, root: bool, inside: bool, out: bool, lo: int):
        self.tag, self.parent, self.mark, self.root, self.inside, self.out, self.lo = tag, parent, mark, root, inside, out, lo
        self.parts: list[str] = []
        self.hash = self.size = self.hi = 0


def _attributes(text: str) -> dict[str, str]:
    if not _TELLING.search(text):
        return {}
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), a or b or c)
    return found


def _mark(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """How an element marks itself as no content; inside: in an article or main."""
    if tag in NO_CONTENT or (tag == "header" and not inside):
        return STRONG
    if not attributes or tag in ("html", "body"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return STRONG
    if attributes.get("role", "").lower() in NO_ROLE or _UNSEEN.search(attributes.get("style", "")):
        return STRONG
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    if not SURE.isdisjoint(names):
        return SURELY
    parts = {p for n in names if not _ABOUT.match(n) for p in re.split(r"[^a-z0-9]+", n)}
    return SURELY if not SURE_PART.isdisjoint(parts) else HINT if not SURE.isdisjoint(parts) else 0


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Page:
    """A page's elements in order of their start, and its blocks: pieces of text with the element of each."""

    def __init__(self, page: str):
        self.elements = [Element("#top", -1, 0, False, False, False, 0)]
        self.blocks: list[list[tuple[int, str]]] = []
        self._pieces: list[tuple[int, str]] = []
        self._stack = [0]
        self._open: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        self._blocks_open: list[int] = []
        self._read(page)
        self._close(1)
        self._flush()
        top = self.elements[0]
        top.hi = len(self.blocks)

    def _flush(self) -> None:
        if any(not text.isspace() for _, text in self._pieces):
            self.blocks.append(self._pieces)
        self._pieces = []

    def _close(self, n: int) -> None:
        """Close the elements of the stack from place n on."""
        while len(self._stack) > n:
            e = self.elements[self._stack.pop()]
            self._open[e.tag].pop()
            if e.tag in BLOCK:
                self._blocks_open.pop()
                self._flush()
            e.hi = len(self.blocks) + (1 if self._pieces else 0)
            digest = blake2b("\x00".join([e.tag, *e.parts]).encode("utf-8", "replace"), digest_size=8).digest()
            e.hash, e.parts = int.from_bytes(digest, "little", signed=True), []
            up = self.elements[self._stack[-1]]
            up.parts.append(digest.hex())
            up.size += e.size

    def _text(self, text: str) -> None:
        text = entities.unescape(text)
        here = self._stack[-1]
        e = self.elements[here]
        self._pieces.append((here, text))
        if bare := " ".join(text.split()):
            e.parts.append("=" + bare)
            e.size += len(bare)

    def _nearest(self, tags: set[str]) -> int:
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _end(self, tag: str) -> None:
        if not self._open.get(tag):
            return
        place = self._open[tag][-1]
        # an end tag left over from outside an article does not end the article
        if place < self._nearest(ROOT) and tag not in ("body", "html", "article", "main", "div", "section"):
            return
        self._close(place)

    def _start(self, tag: str, attributes: str) -> None:
        stack, elements = self._stack, self.elements
        if self._open.get("head") and elements[stack[-1]].tag == "head" and tag not in IN_HEAD:
            self._close(len(stack) - 1)
        if tag in CLOSES:
            place = self._nearest(CLOSES[tag])
            if place and place >= self._nearest(WALLS - CLOSES[tag]):
                self._close(place)
        if tag in BLOCK:
            # a paragraph ends where a block begins, and so does what it left open
            if self._blocks_open and elements[stack[self._blocks_open[-1]]].tag == "p":
                self._close(self._blocks_open[-1])
            self._flush()
        up = elements[stack[-1]]
        found = _attributes(attributes) if attributes else {}
        inside = up.inside or up.root
        mark = _mark(tag, found, inside)
        root = tag in ROOT or found.get("role", "").lower() == "main"
        elements.append(Element(tag, stack[-1], mark, root, inside, up.out or mark == STRONG, len(self.blocks)))
        self._open[tag].append(len(stack))
        if tag in BLOCK:
            self._blocks_open.append(len(stack))
        stack.append(len(elements) - 1)

    def _read(self, page: str) -> None:
        at = begin = 0
        while m := _OPEN.search(page, at):
            lo = m.start()
            tag = _TAG.match(page, lo)
            if tag is None:
                if page[lo + 1].isalpha() or page[lo + 2 : lo + 3].isalpha() and page[lo + 1] == "/":
                    if lo > begin:
                        self._text(page[begin:lo])
                    return  # the page ends inside a tag
                # a comment, a declaration or the like
                if lo > begin:
                    self._text(page[begin:lo])
                mark, skip = ("-->", 2) if page.startswith("<!--", lo) else (">", 0)
                end = page.find(mark, lo + skip)
                at = begin = end + len(mark) if end >= 0 else len(page)
                continue
            if lo > begin:
                self._text(page[begin:lo])
            at = begin = tag.end()
            name = tag[2].lower()
            if tag[1]:
                self._end(name)
            elif name in VOID:
                if name == "br":
                    self._pieces.append((self._stack[-1], " "))
                elif name == "hr":
                    self._flush()
            else:
                self._start(name, tag[3])
                if name in RAW:
                    end = _ENDS[name].search(page, at)
                    at = begin = end.end() if end else len(page)
                    self._close(len(self._stack) - 1)
                elif tag[3].endswith("/") and name not in BLOCK:
                    self._close(len(self._stack) - 1)
        if begin < len(page):
            self._text(page[begin:])

    # -- what is content ---------------------------------------------------------------

    def root(self) -> int:
        """The article or main element with most text that is not excluded; articles go first. 0: none."""
        for tags in (("article",), ROOT):
            found = [i for i, e in enumerate(self.elements) if e.root and not e.out and (e.tag in tags or e.tag not in ROOT)]
            if found:
                return max(found, key=lambda i: (self.elements[i].size, -i))
        return 0

    def content(self) -> tuple[list[str], list[tuple[int, bool, int, int]], int]:
        """The blocks of content; the subtrees that may be templates, as (hash, marked, first block, end),
        with blocks as numbered in the first; and what tells the page from others."""
        elements = self.elements
        root = self.root()
        above, i = set(), root
        while i > 0:
            above.add(i)
            i = elements[i].parent
        base = elements[root].size
        n = len(elements)
        # by parents first: 0 outside the root, 1 content, 2 excluded by itself
        state = [0] * n
        state[0] = 0 if root else 1
        tops: list[tuple[int, bool]] = []
        for i in range(1, n):
            e = elements[i]
            up = state[e.parent]
            small = 2 * e.size <= base
            if i in above:
                state[i] = 1 if i == root else up
                continue
            state[i] = up
            if up == 2:
                continue
            gone = e.mark == STRONG or (e.mark == SURELY and (10 * e.size <= 9 * base if root else small))
            if gone:
                state[i] = 2
            if not e.size or e.tag not in BLOCK or e.tag in ("html", "body", "head"):
                continue
            if up == 0:
                # beside the root: the outermost are enough, as all of it goes anyway
                if e.parent == 0 or e.parent in above or elements[e.parent].tag in ("html", "body"):
                    tops.append((i, True))
            elif gone or not root or (small and (e.tag in CONTAINERS or e.mark)):
                tops.append((i, gone or bool(e.mark)))
        # the blocks that stay, and where each of the page's blocks is among them
        kept, place = [], []
        for pieces in self.blocks:
            place.append(len(kept))
            text = " ".join("".join(t for i, t in pieces if state[i] == 1).split())
            if text:
                kept.append(text)
        place.append(len(kept))
        cands = [(elements[i].hash, marked, place[min(elements[i].lo, len(place) - 1)], place[min(elements[i].hi, len(place) - 1)]) for i, marked in tops]
        telling = [t for t in kept if t.count(" ") + 1 >= TELLING_WORDS] or kept
        return kept, cands, min(map(_digest, telling), default=0)


def _without(blocks: list[str], spans: list[tuple[int, int]]) -> tuple[list[str], int]:
    """Blocks outside the spans, and how many spans lie in no other."""
    out, at, outer = [], 0, 0
    for lo, hi in sorted(spans, key=lambda s: (s[0], -s[1])):
        if lo == hi:  # excluded by itself, or beside the root
            outer += 1
        elif hi > at:
            outer += 1
            out += blocks[at:lo]
            at = hi
    return out + blocks[at:], outer


def main_text(page: str | None, templates: set[int] = frozenset()) -> tuple[str, int]:
    """The page's main text, and how many template subtrees were deleted from it."""
    blocks, cands, _ = Page(page or "").content()
    left, n = _without(blocks, [(lo, hi) for h, _, lo, hi in cands if h in templates])
    return "\n".join(left), n


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


_PARSED = "page_id long, url string, x long, host string, page long, size int, blocks binary, cands array<struct<hash:long,marked:boolean,lo:int,hi:int>>"


def parsed(pages: DataFrame) -> DataFrame:
    """A row a page: its blocks of content (one a line, compressed, as they are shuffled once; size is
    that of the bytes before), the subtrees that may be templates, and what tells it from others."""
    cand = pa.list_(pa.struct([("hash", pa.int64()), ("marked", pa.bool_()), ("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sub = b.slice(at, 256)
                hosts, ids, sizes, blocks, cands = [], [], [], [], []
                for url, text in zip(sub.column(1).to_pylist(), sub.column(3), strict=True):
                    kept, found, page = Page(text.as_py() or "").content()
                    hosts.append(host_of(url))
                    ids.append(page)
                    lines = "\n".join(kept).encode("utf-8", "replace")
                    sizes.append(len(lines))
                    blocks.append(pa.compress(lines, "zstd", asbytes=True))
                    cands.append([{"hash": h, "marked": m, "lo": lo, "hi": hi} for h, m, lo, hi in found])
                cols = [sub.column(0), sub.column(1), sub.column(2), pa.array(hosts, pa.string()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(blocks, pa.binary()), pa.array(cands, cand)]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "x", "host", "page", "size", "blocks", "cands"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64("url", "html").alias("x"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, _PARSED)


def templates(found: DataFrame, min_pages: int = MIN_PAGES, marked_pages: int = MARKED_PAGES) -> DataFrame:
    """(host, hash, n_pages): subtrees that recur across the pages of a host; those under ``min_pages`` only count where marked."""
    each = found.select("host", "page", F.explode("cands.hash").alias("hash")).distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_pages"))
    return each.filter(F.col("n_pages") >= min(min_pages, marked_pages))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, marked_pages: int = MARKED_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_templates per row of ``pages``."""
    rows = table(parsed(pages), TEXT_ROWS)
    recurring = table(templates(rows, min_pages, marked_pages))
    own = rows.select(F.col("page_id").alias("gid"), F.col("x").alias("gx"), "host", F.inline("cands"))
    gone = own.join(F.broadcast(recurring) if few(recurring, 200_000) else recurring, ["host", "hash"])
    gone = gone.filter((F.col("n_pages") >= min_pages) | (F.col("marked") & (F.col("n_pages") >= marked_pages)))
    # equal rows have equal spans
    gone = gone.groupBy("gid", "gx").agg(F.collect_set(F.struct("lo", "hi", "hash")).alias("gone"))
    rows = rows.join(gone, F.col("page_id").eqNullSafe(F.col("gid")) & (F.col("x") == F.col("gx")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n = [], []
            for size, packed, spans in zip(b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), strict=True):
                lines = pa.decompress(packed.as_buffer(), size, "zstd", asbytes=True).decode() if size else ""
                left, count = _without(lines.split("\n") if lines else [], [(s["lo"], s["hi"]) for s in spans or []])
                texts.append("\n".join(left))
                n.append(count)
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars", "n_templates"])

    return rows.select("page_id", "url", "size", "blocks", "gone").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_templates long")
