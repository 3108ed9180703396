"""HTML extraction by site template removal (operator 10).

Pages are parsed into element trees by a tolerant one-pass reader; each step is linear in the page. Two hashes tell a
subtree: the exact one (names, text, children in order), and its slot: its place in the page and its shape (names,
classes, ids and roles, equal neighbours once), with the text apart, so a menu whose entries differ from page to page
has one slot. Spark counts the different pages of a host on which a hash occurs. On MIN_PAGES of them it recurs.

What recurs is the site's template and is deleted:

* a subtree outside of articles whose exact hash recurs, or whose slot recurs and which lies beside the articles (else
  the main element) of its page, or of which links make up most, or which is furniture by its kind (menu, sidebar, form,
  notice, advert, comments and the like, by name, role, class or id);
* within an article furniture whose slot recurs, a subtree mostly of links whose exact hash recurs, and a box (BOXES, not
  a paragraph) that recurs exactly at the beginning or the end of articles: a passage that many articles share stays.

Lists of names are a tie-break only: where a slot is known to be on too few pages of its host to tell, furniture goes
by its kind, and so does what lies beside an article. A slot that is in neither set stays.

A page is told by the text of its articles without the template step: pages of equal text on a host count once, and for
exact hashes so do near copies, which share most of their sentences, in and out of links. They are found by least
hashes, as connected components, among the pages that hold a recurring subtree. So what copies of one page share is not
template.

Hashes are counted and joined by (host, hash), so a host that holds a third of the pages is no hot group and its template
has no bound; the rows of a hash that very many pages hold are dealt to several places. Pages are parsed once: what may be
deleted and all text is kept as a reduced tree. Verdicts on a bounded number of hashes go to every task; more are joined
to the pages whose text meets them, and then compressed trees are all that the shuffle carries.

Defined results: null and empty html give an empty text; markup without text too; a page without a host counts under
the empty host; repeated rows are pages of their own; very long and very deep pages are read in full; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import html
import marshal
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import read, scoped, spread, trim, written
from siftline.llm.components import connected_components
from siftline.llm.urls import host_of

#: A subtree is template from so many different pages of its host on, however many pages the host has.
MIN_PAGES = 3
#: Places to which the rows of one key are dealt in joins; verdicts that are sent to every task instead, some 10 MB.
SALTS, FEW_VERDICTS = 256, 100_000
#: Pages are near copies if all least hashes of a band are equal: at a Jaccard index of 0.7 by seven in ten, of 0.8 nearly always.
BANDS, BAND_ROWS = 20, 8
#: Words from which on a sentence is cut.
LONG_SENTENCE = 64
_random = np.random.default_rng(10)
_FACTORS = _random.integers(0, 1 << 31, BANDS * BAND_ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _random.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32)

#: Names of HTML elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements that never hold text of the page, and those that are furniture by their name.
NEVER = frozenset("head script style noscript template iframe object embed svg canvas audio video map textarea xmp noembed noframes title input".split())
FURNITURE = frozenset("nav footer aside form button select option label fieldset dialog menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Containers whose subtrees are hashed exactly.
COUNTED = frozenset("address aside center dir div dl details fieldset figure footer form header menu nav ol p section span table tr td ul".split())
#: Words of classes and ids that name furniture, and words that say nothing beside them. A class or id names furniture if
#: it has one of the former and no other words: `share` and `share-box` do, `share-price` does not.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
NEUTRAL = frozenset("area articles bar block body bottom box button buttons column container content feed form global icons id inner item items left link links list main outer page panel posts primary right row secondary section sign signup site slot stories sub text thread title top unit up wrap wrapper zone".split())
#: Containers that go from the beginning or the end of an article if they recur there.
BOXES = frozenset("address center details div dl figure ol section table ul".split())
FIRST, LAST = 0x5BD1E9955BD1E995, 0x2545F4914F6CDD1D
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Elements that a beginning element closes if they are open, up to the scope behind them.
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tr td th thead tbody", "table"), "tfoot": ("tr td th tbody", "table")}
CLOSES = {k: tuple(tuple(x.split()) for x in v) for k, v in CLOSES.items()}
CLOSES_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "legend", "optgroup", "option"}
P_SCOPE = tuple("button table td th caption html body object".split())

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>""", re.DOTALL)
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TAIL = re.compile(r"<[!?/a-zA-Z]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in RAW}
_WORD = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"\n|(?<=[.!?])\s|(?<=[。！？])")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Element:
    """held: an article, main element or body is within. total, linked: lengths of the text, and of that in links. at, end:
    where it and what lies in it stand in the list of elements."""

    __slots__ = ("at", "children", "end", "exact", "held", "inside", "linked", "name", "parent", "place", "rest", "shape", "total")

    def __init__(self, name: str, rest: str, parent: Element | None):
        self.name, self.rest, self.children, self.parent = name, rest, [], parent


def parse(source: str) -> list[Element]:
    """The elements of a page in their order, the root first. Children are elements and strings; strings have their references decoded."""
    root = Element("#root", "", None)
    elements, stack = [root], [root]
    open_: dict[str, list[int]] = {}  # the places on the stack of the open elements of a name
    find, at = _TOKEN.search, 0
    # What is begun behind the last > is no markup.
    end = source.rfind(">") + 1
    tail = _TAIL.split(source[end:], maxsplit=1)[0]

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    def cut(k: int) -> None:
        for e in stack[k:]:
            open_[e.name].pop()
        del stack[k:]

    def close(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Closes the outermost open element of the names within the innermost of the scope."""
        least = max((open_[n][-1] for n in scope if open_.get(n)), default=0)
        over = [x[bisect.bisect(x, least)] for n in names if (x := open_.get(n)) and x[-1] > least]
        if over:
            cut(min(over))

    while m := find(source, at, end):
        text(source[at : m.start()])
        at = m.end()
        if (name := m["name"]) is None:
            if m["cdata"]:
                stack[-1].children.append(m["cdata"])
            continue
        name = name.lower()
        if m["end"]:
            if open_.get(name):
                cut(open_[name][-1])
            continue
        if name in CLOSES_P and open_.get("p"):
            close(("p",), P_SCOPE)
        if name in CLOSES:
            close(*CLOSES[name])
        e = Element(name, m["rest"], stack[-1])
        elements.append(e)
        stack[-1].children.append(e)
        if name in RAW:
            over = _RAW_END[name].search(source, at)
            at = over.end() if over else len(source)
        elif name not in VOID and not m["rest"].endswith("/") or name in BLOCK and name != "hr":
            open_.setdefault(name, []).append(len(stack))
            stack.append(e)
    if at < end:
        text(source[at:end])
    if at <= end:
        text(tail)
    return elements


def _hash(*parts: bytes) -> bytes:
    return blake2b(b"\x00".join(parts), digest_size=8).digest()


def _number(h: bytes) -> int:
    return int.from_bytes(h, "little", signed=True)


def attributes(rest: str) -> Iterator[tuple[str, str]]:
    for m in _ATTR.finditer(rest):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


def kind_words(rest: str) -> bytes:
    """Classes, id and role of a tag, as the slot has them. Numbers are left out: they tell pages, not places."""
    found = [(k, " ".join(sorted(_WORD.findall(v.lower())))) for k, v in attributes(rest) if k in ("class", "id", "role")] if rest else ()
    return repr(sorted(found)).encode() if found else b""


def furniture(e: Element, inside: bool) -> bool:
    """By its name, role, class or id. Inside an article a header stays: it has the headline."""
    if e.name in FURNITURE or e.name == "header" and not inside:
        return True
    if e.name in ("article", "main") and not inside or not e.rest or e.name in ("html", "body"):
        return False
    for name, value in attributes(e.rest):
        if name in ("class", "id"):
            if not (inside and e.name == "header"):
                for token in value.lower().split() if name == "class" else (value.lower(),):
                    w = _WORD.findall(token)
                    if not BOILERPLATE.isdisjoint(w) and all(x in BOILERPLATE or x in NEUTRAL for x in w):
                        return True
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "style" and _INVISIBLE.search(value):
            return True
    return False


def _tops(root: Element, name: str) -> list[Element]:
    """The outermost elements of a name that are not within furniture, and are none themselves."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.name == name:
            if not furniture(x, True):
                out.append(x)
        elif x.name not in NEVER and (x is root or not furniture(x, False)):
            stack += [c for c in reversed(x.children) if not isinstance(c, str)]
    return out


class Node:
    """A piece of a page that may be deleted, an article or a link. Children are nodes, strings, and None where a block begins or ends."""

    __slots__ = ("box", "children", "exact", "flags", "slot")

    def __init__(self, flags: int = 0, slot: int | None = None, exact: int | None = None, box: int | None = None):
        self.flags, self.slot, self.exact, self.box, self.children = flags, slot, exact, box, []


#: What a node is: beside the articles, furniture by its kind, mostly links, an article, a link. Where a walk is: around
#: the articles, in one, elsewhere.
BESIDE, OWN, LINKED, ARTICLE, LINK = 1, 2, 4, 8, 16
AROUND, INSIDE, FREE = range(3)


class Page:
    """A parsed page. reduced() gives the tree of what may be deleted, with the hashes."""

    def __init__(self, source: str):
        self.elements = parse(source)
        self.root = self.elements[0]
        self.tops = _tops(self.root, "article") or _tops(self.root, "main")
        self.around: set[int] = set()
        for top in self.tops:
            e = top.parent
            while e is not None and id(e) not in self.around:
                self.around.add(id(e))
                e = e.parent
        self.articles = {id(t) for t in self.tops}
        self._measure()

    def _measure(self) -> None:
        """Lengths of texts, and exact hashes where they count: of containers outside of articles, within them of what is
        mostly links and of boxes. Children stand behind their parents in the list."""
        for k in range(len(self.elements) - 1, -1, -1):
            e = self.elements[k]
            total = linked = 0
            end, held = k + 1, False
            for c in e.children:
                if isinstance(c, str):
                    total += len(c.strip())
                else:
                    total, linked, end = total + c.total, linked + c.linked, c.end
                    held = held or c.held or c.name in ("article", "main", "body")
            e.total, e.linked, e.held, e.at, e.end = total, total if e.name == "a" else linked, held, k, end
            e.shape = e.exact = e.place = None
        needed = 0  # up to here elements lie in one whose hash is needed
        marked = []
        for e in self.elements:
            up = e.parent
            e.inside = e.name in ("article", "main") or up is not None and up.inside
            if e.at < needed:
                marked.append(e)
            elif not e.held and (e.name in COUNTED and (not e.inside or 2 * e.linked > e.total) or e.inside and e.name in BOXES):
                marked.append(e)
                needed = e.end
        for e in reversed(marked):
            parts = [e.name.encode()]
            for c in e.children:
                if isinstance(c, str):
                    if w := " ".join(c.split()):
                        parts.append(b"t" + w.encode("utf-8", "replace"))
                else:
                    parts.append(b"e" + c.exact)
            e.exact = _hash(*parts) if len(parts) > 1 else b""

    def _shape(self, e: Element) -> bytes:
        """The hash of names, classes, ids and roles; equal neighbours count once."""
        if e.shape is None:
            for x in reversed(self.elements[e.at : e.end]):
                if x.shape is None:
                    parts = [x.name.encode(), kind_words(x.rest)]
                    for c in x.children:
                        if not isinstance(c, str) and c.shape != parts[-1]:
                            parts.append(c.shape)
                    x.shape = _hash(*parts)
        return e.shape

    def _place(self, e: Element) -> bytes:
        path = []
        while e.place is None and e.parent is not None:
            path.append(e)
            e = e.parent
        place = e.place or b""
        for x in reversed(path):
            x.place = place = _hash(place, x.name.encode(), kind_words(x.rest))
        return place

    def slot(self, e: Element) -> int:
        return _number(_hash(b"slot", self._place(e), self._shape(e)))

    @staticmethod
    def exact_key(e: Element) -> int | None:
        """The exact hash of a subtree that is counted: within articles of one that is mostly links."""
        if e.exact and e.name in COUNTED and not e.held and (not e.inside or 2 * e.linked > e.total):
            return _number(e.exact)
        return None

    @staticmethod
    def box_key(e: Element) -> int | None:
        return _number(e.exact) if e.exact and e.inside and e.name in BOXES and not e.held else None

    def counted(self) -> set[int]:
        return {h for e in self.elements if (h := self.exact_key(e)) is not None}

    def reduced(self) -> Node:
        """The page's tree without what never is text; what no step can delete is in its parent's place."""
        root = Node()
        # Explicit stack: pages may nest deeper than Python recurses.
        stack = [(iter(self.root.children), self.root.name, AROUND if self.tops else FREE, root)]
        while stack:
            children, name, mode, node = stack[-1]
            c = next(children, None)
            if c is None:
                stack.pop()
                if name in BLOCK:
                    node.children.append(None)
            elif isinstance(c, str):
                if mode != AROUND:
                    node.children.append(c)
            elif c.name == "br":
                node.children.append(" ")
            elif c.name == "hr":
                node.children.append(None)
            else:
                if c.name in BLOCK:
                    node.children.append(None)
                if c.name in NEVER or c.name == "wbr":
                    continue
                under = node
                if id(c) in self.around:
                    pass
                elif id(c) in self.articles:
                    mode, under = INSIDE, Node(ARTICLE)
                else:
                    flags = BESIDE * (mode == AROUND) | OWN * furniture(c, mode == INSIDE)
                    if not flags and mode == FREE and not self.tops and c.name in COUNTED and not c.held and 2 * c.linked > c.total:
                        flags = LINKED
                    slot, exact, box = self.slot(c) if flags else None, self.exact_key(c), self.box_key(c)
                    mode = FREE if mode == AROUND else mode
                    if flags or exact is not None or box is not None or c.name == "a":
                        under = Node(flags | LINK * (c.name == "a"), slot, exact, box)
                if under is not node:
                    node.children.append(under)
                stack.append((iter(c.children), c.name, mode, under))
        return root


def packed(root: Node) -> bytes:
    """A reduced tree as bytes, however deep it is."""
    flat: list = []
    stack = [iter(root.children)]
    while stack:
        c = next(stack[-1], stack)
        if c is stack:
            stack.pop()
            flat.append(0)
        elif isinstance(c, Node):
            flat.append((c.flags, c.slot, c.exact, c.box))
            stack.append(iter(c.children))
        else:
            flat.append(c)
    return zstandard.ZstdCompressor(level=1).compress(marshal.dumps(flat, 2))


def unpacked(data: bytes) -> Node:
    root = Node()
    stack = [root]
    for x in marshal.loads(zstandard.ZstdDecompressor().decompress(data)):
        if x == 0:
            stack.pop()
        elif isinstance(x, tuple):
            c = Node(*x)
            stack[-1].children.append(c)
            stack.append(c)
        else:
            stack[-1].children.append(x)
    return root


def edges(top: Node, template: set[int], met: set[int] | None) -> set[int]:
    """The ids of the template boxes that an article begins or ends with, also within a box around its text. With met,
    that gets the keys of all boxes that could be such."""
    gone: set[int] = set()
    for place, order in ((FIRST, iter), (LAST, reversed)):
        todo = [top]
        while todo:
            for c in order(todo.pop().children):
                if not isinstance(c, Node):
                    if c and c.strip():
                        break
                    continue
                if not c.children or id(c) in gone or c.flags & OWN:
                    continue
                if c.box is None:
                    break
                if met is not None:
                    met.add(c.box ^ place)
                    todo.append(c)
                elif c.box ^ place in template:
                    gone.add(id(c))
                else:
                    todo.append(c)
                    break
    return gone


def main_text(root: Node, template: set[int] = frozenset(), rare: set[int] = frozenset(), *, core: bool = False, linked: bool = True, met: set[int] | None = None, slots: set[int] | None = None) -> str:
    """The text of a reduced tree without what template and rare delete. core: without all that could be deleted for its
    slot by either set; linked: with the text of links. The exact hashes and the slots on the way are added to met and slots."""
    blocks: list[str] = []
    run: list[str] = []
    gone: set[int] = set()

    def goes(c: Node) -> bool:
        if c.slot is not None:
            if slots is not None:
                slots.add(c.slot)
            if c.flags & (BESIDE | OWN) and (core or c.slot in rare) or c.slot in template:
                return True
        if c.exact is not None and met is not None:
            met.add(c.exact)
        return c.exact in template or id(c) in gone

    def flush() -> None:
        if run:
            if s := " ".join("".join(run).split()):
                blocks.append(s)
            run.clear()

    stack = [iter(root.children)]
    while stack:
        c = next(stack[-1], stack)
        if c is stack:
            stack.pop()
        elif c is None:
            flush()
        elif isinstance(c, str):
            run.append(c)
        elif c.flags & ARTICLE:
            gone |= edges(c, template, met)
            stack.append(iter(c.children))
        elif not goes(c) and (linked or not c.flags & LINK):
            stack.append(iter(c.children))
    flush()
    return "\n".join(blocks)


def _minima(text: str) -> np.ndarray | None:
    """Least hashes of the text's sentences, each weighed by its words; None for no text."""
    keys: list[int] = []
    for sentence in _SENTENCE.split(text):
        words = sentence.split()
        at = 0
        for k, w in enumerate(words, 1):
            # What goes on without an end is cut behind words that their hash tells.
            if k == len(words) or len(words) > LONG_SENTENCE and zlib.crc32(w.encode("utf-8", "replace")) % 16 == 0:
                h = zlib.crc32(" ".join(words[at:k]).encode("utf-8", "replace"))
                keys += [h + (j << 32) for j in range((k - at) // 4 + 1)]
                at = k
    if not keys:
        return None
    x = np.unique(np.array(keys, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(least, (x[k : k + 4096, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return least


def similarity_bands(text: str, unlinked: str) -> list[int]:
    """Keys of which pages with nearly the same text share one, if their text outside of links is nearly the same too."""
    if (least := _minima(text)) is None:
        return []
    parts = [least.reshape(BANDS, BAND_ROWS)]
    if unlinked != text and (other := _minima(unlinked)) is not None:
        parts.append(other.reshape(BANDS, BAND_ROWS))
    return [int.from_bytes(blake2b(b"".join(p[k].tobytes() for p in parts), digest_size=8).digest(), "little", signed=True) for k in range(BANDS)]


def holding(rows: DataFrame, keys: DataFrame, on: list[str], by: str) -> DataFrame:
    """The rows whose key is among the keys, which are distinct. The rows of a key are dealt to SALTS places by a column."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    places = salted.select(*on, "_salt").distinct().join(keys, on)
    return salted.join(places, [*on, "_salt"]).drop("_salt")


_PARSED = "page_id long, url string, host string, page long, content long, counted array<long>, met array<long>, slots array<long>, tree binary"


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, page, html) -> the same without html, with the page's hashes and its reduced tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, counted, met, slots, trees = [], [], [], [], []
            for source in b.column("html"):
                page = Page(source.as_py() or "")
                tree, own, places = page.reduced(), set(), set()
                text = main_text(tree, core=True, met=own, slots=places)
                content.append(_number(_hash(text.encode("utf-8", "replace"))))
                counted.append([*own.union(page.counted())])
                met.append([*own])
                slots.append([*places])
                trees.append(packed(tree))
            longs = pa.list_(pa.int64())
            columns = [*(b.column(c) for c in ("page_id", "url", "host", "page")), pa.array(content, pa.int64()), *(pa.array(x, longs) for x in (counted, met, slots)), pa.array(trees, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PARSED.split(", ")])
        trim()

    return spread(pages.select("page_id", "url", "host", "page", "html")).mapInArrow(run, _PARSED)


def verdicts(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """parsed() pages -> (host, hash, often): of the hashes in pages' texts those of template, and false for the slots that
    are on too few pages of the host to tell."""
    found = found.withColumn("content", F.xxhash64("host", "content"))
    on = ["host", "hash"]
    met = found.select("host", "page", F.explode("met").alias("hash"))
    held = found.select("host", "content", F.explode("counted").alias("hash")).distinct()
    often = held.groupBy(on).agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select(on)
    often = written(often.join(met.select(on).distinct(), on), "recurring")
    holders = written(holding(held, often, on, "content"), "holders")
    # Near copies count as one page: the similar ones among the pages that hold what recurs.

    def bands_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [unpacked(t.as_py()) for t in b.column("tree")]
            bands = [similarity_bands(main_text(t, core=True), main_text(t, core=True, linked=False)) for t in trees]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("content"), pa.array(bands, pa.list_(pa.int64()))], names=["host", "content", "bands"])

    copied = written(holders.select("content").distinct(), "copied")
    bands = found.select("host", "content", "tree").join(copied, "content", "left_semi").select("host", "content", "tree").mapInArrow(bands_of, "host string, content long, bands array<long>").groupBy("host", "content").agg(F.min("bands").alias("bands"))
    bands = bands.select("host", "content", F.posexplode("bands").alias("band", "value"))
    at = ["host", "band", "value"]
    least = bands.groupBy(at).agg(F.min("content").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = connected_components(holding(bands, least, at, "content").select(F.col("content").alias("u"), F.col("least").alias("v")))
    original = F.coalesce("component", "content").alias("original")
    apart = holders.join(copies.withColumnRenamed("id", "content"), "content", "left").select("host", "hash", original).distinct()
    exact = apart.groupBy(on).agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select(*on, F.lit(True).alias("often"))
    # Slots are told by place and shape; of pages of equal text one counts.
    slots = found.select("host", "page", "content", F.explode("slots").alias("hash"))
    places = slots.select("host", "content", "hash").distinct().groupBy(on).agg((F.count("*") >= min_pages).alias("often"))
    return exact.unionByName(places)


def by_page(found: DataFrame, known: DataFrame) -> DataFrame:
    """(page, template, rare): the verdicts on the hashes that each page's own text meets."""
    on = ["host", "hash"]
    asked = found.select("host", "page", F.explode(F.concat("met", "slots")).alias("hash")).distinct()
    return holding(asked, known, on, "page").groupBy("page").agg(*(F.collect_set(F.when(F.col("often") == x, F.col("hash"))).alias(name) for name, x in (("template", True), ("rare", False))))


@scoped
def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> the same ids and urls with their main text."""
    place = F.pmod(F.xxhash64("page_id"), F.lit(SALTS))  # so that copies of a page do not meet in one place
    with_host = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", host_of(F.col("url")).alias("host"))
    found = written(parsed(with_host.withColumn("page", F.xxhash64("host", "html", place))), "parsed", keep=True)
    known = written(verdicts(found), "verdicts")
    schema = "page_id long, url string, text string"

    def batch(b: pa.RecordBatch, sets: list[tuple[set[int], set[int]]]) -> pa.RecordBatch:
        texts = [main_text(unpacked(tree.as_py()), *own) for tree, own in zip(b.column("tree"), sets, strict=True)]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = known.limit(FEW_VERDICTS + 1).collect()
    if len(rows) <= FEW_VERDICTS:
        # So few go to every task; the pages stay where they are.
        hosts: dict[str, tuple[set[int], set[int]]] = {}
        for r in rows:
            hosts.setdefault(r["host"], (set(), set()))[not r["often"]].add(r["hash"])
        none = (set(), set())

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield batch(b, [hosts.get(h, none) for h in b.column("host").to_pylist()])

        return found.select("page_id", "url", "host", "tree").mapInArrow(told, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(b, [({*(t or ())}, {*(r or ())}) for t, r in zip(b.column("template").to_pylist(), b.column("rare").to_pylist(), strict=True)])

    told_pages = written(by_page(found, known), "templates", keep=True)
    return found.select("page_id", "url", "page", "tree").join(told_pages, "page", "left").select("page_id", "url", "tree", "template", "rare").mapInArrow(run, schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
