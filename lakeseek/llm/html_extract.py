"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A small linear
classifier with hand-set weights (path of elements, class and id words, share
of running text in an element, link share, length, punctuation) gives
each block the cost of either label; these are its capacities to the two
terminals. Neighbouring blocks, and successive blocks of one container, are
joined by smoothness edges. The minimum cut, found by maximum flow, is the
cheapest labelling; blocks on the content side make the text.

Edge cases: a null or empty page, and one without content, gives the empty
text; a page of any depth is read in linear time; text inside math, svg, button,
canvas and object elements is text of its line; unclosed tags, comments and quotes are read as browsers do; repeated
pages are extracted each; other columns pass through, but for those named
like the results, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import small_batches

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br math mi mo mn ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded menclose mtable mtr mtd semantics annotation button canvas object svg g path text tspan circle rect line polyline polygon ellipse defs use symbol".split())
_DROP = {"script", "style", "head", "template", "noscript", "iframe", "select", "textarea", "option", "audio", "video", "title"}
_NO_P_AROUND = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "body", "article", "main", "section", "div", "nav", "aside", "td"}
#: Words of class, id and role that speak against content, and for it.
_AGAINST = set("ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr notice alert warning popup modal overlay newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget footer foot header masthead topbar toolbar share sharing social related recommended more trending comment comments disqus reply replies respond discussion reader form search pagination pager skip copyright legal disclaimer meta tags rating poll".split())
#: Of these, those that hold of a wrapper of articles too.
_APART = set("comment comments disqus reply replies respond discussion related recommended more trending".split())
_FOR = set("article content entry post story main body text maintext prose".split())


#: Of these, those that prose inside an article outweighs: sections of a paper or a law bear such names too.
_SOFT = set("related recommended more trending side legal meta tags head foot copyright skip discussion search form rating poll disclaimer warning alert".split())


@dataclass(slots=True, eq=False)
class Node:
    """An element that holds blocks; ``kind`` is alike for elements of equal path."""

    tag: str
    words: frozenset[str]
    serial: int
    up: Node | None
    depth: int
    kind: int
    inside: bool
    wrapper: int | None  # kind of the path around the first article or main element


@dataclass(slots=True)
class Block:
    text: str
    at: Node | None
    link_chars: int
    parent: int

    @property
    def tag(self) -> str:
        return self.at.tag if self.at else ""


_HELD = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "td", "th", "pre")


class _Page:
    """Reads a page once, from start to end, in time linear in its size however deep its elements lie."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, Node | None]] = []
        self.holders: list[Node] = []
        self.opened: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.parts: list[str] = []
        self.links = self.linked = self.dropped = self.serial = 0
        at = 0
        n = len(page)
        while at < n:
            m = _TAG.search(page, at)
            if m is None:
                self.data(page[at:])
                break
            if m.start() > at:
                self.data(page[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["end"]:
                self.close(name)
                continue
            self.open(name, m["attrs"])
            if name in _RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
                self.close(name)
        self.flush()

    def data(self, text: str) -> None:
        if not self.dropped:
            self.parts.append(text)
            if self.linked:
                self.links += len(text.strip())

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", _html.unescape("".join(self.parts))).strip()
            if text:
                holder = self.holders[-1] if self.holders else None
                group = holder.up if holder and holder.up and holder.tag in _HELD else holder
                self.blocks.append(Block(text, holder, min(self.links, len(text)), group.serial if group else -1))
            self.parts = []
        self.links = 0

    def left(self, name: str) -> None:
        self.opened[name] -= 1
        self.linked -= name == "a"
        self.dropped -= name in _DROP

    def pop_to(self, k: int) -> None:
        for name, node in self.stack[k:]:
            self.left(name)
            if node is not None:
                self.holders.pop()
        del self.stack[k:]

    def open(self, name: str, attrs: str) -> None:
        if name == "br":
            self.data(" ")
            return
        if name not in _INLINE:
            self.flush()
            if name in _NO_P_AROUND:
                self.end_implied({"p"})
            if name in _SELF_CLOSING:
                self.end_implied(_SELF_CLOSING[name])
            if name == "body":
                self.end_implied({"head"})
        elif name == "a" and self.opened.get("a"):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "a":
                    self.left("a")
                    del self.stack[k]
                    break
                if self.stack[k][0] not in _INLINE:
                    break
        if name in _VOID:
            return
        words: set[str] = set()
        hidden = False
        if attrs:
            for m in _ATTR.finditer(attrs):
                key = m[1].lower()
                value = m[2] or m[3] or m[4] or ""
                if key in ("class", "id", "role", "aria-label", "itemprop"):
                    words.update(_WORD.findall(value.lower()))
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    hidden = True
        if hidden:
            words.add("popup")
            words.add("hidden")
        self.serial += 1
        node = None
        if name not in _INLINE:
            up = self.holders[-1] if self.holders else None
            key = (up.kind if up else 0, name, frozenset(words))
            kind = self.kinds.setdefault(key, len(self.kinds) + 1)
            main = name in ("article", "main")
            wrapper = up.wrapper if up and up.wrapper is not None else (up.kind if up else 0) if main else None
            node = Node(name, key[2], self.serial, up, up.depth + 1 if up else 0, kind, bool(main or up and up.inside), wrapper)
            self.holders.append(node)
        self.stack.append((name, node))
        self.opened[name] = self.opened.get(name, 0) + 1
        self.linked += name == "a"
        self.dropped += name in _DROP

    def end_implied(self, names: set[str]) -> None:
        if not any(self.opened.get(x) for x in names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                self.pop_to(k)
                return
            if self.stack[k][0] in _SCOPE:
                return

    def close(self, name: str) -> None:
        if name not in _INLINE or name == "br":
            self.data(" ") if name == "br" else self.flush()
        if not self.opened.get(name):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                if name in _INLINE:
                    self.left(name)
                    del self.stack[k]
                else:
                    self.pop_to(k)
                return
            if name in _INLINE and self.stack[k][0] not in _INLINE:
                return


def home(blocks: list[Block]) -> int | None:
    """The wrapper of most of the text that stands in article and main elements."""
    size: dict[int, int] = {}
    for b in blocks:
        if b.at and b.at.wrapper is not None:
            size[b.at.wrapper] = size.get(b.at.wrapper, 0) + len(b.text)
    return max(size, key=size.__getitem__, default=None)


def is_prose(b: Block) -> bool:
    return len(b.text) > 40 and 10 * b.link_chars < 3 * len(b.text) and any(c in b.text for c in ".!?。")


class Judge:
    """Costs of the two labels of a page's blocks; what the elements around a block say is summed once an element."""

    def __init__(self, blocks: list[Block]):
        self.home = home(blocks)
        self.known: dict[tuple[int, bool], float] = {}
        # characters of all blocks of an element, and of those that are running text
        size: dict[int, list[int]] = {}
        nodes: dict[int, Node] = {}
        for b in blocks:
            at = b.at
            if at is not None:
                now = size.setdefault(at.serial, [0, 0])
                now[0] += len(b.text)
                now[1] += len(b.text) * is_prose(b)
            while at is not None and at.serial not in nodes:
                nodes[at.serial] = at
                at = at.up
        for k in sorted(nodes, reverse=True):
            if (up := nodes[k].up) is not None:
                now = size.setdefault(up.serial, [0, 0])
                now[0] += size[k][0]
                now[1] += size[k][1]
        self.prose = {k for k, (n, m) in size.items() if 2 * m > n}

    def element(self, e: Node, at_home: bool) -> float:
        """What one element says."""
        score = 0.0
        if e.tag in ("article", "main"):
            score += 6
        elif e.tag in ("nav", "footer", "aside", "form", "menu", "dialog"):
            score -= 14
        elif e.tag == "header":
            score -= 2 if e.inside else 10
        if e.words:
            bad, good = e.words & _AGAINST, e.words & _FOR
            if at_home and not e.inside:
                bad &= _APART
            elif e.inside and e.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                bad = frozenset()
            elif e.inside and e.serial in self.prose:
                bad -= _SOFT
            if bad and not (e.tag in ("article", "main", "body", "html") or good and e.tag != "div"):
                score -= 13 if not good or e.words & {"comment", "comments", "ad", "ads", "sidebar", "footer", "menu", "nav"} else 4
            elif good and not e.inside:
                score += 4
        return score

    def path(self, at: Node | None, at_home: bool) -> float:
        todo = []
        while at is not None and (at.serial, at_home) not in self.known:
            todo.append(at)
            at = at.up
        score = self.known[at.serial, at_home] if at is not None else 0.0
        for e in reversed(todo):
            score += self.element(e, at_home)
            self.known[e.serial, at_home] = score
        return score

    def costs(self, b: Block) -> tuple[int, int]:
        """Cost of calling a block boilerplate, and of calling it content."""
        n = len(b.text)
        link = b.link_chars / n
        inside = bool(b.at and b.at.inside)
        at_home = self.home is not None and b.at is not None and b.at.wrapper == self.home
        score = self.path(b.at, at_home)
        if not inside:
            score += min(n, 400) / 100 - 2.0
        score -= (3 if inside else 7) * (link > 0.5)
        if n > 80 and is_prose(b):
            score += 1.5
        if b.tag in ("h1", "h2", "h3") and not inside:
            score += 1
        k = int(round(score * 10))
        return max(k, 0), max(-k, 0)


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes on the source side of a minimum cut; Dinic's algorithm.

    ``source``/``sink``: capacities from and to the terminals; ``edges``: (a, b, capacity each way).
    """
    n = len(source)
    s, t = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def arc(a: int, b: int, c: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(source[i], sink[i])
        if source[i] > both:
            arc(s, i, source[i] - both, 0)
        elif sink[i] > both:
            arc(i, t, sink[i] - both, 0)
    for a, b, c in edges:
        if c:
            arc(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for a in queue:
            for e in out[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        next_ = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                push = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= push
                    cap[e ^ 1] += push
                first = next(k for k, e in enumerate(path) if not cap[e])
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while next_[a] < len(out[a]):
                e = out[a][next_[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                next_[a] += 1
            else:
                if a == s:
                    break
                e = path.pop()
                a = to[e ^ 1]
                next_[a] += 1
                continue
            path.append(e)
            a = to[e]


def main_text(page: str | None, adjacency: int = 4, proximity: int = 12) -> str:
    """The content blocks of a page, one on a line."""
    if not page:
        return ""
    blocks = _Page(page).blocks
    if not blocks:
        return ""
    judge = Judge(blocks)
    pair = [judge.costs(b) for b in blocks]
    edges = [(i, i + 1, adjacency) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.parent in last:
            edges.append((last[b.parent], i, proximity))
        last[b.parent] = i
    label = min_cut([c for c, _ in pair], [c for _, c in pair], edges)
    return "\n".join(b.text for b, on in zip(blocks, label) if on)


def extract_main_text(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` without ``html``, with the main text and its number of code points; columns of these names are replaced."""
    small_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html, text, n_chars)]
    pages = pages.select(*rest, html)
    schema = T.StructType(list(pages.schema.fields)[:-1]).add(text, "string").add(n_chars, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = [main_text(h) for h in part.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)
