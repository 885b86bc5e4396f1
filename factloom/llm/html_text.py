"""HTML extraction by composite text density.

A page is read into a tree of block elements (inline markup belongs to its
block); only what shows no text (head, scripts, styles, hidden parts) isn't part of it. Each node's
density is its characters per tag, adjusted for links:

    C/T * log_b((C/LC) * (T/LT)),  b = ln(C/(C-LC) * LC + LCb/Cb * C + e)

with C characters, T tags, LC link characters, LT link tags, and Cb, LCb those
of the body. Parts that name themselves as no article (menus, page headers, footers,
sidebars, notices, adverts, forms, reader comments), by element or by a word of their class, id or
role, count as links, so their density is zero. Such a name doesn't count if it
only says what a part has (with-sidebar, hasComments), or if the part holds the page's main element or
largest article, which makes it the frame of these. An inline element that names itself so is left out, and ends with its block at
the latest, as does a link.

The densities of a node's children are summed, and the subtree of
the largest sum is the main text. The least density on its path to the body is
the threshold: other subtrees at or above it give their own largest-sum part, and named
parts below it are left out. A heading or a short paragraph can't reach the threshold by itself, so what was
chosen is widened to the blocks of text elements next to it, in page order, up to
a block that is mostly links, is no text element or shares only the body with the
main text; headings right before chosen text stay in any case.

Defined results: null or empty html gives an empty text; a page without text
outside parts that name themselves gives an empty text; a page cut off anywhere is read as
far as it goes (an unfinished tag is dropped, an unfinished reference is plain
text); plain text without markup is one block. White space is what str.split()
takes for it. Repeated rows give the same text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, workers_import_us

#: Names of HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
GONE = frozenset("select textarea input script style noscript template svg math canvas iframe object embed audio video map head title noembed noframes xmp".split())
NAMED = frozenset("nav menu aside footer form fieldset dialog search".split())
ENDS_P = BLOCK - frozenset(["html", "body"])
OWN_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th", "tbody", "thead"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
SCOPES = frozenset("ul ol dl table div article section main body html td th blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = HEADINGS | frozenset("address blockquote caption dd div dt figcaption li p pre summary td th".split())
#: Words in class, id or role that mark a part as no article, by what the part is.
MENUS = "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination"
HEADERS_FOOTERS = "masthead footer contentinfo"
SIDEBARS = "sidebar aside complementary"
NOTICES = "cookie cookies consent gdpr alertdialog modal popup dialog toast overlay"
ADVERTS = "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored"
FORMS = "form login signup newsletter"
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
MARKS = COMMENTS | frozenset(" ".join([MENUS, HEADERS_FOOTERS, SIDEBARS, NOTICES, ADVERTS, FORMS]).split())
#: Words that do so outside an article only; within one they are its own title, or a box of its text.
OUTSIDE = frozenset("header banner alert notice notices notification notifications".split())
#: Words before a mark that say what a part has or lacks, not what it is.
HAVING = frozenset("with has have no non not without show hide".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|<(?=/?[a-zA-Z])[^<]*\Z", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style|type)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element. out: shows no text; marked: names itself as no article; named: that counts, for it or a part that it is in; closed: its end was read."""

    __slots__ = ("best", "chars", "children", "closed", "density", "link_chars", "link_tags", "marked", "name", "named", "named_tags", "out", "sum", "tags", "up")

    def __init__(self, name: str, up: Node | None, out: bool, marked: str = ""):
        self.name, self.up, self.out, self.marked, self.named, self.closed = name, up, out, marked, False, False
        self.children: list = []  # nodes, and [text, characters in links] runs
        self.chars = self.tags = self.link_chars = self.link_tags = self.named_tags = 0
        self.density = self.sum = 0.0
        self.best: Node = self


def _marks(name: str, raw: str, in_article: bool) -> str:
    """How an element's attributes mark it as no part of the article: "hidden", "comments", "other" or not at all."""
    if not raw or raw.isspace():
        return ""
    found = ""
    for key, value in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return "hidden"
        if key not in ("class", "id", "role"):
            continue
        for token in value.split():
            words = [w.lower() for w in _WORD.findall(token)]
            says = {w for k, w in enumerate(words) if not k or words[k - 1] not in HAVING}
            if says & COMMENTS:
                found = "comments"
            elif says & MARKS or not in_article and says & OUTSIDE:
                found = found or "other"
    return found


def parse(page: str) -> Node:
    """The tree of a page's blocks, under a root that stands for the body."""
    root = Node("body", None, False)
    now, article = root, 0
    opened: list[tuple[str, Node]] = []  # inline elements to leave out, by name, with the block that each began in
    link: Node | None = None  # the block that the open link began in
    at, end = 0, len(page)

    def add(raw: str) -> None:
        if not raw or now.out or opened:
            return
        text = html.unescape(raw) if "&" in raw else raw
        kids = now.children
        if kids and isinstance(kids[-1], list):
            kids[-1][0].append(text)
        else:
            kids.append([[text], 0])
        if link is not None:
            kids[-1][1] += len("".join(text.split()))

    def leave() -> None:
        nonlocal now, article, link
        now.closed = True
        article -= now.name in ("article", "main")
        if link is now:
            link = None
        while opened and opened[-1][1] is now:
            opened.pop()
        now = now.up

    def close(names, scopes=SCOPES) -> None:
        node = now
        while node.up is not None and node.name not in names:
            if node.name in scopes:
                return
            node = node.up
        if node.up is not None:
            while not node.closed:
                leave()

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name, raw = name.lower(), m.group(3)
        if m.group(1):
            if name == "a":
                link = None
            last = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == name), None)
            if last is not None:
                del opened[last:]
            elif name in BLOCK or name in GONE:
                if name not in ("body", "html"):
                    close((name,), frozenset(["article", "main", "table"]) - {name} if name in ("p", "li", "dd", "dt") else frozenset())
            continue
        if name in ("html", "body"):
            continue
        if name == "br":
            add(" ")
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else end
            if stop:
                tail = page.find(">", at)
                at = tail + 1 if tail >= 0 else end
            continue
        if name in VOID and name != "hr":
            if name == "img":
                add(" ")
            continue
        if name in BLOCK or name in GONE:
            if name in ENDS_P:
                close(("p",), SCOPES)
            if name in OWN_CLOSE:
                close(OWN_CLOSE[name], SCOPES - {"td", "th"} if name in ("tr", "tbody", "thead", "tfoot") else SCOPES)
            if name == "hr":
                now.children.append(Node("hr", now, False))
                continue
            marked = _marks(name, raw, article > 0)
            if name == "main" or name == "article" and marked not in ("comments", "hidden") and not (article and marked):
                marked = ""
            elif name in NAMED or name == "header" and not article:
                marked = marked or "element"
            out = now.out or bool(opened) or name in GONE or marked == "hidden"
            now.children.append(node := Node(name, now, out, marked))
            now = node
            article += name in ("article", "main")
            continue
        if name == "a":
            link = now
            if not now.out:
                now.link_tags += 1
        if not raw.endswith("/") and _marks(name, raw, article > 0):
            opened.append((name, now))
    return root


def _size(run: list) -> int:
    return len("".join("".join(run[0]).split()))


def _shown(root: Node) -> list[Node]:
    """All nodes that show text or hold some that do, each before what it holds."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.out)
    return order


def resolve(root: Node) -> None:
    """Which marks count: all but those of frames, which hold the main element or the largest article. Reader comments are never a frame."""
    order = _shown(root)
    held: dict[int, int] = {}
    for node in reversed(order):
        held[id(node)] = sum(_size(c) if isinstance(c, list) else held.get(id(c), 0) for c in node.children)
    bodies = [n for n in order if n.name == "main"] or [n for n in order if n.name == "article" and not n.marked]
    frames: set[int] = set()
    node = max(bodies, key=lambda n: held[id(n)], default=None)
    while node is not None:
        frames.add(id(node))
        node = node.up
    for node in order:
        own = node.marked == "comments" or bool(node.marked) and id(node) not in frames
        node.named = own or node.up is not None and node.up.named


def weigh(root: Node) -> None:
    """Counts characters and tags of every subtree, then densities and their sums, without recursion. What is named counts as links."""
    order = _shown(root)
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, list):
                size = _size(c)
                node.chars += size
                node.link_chars += size if node.named else c[1]
            elif not c.out:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
                node.named_tags += c.named_tags + c.named
    ratio = root.link_chars / root.chars if root.chars else 0.0
    for node in order:
        tags = node.tags + node.link_tags
        node.density = _density(node.chars, tags, node.link_chars, tags if node.named else node.link_tags + node.named_tags, ratio)
    for node in reversed(order):
        kids = [c for c in node.children if isinstance(c, Node) and not c.out]
        # a text run of its own counts as a child without tags
        loose = sum(_size(c) for c in node.children if isinstance(c, list)) if kids and not node.named else 0
        node.sum = sum(c.density for c in kids) + loose if kids else node.density
        # the node of the largest sum within; of equal ones the outermost, then the first
        node.best = node
        for c in kids:
            if c.chars and c.best.sum > node.best.sum:
                node.best = c.best


def _density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    if not chars:
        return 0.0
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + ratio * chars + math.e)
    value = chars / lc * (t / lt)
    return chars / t * math.log(max(value, 1.0)) / math.log(base) if base > 1 + 1e-9 else chars / t * math.log(max(value, 1.0) + math.e - 1)


def choose(root: Node) -> tuple[list[Node], list[Node], Node | None]:
    """The subtrees that hold the main text; the named parts to leave out; and the frame: the part right below the body with the subtree of the largest sum."""
    if not root.chars:
        return [], [], None
    path, node = [], root.best
    while node is not None:
        path.append(node)
        node = node.up
    threshold = min(n.density for n in path)
    order = _shown(root)
    chosen = [root.best, *(n.best for n in order if n is not root and n.chars and n.density >= threshold)]
    if root.link_chars < root.chars:
        left = [n for n in order if n.named and n.density < max(threshold, math.ulp(0.0))]
    else:  # all text is in named parts or links: only those named by their element, or as comments, are sure to be no article
        left = [n for n in order if n.named and (n.name in NAMED or n.marked == "comments")]
    return chosen, left, path[-2] if len(path) > 1 else root


def blocks(root: Node, chosen: list[Node], left: list[Node], frame: Node | None) -> list[str]:
    """Texts of the chosen subtrees' blocks and of those that widen them, in page order; white space is one space."""
    ids, without = {id(n) for n in chosen}, {id(n) for n in left}
    found: list[tuple[str, bool, bool, bool]] = []  # text, chosen, may widen, is a heading
    stack: list = [(root, root, False, False)]
    while stack:
        item, owner, taken, inside = stack.pop()
        if isinstance(item, list):
            text = " ".join("".join(item[0]).split())
            if text:
                plain = 2 * item[1] <= len(text) - text.count(" ")
                found.append((text, taken, inside and plain and owner.name in TEXT, plain and owner.name in HEADINGS))
        elif not item.out and id(item) not in without:
            taken, inside = taken or id(item) in ids, inside or item is frame
            stack.extend((c, item, taken, inside) for c in reversed(item.children))
    keep = [taken for _, taken, _, _ in found]
    for k in range(1, len(found)):
        keep[k] = keep[k] or keep[k - 1] and found[k][2]
    for k in range(len(found) - 2, -1, -1):
        keep[k] = keep[k] or keep[k + 1] and (found[k][2] or found[k][3])
    return [text for (text, *_), kept in zip(found, keep, strict=True) if kept]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    resolve(root)
    weigh(root)
    return "\n\n".join(blocks(root, *choose(root)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars), one for each row of pages."""
    workers_import_us(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(page) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
