"""Main text of web pages by composite text density.

Every element gets the density of its text: characters per tag, adjusted for the share that
stands in links and in link tags, against the page's average.  The density sum of an element
is the sum over its children.  The element with the largest sum is the heart of the page; the
least density on its path up to the body is the threshold, and the elements that reach it
belong to the article as well.  What is no content by its nature (scripts, menus, forms) or by
its announced role (sidebar, advert, comments) has no part in it.  Where the page itself marks
an article around the heart, that is the article.

Scale: pages are independent, so this is one pass without a shuffle; a page's tree is the
working set.

Defined results: null, empty or markup-only pages have the empty text; broken markup (unclosed
or stray tags, cut-off pages) is read as far as it goes; rows are independent, so repeated
rows and ids get a row each.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.text import map_texts

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article.
OUTSIDE = RAW | set(
    "head nav footer aside form noscript template svg canvas object audio video select "
    "button menu dialog fieldset datalist option map annotation annotation-xml".split())
#: Words of class, id or role that announce something beside the article.
BESIDE = set(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner banners sponsor "
    "sponsored promo promos promotion nav navi navbar navigation menu menus topbar breadcrumb breadcrumbs "
    "footer sidebar side aside widget widgets complementary contentinfo cookie cookies consent gdpr "
    "notice notices notification notifications alert disclaimer comment comments commentlist discussion "
    "respond reply replies responses disqus share sharing social related recommended recommendations newsletter "
    "subscribe subscription signup login popup popups modal overlay pagination pager toolbar search "
    "searchbox masthead form skip hidden copyright tags tagcloud toc".split())
#: Those of them that may as well name a part of the article.  In a marked article, on headings
#: and paragraphs, and in an id they count only where most of the text stands in links.
AMBIGUOUS = set(
    "side aside complementary notice notices notification notifications alert disclaimer discussion "
    "respond reply replies responses share sharing social related recommended recommendations "
    "subscription search form skip copyright tags toc menu menus promotion overlay toolbar".split())
#: Class or id of a page's header that is not marked as such by its tag.
HEADERS = {"header", "site-header", "page-header", "top-header", "main-header", "global-header"}
#: Beginnings of class names that speak of something else on the page.
ELSEWHERE = ("has-", "with-", "no-", "without-", "js-", "is-")
CONTAINERS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | set(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure "
    "footer form header hgroup hr html legend li main ol p pre section summary table tbody tfoot "
    "thead tr ul".split())
#: Start tags that end an open paragraph, and tags that end an open one of their own kind.
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "tbody", "thead", "tfoot", "tr", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"},
            "td": {"td", "th"}, "th": {"td", "th"}}
BORDERS = {"ul", "ol", "dl", "table", "select", "body", "article", "section", "div", "main"}
WORDS = re.compile(r"[a-z]+")
PARTS = re.compile(r"[^\W_]+")


class Node:
    __slots__ = ("beside", "chars", "children", "density", "down", "link_chars", "link_tags",
                 "parent", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, beside: str = "") -> None:
        self.tag, self.parent, self.beside = tag, parent, beside
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.down = 0.0


def _beside(tag: str, attributes: str) -> str:
    """Why the element is no content: by its ``tag`` or its ``name``; ``header``; or nothing.

    ``class`` and ``id``: perhaps, by an ambiguous word there; ``_decide`` settles it.
    """
    if tag == "dialog" and any(k.lower() == "open" for k, *_ in ATTRIBUTE.findall(attributes)):
        return "id"
    if tag in OUTSIDE:
        return "tag"
    if tag == "header":
        return "header"
    if not attributes or tag in ("html", "body", "main"):
        return ""
    text, perhaps = tag in HEADINGS or tag == "p", ""
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id", "role"):
            own = [x for x in value.split() if not x.startswith(ELSEWHERE)]
            found = BESIDE.intersection(w for x in own for w in _ends(x))
            if found and not (text and key == "id"):
                if not found <= AMBIGUOUS:
                    return "name"
                perhaps = "id" if text or key == "id" else "class"
            if not HEADERS.isdisjoint(own):
                return "header"
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return "tag"
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "tag"
    return perhaps


def _ends(token: str) -> list[str]:
    """The first and the last part of a class or id, if they are words."""
    parts = PARTS.findall(token)
    return [w for x in {*parts[:1], *parts[-1:]} for w in [x.rstrip("0123456789")] if WORDS.fullmatch(w)]


def _decide(root: Node) -> None:
    """Settles what an ambiguous name left open, by the share of the text that stands in links."""
    order, stack = [], [(root, False)]
    while stack:
        x, inside = stack.pop()
        order.append((x, inside))
        if x.beside not in ("tag", "name"):
            inside = inside or x.tag in CONTAINERS
            stack += [(c, inside) for c in x.children if isinstance(c, Node)]
    chars: dict[int, tuple[int, int]] = {}
    for x, inside in reversed(order):
        total = linked = 0
        for c in x.children if x.beside not in ("tag", "name") else ():
            a, b = (len(c.strip()),) * 2 if isinstance(c, str) else chars[id(c)]
            total, linked = total + a, linked + (0 if isinstance(c, str) else b)
        chars[id(x)] = total, total if x.tag == "a" else linked
        if x.beside in ("class", "id"):
            by_name = x.beside == "class" and not inside
            x.beside = "name" if by_name or total and linked * 2 >= total else ""


def parse(page: str) -> Node:
    """The page as a tree under a body; text is decoded, broken markup is closed."""
    root = Node("body", None)
    at, node, place, size = 0, root, 0, len(page)

    def text(to: int) -> None:
        if at < to:
            node.children.append(entities.unescape(page[at:to]))

    def close(names: set[str], borders: set[str]) -> None:
        nonlocal node
        x = node
        while x is not root and x.tag not in borders:
            if x.tag in names:
                node = x.parent
                return
            x = x.parent

    while place < size:
        m = TAG.search(page, place)
        if not m:
            break
        text(m.start())
        at = place = max(m.end(), m.start() + 1)
        name = (m[2] or "").lower()
        if not name or name in ("html", "body"):
            continue
        if m[1]:
            x = node
            while x is not root and x.tag != name:
                # A stray inline end tag does not close blocks.
                if x.tag in BLOCKS and name not in BLOCKS:
                    x = root
                    break
                x = x.parent
            if x is not root:
                node = x.parent
            continue
        if name in CLOSES_P:
            close({"p"}, BORDERS | {"li", "td", "th", "blockquote"})
        if name in SIBLINGS:
            close(SIBLINGS[name], BORDERS - {"div", "section"})
        child = Node(name, node, _beside(name, m[3]))
        if name == "main":  # what holds the main part is not beside it, whatever it is called
            x = node
            while x is not None:
                x.beside = "" if x.beside in ("name", "class", "id") else x.beside
                x = x.parent
        node.children.append(child)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, place)
            at = place = end.end() if end else size
        elif name not in VOID:
            node = child
    text(size)
    _decide(root)
    return root


def _order(root: Node) -> list[Node]:
    """Elements that may hold content, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [c for c in reversed(x.children) if isinstance(c, Node) and not _excluded(c)]
    return out


def _excluded(x: Node) -> bool:
    """Whether the element is no content; of an article's own header the headings are."""
    if x.beside == "header":
        p = x.parent
        while p is not None and p.tag not in CONTAINERS:
            p = p.parent
        return p is None
    return bool(x.beside)


def _measure(order: list[Node]) -> None:
    for x in reversed(order):
        in_link = x.tag == "a"
        for c in x.children:
            if isinstance(c, str):
                x.chars += len(c) - c.count(" ") // 2 if c.strip() else 0
            elif not _excluded(c):
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
        if in_link:
            x.link_chars, x.link_tags = x.chars, x.tags
    body = order[0]
    share = body.link_chars / max(body.chars, 1)
    for x in order:
        if not x.chars:
            continue
        c, t, lc, lt = x.chars, max(x.tags, 1), x.link_chars, x.link_tags
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        x.density = c / t * math.log(c / max(lc, 1) * t / max(lt, 1) + 1) / base
    for x in reversed(order):
        x.down = sum(c.density for c in x.children if isinstance(c, Node))


def _chosen(order: list[Node]) -> list[Node]:
    """Roots of the article, in page order."""
    body = order[0]
    # Only blocks can be the heart: inline marks are part of their paragraph.
    heart = max((x for x in order if x.tag in BLOCKS or x is body), key=lambda x: x.down)
    if heart.down <= 0:
        heart = body
    marked = [x for x in order if x.tag in CONTAINERS]
    up = heart
    while up is not None and up.tag != "article":
        up = up.parent
    if up is None:
        up = heart
        while up is not None and up.tag not in CONTAINERS:
            up = up.parent
    if up is None and len(marked) == 1 and heart is body:
        up = marked[0]
    if up is not None:
        return [up]
    threshold, x = heart.density, heart
    while x is not None:
        threshold = min(threshold, x.density)
        x = x.parent
    out, stack = [], [body]
    while stack:
        x = stack.pop()
        if x is heart:
            out.append(x)
            continue
        inside = heart
        while inside is not None and inside is not x:
            inside = inside.parent
        # Titles are short, so the threshold is not for them.
        if inside is None and (x.density >= threshold or x.tag == "h1") and x.link_chars * 2 < x.chars:
            out.append(x)
        elif inside is not None or x is body:
            stack += [c for c in reversed(x.children) if isinstance(c, Node) and not _excluded(c)]
    return out


def _link_list(x: Node) -> bool:
    """A menu without a name: three or more links and nothing else, outside a marked article."""
    if x.tag not in ("ul", "ol", "div", "p") or x.link_tags < 3 or x.link_chars < x.chars:
        return False
    while x is not None and x.tag != "article":
        x = x.parent
    return x is None


def _blocks(roots: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        block = " ".join("".join(run).split())
        run.clear()
        if block:
            out.append(block)

    for root in roots:
        stack: list[tuple[Node | str, bool]] = [(root, False)]
        while stack:
            x, done = stack.pop()
            if isinstance(x, str):
                run.append(x)
                continue
            if done:
                end()
                continue
            if _excluded(x) or _link_list(x):
                run.append(" ")
                continue
            if x.tag in ("br", "td", "th", "img", "wbr"):
                run.append("" if x.tag == "wbr" else " ")
            kids = x.children
            if x.beside == "header":
                kids = [c for c in _under(x) if c.tag in HEADINGS]
            if x.tag in BLOCKS:
                end()
                stack.append((x, True))
            stack += [(c, False) for c in reversed(kids)]
        end()
    return out


def _under(x: Node) -> list[Node]:
    out, stack = [], [x]
    while stack:
        n = stack.pop()
        if n.tag in HEADINGS and not n.beside:
            out.append(n)
        else:
            stack += [c for c in reversed(n.children) if isinstance(c, Node) and not c.beside]
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, each with single spaces, two line ends between them."""
    if not page:
        return ""
    order = _order(parse(page))
    _measure(order)
    return "\n\n".join(_blocks(_chosen(order)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            piece = batch.slice(at, 500)
            texts = [main_text(h) for h in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("page"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page", "text", "n_chars"])


def _schema(pages: DataFrame) -> str:
    return f"page {pages.schema['page'].dataType.simpleString()}, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` as ``page``, with the main text and its length in code points."""
    packed = pages.select(F.struct("*").alias("page"), "html")
    return map_texts(packed, _extract, _schema(packed))


def report(pages: DataFrame) -> DataFrame:
    narrow = pages.select(F.struct("page_id", "url").alias("page"), "html")
    told = map_texts(narrow, _extract, _schema(narrow))
    return told.select("page.page_id", "page.url", "text", "n_chars")
