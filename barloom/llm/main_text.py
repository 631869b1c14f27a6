"""Main text of web pages by composite text density.

A page is read into a tree of elements. Scripts, styles, forms and other parts that hold no article text are never
part of it, nor is an element whose name, role, class or id says that it is navigation, a header or footer, a side
bar, a notice, an advert or reader comments. Ids made from titles hold such words too. So headings never go by their
class, id or role; inside an article or main element nothing goes by them but containers with an unambiguous name, and
then only where their density is low as well, which also decides outside of it on paragraphs and on names with words
that titles hold.

For every node, with its characters C, tags T, link characters LC and link tags LT (all of its subtree), the composite
density is ``C/T * log(C/LC * T/LT) / log(log(C/nLC * LC + LCb/Cb * C + e))``, where nLC = C - LC and b is the body;
zeros count as one where they divide. A node's density sum adds those of its children and of its own text. The node
with the greatest sum sets the threshold, the least density on its path to the body; of the nodes at or above it the
one with the greatest sum is selected, and grown to the article or main element around it. Its text is given by blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.byte_bpe import blocks

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("script style noscript iframe noembed noframes template head title svg annotation annotation-xml canvas object audio video map form button select textarea input option datalist fieldset nav aside footer menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
#: What an opening tag closes, up to the nearest element that holds such parts.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements that an end tag of something around them doesn't reach through.
SCOPES = frozenset(["html", "table", "td", "th", "caption", "template"])
#: Words in a class or id, or a role, of what isn't article text.
AWAY = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion
    nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail footer masthead header topbar toolbar pagination pager
    notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login paywall
    comment comments commentlist disqus respond replies discussion share sharing social related recommended recommendations
    widget complementary contentinfo search hidden skip""".split()
)
#: Of these the ones that mean nothing else; inside an article only whole names of these count.
PLAIN = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsored nav navbar navigation breadcrumb breadcrumbs sidebar
    masthead topbar toolbar pagination pager cookie cookies gdpr popup modal newsletter paywall comments commentlist disqus
    contentinfo""".split()
)
#: Words that ids made from titles often hold.
TITLES = frozenset("discussion related share sharing social search comment respond replies promotion consent subscription".split())
#: What a name can cut inside an article.
CONTAINERS = frozenset("div section ul ol dl table center article details figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>\x00]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)>)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"\s+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("name", "parent", "parts", "away", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, name: str, parent: Node | None, away: bool | str = False):
        self.name, self.parent, self.away = name, parent, away
        self.parts: list[Node | str] = []


def _away(name: str, attributes: str, inside: set[str]) -> bool | str:
    """True for what an element's kind or style hides; for what its class, id or role tells "named", or "perhaps" where
    its density has to be low as well."""
    if name in HIDDEN or name == "header" and "article" not in inside and "main" not in inside:
        return True
    if not attributes or name == "main":
        return False
    found: bool | str = False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDING.search(value):
            return True
        if key not in ("class", "id", "role") or name in HEADINGS:
            continue
        if inside:
            if name in CONTAINERS and any(w in PLAIN for w in value.lower().split()):
                found = found or "perhaps"
            continue
        words = re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", value).lower())
        if any(w in AWAY for w in words):
            found = "named" if name != "p" and any(w in AWAY and w not in TITLES for w in words) else found or "perhaps"
    return found


def parse(html: str) -> Node:
    """The tree of a page. Unclosed elements end where HTML implies it: paragraphs at the next block, items at the next
    item, everything at the end tag of what is around it."""
    root = node = Node("html", None)
    at, n, last = 0, len(html), html.rfind(">")
    depth: dict[str, int] = {}

    def text(raw: str) -> None:
        if raw:
            node.parts.append(unescape(raw) if "&" in raw else raw)

    def close(to: Node) -> None:
        nonlocal node
        while node is not to:
            depth[node.name] -= 1
            node = node.parent

    while at < n:
        start = html.find("<", at)
        if start < 0 or start > last and html[start : start + 2] != "<!":  # no tag ends beyond
            text(html[at:])
            break
        tag = TAG.match(html, start)
        if tag is None:  # a lone "<" is text
            text(html[at : start + 1])
            at = start + 1
            continue
        text(html[at:start])
        at = tag.end()
        if tag["cdata"] is not None:
            text(tag["cdata"])
        if tag["name"] is None:
            continue
        name = tag["name"].lower()
        if tag["end"]:
            if depth.get(name):
                up = node
                while up.name != name and (up.name not in SCOPES or name in SCOPES):
                    up = up.parent
                if up.name == name and up.parent is not None:
                    close(up.parent)
            elif name == "br":
                text(" ")
            continue
        if name in ("html", "body", "head"):
            continue
        if name in BLOCKS and depth.get("p"):
            up = node
            while up.name != "p" and up.name not in SCOPES and up.parent is not None:
                up = up.parent
            if up.name == "p":
                close(up.parent)
        if name in CLOSES:
            ends, holders = CLOSES[name]
            up, around = node, None
            while up.parent is not None and up.name not in holders:
                around = up.parent if up.name in ends else around
                up = up.parent
            if around is not None:
                close(around)
        child = Node(name, node, _away(name, tag["attributes"], {k for k in ("article", "main") if depth.get(k)}))
        node.parts.append(child)
        if name in VOID:
            continue
        if name in RAW:
            ending = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            stop = ending.start() if ending else n
            if name == "textarea" or name == "title":
                child.parts.append(unescape(html[at:stop]))
            at = html.find(">", stop) + 1 or n
            continue
        if not tag["attributes"].rstrip().endswith("/") or name not in ("path", "circle", "rect", "line", "use", "g"):
            node = child
            depth[name] = depth.get(name, 0) + 1
    return root


def _mend(root: Node) -> None:
    """A part that is only named as away, but holds the page's main element or heading ("with-sidebar"), isn't."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.name in ("main", "h1"):
            up = node.parent
            while up is not None:
                if up.away in ("named", "perhaps"):
                    up.away = False
                up = up.parent
        stack += [p for p in node.parts if isinstance(p, Node) and p.away is not True]


def _ordered(root: Node) -> list[Node]:
    """Kept nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in node.parts if isinstance(p, Node) and not p.away]
    return out


def measure(root: Node) -> list[Node]:
    """Sets the counts, densities and sums of all kept nodes; returns them, parents first."""
    nodes = _ordered(root)
    own: dict[Node, int] = {}
    for node in reversed(nodes):
        own[node] = sum(len(SPACE.sub(" ", p).strip()) for p in node.parts if isinstance(p, str))
        kept = [p for p in node.parts if isinstance(p, Node) and not p.away]
        node.chars = own[node] + sum(k.chars for k in kept)
        node.tags = sum(k.tags + 1 for k in kept)
        node.link_tags = sum(k.link_tags + (k.name == "a") for k in kept)
        node.link_chars = node.chars if node.name == "a" else sum(k.link_chars for k in kept)
    body = max(1, root.link_chars) / max(1, root.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if not c:
            node.density = 0.0
            continue
        base = math.log(math.log(c / max(1, c - node.link_chars) * lc + body * c + math.e))
        node.density = c / t * (math.log(max(1.0, c / lc * t / lt)) / base if base > 0 else 0.0)
    for node in nodes:
        node.sum = sum(p.density for p in node.parts if isinstance(p, Node) and not p.away) + own[node]
    return nodes


def _weigh(root: Node) -> None:
    """Parts that are perhaps away stay where their density reaches that of what holds them: the article or main
    element around them, or the page."""
    some: list[tuple[Node, Node]] = []
    stack = [(root, root)]
    while stack:
        node, holder = stack.pop()
        if node.away == "perhaps":
            some.append((node, holder))
            node.away = False
        elif node.name in ("article", "main"):
            holder = node
        stack += [(p, holder) for p in node.parts if isinstance(p, Node) and p.away not in (True, "named")]
    if some:
        measure(root)
        for node, holder in some:
            node.away = "named" if node.density < holder.density else False


def select(root: Node) -> Node | None:
    """The subtree with the main text; None where there is no text."""
    _mend(root)
    _weigh(root)
    nodes = measure(root)
    if not root.chars:
        return None
    peak = max(nodes, key=lambda x: x.sum)
    threshold, up = peak.density, peak
    while up is not None:
        threshold = min(threshold, up.density)
        up = up.parent
    best = max((x for x in nodes if x.density >= threshold), key=lambda x: x.sum)
    around = best
    while around.parent is not None and around.name not in ("article", "main"):
        around = around.parent
    if around.parent is not None:
        return around
    # Without such an element: the block around the selection, while it holds most of the text of what is around it.
    while best.parent is not None and (best.name not in BLOCKS or best.name == "p" or best.name[:1] == "h" and best.name[1:].isdigit() or best.chars >= 0.5 * best.parent.chars):
        best = best.parent
    return best


def text_of(node: Node) -> str:
    """Blocks of the subtree in page order, one to a line; white space inside a block is one space."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if joined := SPACE.sub(" ", "".join(line)).strip():
            out.append(joined)
        line.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        part = stack.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            line.append(part)
        elif part.name == "br":
            line.append(" ")
        elif not part.away or part is node:
            if part.name in BLOCKS:
                end()
                stack.append(None)
            stack += reversed(part.parts)
    end()
    return "\n".join(out)


def main_text(html: str | None) -> str:
    chosen = select(parse(html)) if html else None
    return text_of(chosen) if chosen else ""


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``id_column, url_column, text, n_chars`` per page: its main text, and how many code points that has.

    A NULL or empty page, and one without text, gives an empty text. Rows that repeat give rows that repeat; other
    columns aren't read. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(2).to_pylist()
            for a, b in blocks(pages):
                texts = list(map(main_text, pages[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_column].alias("id"), pages[url_column].alias("url"), pages[html_column].cast("string").alias("html"))
    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("id", "url")}
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnsRenamed({"id": id_column, "url": url_column})
