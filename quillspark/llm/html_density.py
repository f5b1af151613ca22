"""Main-text extraction by composite text density.

A page is read into a DOM. What the article never is (menus, page headers and footers, sidebars, notices, adverts, forms,
scripts, reader comments) is left out by its element's name, its role, or a whole word of its class or id. For every
remaining node the composite density is its characters per tag, adjusted by its links (Sun, Song and Liao, 2011):

    C / T * log(C / LC * T / LT) to the base ln(C / NLC * LC + LCb / Cb * C + e)

with C characters, T tags, LC and LT those inside links, NLC characters outside links, and LCb, Cb of the body. The
density sum of a node adds its children's densities. The threshold is the least density on the path from the body to the
node of the greatest sum; the article is the subtree of the greatest sum among nodes whose density reaches the threshold.

That subtree may be a part of the article: one paragraph, or one section beside others. So it stands for the container that
holds it, and on the path from there to the body a sibling belongs to the article if it holds a heading or reaches the
path's least density so far, and most of its characters are outside links. Inside an article element, density has to tell
only what is links. Of siblings right under the body only headings before it belong to it.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*>?", re.S)
#: An attribute: its name, and its value if it has one.
_ATTR = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_ASKED = re.compile("class|id|role|hidden|style", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
_DROP = _RAW | frozenset("head nav footer aside form button select option input label fieldset dialog menu object embed audio video canvas map applet frameset".split())
_BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html li main"
    " ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are pieces of an article, never all of it.
_PIECES = _HEADINGS | frozenset("p pre li dt dd td th tr tbody figcaption caption summary".split())
#: What an opening tag closes by itself, as far as it is innermost in the page's frame.
_CLOSES = {
    **{t: frozenset({"p"}) for t in _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}},
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    **{t: frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}) for t in ("tbody", "thead", "tfoot")},
    "option": frozenset({"option"}),
}
#: A whole word of class, or an id, that marks what the contract of an article leaves out: menus, page headers and footers,
#: sidebars, notices, adverts and reader comments, alone or with what usually stands before or after it.
_NOISE = re.compile(
    r"(?:(?:site|page|top|bottom|main|global|primary|secondary|left|right|mobile|sticky|inline|reader|user|post|article|blog)[_-]?)?"
    r"(?:ads?|advert|advertisement|advertising|adsense|ad[_-]?slot|sponsor(?:ed)?|promo(?:tion)?|banner|comments?|disqus|respond|repl(?:y|ies)|cookies?|gdpr|consent|notice|alert"
    r"|popup|modal|newsletter|subscribe|signup|login|paywall|sidebar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|share|sharing|social"
    r"|pagination|pager|copyright)"
    r"(?:[_-]?(?:\d+|area|bar|banner|block|body|box|container|content|form|group|inner|items?|left|links|list|menu|notice|posts?|respond|right|section|slot|stories|top|unit|widget|wrap(?:per)?))*"
    r"|(?:site|page|top|global|blog)[_-]?header|header(?:[_-]?(?:bar|inner|wrap(?:per)?))?"
    r"|(?:related|recommended|trending|more)[_-]?(?:articles|content|links|posts|stories)",
    re.I,
)
_ROLES = frozenset("alert banner complementary contentinfo menu navigation search".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACES = re.compile(r"\s+")


#: What forms the frame of a page: an end tag of one of them closes what is open inside it.
_FRAME = _BLOCK | _DROP
_SECTIONS = frozenset("article main section".split())


class Node:
    __slots__ = ("chars", "density", "holds", "items", "link_chars", "link_tags", "name", "noise", "parent", "sum", "tags", "titled")

    def __init__(self, name: str, parent: Node | None, noise: bool = False):
        self.name, self.parent, self.noise = name, parent, noise
        self.holds = False
        self.items: list[Node | str] = []


def _noise(name: str, attrs: str, in_section: bool) -> bool:
    if name in _DROP:
        return True
    # a page's header holds no text of the article; the header of a section or an article holds its heading
    if name == "header" and not in_section:
        return True
    if not attrs or name in ("html", "body", "main") or not _ASKED.search(attrs):
        return False
    found: dict[str, str] = {}
    for key, value in _ATTR.findall(attrs):
        found.setdefault(key.lower(), value[1:-1] if value[:1] in ('"', "'") else value)
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    if any(role in _ROLES for role in found.get("role", "").lower().split()):
        return True
    # names of places in the text stand on headings and on what isn't a block
    if name in _HEADINGS or name not in _BLOCK and name != "span":
        return False
    words = found.get("class", "").split() + (found.get("id", "").split() if name != "span" else [])
    return any(_NOISE.fullmatch(word) for word in words)


class _Open:
    """The open elements: a stack of all, of those of the page's frame, and how many of each name are open.

    Every step either opens an element or closes some, so a page is read in a time proportional to its length.
    """

    def __init__(self, root: Node):
        self.all, self.frames, self.counts = [root], [], {}
        #: open elements by name since the innermost frame
        self.inner: list[dict[str, int]] = [{}]

    def push(self, node: Node) -> None:
        self.all.append(node)
        self.counts[node.name] = self.counts.get(node.name, 0) + 1
        if node.name in _FRAME:
            self.frames.append(node)
            self.inner.append({})
        else:
            self.inner[-1][node.name] = self.inner[-1].get(node.name, 0) + 1

    def pop(self) -> Node:
        node = self.all.pop()
        self.counts[node.name] -= 1
        if node.name in _FRAME:
            self.frames.pop()
            self.inner.pop()
        else:
            self.inner[-1][node.name] -= 1
        return node

    def close(self, name: str) -> None:
        """An end tag: one of the frame closes what is inside, another doesn't reach beyond its block; a stray one does nothing."""
        if (self.counts if name in _FRAME else self.inner[-1]).get(name, 0):
            while self.pop().name != name:
                pass

    def make_room(self, name: str) -> None:
        """Closes what an opening tag closes by itself."""
        gone = _CLOSES[name]
        last = None
        for node in reversed(self.frames):
            if node.name not in gone:
                break
            last = node
        while last is not None and self.pop() is not last:
            pass


def parse(page: str) -> Node:
    """A lenient DOM: unknown end tags are skipped, open elements end with their container or the page."""
    root = Node("html", None)
    held = _Open(root)
    body: Node | None = None
    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            held.all[-1].items.append(page[at:])
            break
        if found.start() > at:
            held.all[-1].items.append(page[at : found.start()])
        at = found.end()
        ends, name, attrs = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if ends:
            held.close(name)
            continue
        if name == "html" or name == "body" and body is not None:
            continue
        if name in _CLOSES:
            held.make_room(name)
        if name == "body":
            while len(held.all) > 1:
                held.pop()
        here = held.all[-1]
        node = Node(name, here, _noise(name, attrs, any(held.counts.get(x, 0) for x in _SECTIONS)))
        here.items.append(node)
        if name in ("article", "main") and not node.noise:
            # what holds the article is no noise, whatever its class says
            above: Node | None = here
            while above is not None and not above.holds:
                above.holds, above.noise = True, above.noise and above.name in _DROP
                above = above.parent
        if name == "body":
            body = node
        if name in _VOID or attrs.endswith("/") and name not in _BLOCK and name != "a":
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        held.push(node)
    return body or root


def _measure(body: Node) -> list[Node]:
    """Nodes in page order without noise, with characters, tags, density and density sum."""
    order: list[Node] = []
    stack = [body]
    while stack:
        node = stack.pop()
        order.append(node)
        node.items = [x for x in node.items if isinstance(x, str) or not x.noise]
        stack += [x for x in reversed(node.items) if not isinstance(x, str)]
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(_SPACES.sub("", x))
            else:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.name == "a")
        if node.name == "a":
            node.link_chars = node.chars
        node.titled = node.name in _HEADINGS and node.chars > 0 or any(x.titled for x in node.items if not isinstance(x, str))
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(order):
        node.density = _density(node, ratio)
        node.sum = sum(x.density for x in node.items if not isinstance(x, str)) or node.density
    return order


def _density(node: Node, body_ratio: float) -> float:
    # a link is all link: log(1)
    if not node.chars or node.name == "a":
        return 0.0
    tags, links, link_tags = max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
    spread = math.log(math.log(node.chars / max(node.chars - node.link_chars, 1) * node.link_chars + body_ratio * node.chars + math.e))
    value = math.log(max(node.chars / links * tags / link_tags, 1.0))
    # without a link on the whole page the base is 1: then the logarithm itself
    return node.chars / tags * (value / spread if spread > 1e-9 else value)


def select(body: Node) -> Node | None:
    """The subtree of the greatest density sum among nodes that reach the body path's threshold; None for a page without text."""
    order = _measure(body)
    if not body.chars:
        return None
    best = max(order, key=lambda x: x.sum)
    threshold = best.density
    up = best
    while up is not body:
        up = up.parent
        threshold = min(threshold, up.density)
    return max((x for x in order if x.density >= threshold), key=lambda x: x.sum)


def whole(body: Node, best: Node) -> Node:
    """A tree of the article: best's container and what belongs to it on the path to the body, in page order."""
    while best is not body and (best.name not in _BLOCK or best.name in _PIECES):
        best = best.parent
    path, least = [best], best.density
    while path[-1] is not body:
        path.append(path[-1].parent)
    # inside which of the path's nodes there is an article element
    inner = max((i for i, x in enumerate(path) if x.name == "article"), default=-1)
    kept = best
    for i, up in enumerate(path[1:], 1):
        wider = Node(up.name, None)
        if up is body:
            # of what stands beside it on the page only headings before it are its own
            wider.items = [x for x in up.items[: up.items.index(path[i - 1])] if not isinstance(x, str) and x.name in _HEADINGS and 2 * x.link_chars <= x.chars]
            wider.items.append(kept)
            return wider
        least = min(least, up.density)
        for x in up.items:
            if isinstance(x, str):
                # loose text of the article's element, or of inline markup around best
                if i <= inner or up.name not in _BLOCK:
                    wider.items.append(x)
            elif x is path[i - 1]:
                wider.items.append(kept)
            elif x.chars and 2 * x.link_chars <= x.chars and (i <= inner or x.titled or x.density >= least):
                wider.items.append(x)
        kept = wider
    return kept


def blocks(node: Node) -> list[str]:
    """The texts of its blocks in page order."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            text = _SPACES.sub(" ", html.unescape("".join(run))).strip()
            if text:
                out.append(text)
            run.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.name == "br":
            run.append(" ")
        else:
            if x.name in _BLOCK:
                end()
                stack.append(None)
            stack += reversed(x.items)
    end()
    return out


def extract(page: str | None) -> str:
    """The article of one page, its blocks joined by newlines; empty for null, empty and textless pages."""
    if not page:
        return ""
    body = parse(page)
    best = select(body)
    return "\n".join(blocks(whole(body, best))) if best is not None else ""


def main_text(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url"), into: str = "text") -> DataFrame:
    """The kept columns and the main text of every page's whole HTML, one row for each row of pages, in no order.

    A null or empty page has an empty text. Character references are decoded, white space inside a block becomes one space,
    blocks are trimmed and joined by one newline; nothing else is dropped or cut. Other columns aren't read. Repeated rows
    each give a row; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    fields = [pages.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{into}` string"])

    def run(batch):
        yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), pa.array([extract(x) for x in batch.column(len(keep)).to_pylist()], pa.string())], names=[*keep, into])

    return pages.select(*(F.col(c) for c in keep), F.col(html_column)).mapInArrow(per_batch(run), schema)
