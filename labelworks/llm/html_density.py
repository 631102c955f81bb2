"""Operator 7: main text of web pages by composite text density.

Each node of the page's tree gets a density: its characters per tag, lowered where much of its text is link text or many
of its tags are links, against the share of links in the whole body. A node's density sum adds the densities of its
children. The node with the largest sum tells the threshold: the least density on its way up to the body. From the body
down, of each subtree whose top is at or above the threshold the node with the largest density sum is content, and the
walk goes on with the children, so that text in several wrappers is found in each. The log of the density grows with a
node's size; so a wrapper of several texts with no larger share of links than the body also passes by its characters per
tag alone. A chosen node brings the article around it, the one with the largest sum else the main element around it, and
an inline one the running text that it stands in.

Scripts, styles, controls and page furniture that has its own element or role (menus, asides, footers, headers outside an
article) are never counted nor printed. A class or id that names furniture (sidebar, notice, advert, comments, ...) and a
form are no more than a weight: text inside counts an eighth while the node with the largest sum is looked for. What holds
that node is no furniture, whatever it is called; named elements elsewhere are left out, and the densities are taken anew.
Inside an article or main element, ids that may as well name a chapter (discussion, legal, related, ...) tell nothing.
Text: character references are decoded, white space inside a block becomes one blank, blocks are joined by an empty line.

Edge cases: a null or empty page, and one without text, gives an empty text; unclosed, misnested and unknown tags are
taken as browsers do in the common cases; a page without a body tag is a body; nothing is cut off at any length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import pieces, texts_of

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
#: The same where a quote is left open up to the page's end: a tag ends at the first sign that can end it.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
DROPPED = frozenset("script style noscript template iframe head title nav aside button select textarea input svg canvas object embed dialog menu footer".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
#: An opened tag that ends an open one of the same list.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banners?|sponsor\w*|promo\w*|cookies?|consent|notices?|alerts?|popup|modal|newsletter|subscri\w+|nav|navbar|navigation|menus?|breadcrumbs?|side-?bars?|foot(?:er)?|masthead|site-?header|page-?header|"
    r"comments?|comment-?list|reader-?comments?|discussion|disqus|repl(?:y|ies)|share|sharing|social|related|recommend\w*|widgets?|login|search|pagination|pager|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Words of FURNITURE that tell furniture by an id inside an article too.
SURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|popup|newsletter|nav|navbar|breadcrumbs?|side-?bars?|foot(?:er)?|masthead|site-?header|page-?header|comments?|comment-?list|reader-?comments?|disqus|pagination|pager)(?:$|[\s_-])", re.I
)
#: Words of FURNITURE that main text is called by as well: an element with one stays if it is as dense as the main text's
#: surroundings and has no more links than the page.
LOOSE = re.compile(r"(?:^|[\s_-])(?:discussion|repl(?:y|ies)|share|sharing|social|related|recommend\w*|legal|disclaimer|copyright|search|alerts?|promo\w*|sponsor\w*|login|widgets?)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


#: What the density of text in a named element counts while the main text is looked for.
NAMED_WEIGHT = 1 / 8


class Node:
    __slots__ = ("chars", "density", "dropped", "kids", "link_chars", "link_tags", "loose", "named", "parent", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, named: bool = False, loose: bool = False):
        self.tag, self.parent, self.dropped, self.named, self.loose = tag, parent, dropped, named, loose
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _furniture(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is furniture by its kind or role, whether it is called so, and if so by loose words only."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return True, False, False
    if tag in ("html", "body", "article", "main") or not attributes.strip():
        return False, tag == "form", False
    named = tag == "form"
    loose = not named
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True, False, False
        if name in ("class", "id"):
            words = SURE if name == "id" and inside_article else FURNITURE
            if words.search(value):
                named = True
                # What is left without the loose words, put together so that no two words meet.
                loose = loose and not words.search(LOOSE.sub(" . ", LOOSE.sub(" . ", value)))
    return re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes) is not None, named, named and loose


def parse(page: str) -> Node:
    """The page's tree; text is kept as it stands, references undecoded. Time is linear in the page's length."""
    root = Node("#root", None, False)
    node, at, articles, tags, last = root, 0, 0, TAG, page.rfind(">")
    opened: Counter[str] = Counter()  # of the open elements; no search goes up for a tag that isn't among them

    def close(up: Node) -> Node:
        nonlocal articles
        walk = node
        while walk is not up.parent:
            opened[walk.tag] -= 1
            articles -= walk.tag in ("article", "main")
            walk = walk.parent
        return up.parent

    while True:
        begin = page.find("<", at)
        while 0 <= begin <= last and not (page[begin + 1].isalpha() or page[begin + 1] in "/!?"):
            begin = page.find("<", begin + 1)
        m = None
        while 0 <= begin <= last:
            m = (OTHER if page[begin + 1] in "!?" else tags).match(page, begin)
            if m is None and tags is TAG and PLAIN_TAG.match(page, begin):
                tags = PLAIN_TAG
                continue
            if m is not None:
                break
            begin = page.find("<", begin + 1)
        if m is None and page.startswith("<!--", begin) and begin >= 0:
            m = OTHER.match(page, begin)
        text = page[at : m.start() if m else len(page)]
        if text:
            node.kids.append(text)
        if m is None:
            return root
        at = m.end()
        if m.re is OTHER:
            if m[0].startswith("<![CDATA["):
                node.kids.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                node.kids.append(" ")
            if not opened[tag]:
                continue
            up = node
            while up.parent is not None and up.tag != tag:
                # An inline end tag does not close the blocks around it.
                if tag not in BLOCK and up.tag in BLOCK:
                    break
                up = up.parent
            if up.tag == tag and up.parent is not None:
                node = close(up)
            continue
        if tag == "br":
            node.kids.append(" ")
            continue
        # A block ends an open paragraph with all inline tags inside it; an item ends its open sibling.
        ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if any(opened[e] for e in ends):
            up = node
            while up.parent is not None and up.tag not in ends and (up.tag not in BLOCK or tag in SIBLINGS and up.tag in CLOSES_P and up.tag not in ("ul", "ol", "dl", "table")):
                up = up.parent
            if up.tag in ends and up.parent is not None:
                node = close(up)
        dropped, named, loose = _furniture(tag, m[3], articles > 0)
        new = Node(tag, node, node.dropped or dropped, named, loose)
        node.kids.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        node = new
        opened[tag] += 1
        articles += tag in ("article", "main")


def _order(root: Node) -> list[Node]:
    """All counted nodes, parents first; no recursion, so depth is no limit."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if not n.dropped:
            out.append(n)
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return out


def measure(root: Node) -> Node:
    """Fill in counts, densities and density sums; the body. Named elements apart from the main text become dropped ones, but for
    those with loose names that are as dense as the nodes from the main text up to the body."""
    body = _densities(root)
    named = [n for n in _order(root) if n.named]
    if not named:
        return body
    up = best = max(_order(body), key=lambda n: n.total)
    while up is not None:
        up.named = False
        up = up.parent
    least, up = best.density, best
    while up is not body and up.parent is not None:
        up = up.parent
        least = min(least, up.density)
    # Beside an article, what is called a discussion is the readers'.
    inside: set[Node] = set()
    for n in _order(body):
        if n.tag in ("article", "main") or n.parent in inside:
            inside.add(n)
    for n in named:
        if n.named and n.loose and (n in inside or not inside) and n.density >= least * NAMED_WEIGHT and n.link_chars * body.chars <= body.link_chars * n.chars:
            # Its words' weight counted while the main text was looked for; its own density lets it stay.
            n.named = False
        n.dropped = n.dropped or n.named
    return _densities(root)


def _densities(root: Node) -> Node:
    nodes = _order(root)
    shaded: set[Node] = set()
    for n in nodes:  # parents come first
        if n.named or n.parent in shaded:
            shaded.add(n)
    body = next((n for n in nodes if n.tag == "body"), root)
    for n in reversed(nodes):
        own = sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        kids = [k for k in n.kids if isinstance(k, Node) and not k.dropped]
        n.chars = own + sum(k.chars for k in kids)
        n.tags = sum(k.tags + 1 for k in kids)
        n.link_chars = n.chars if n.tag == "a" else sum(k.link_chars for k in kids)
        n.link_tags = (n.tag == "a") + sum(k.link_tags for k in kids)
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        if n.chars:
            plain, links, tags = max(n.chars - n.link_chars, 1), max(n.link_chars, 1), max(n.tags, 1)
            base = math.log(n.chars / plain * n.link_chars + share * n.chars + math.e)
            ratio = n.chars / links * tags / max(n.link_tags, 1)
            # Shifted so that a text without any link or tag, however short, still has a density.
            n.density = n.chars / tags * math.log(math.e - 1 + ratio) / max(math.log(base), 1.0) * (NAMED_WEIGHT if n in shaded else 1)
    for n in nodes:
        n.total = sum(k.density for k in n.kids if isinstance(k, Node) and not k.dropped) + (n.density if any(isinstance(k, str) and k.strip() for k in n.kids) else 0.0)
    return body


def _plain(n: Node) -> float:
    return n.chars / max(n.tags, 1)


def _around(n: Node, body: Node, tags: tuple[str, ...]) -> Node:
    """The innermost of these elements around a node; else the node with the text that runs through it."""
    up = n
    while up is not body and up.tag not in tags:
        up = up.parent
    if up.tag in tags:
        return up
    while n is not body and n.tag not in BLOCK and n.parent is not body and any(isinstance(k, str) and k.strip() for k in n.parent.kids):
        n = n.parent
    return n


def content(body: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    nodes = _order(body)
    best = max(nodes, key=lambda n: n.total, default=body)
    threshold, plain, up = best.density, _plain(best), best
    while up is not body:
        up = up.parent
        threshold, plain = min(threshold, up.density), min(plain, _plain(up))
    # The node with the largest sum of each subtree, found from the leaves up; the first of equals.
    most: dict[Node, Node] = {}
    for n in reversed(nodes):
        most[n] = max([n, *(most[k] for k in n.kids if isinstance(k, Node) and not k.dropped)], key=lambda x: x.total)
    chosen = set()
    around: dict[Node, Node] = {}
    for n in nodes:
        wrapper = sum(isinstance(k, Node) and not k.dropped and k.chars > 0 for k in n.kids) > 1
        alike = wrapper and n.link_chars * body.chars <= body.link_chars * n.chars and _plain(n) >= plain
        if n.density > 0 and (n.density >= threshold or alike):
            top = most[n]
            if top not in around:
                around[top] = _around(top, body, ("article", "main") if top is best else ("article",))
            chosen.add(around[top])
    out, stack = [], [body]
    while stack:
        n = stack.pop()
        if n in chosen:
            out.append(n)
        else:
            stack += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.dropped]
    return out


def render(nodes: list[Node]) -> str:
    """The blocks' texts, joined by an empty line."""
    blocks: list[list[str]] = [[]]
    for top in nodes:
        blocks.append([])
        stack: list[Node | str | None] = [top]
        while stack:
            k = stack.pop()
            if k is None:
                blocks.append([])
            elif isinstance(k, str):
                blocks[-1].append(k)
            elif not k.dropped:
                if k.tag in BLOCK:
                    blocks.append([])
                    stack.append(None)
                stack += reversed(k.kids)
        blocks.append([])
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def main_text(page: str | None) -> str:
    return render(content(measure(parse(page)))) if page else ""


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns but the page itself, with text and n_chars (columns of these names are replaced)."""
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column):
                texts = [main_text(x) for x in texts_of(part, column)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    schema = StructType([*(pages.schema[c] for c in kept), *StructType.fromDDL("text string, n_chars long").fields])
    return pages.select(*kept, F.col(column).cast("string").alias(column)).mapInArrow(run, schema)


def op7_query(pages: DataFrame) -> DataFrame:
    return extract_main_text(pages.select("page_id", "url", "html"))
