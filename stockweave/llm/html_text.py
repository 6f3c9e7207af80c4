"""Main text of web pages by composite text density.

A page's blocks and inline elements form a tree without elements that are never article text. For every node the
characters under it, those under links, and the tags under it give its composite density: characters per tag, scaled down where
many characters or tags are links, with the page's own share of link text as the measure. The node with the greatest sum of its
children's densities holds the article. Inside it, subtrees that are less dense than the path from that node to the body are left out, if they
are mostly links or their names mark them. What an element is named is a weak prior: it scales the densities under it, and never decides alone.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Factors on the densities under an element whose names mark it as no article text, as a notice or advert, or that is a form or readers' comments, and on the sums of what an article or main element holds.
MARK_PRIOR, NOTICE_PRIOR, COMMENT_PRIOR, ARTICLE_PRIOR = 0.8, 0.2, 0.15, 8.0

# Tags by what they do in a page, and class or id words that mark what is no article text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav aside footer script style noscript template iframe button select option textarea title head svg math canvas object audio video map menu dialog search label input".split())
MARKS = frozenset("ad ads adbox adsense adslot adunit advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager footer masthead widget toolbar topbar copyright skip".split())
COMMENT_MARKS = frozenset("comment comments disqus reply replies respond".split())
NOTICE_MARKS = frozenset("alert notice notices cookie cookies consent gdpr advert adverts advertisement advertising sponsored newsletter".split())
#: "widget" marks nothing beside one of these words; what follows one of LAYOUT in a class names what the page has or lacks.
OWN_WIDGET = frozenset("article body content editor entry post story text title".split())
LAYOUT = frozenset("no has have with without".split())
#: With "header" in its class or id an element is the page's, unless one of these words says whose it is.
HEADER_MARK, OWN_HEADER = "header", frozenset("article content entry post story title".split())
#: Blocks of running text: what stands beside one of these belongs to the same article.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
LISTS = frozenset("ul ol dl".split())
ENDS_P = BLOCKS - {"body", "html"}
#: Elements that an opening tag of the same family ends, up to the container named.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: An attribute: quotes open a value only after an equals sign.
_NAME_VALUE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)?+)?+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|{_NAME_VALUE})*+)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)?+)?+""")
_NONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)


class Node:
    """An element; weight is the prior of its names and of those around it, inside whether an article or main element holds it, heading whether it holds a heading,
    own whether its names say that it is an article's, headed whether it is or lies in a header outside an article."""

    __slots__ = ("tag", "parent", "dropped", "weight", "inside", "heading", "own", "headed", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped, self.kids = tag, parent, dropped, []
        self.weight = parent.weight if parent else 1.0
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.heading = self.own = False
        self.headed = parent is not None and parent.headed
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class _Open:
    """The stack of open elements, with the places of each tag in it, so that no look-up walks the stack."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {root.tag: [0]}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Closes the elements from place k on; the root stays open."""
        while len(self.nodes) > max(k, 1):
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, tags, within) -> None:
        k = self.last(tags)
        if k > max(0, self.last(within)):
            self.cut(k)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in reversed(list(_ATTRIBUTE.finditer(text)))}  # of repeated names the first counts


def _is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(attributes.get("style", "")))


def _words(attributes: dict[str, str]) -> set[str]:
    """The words of class, id, role and label, without what the page has or lacks."""
    words = set()
    for token in " ".join(attributes.get(k, "") for k in ("class", "id", "role", "aria-label")).lower().split():
        for w in re.split(r"[^a-z]+", token):
            if w in LAYOUT:
                break
            words.add(w)
    return words


def _prior(tag: str, words: set[str], inside: bool) -> float:
    """How likely the tag and the words of its names leave it that the element is article text; inside: an article or main element holds it."""
    if tag in ("html", "body", "main"):
        return 1.0
    if tag == "form" or words & COMMENT_MARKS:
        return COMMENT_PRIOR
    marks = words & MARKS
    if tag == "article" or marks == {"widget"} and words & OWN_WIDGET:
        return 1.0
    if marks & NOTICE_MARKS:
        return NOTICE_PRIOR
    return MARK_PRIOR if marks or (HEADER_MARK in words and not inside and not words & OWN_HEADER) else 1.0


def _any(top: Node, test) -> bool:
    """Whether some element or text under top passes the test."""
    todo = list(top.kids)
    while todo:
        k = todo.pop()
        if test(k):
            return True
        if isinstance(k, Node):
            todo += k.kids
    return False


def _without_page_headers(headers: list[Node]) -> None:
    """Takes headers outside article and main elements out of the tree, but for an article's own: it holds a heading, running text stands beside it, and a section or a name around it says whose it is."""
    text = {}
    for h in headers:
        up = h.parent
        if id(up) not in text:
            text[id(up)] = any(isinstance(k, Node) and k.tag in TEXT_BLOCKS - HEADINGS and _any(k, lambda x: isinstance(x, str) and bool(x.strip())) for k in up.kids)
        h.dropped = not (text[id(up)] and (up.tag == "section" or up.own or h.own) and _any(h, lambda x: isinstance(x, Node) and x.tag in HEADINGS))
    for up in {id(h.parent): h.parent for h in headers}.values():
        up.kids = [k for k in up.kids if isinstance(k, str) or not k.dropped]


def parse(page: str) -> tuple[Node, Node]:
    """(root, body). kids holds nodes and texts in page order; end tags that are left out are implied, unmatched ones are ignored. Takes time in proportion to the page, however deep it nests."""
    root = Node("html", None, False)
    body, open_, at, headers = root, _Open(root), 0, []

    def text(s: str) -> None:
        if s and not open_.nodes[-1].dropped:
            open_.nodes[-1].kids.append(html.unescape(s))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = open_.last((tag,))
            # the end of an inline element does not close a block
            if k > 0 and (tag in BLOCKS or tag == "a" or open_.blocks[-1] < k):
                open_.cut(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "html" or (tag == "body" and body is not root):
            continue
        if tag in ENDS_P:
            open_.close(("p",), ("td", "th", "li", "article", "section", "div", "blockquote", "body"))
        if tag in SIBLINGS:
            open_.close(*SIBLINGS[tag])
        if tag == "body":
            open_.cut(1)  # the head ends where the body begins
        up = open_.nodes[-1]
        attributes = _attributes(m[3]) if m[3] else {}
        drop = up.dropped or tag in DROPPED or _is_hidden(attributes)
        node = Node(tag, up, drop)
        if tag == "body":
            body = node
        if not drop:
            words = _words(attributes) if attributes else set()
            node.weight, node.own = min(up.weight, _prior(tag, words, up.inside)), bool(words & OWN_HEADER)
            if tag == "header" and not up.inside and not up.headed:
                node.headed = True
                headers.append(node)
            up.kids.append(node)
        if tag not in VOID and not _closes_itself(m[3]):
            open_.push(node)
    _without_page_headers(headers)
    return root, body


def _closes_itself(rest: str) -> bool:
    """Whether a slash ends the tag, and not a value without quotes."""
    return rest.endswith("/") and not any(m.end() == len(rest) for m in _ATTRIBUTE.finditer(rest))


def _ordered(top: Node) -> list[Node]:
    """Nodes under top, parents first."""
    out, todo = [], [top]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [k for k in n.kids if isinstance(k, Node)]
    return out


def composite_density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Of c characters under t tags, lc of them under lt links, on a page of which `share` of the characters are links."""
    if not c:
        return 0.0
    t, lt = max(t, 1), max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    return c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0) + 1) / max(base, 1.0)


def measure(body: Node) -> list[Node]:
    """Counts, densities and weighted sums of the children's densities of the body's nodes, parents first."""
    nodes = _ordered(body)
    for n in reversed(nodes):
        n.heading = n.tag in HEADINGS
        for k in n.kids:
            if isinstance(k, Node):
                n.chars, n.link_chars = n.chars + k.chars, n.link_chars + k.link_chars
                n.tags, n.link_tags = n.tags + k.tags + 1, n.link_tags + k.link_tags + (k.tag == "a")
                n.heading |= k.heading
            else:
                n.chars += len(k) - k.count(" ") - k.count("\n")
        if n.tag == "a":
            n.link_chars = n.chars
    share = body.link_chars / max(body.chars, 1)
    for n in nodes:
        n.density = composite_density(n.chars, n.tags, n.link_chars, n.link_tags, share)
    for n in nodes:
        n.total = sum(k.density * k.weight for k in n.kids if isinstance(k, Node)) * (ARTICLE_PRIOR if n.inside else 1.0)
    return nodes


def article(body: Node, nodes: list[Node]) -> tuple[Node, tuple[float, float]]:
    """The node of the greatest density sum, with what belongs to it, and the least density and least characters per tag on the path to the body.

    An article or main element around it is the article. Else the node's parent is, as long as running text or a title stands beside the node.
    """
    best = max(nodes, key=lambda n: n.total, default=body)
    if best.inside:
        while best.tag not in ("article", "main") and best is not body:
            best = best.parent
    else:
        while best is not body and (best.tag not in BLOCKS or best.tag in TEXT_BLOCKS or _belongs(best)):
            best = best.parent
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    return best, (min(n.density for n in path), min(_plain(n) for n in path))


def _plain(n: Node) -> float:
    """Characters per tag, which do not grow with a subtree's size as the composite density does."""
    return n.chars / max(n.tags, 1)


def _belongs(n: Node) -> bool:
    """Whether the parent of n has running text of its own, or an element with a title, beside n. What names mark more than n does not count."""
    for k in n.parent.kids:
        if isinstance(k, str):
            if k.strip():
                return True
        elif k is not n and k.chars and k.weight >= n.weight and 2 * k.link_chars < k.chars and (k.tag in TEXT_BLOCKS or k.heading):
            return True
    return False


def _left_out(n: Node, top: Node, thresholds: tuple[float, float]) -> bool:
    """Whether a block under top is no part of its text: mostly links and less dense than the path, or marked by names within top and, by their prior, of fewer characters per tag than the path.

    What holds most of the text of top stays whatever it is named, but for readers' comments.
    """
    links = 2 * n.link_chars > n.chars and n.density < thresholds[0]
    most = n.weight > COMMENT_PRIOR and 2 * (n.chars - n.link_chars) > top.chars - top.link_chars
    return links or (n.weight < top.weight and not most and _plain(n) * n.weight / top.weight < thresholds[1])


def _lists_of_text(n: Node) -> set[int]:
    """ids of the lists in n that belong to its text even if they are links: with running text before and after them, or, in an article, right after a heading; unmarked."""
    if not any(isinstance(k, Node) and k.tag in LISTS for k in n.kids):
        return set()

    def after_text(kids) -> set[int]:
        seen, out = False, set()
        for k in kids:
            if isinstance(k, str):
                seen |= bool(k.strip())
                continue
            if seen and k.tag in LISTS and k.weight >= n.weight:
                out.add(id(k))
            seen |= k.tag in TEXT_BLOCKS and k.chars > 2 * k.link_chars and k.weight >= n.weight
        return out

    elements = [k for k in n.kids if isinstance(k, Node)]
    headed = {id(k) for h, k in zip(elements, elements[1:]) if n.inside and h.tag in HEADINGS and h.chars > 2 * h.link_chars and k.tag in LISTS and k.weight >= n.weight}
    return headed | (after_text(n.kids) & after_text(reversed(n.kids)))


def blocks(top: Node, thresholds: tuple[float, float]) -> list[str]:
    """Texts of the blocks under top in page order, white space as single spaces."""
    out, line, todo, spared = [], [], [top], set()

    def end() -> None:
        if s := " ".join("".join(line).split()):
            out.append(s)
        line.clear()

    while todo:
        n = todo.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            line.append(n)
        elif n.tag == "br":
            line.append(" ")
        elif n is top or id(n) in spared or not (n.tag in BLOCKS and _left_out(n, top, thresholds)):
            lists = _lists_of_text(n)
            # the items of a list that belongs to the text do, too
            spared |= {id(k) for k in n.kids if isinstance(k, Node)} if id(n) in spared else lists
            if n.tag in BLOCKS:
                end()
                todo.append(None)
            todo += n.kids[::-1]
    end()
    return out


def main_text(page: str) -> str:
    """The article of a page, '' if there is none."""
    _, body = parse(page)
    return "\n".join(blocks(*article(body, measure(body))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> one row per input row: page_id, url, text, n_chars (code points of text).

    A null or empty html, or a page without article text, gives an empty text. Broken markup is read as far as it can be: an open
    tag, comment or script at the end is dropped. Repeated rows are each extracted; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
