"""Main text of web pages by composite text density.

Each DOM node has the characters of its text for each tag, adjusted by how much of it stands in links. A node's density
sum adds up its children's densities; the node with the largest sum holds the main text. The least density outside links
on the path from it up to the body is the threshold, and other subtrees that reach it, and aren't mostly links, are kept too, with
headings and loose text between what is kept, and with parts of the same container. Within an article or main, that is the main
text, with sibling articles of like density. Elements that can't be main text by their tag are cut before; those with the tag or the
name, in class, id or role, of furniture are cut unless they hold the lead article; articles are cut by name, too, and where they
stand in a list within the lead article. Where a name is doubtful, an element is kept if it reads like text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.llm.workers import tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
NEVER = frozenset("head title script style noscript template nav button select textarea iframe svg object canvas dialog menu".split())
#: Elements that seldom do. They are cut unless they hold the lead article or nearly all text of the page.
SELDOM = frozenset("footer aside form header".split())
#: The same for words in class, id or role: by the first or last word of a name, or the whole name.
NAMES = frozenset(
    "promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar complementary "
    "cookie cookies consent gdpr newsletter subscribe subscription signup login comments commentlist disqus replies respond share sharing social pagination pager".split()
)
#: Adverts, by any word of a name.
ADVERT = re.compile(r"ads?(box|slot|unit|wrap|wrapper|banner|container|space|block|frame|zone|area|sense|words|bygoogle)?$|adverts?$|advertis\w+$|sponsor(s|ed)?$")
#: Words before a last word "comment" that say it isn't a reader's.
EDITORS = frozenset("editor editors editorial author authors translator".split())
#: Words that stand in names of main text, too: cut unless the element reads like text, by its paragraphs and few links.
DOUBTFUL = frozenset("banner alert widget popup modal overlay toolbar search reply".split())
#: The same, but cut only if much of the element stands in links or no paragraph is in it.
LINKED = frozenset("related recommended header".split())
#: Cut unless the element holds most of the page.
NOTICES = frozenset("notice notices".split())
#: Words before which a name says how an element is laid out, not what it is.
LAYOUT = frozenset("has with no without is not".split())
#: Parts of a page's text: one that holds so much isn't cut by its tag or name, and by a doubtful name.
NEARLY_ALL, MOST = 0.9, 0.5
#: Characters in paragraphs, and the largest part of them in links, of an element that reads like text.
READS_CHARS, READS_LINKS = 200, 0.2
#: A sibling of the main article is main text, too, if it has this part of its density.
LIKE = 0.3
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A block with this part of its characters in links or more is a list of links.
LINK_SHARE = 0.5
#: What a start tag closes, up to the nearest of the elements after it.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPES = frozenset("html body table td th button".split())


class Node:
    __slots__ = ("density", "headed", "items", "link", "names", "parent", "prose", "spans", "tag", "total")

    def __init__(self, tag: str, parent: Node | None, names: str = ""):
        self.tag, self.parent, self.names = tag, parent, names
        self.items: list[Node | str] = []


class TreeBuilder(HTMLParser):
    """The tree of a page, with the end tags that HTML lets authors leave out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)

    def _close(self, tags, within) -> None:
        node = self.at
        while node is not None and node.tag not in within:
            if node.tag in tags:
                self.at = node.parent or self.root
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag == "html" and self.at is self.root:
            return
        if tag in BLOCKS:
            self._close({"p"}, SCOPES)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        node = Node(tag, self.at, names)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at is not self.root:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.items.append(data)


def _words(names: str) -> list[list[str]]:
    """The words of each name, but of those that only say how an element is laid out."""
    split = (re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) for name in names.split())
    return [words for words in split if words and words[0] not in LAYOUT]


def _is_named(words: list[list[str]], wanted: frozenset[str]) -> bool:
    """Whether the first or the last word of a name, or a whole name, is one of the words."""
    return any(x[0] in wanted or (x[-1] in wanted and not (len(x) > 1 and x[-1] == "widget")) for x in words)


def _furniture_names(node: Node) -> bool:
    """Whether an element's names say that it is no main text, whatever it holds: furniture, an advert or readers' comments."""
    words = _words(node.names) if node.names else []
    comment = any(x[0] == "comment" or (x[-1] == "comment" and not EDITORS.intersection(x)) for x in words)
    return comment or _is_named(words, NAMES) or any(ADVERT.match(w) for x in words for w in x)


def _lead(order: list[Node], whole: int) -> set[int]:
    """The article or main with most text, but not one that is furniture or stands in some, and all that is around it; ids of nodes."""
    clean: dict[int, bool] = {}
    lead = None
    for node in order:
        above = node.parent is None or clean[id(node.parent)]
        cut = (node.tag in SELDOM and node.tag != "form") or _furniture_names(node)
        clean[id(node)] = above and not (cut and node.total < NEARLY_ALL * whole and node.tag not in ("html", "body"))
        if node.tag in ("article", "main") and node.total and not _furniture_names(node):
            worth = (clean[id(node)], node.total)
            if lead is None or worth > lead[0]:
                lead = worth, node
    found, node = set(), lead[1] if lead else None
    while node is not None:
        found.add(id(node))
        node = node.parent
    return found


def _is_furniture(node: Node, in_article: bool, whole: int, lead: set[int]) -> bool:
    """Whether an element with measured text is cut, given the characters of the page and what holds the lead article."""
    if node.tag in ("html", "body") or id(node) in lead:
        return False
    head = node.tag == "header" and in_article
    if node.tag in SELDOM and not head and node.total < NEARLY_ALL * whole:
        return True
    if _furniture_names(node) and (lead or node.total < NEARLY_ALL * whole):
        return True
    if node.tag in ("main", "article") or node.total >= MOST * whole:
        return False
    words = _words(node.names) if node.names else []
    if _is_named(words, NOTICES):
        return True
    few_links = node.link[0] <= READS_LINKS * node.total
    if _is_named(words, DOUBTFUL) and not (node.prose >= READS_CHARS and few_links):
        return True
    return _is_named(words, LINKED) and not (head or (in_article and _is_named(words, frozenset({"header"})))) and not (node.prose and few_links)


def _total(order: list[Node]) -> None:
    """Characters, tags, links and characters in paragraphs and headings below each node."""
    for node in reversed(order):
        children = [x for x in node.items if not isinstance(x, str)]
        own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        node.total = own + sum(x.total for x in children)
        node.spans = len(children) + sum(x.spans for x in children)
        node.headed = node.total if node.tag in HEADINGS else sum(x.headed for x in children)
        node.prose = node.total if node.tag == "p" else sum(x.prose for x in children)
        if node.tag == "a":
            node.link = (node.total, 1)
        else:
            node.link = (sum(x.link[0] for x in children), sum(x.link[1] for x in children))


def _nodes(root: Node, kept: Callable[[Node, bool], bool]) -> list[Node]:
    """The nodes below ``root`` that ``kept`` takes, given whether they are in an article, parents first; others are cut off."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_article = stack.pop()
        in_article = in_article or node.tag in ("article", "main")
        order.append(node)
        node.items = [x for x in node.items if isinstance(x, str) or kept(x, in_article)]
        stack += [(x, in_article) for x in reversed(node.items) if not isinstance(x, str)]
    return order


def _measure(root: Node) -> list[Node]:
    """Cut furniture and measure what is left. The nodes left, parents first."""
    order = _nodes(root, lambda x, _: x.tag not in NEVER)
    _total(order)
    whole = root.total
    lead = _lead(order, whole)
    order = _nodes(root, lambda x, inside: not _is_furniture(x, inside, whole, lead))
    _total(order)
    # articles in a list within the lead article are comments or teasers, unless there is little else
    top = next((n for n in order if id(n) in lead and n.tag in ("article", "main")), None)
    if top is not None:
        listed, stack = [], [(x, False) for x in top.items if not isinstance(x, str)]
        while stack:
            node, in_list = stack.pop()
            if in_list and node.tag == "article" and id(node) not in lead:
                listed.append(node)
            else:
                stack += [(x, in_list or node.tag == "li") for x in node.items if not isinstance(x, str)]
        if listed and top.total - sum(x.total for x in listed) >= READS_CHARS:
            gone = set(map(id, listed))
            order = _nodes(root, lambda x, _: id(x) not in gone)
            _total(order)
    return order


def _density(node: Node, body: Node) -> float:
    """Characters for each tag, times a logarithm that falls with the part of characters and tags in links."""
    chars, tags = node.total, max(node.spans, 1)
    link_chars, link_tags = node.link
    if not chars:
        return 0.0
    if not body.link[0]:
        return chars / tags
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body.link[0] / body.total * chars + math.e)
    return max(chars / tags * math.log(chars / max(link_chars, 1) * tags / max(link_tags, 1) + 1) / math.log(base), 0.0)


def _plain_density(node: Node) -> float:
    """Characters outside links for each tag that isn't one."""
    return (node.total - node.link[0]) / max(node.spans - node.link[1], 1)


def _text(nodes: list[Node | str]) -> str:
    """The blocks below the nodes in page order."""
    blocks, current = [], []

    def flush() -> None:
        words = "".join(current).split()
        if words:
            blocks.append(" ".join(words))
        current.clear()

    for top in nodes:
        if not isinstance(top, str) and top.tag in BLOCKS:
            flush()
        stack: list[Node | str | None] = [top]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                current.append(item)
            elif item.tag == "br":
                current.append(" ")
            else:
                if item.tag in BLOCKS:
                    flush()
                    stack.append(None)
                stack += reversed(item.items)
    flush()
    return "\n".join(blocks)


def main_text(html: str) -> str:
    """The main text of a page: its blocks joined by a line feed, empty if there is none."""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    order = _measure(builder.root)
    body = next((n for n in order if n.tag == "body"), builder.root)
    if not body.total:
        body = builder.root
    for node in order:
        node.density = _density(node, body)
    best, most = body, -1.0
    inside = {id(body)}
    for node in order:
        if node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
    for node in order:
        if id(node) in inside:
            total = sum(x.density for x in node.items if not isinstance(x, str))
            # text that stands in the node itself counts as one more child
            own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
            if total + own > most:
                best, most = node, total + own
    # inline elements and single blocks belong to what stands around them
    while best is not body and best.tag not in ("article", "main", "section", "div", "td", "body"):
        best = best.parent
    # the outermost article or main around it is the main text
    whole, node = None, best
    while node is not None:
        if node.tag in ("article", "main"):
            whole = node
        node = node.parent if node is not body else None
    if whole is not None:
        alike = [whole]
        if whole.tag == "article" and whole.parent is not None:
            alike = [x for x in whole.parent.items if x is whole or (not isinstance(x, str) and x.tag == "article" and _plain(x) and x.density >= LIKE * whole.density)]
        return _text([*_title(alike[0], alike, body), *alike])
    threshold, node = _plain_density(best), best
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, _plain_density(node))
    chosen: list[Node | str] = [best]
    node = best
    while node is not body and node.parent is not None:
        chosen = _beside(node, chosen, threshold, node.parent is body)
        node = node.parent
    return _text(chosen)


def _plain(x: Node | str) -> bool:
    return isinstance(x, str) or x.link[0] < LINK_SHARE * max(x.total, 1)


def _has_title(x: Node | str) -> bool:
    return not isinstance(x, str) and (x.tag == "h1" or any(map(_has_title, x.items)))


def _title(node: Node, chosen: list[Node], body: Node) -> list[Node]:
    """What is nothing but headings right before an article without a title of its own, there or around it."""
    if any(map(_has_title, chosen)):
        return []
    while node is not body and node.parent is not None:
        items = node.parent.items
        at = next(k for k, x in enumerate(items) if x is node)
        before = [x for x in items[:at] if (x.strip() if isinstance(x, str) else x.total)]
        if before:
            last = before[-1]
            return [last] if not isinstance(last, str) and last.headed == last.total and _plain(last) else []
        node = node.parent
    return []


def _beside(node: Node, chosen: list[Node | str], threshold: float, at_body: bool) -> list[Node | str]:
    """``chosen`` of ``node`` with what is kept of its parent's other items, in page order.

    Kept are blocks that reach the threshold and aren't mostly links, and headings, paragraphs, inline elements and loose text between
    two kept blocks or, for headings, right before one. Sections and divisions of one container, and paragraphs beside them, are parts of
    the same text, if they have paragraphs or headings and aren't mostly links; right below the body, those of the same names are.
    """
    items = node.parent.items
    at = next(k for k, x in enumerate(items) if x is node)

    def part(x: Node) -> bool:
        if node.tag == "section" and x.tag in ("section", "p"):
            return True
        same = not at_body or (x.names and x.names == node.names)
        return node.tag == "div" and same and (x.tag == "p" or (x.tag == "div" and (x.prose > 0 or x.headed > 0)))

    dense = [k for k, x in enumerate(items) if k == at or (not isinstance(x, str) and x.tag in BLOCKS and x.total and _plain(x) and (part(x) or _plain_density(x) >= threshold))]
    kept = set(dense)
    for k in range(len(items) - 1, -1, -1):
        x = items[k]
        loose = isinstance(x, str) or x.tag not in BLOCKS
        heads = not loose and x.total and x.headed == x.total
        if k not in kept and _plain(x) and dense[0] < k < dense[-1]:
            if loose or x.tag == "p" or heads:
                kept.add(k)
        elif k not in kept and heads and _plain(x) and k < dense[0]:
            between = items[k + 1 : dense[0]]
            if all(not y.strip() if isinstance(y, str) else not y.total or y.headed == y.total for y in between):
                kept.add(k)
    out: list[Node | str] = []
    for k in sorted(kept):
        out += chosen if k == at else [items[k]]
    return out


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null html counts as empty and gives an empty text and 0; a page without markup is one block; whole pages are read,
    whatever their length. Repeated rows give repeated rows; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
