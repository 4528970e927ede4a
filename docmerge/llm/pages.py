"""Main text of web pages by composite text density.

A page becomes a tree. Elements that are boilerplate by their kind, or by role, class or id unless they hold the article, are left out; for every other node characters, tags, link characters and
link tags are summed, and the composite density weighs characters per tag by how far text and tags outweigh
links. The node whose children's densities have the greatest sum holds the article. The least density on its path to
the body is the threshold for what else on the page is kept. An ``article`` or ``main`` element around the found node is taken whole.

Nulls: a null page is empty and has no text; null ids and URLs are kept. Repeated rows are read one by one; of nodes with
equal sums the first in page order is taken. An empty table gives no rows. Other columns are ignored. Pages are read whole,
in time that grows with their length, however deep their elements, without recursion. Blocks are joined by two line feeds; a ``br`` ends one. Broken markup never fails: unclosed elements end with their
parents, stray end tags are skipped, a lone ``<`` is text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmerge.llm.common import id_number, id_text

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[a-zA-Z][^>]*(?:>|\Z)|<[a-zA-Z](?:[^>"']++|"[^"]*"|'[^']*')*+(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]*+))?+|"[^"]*"|'[^']*'""")
_PART = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article.
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select input textarea label iframe svg canvas object menu dialog datalist map "
    "audio video search title xmp noembed noframes fieldset".split()
)
#: Words before the last one of a class or id that say what its element has, not what it is.
HAS = frozenset("has no with without".split())
#: Words that name boilerplate as a class, id or role, or as its last part.
NAMED = frozenset(
    "nav navbar navigation menu sidebar footer ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments disqus replies respond breadcrumb breadcrumbs pagination pager toolbar widget complementary contentinfo masthead copyright "
    "topnav sidenav mainnav topbar bottombar sidebars sidemenu commentlist commentarea usercomments cookiebar cookiebanner adsense adsbygoogle adbox adslot "
    "adcontainer banners ribbon disclaimer skiplink".split()
)
#: Of these, what names the words of readers and other articles: they may outweigh a page's article and are never taken for a wrapper of it.
BESIDE = frozenset("comment comments disqus replies respond commentlist commentarea usercomments related recommended".split())
WHOLE = frozenset(("html", "body", "main", "article"))
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_SCOPE = frozenset("ul ol dl table div section article body html blockquote aside nav td th".split())
#: What a block that opens can end, or what keeps it from ending more.
_STOPS = _ENDS_SCOPE | {"p"} | set(_CLOSED_BY)


class Node:
    __slots__ = ("tag", "parent", "children", "skipped", "named", "chars", "tags", "link_chars", "link_tags", "density", "total", "role", "inside", "stop")

    def __init__(self, tag: str, parent: Node | None, skipped: bool = False, role: str = "", named: str = ""):
        self.tag, self.parent, self.skipped, self.role, self.named = tag, parent, skipped, role, named
        self.inside: bool = tag in ("article", "main") or parent is not None and parent.inside
        self.stop: Node | None = self if tag in _STOPS or parent is None else parent.stop  # the nearest of _STOPS, itself included
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _attributes(token: str, tag: str) -> dict[str, str]:
    """A start tag's attributes, each name with its value consumed in turn; the first of equal names counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(token, len(tag) + 1):
        if name:
            found.setdefault(name.lower(), (value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value).lower())
    return found


def _name_of(value: str) -> str:
    """The first word of a class, id or role that names boilerplate, itself or by its last part."""
    for word in value.split():
        parts = _PART.findall(word)
        if parts and parts[-1] in NAMED and HAS.isdisjoint(parts[:-1]):
            return parts[-1]
    return ""


def _boilerplate(tag: str, token: str, parent: Node) -> tuple[bool, str, str]:
    """Whether an element is left out by its kind, the name that only marks it as boilerplate, and its role."""
    if tag in DROPPED:
        return True, "", ""
    role = named = ""
    if len(token) > len(tag) + 2:
        marks = _attributes(token, tag)
        if "hidden" in marks and tag not in WHOLE or marks.get("aria-hidden") == "true" or "display:none" in "".join(marks.get("style", "").split()):
            return True, "", ""
        role = marks.get("role") or marks.get("itemprop", "")
        if tag not in WHOLE:
            named = next(filter(None, (_name_of(marks.get(name, "")) for name in ("class", "id", "role"))), "")
    if tag == "header" or role == "banner":  # a page's header goes, an article's stays
        return not parent.inside, named, role
    return False, named, role


def parse(page: str) -> list[Node]:
    """The page's nodes in page order; the first is the root."""
    root = Node("#root", None)
    nodes, node = [root], root
    open_tags: Counter[str] = Counter()
    position, size = 0, len(page)

    def leave(now: Node, then: Node) -> Node:
        while now is not then:
            open_tags[now.tag] -= 1
            now = now.parent
        return then

    while position < size:
        match = _TOKEN.match(page, position)
        token, position = match.group(), match.end()
        if token[0] != "<" or len(token) == 1:
            node.children.append(token)
            continue
        if token[1] in "!?":
            continue
        tag = _NAME.match(token).group(1).lower()
        if token[1] == "/":
            if tag == "br":
                node.children.append(made := Node("br", node))
                nodes.append(made)
                continue
            if open_tags[tag] > 0:  # each node is left once, so stray end tags cost nothing
                above = node
                while above.tag != tag:
                    above = above.parent
                node = leave(node, above.parent)
            continue
        if tag in BLOCKS and tag != "br":
            node = leave(node, _before(node, tag))
        skipped, named, role = _boilerplate(tag, token, node)
        made = Node(tag, node, skipped or node.skipped, role, named)
        node.children.append(made)
        nodes.append(made)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])|\Z", re.I).search(page, position)
            position = end.start()
        if tag not in VOID and not token.endswith("/>"):
            node = made
            open_tags[tag] += 1
        elif tag in RAW:
            node = made
            open_tags[tag] += 1
    return nodes


def _before(node: Node, tag: str) -> Node:
    """Where a block element goes: it ends an open paragraph or heading run, and some elements end their likes."""
    ends = _CLOSED_BY.get(tag, ())
    above = node.stop
    while above is not None and above.parent is not None:
        if above.tag == "p" or above.tag in ends:
            node = above.parent
            if above.tag == "p" and not ends:
                break
        elif above.tag in _ENDS_SCOPE:
            break
        above = above.parent.stop
    return node


def _measure(nodes: list[Node]) -> None:
    """Densities of all nodes, children before parents."""
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.total = 0.0
    for node in reversed(nodes):
        if node.skipped:
            continue
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(child.split()) and len(" ".join(child.split()))
        if node.tag == "a":
            node.link_chars = node.chars
        above = node.parent
        if above is not None:
            above.chars += node.chars
            above.tags += node.tags + 1
            above.link_chars += node.link_chars
            above.link_tags += node.link_tags + (node.tag == "a")
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        if node.skipped or not node.chars:
            continue
        chars, links = node.chars, node.link_chars
        base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
        ratio = chars / max(1, links) * max(1, node.tags) / max(1, node.link_tags)
        node.density = max(0.0, chars / max(1, node.tags) * math.log(max(ratio, 1e-9)) / base)
        if node.parent is not None and node.tag in BLOCKS:
            node.parent.total += node.density


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role in ("main", "article", "articlebody")


def _leave_named(nodes: list[Node]) -> None:
    """Leave out the elements that are named as boilerplate, but for those that hold the article.

    Nothing is dropped before densities are known: an element stays if it holds an article, or a greater density sum than what is
    outside of named elements and the element itself as one block. Where articles stand outside, those inside (comments,
    teasers) only count if theirs is the greater sum.
    """
    if not any(n.named and not n.skipped for n in nodes):
        return
    _measure(nodes)
    top: dict[int, Node] = {}  # by node in a named element: the outermost one
    within: set[int] = set()  # articles in named elements and what they hold
    beside: set[int] = set()
    for node in nodes:
        above = id(node.parent)
        if node.named or above in top:
            top[id(node)] = top.get(above, node)
            if _is_article(node) or above in within:
                within.add(id(node))
            if node.named in BESIDE or above in beside:
                beside.add(id(node))
    articles = [n for n in nodes if _is_article(n) and not n.skipped and n.chars]
    alone = all(id(n) in top for n in articles)
    found = [(n.total - top[id(n)].density, n) for n in nodes if id(n) in top and not n.skipped and n.total > 0 and id(n) not in beside and (alone or id(n) in within)]
    dropped = {id(n) for n in nodes if n.skipped}
    for node in nodes:
        node.skipped = node.skipped or id(node) in top
    _measure(nodes)
    outside = max((n.total for n in nodes if not n.skipped), default=0.0)
    holding = articles if alone else []
    if found:
        greatest, best = max(found, key=lambda x: x[0])
        if greatest > outside or not outside:
            holding = [*holding, best]
    held: set[int] = set()
    for node in holding:
        up: Node | None = node
        while up is not None and id(up) not in held:
            held.add(id(up))
            up = up.parent
    for node in nodes:
        node.skipped = id(node) in dropped or bool(node.named) and id(node) not in held or node.parent is not None and node.parent.skipped


def _article(nodes: list[Node]) -> tuple[Node, float]:
    """The node of the greatest density sum, or the article around it, and the threshold."""
    best = max((n for n in nodes if not n.skipped and n.total > 0), key=lambda n: n.total, default=nodes[0])
    least, above, whole = best.density, best, best
    while above is not None:
        if above.chars:
            least = min(least, above.density)
        if _is_article(above):
            whole = above
        above = above.parent
    if whole is best and best.parent is not None:
        rest = [c for c in best.parent.children if isinstance(c, Node) and c is not best and not c.skipped and c.chars]
        if rest and all(c.tag in ("h1", "h2", "h3", "hgroup", "header") for c in rest):
            whole = best.parent  # headings beside the found node belong to it
    return whole, least


def main_text(page: str | None) -> str:
    """Blocks of the main text, in page order, with an empty line (two line feeds) between them."""
    nodes = parse(page or "")
    _leave_named(nodes)
    _measure(nodes)
    article, least = _article(nodes)
    path, above = set(), article.parent
    while above is not None:
        path.add(id(above))
        above = above.parent
    alone = _is_article(article)
    blocks, words = [], []
    work: list[tuple[Node | str | None, bool]] = [(nodes[0], article is nodes[0])]
    while work:
        item, kept = work.pop()
        if item is None:
            blocks.append("".join(words))
            words = []
        elif isinstance(item, str):
            if kept:
                words.append(item)
        elif not item.skipped:
            likely = not alone and item.density >= least and id(item) not in path and item.tag in BLOCKS
            kept = kept or item is article or likely or item.tag == "article" and alone and article.tag == "article"
            edge = [(None, kept)] if item.tag in BLOCKS else []
            work += edge
            work += [(child, kept) for child in reversed(item.children)]
            work += edge
    blocks.append("".join(words))
    lines = (" ".join((html.unescape(b) if "&" in b else b).split()) for b in blocks)
    return "\n\n".join(line for line in lines if line)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [main_text(page) for page in batch.pop("html")]
        yield batch.assign(text=texts, n_chars=[len(t) for t in texts])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` and ``n_chars`` (code points)."""
    source = pages.select(id_text("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    found = source.mapInPandas(_extract, "page_id string, url string, text string, n_chars long")
    return found.withColumn("page_id", id_number("page_id"))
