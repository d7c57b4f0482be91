"""Main text of HTML pages by tree scoring.

A forgiving parser builds the page's tree. Every paragraph passes points (one, plus its commas, plus
its length up to a limit) to its ancestors, less to the farther ones; a container's points are
discounted by the share of its text that stands in links. The container with the most points is
kept, and those of its siblings that score well enough, with the headings right before it. What is
page furniture by its tag, role, visibility or class name is taken out beforehand.

Where the page marks its article (``article`` or ``main``), nothing in it goes for its form alone: lists of
links stay, and a name cuts only if all of its parts speak of furniture, or if most of the
text stands in links. Words that also title an article's own sections (``discussion``) need the links too.

- A NULL, empty or text-less page has the empty text.
- A page without any scored container gives all of its text that is not furniture.
- A text is read whole whatever its length; the work is linear in it, also for deeply nested tags.
- Equal pages give equal texts; of equally scored containers the first in page order is kept.
- Result columns replace columns of the same name; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: Start tags that end an open element of these names, up to the nearest element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPES = frozenset("html body article main section div td th table ul ol dl li blockquote figure button".split())

FURNITURE = frozenset(
    "script style noscript template head title nav footer aside form button select textarea input label fieldset "
    "iframe object embed svg canvas audio video dialog menu map math".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split()
)
#: Parts of a class or id that mark page furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe "
    "subscription signup login sidebar sidebars aside rail widget widgets menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer foot header masthead topbar comment comments disqus respond replies reply discussion related "
    "recommended recommendations share sharing social toolbar pagination pager search skip hidden copyright disclaimer "
    "outbrain taboola form".split()
)
#: Marks that are common titles of an article's own sections too.
SECTION_WORDS = frozenset("discussion related search form promotion consent alert subscription sharing head header copyright".split())
#: Parts of a name that say where or in what an element stands.
PLAIN_PARTS = frozenset(
    "area article bar block body box btn button buttons card cell col container content cta group in inline inner item items "
    "left line link links list middle module on outer page panel post right row section site slot story strip text "
    "thread title top bottom unit wrap wrapper zone".split()
)
#: A class or id that begins so speaks of something else, not of the element.
PRONE = re.compile(r"^(?:has|with|no|without|is|page|site|js)[-_]")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NAME_PARTS = re.compile(r"[^a-z0-9]+")
#: Never taken out for a name: they hold the page or the article.
KEPT = frozenset(("html", "body", "article", "main"))
ARTICLES = frozenset(("article", "main"))
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

PARAGRAPHS = frozenset("p pre blockquote td dd li figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table div section".split())
COMMAS = re.compile("[,،、，]")
LENGTH_UNIT, LENGTH_POINTS = 100, 3
#: Their text is no reader's text.
CODE = frozenset(("script", "style", "template"))
#: The share of a paragraph's points for its parent, grandparent and so on.
SHARES = (1.0, 0.5, 0.25, 0.125)
SIBLING_SHARE = 0.2
LINK_LIST = 0.5
#: A ``div`` or ``section`` outside of a marked article is a list of links if it has hardly any other text.
LINKS_ONLY = 0.9


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "points", "text", "links", "block", "inside")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.points = 0.0
        self.text = self.links = 0
        self.block: Node = self if parent is None or tag in BLOCKS else parent.block
        #: Within what the page marks as its article.
        self.inside: bool = parent is not None and (parent.inside or parent.tag in ARTICLES)


class TreeBuilder(HTMLParser):
    """Builds nodes and supplies the end tags that pages leave out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.open: Counter[str] = Counter()

    def _to(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _end(self, names: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        if not any(self.open[name] for name in names):
            return
        node = self.at
        while node.parent is not None:
            if node.tag in names:
                self._to(node.parent)
                return
            if node.tag in scope:
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS:
            self._end(*ENDS[tag])
        elif tag in BLOCKS:
            self._end({"p"}, SCOPES)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # browsers ignore the slash

    def handle_endtag(self, tag: str) -> None:
        # An inline end tag does not reach out of its block.
        self._end({tag}, frozenset() if tag in BLOCKS else SCOPES | {"p"} - {tag})

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def is_furniture(node: Node) -> bool:
    attrs = node.attrs
    if node.tag in FURNITURE:
        return True
    if node.tag == "header" and not node.inside:  # an article's own header belongs to it
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")):
        return True
    if node.tag in KEPT:
        return False
    if attrs.get("role", "").strip().lower() in ROLES:
        return True
    if node.tag in HEADINGS or node.tag == "header":
        return False
    linked = node.links > LINK_LIST * node.text
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        spaced = CAMEL.sub("-", name).lower()
        parts = {part for part in NAME_PARTS.split(spaced) if part and not part.isdigit()}
        if PRONE.match(spaced) or MARKS.isdisjoint(parts):
            continue
        marks = parts & MARKS
        if not node.inside or linked or (not marks <= SECTION_WORDS and parts - marks <= PLAIN_PARTS):
            return True
    return False


def preorder(root: Node) -> list[Node]:
    """The nodes in page order."""
    seen, stack = [], [root]
    while stack:
        node = stack.pop()
        seen.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return seen


def measure(nodes: list[Node]) -> None:
    """Fill in the lengths of the nodes' texts and of those in links, without white space at the ends of strings."""
    for node in nodes:
        node.text = sum(len(c.strip()) for c in node.children if isinstance(c, str) and node.tag not in CODE)
        node.links = 0
    for node in reversed(nodes):
        if node.tag == "a":
            node.links = node.text
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.links += node.links


def cut_furniture(nodes: list[Node]) -> list[Node]:
    """Cut furniture from the tree; the nodes that remain, in page order."""
    for node in nodes:
        node.children = [c for c in node.children if isinstance(c, str) or not is_furniture(c)]
    return preorder(nodes[0])


def score(nodes: list[Node]) -> None:
    """Pass the paragraphs' points up."""
    direct: dict[int, list[str]] = {}
    for node in nodes:
        for child in node.children:
            if isinstance(child, str) and child.strip():
                direct.setdefault(id(node.block), []).append(child)
    for node in nodes:
        if (parts := direct.get(id(node))) is None or node.tag in HEADINGS:
            continue
        text = " ".join(parts)
        points = 1 + len(COMMAS.findall(text)) + min(len(text) / LENGTH_UNIT, LENGTH_POINTS)
        to = node.parent if node.tag in PARAGRAPHS else node
        for share in SHARES:
            if to is None:
                break
            to.points += points * share
            to = to.parent


def final_points(node: Node) -> float:
    return node.points * (1 - node.links / node.text) if node.text else 0.0


def is_link_list(node: Node) -> bool:
    if node.inside or node.tag not in LISTS or not node.text:
        return False
    return node.links > (LINKS_ONLY if node.tag in ("div", "section") else LINK_LIST) * node.text


def chosen(nodes: list[Node]) -> list[Node]:
    """The best container and the siblings that go with it, in page order."""
    best = max(nodes, key=final_points)
    if final_points(best) <= 0:
        return [nodes[0]]
    above = best
    while above is not None and above.tag not in ARTICLES:
        above = above.parent
    if above is not None:  # the page itself says where its article begins and ends
        best = above
    if best.parent is None:
        return [best]
    least = SIBLING_SHARE * final_points(best)
    kept: list[Node] = []
    headings: list[Node] = []  # right before the node at hand
    for node in best.parent.children:
        if isinstance(node, str):
            headings = [] if node.strip() else headings
            continue
        plain = node.text > 0 and node.links <= 0.25 * node.text
        if node.tag in HEADINGS:
            headings = [*headings, node] if plain else []
            continue
        lone = node.tag in PARAGRAPHS and plain and best.tag not in ARTICLES
        if node is best or lone or (node.tag == best.tag or plain) and node.points and final_points(node) >= least:
            kept += [*headings, node]
        if node.tag not in VOID:
            headings = []
    return kept


def block_texts(roots: list[Node]) -> list[str]:
    """One string per block, white space made single spaces; link lists inside are left out."""
    blocks: list[str] = []
    open_block: list[str] = []

    def close() -> None:
        if text := " ".join("".join(open_block).split()):
            blocks.append(text)
        open_block.clear()

    stack: list[Node | str | None] = list(reversed(roots))
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            open_block.append(item)
        elif item.tag in ("br", "hr", "img", "wbr"):
            open_block.append("" if item.tag == "wbr" else " ")
        else:
            if is_link_list(item) and item not in roots:
                close()
                continue
            if item.tag in BLOCKS:
                close()
                stack.append(None)
            stack.extend(reversed(item.children))
    close()
    return blocks


def without_open_comment(html: str) -> str:
    """A comment that is never closed goes on to the end of the page (unless it stands in a script)."""
    at = html.rfind("<!--")
    open_comment = at >= 0 and html.find("-->", at) < 0 and "</script" not in html[at:].lower()
    return html[:at] if open_comment else html


def main_text(html: str | None) -> str:
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(without_open_comment(html))
    builder.close()
    nodes = preorder(builder.root)
    measure(nodes)
    nodes = cut_furniture(nodes)
    measure(nodes)
    score(nodes)
    return " ".join(block_texts(chosen(nodes)))


def extract_main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add each page's main text; one narrow pass over the whole pages."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return df.withColumn(out, extract(F.col(html)))
