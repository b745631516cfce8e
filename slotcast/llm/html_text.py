"""Main text of web pages by composite text density.

For every node of the document tree, the density is the number of characters for each
tag below it, lowered where much of its text is links (composite text density).  The
density sum of a node is the sum over its children; the node with the largest sum
whose density, and that of every node on its path from the body, reaches the threshold
is the main subtree.  The threshold is the smallest density on the path from the body
to the densest node.

Menus, forms, scripts and the like, by element, role or name, count as no text and,
with all that is below them, are never chosen; but a form around most of a page is none.  Names count only as whole class or id
tokens; within an ``article`` or ``main`` only those that can't name a part of a story.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object textarea select option button".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag here ends an open element of those kinds first, unless one of the limits stands between.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}, "body": {"head"},
}
LIMITS = ("table", "ul", "ol", "dl", "select")
#: Inline or small elements that are never the main subtree themselves.
SMALL = frozenset("p b i a span em strong li td tr".split())
#: Elements that may stand beside the main subtree as parts of the same story.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure section header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
# Names of what is not the story, and words that may stand beside one in a class or id.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice alert popup "
    "modal newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead share sharing social related "
    "recommended recommendations widget widgets comment comments disqus respond responses replies pagination".split()
)
BESIDE = frozenset(
    "site page main global top bottom left right primary secondary header box bar area section wrapper wrap container block list slot unit link links item items "
    "post posts article articles button buttons icons message overlay form thread reader user content inner outer".split()
)
#: What is left out even inside an article.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising ad-slot ad-box ad-container ad-wrapper ad-unit sponsored cookie-banner cookie-notice cookie-consent "
    "newsletter newsletter-signup sidebar navbar breadcrumb breadcrumbs pagination comments comment comment-list comments-section comments-area user-comments "
    "reader-comments disqus_thread share-buttons social-share social-links related-posts related-articles related-links notice".split()
)


def names_noise(names: list[str], inside: bool) -> bool:
    """True if one of the class or id tokens names what is not the story."""
    for name in names:
        name = name.lower()
        if name in NEVER:
            return True
        if not inside:
            parts = [x.rstrip("0123456789") for x in name.replace("_", "-").split("-")]
            parts = [x for x in parts if x]
            if any(x in NOISE for x in parts) and all(x in NOISE or x in BESIDE for x in parts):
                return True
    return False


class Node:
    __slots__ = ("tag", "up", "down", "own", "noise", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, noise: bool = False):
        self.tag, self.up = tag, up
        #: noise itself; itself or below what is noise; below an article or main
        self.own = noise
        self.noise = noise or (up is not None and up.noise)
        self.inside = up is not None and (up.inside or up.tag in ("article", "main"))
        self.down: list = []  # nodes and strings
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


#: Elements whose content is text up to their own end tag; in the second group with character references.
RAW, RAW_DECODED = frozenset("script style xmp iframe noembed noframes".split()), frozenset("textarea title".split())
_TAG_NAME, _ATTRIBUTE = re.compile(r"[^\s/>]+"), re.compile(r"[^\s/>=]?[^\s/>=]*")
_GAP, _EQUALS, _BARE = re.compile(r"[\s/]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_COMMENT_END = re.compile("--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW | RAW_DECODED}


def _attributes(html: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """Attributes from ``at`` on, whether the tag closes itself, and the place behind its ``>``; -1 where there is none."""
    out = []
    while True:
        gap = _GAP.match(html, at)
        at = gap.end()
        if at >= len(html):
            return out, False, -1
        if html[at] == ">":
            return out, gap.group().endswith("/"), at + 1
        first = html[at] == "="  # a stray one begins a name
        name = _ATTRIBUTE.match(html, at + first)
        key, at, value = html[at : name.end()].lower(), name.end(), ""
        if equals := _EQUALS.match(html, at):
            at = equals.end()
            if html[at : at + 1] in ('"', "'"):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return out, False, -1
                value, at = html[at + 1 : end], end + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare.group(), bare.end()
        out.append((key, unescape(value)))


def scan(html: str, tree: _Tree) -> None:
    """Hands the tags and texts of a page to ``tree``, as a browser reads them, each character once.

    What is left open at the end of the page (a tag, a comment, a declaration) is
    dropped; a ``<`` that begins nothing is text.
    """
    at = since = 0  # text since there is not handed on yet

    def text(end: int, decoded: bool = True) -> None:
        if end > since:
            tree.handle_data(unescape(html[since:end]) if decoded else html[since:end])

    while (at := html.find("<", at)) >= 0:
        mark = html[at + 1 : at + 2]
        if mark.isascii() and mark.isalpha():
            text(at)
            name = _TAG_NAME.match(html, at + 1)
            tag = name.group().lower()
            attributes, closed, at = _attributes(html, name.end())
            if at < 0:
                return
            since = at
            if closed:
                tree.handle_startendtag(tag, attributes)
                continue
            tree.handle_starttag(tag, attributes)
            if tag in _RAW_END:
                end = _RAW_END[tag].search(html, at)
                at = end.start() if end else len(html)
                text(at, tag in RAW_DECODED)
                since = at
        elif mark == "/" and (html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha()):
            text(at)
            name = _TAG_NAME.match(html, at + 2)
            _, _, at = _attributes(html, name.end())
            if at < 0:
                return
            since = at
            tree.handle_endtag(name.group().lower())
        elif mark in ("!", "?", "/") and mark and at + 2 < len(html):
            text(at)
            if html.startswith("<!--", at):
                if html.startswith((">", "->"), at + 4):
                    at = html.find(">", at) + 1
                else:
                    end = _COMMENT_END.search(html, at + 4)
                    at = end.end() if end else -1
            else:
                at = html.find(">", at) + 1 or -1
            if at < 0:
                return
            since = at
        else:
            at += 1
    text(len(html))


class _Tree:
    """Elements and texts with character references decoded; forgiving about missing end tags.

    ``depths`` has for each kind the places of its open elements on the stack, so the
    nearest one is known without a walk: time is linear in the page however it nests.
    """

    def __init__(self):
        self.root = Node("#root", None)
        self.stack = [self.root]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of open blocks but paragraphs
        self.forms: list[Node] = []  # noise as forms only

    def _nearest(self, tags) -> int:
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def _pop_to(self, depth: int) -> None:
        """Ends the elements from this place of the stack on."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and tag not in ("html", "body"):
            place = self._nearest(("p",))
            if place > (self.blocks[-1] if self.blocks else 0):
                self._pop_to(place)
        if tag in ENDS:
            ends = ENDS[tag]
            place = self._nearest(ends)
            if place > self._nearest([x for x in LIMITS if x not in ends]):
                self._pop_to(place)
        at = self.stack[-1]
        inside = at.inside or at.tag in ("article", "main")
        named = dict(attrs)
        noise = (tag in BOILERPLATE and tag != "form") or tag in HIDDEN or "hidden" in named or named.get("role") in ROLES or named.get("aria-hidden") == "true"
        if not noise and tag not in ("html", "body"):
            noise = names_noise(f"{named.get('class') or ''} {named.get('id') or ''}".split(), inside or tag in ("article", "main"))
        if tag == "header" and not inside:
            noise = True
        node = Node(tag, at, noise or tag == "form")
        at.down.append(node)
        if tag == "form" and not noise:
            self.forms.append(node)
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.stack))
            if tag in BLOCK and tag != "p":
                self.blocks.append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style"):
            self._pop_to(len(self.stack) - 1)

    def handle_endtag(self, tag):
        place = self._nearest((tag,))
        if place and (tag in BLOCK or place > (self.blocks[-1] if self.blocks else 0)):  # an inline end tag ends no block
            self._pop_to(place)

    def handle_data(self, data):
        self.stack[-1].down.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    scan(html, tree)
    if tree.forms:
        _free_forms(tree.root, tree.forms)
    return tree.root


def _free_forms(root: Node, forms: list[Node]) -> None:
    """A form around most of a page's text, as server-side pages have, is no noise: only what is in it."""
    order, chars, only_forms = _walk(root), {}, set(map(id, forms))
    for node in reversed(order):
        own = sum(chars[id(x)] if isinstance(x, Node) else len(x.strip()) for x in node.down)
        chars[id(node)] = 0 if node.own and id(node) not in only_forms else own
    free = [f for f in forms if 2 * chars[id(f)] > chars[id(root)]]
    for f in free:
        f.own = False
    for node in order if free else ():
        node.noise = node.own or (node.up is not None and node.up.noise)


def _walk(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out = [root]
    for node in out:
        out.extend(x for x in node.down if isinstance(x, Node))
    return out


def measure(root: Node) -> list[Node]:
    """Counts and densities of every node; what is noise counts as no text."""
    order = _walk(root)
    for node in reversed(order):
        for x in node.down:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
            elif not node.noise:
                node.chars += len(" ".join(x.split()))
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((x for x in order if x.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(order):
        node.density = _density(node, share)
        node.total = sum(x.density for x in node.down if isinstance(x, Node))
    return order


def _density(node: Node, share: float) -> float:
    if not node.chars:
        return 0.0
    tags, links, link_tags = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
    other = max(1, node.chars - node.link_chars)
    base = math.log(node.chars / other * node.link_chars + share * node.chars + math.e)
    ratio = (node.chars / links) * (tags / link_tags)
    return node.chars / tags * (math.log(max(ratio, 1.0)) / math.log(base) if base > 1.0 else math.log(max(ratio, 1.0)) + 1)


def main_node(root: Node) -> Node:
    """The subtree with the largest density sum under the threshold of the body's path.

    It is widened to its parent while that adds no text, or only parts of a story as
    dense as the threshold asks, and to the article or main that it lies in.
    """
    order = measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    inside = [x for x in _walk(body) if not x.noise]
    if not inside or not body.chars:
        return body
    densest = max(inside, key=lambda x: x.density)
    threshold, node = densest.density, densest
    while node is not None and node is not body.up:
        threshold = min(threshold, node.density)
        node = node.up
    passed = [x for x in inside if x.density >= threshold and x.tag not in SMALL]
    best = max(passed, key=lambda x: x.total, default=body)
    while best.up is not None and best is not body and best.tag not in ("article", "main"):
        up = best.up
        beside = [x for x in up.down if x is not best and isinstance(x, Node) and x.chars]
        if up.chars == best.chars or best.inside or (up is not body and all(x.tag in PARTS and x.density >= threshold for x in beside)):
            best = up
        else:
            break
    return best


def text_of(node: Node) -> str:
    """Texts of the subtree without noise: blocks joined by one space."""
    blocks: list[str] = []
    run: list[str] = []

    def end():
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            end()
        elif x.tag == "br":
            run.append("\n")
        elif not (x.noise and x is not node):
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(x.down))
    end()
    return " ".join(blocks)


def extract(html: str | None) -> str:
    """The main text of one page.

    Null and empty pages, and pages with nothing but noise, have an empty text.  Broken
    markup is read as browsers do in the main: missing end tags are added, stray ones
    ignored.  Of nodes with equal sums the first in page order is chosen.  Time and
    memory are linear in the page, however long or deep.
    """
    return text_of(main_node(parse(html))) if html else ""


def main_text(html: Column) -> Column:
    """The main text of each whole page; see :func:`extract`.

    A function of the one column: other columns, repeated rows and an empty table need no care.
    """

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(x) for x in pages], dtype=object)

    return run(html)
