"""Main text of web pages by composite text density.

A page becomes a light element tree. For each element the density is its
characters per tag, corrected by how much of its text is in links: link-laden
elements fall far below prose. The sum of the densities of an element's child
blocks marks where prose gathers (inline elements dress the text of their block
and add nothing to the sum); the element with the largest sum is the content,
and the least density on its path to the body is the threshold that neighbours
of the path must reach to be content as well.

Elements of the roles that are never the article (menus, page headers and
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments)
are taken out before densities are computed, by element name, role, or a class
or id that says so. Classes that may mean such a part or prose (related, share,
legal, reviews and the like) decide nothing by themselves: such an element goes
only if its density is below the threshold.

Text comes out as blocks in page order, one line each: character references
decoded, white space inside a block turned into one space, ends trimmed.

Defined results: null or empty html gives the empty text; broken markup is read
as far as it goes (unclosed elements end with their parent, stray ends are
ignored); very long and very deeply nested pages are read whole, in time that
grows with their length; repeated rows give repeated results; of equal sums the
outer element wins; other columns are carried along, one that is named like the
result is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
# The element names that each rule is about.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {
    "head", "script", "style", "noscript", "template", "iframe", "embed", "svg", "canvas", "audio", "video",
    "nav", "menu", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "dialog",
    "title", "noembed", "noframes",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROOMS = {"article", "main"}
# Elements that an opening element of the same set ends, within the nearest of the holders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: One attribute with its value, so that what stands inside a value is no attribute.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HEADERS = {"header", "site-header", "page-header", "siteheader", "pageheader"}
# Words of class and id names that say what role an element has, and words that only hint at one.
ROLE_NAMES = (
    "ads? adverts? advertisements? adsense adslot sponsor sponsored nav navbar navigation menu breadcrumbs? side-?bar footer masthead "
    "(?:site|page)?-?header topbar cookies? consent gdpr notice notification newsletter subscribe signup login comments? comment-?list "
    "disqus respond replies skip-?link"
).split()
HINT_NAMES = (
    "banner promo promotion alert popup modal overlay share sharing social related recommended widget reply reviews? pagination pager "
    "copyright disclaimer legal toolbar"
).split()


def _names(words: list[str]) -> re.Pattern:
    return re.compile(rf"(?:^|(?<=[\s_-]))({'|'.join(words)})(?=$|[\s_-]|\d)", re.I)


ROLE, HINT = _names(ROLE_NAMES), _names(HINT_NAMES)


#: The logarithm's base nears 1 where an element and the page have no links; its own logarithm is held above this.
LEAST_LOG = 0.25


class Node:
    __slots__ = ("tag", "parent", "block", "kids", "dead", "hint", "chars", "tags", "link_chars", "link_tags", "density", "gathered", "first", "last")

    def __init__(self, tag: str, parent: Node | None, dead: bool, hint: bool):
        self.tag, self.parent, self.dead, self.hint = tag, parent, dead, hint
        #: The nearest element that is no inline one: itself, or above.
        self.block: Node = parent.block if parent is not None and tag in INLINE else self
        self.kids: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.gathered = 0.0
        self.first = self.last = 0


def _role(tag: str, attributes: str, in_room: bool) -> tuple[bool, bool]:
    """Whether an element has a role that is never the article, and whether a name hints at one."""
    if tag in NEVER or tag == "header" and not in_room:
        return True, False
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return False, False
    hint = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name in ("class", "id"):
            parts = re.sub(r"([a-z])([A-Z])", r"\1-\2", value)
            found = {m.strip("-_ ").lower() for m in ROLE.findall(parts)}
            if found - (HEADERS if in_room else set()):
                return True, False
            hint = hint or HINT.search(parts) is not None
    return False, hint


def _parse(page: str) -> tuple[Node, list[tuple[Node, str | None]]]:
    """The tree, and its text in page order: (element, text), or (element, None)
    where a block begins or ends. The open elements and where each name is open
    are kept, so a tag costs the elements that it closes."""
    root = Node("#page", None, False, False)
    path, flow, at = [root], [], 0
    open_at: defaultdict[str, list[int]] = defaultdict(list)

    def close(depth: int) -> None:
        """Close the open elements from ``depth`` on, innermost first."""
        while len(path) > depth:
            node = path.pop()
            open_at[node.tag].pop()
            node.last = len(flow)
            if node.tag not in INLINE:
                flow.append((node, None))

    pos, end = 0, len(page)
    find = TOKEN.search
    while pos < end:
        m = find(page, pos)
        if m is None:
            flow.append((path[-1], page[pos:]))
            break
        if m.start() > at:
            flow.append((path[-1], page[at:m.start()]))
        pos = at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, attributes = tag.lower(), (m[3] if m[2] else m[6]) or ""
        if m[1] or m[4]:
            if open_at[tag]:
                close(open_at[tag][-1])
            continue
        if (tag == "body" or tag not in INLINE and tag not in RAW and tag not in VOID) and path[-1].tag == "head":
            while path[-1].tag == "head":
                close(len(path) - 1)
        if tag not in INLINE and tag not in VOID:
            # a block ends the paragraph that it opens in
            up = path[-1].block
            if up.tag == "p" or up.tag in HEADINGS and tag in HEADINGS:
                close(open_at[up.tag][-1])
            if tag in ENDS:
                enders, holders = ENDS[tag]
                held = max((open_at[x][-1] for x in holders if open_at[x]), default=0)
                inside = [open_at[x][k] for x in enders if (k := bisect_right(open_at[x], held)) < len(open_at[x])]
                if inside:
                    close(min(inside))
        in_room = any(open_at[x] for x in ROOMS)
        here = path[-1]
        dead, hint = _role(tag, attributes, in_room)
        node = Node(tag, here, here.dead or dead, hint)
        here.kids.append(node)
        if tag not in INLINE:
            flow.append((node, None))
        node.first = len(flow)
        if tag == "br":
            flow.append((here, " "))
        if tag in VOID or attributes.endswith("/") and tag not in RAW:
            node.last = len(flow)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
            pos = at = stop.end() if stop else end
            node.last = len(flow)
            continue
        open_at[tag].append(len(path))
        path.append(node)
    close(1)
    root.last = len(flow)
    return root, flow


def _densities(root: Node, flow: list[tuple[Node, str | None]]) -> list[Node]:
    """Counts and densities of all live elements, parents before children."""
    for node, text in flow:
        if text and not node.dead:
            node.chars += len(text.strip())
    order = [root]
    for node in order:
        order.extend(k for k in node.kids if not k.dead)
    for node in reversed(order):
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    whole = root.chars or 1
    share = root.link_chars / whole
    for node in order:
        c, t = node.chars, node.tags or 1
        if not c:
            continue
        lc, lt = node.link_chars or 1, node.link_tags or 1
        plain = (c - node.link_chars) or 1
        base = math.log(c / plain * node.link_chars + share * c + math.e)
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), LEAST_LOG)
    for node in order:
        # inline elements are dressed text of their block; its own density speaks for them
        node.gathered = sum(k.density for k in node.kids if not k.dead and k.tag not in INLINE)
    return order


def _content(root: Node, order: list[Node]) -> tuple[list[Node], float]:
    """The element where densities gather most with the neighbours of its path
    to the body that reach the path's least density; and that threshold."""
    best = max(order, key=lambda n: n.gathered)
    path, up = [], best if best.gathered else root
    while up is not None:
        path.append(up)
        up = up.parent
    inside = path[:next((k for k, n in enumerate(path) if n.tag == "body"), len(path) - 1) + 1]
    threshold = min((n.density for n in inside if n.density), default=0.0)
    chosen = [path[0]]
    for low, high in zip(inside, inside[1:]):
        chosen += [k for k in high.kids if k is not low and not k.dead and k.chars and (k.density >= threshold or k.tag in HEADINGS)]
    return chosen, threshold


def extract_text(page: str | None) -> str:
    if not page:
        return ""
    root, flow = _parse(page)
    order = _densities(root, flow)
    chosen, threshold = _content(root, order)
    for node in order:  # parents before children
        node.dead = node.parent is not None and node.parent.dead or node.hint and node.density < threshold
    spans = sorted((n.first, n.last) for n in chosen)
    blocks, now = [], []
    for first, last in spans:
        for node, text in flow[first:last]:
            if text is None:
                blocks.append("".join(now))
                now = []
            elif not node.dead:
                now.append(html.unescape(text) if "&" in text else text)
        blocks.append("".join(now))
        now = []
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_col`` in ``text_col``; the html
    itself is left out."""
    kept = [f for f in pages.schema.fields if f.name != html_col and f.name != text_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            texts = [extract_text(x) for x in b[html_col]]
            yield b[[f.name for f in kept]].assign(**{text_col: texts})

    return pages.select(*[f.name for f in kept], html_col).mapInPandas(
        run, T.StructType([*kept, T.StructField(text_col, T.StringType())]))
