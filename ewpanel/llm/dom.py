"""A small tree of a page: its blocks and runs of text, and trees of many pages as one forest of arrays."""

from __future__ import annotations

import html
import re

import numpy as np

# Element names by kind, and words of class, id, role and label attributes by what they announce.
KINDS = {
    "text": "", "root": "html body", "article": "article", "main": "main", "nav": "nav menu", "header": "header hgroup", "footer": "footer", "aside": "aside dialog",
    "form": "form fieldset legend label button select option optgroup textarea input", "section": "section center", "div": "div", "p": "p", "heading": "h1 h2 h3 h4 h5 h6", "item": "li dt dd", "list": "ul ol dl",
    "cell": "td th", "table": "table tbody thead tfoot tr caption", "quote": "blockquote pre figure figcaption address details summary", "inline": "", "other": "",
}
ROLES = {
    "content": "article articles content contents post entry story text main body",
    "menu": "nav navbar navigation menu menus menubar breadcrumb breadcrumbs crumbs tabs toolbar pagination pager skip toc sitemap",
    "header": "header masthead topbar logo branding brand head tagline",
    "footer": "footer foot copyright legal colophon contentinfo imprint",
    "sidebar": "sidebar side aside rail widget widgets secondary complementary",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall signup banner disclaimer privacy warning dialog",
    "ad": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion commercial affiliate outbrain taboola",
    "form": "form login search searchbox signin register contact input poll",
    "comments": "comment comments commentlist reply replies discussion disqus respond thread responses",
    "related": "share sharing social related recommended recommendations popular trending tags follow teaser teasers next previous",
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HIDDEN = frozenset("script style template noscript iframe title svg math canvas object audio video".split())
SCOPES = frozenset("table td th caption html body ul ol dl button".split())
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul dt dd".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
        "thead": ("tr", "td", "th", "tbody"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}

KIND_NAMES = list(KINDS)
KIND = {tag: i for i, tags in enumerate(KINDS.values()) for tag in tags.split()}
TEXT, OTHER = KIND_NAMES.index("text"), KIND_NAMES.index("other")
ROLE_NAMES = list(ROLES)
ROLE = {word: 1 << i for i, words in enumerate(ROLES.values()) for word in words.split()}

_TAG = re.compile(r"""<(?:!--(?:(?=-?>)|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z))""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_OFF = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def role_bits(attributes: str) -> int:
    """A bit for each role whose words stand in the naming attributes."""
    bits = 0
    for found in _NAMED.findall(attributes):
        for word in _WORD.findall(found[0] or found[1] or found[2]):
            bits |= ROLE.get(word.lower(), 0)
    return bits


class Page:
    """Nodes of a page in page order: elements that hold text and their runs of text (leaves).

    ``parent``, ``kind``, ``roles`` and ``level`` (1 for h1 up to 6, else 0) are by node; ``text`` (references
    decoded, white space as it stands) and ``linked`` (characters in links) by leaf, whose numbers are ``leaf``.
    ``breaks`` says of each leaf whether a block began or ended since the last one. Scripts, styles,
    comments and other things that are not shown give no leaf.
    """

    __slots__ = ("parent", "kind", "roles", "level", "leaf", "text", "linked", "breaks")

    def __init__(self, source: str):
        self.parent, self.kind, self.roles, self.level = [-1], [KIND["body"]], [0], [0]
        self.leaf, self.text, self.linked, self.breaks = [], [], [], []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("body", 0)]
        links, broken, at, hidden = 0, True, 0, ""
        run: list[str] = []
        run_linked = 0

        def close_run() -> None:
            nonlocal run_linked, broken
            whole = "".join(run)
            if whole and not whole.isspace():
                self.leaf.append(len(self.parent))
                self.parent.append(stack[-1][1])
                self.kind.append(TEXT)
                self.roles.append(0)
                self.level.append(0)
                self.text.append(whole)
                self.linked.append(run_linked)
                self.breaks.append(broken)
                broken = False
            elif whole and self.text:
                self.text[-1] += " "
            run.clear()
            run_linked = 0

        def pop_to(depth: int) -> None:
            nonlocal links
            for name, _ in stack[depth:]:
                links -= name == "a"
            del stack[depth:]

        def add(text: str) -> None:
            nonlocal run_linked
            if "&" in text:
                text = html.unescape(text)
            run.append(text)
            if links:
                run_linked += len(text.strip())

        while at < len(source):
            if hidden:  # what is not shown ends with its own end tag alone
                end = re.compile(rf"</{re.escape(hidden)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at, hidden = end.end() if end else len(source), ""
                continue
            tag = _TAG.search(source, at)
            if tag is None:
                add(source[at:])
                break
            if tag.start() > at:
                add(source[at : tag.start()])
            at = tag.end()
            name = tag.group(2)
            if name is None:
                continue
            name, attributes = name.lower(), tag.group(3)
            if tag.group(1):
                self._end(name, stack, close_run, pop_to)
                if name not in INLINE:
                    broken = True
                continue
            if name in HIDDEN:
                if not attributes.endswith("/") or name in ("script", "style", "title"):
                    hidden = name
                continue
            if name in ("html", "body", "head"):
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    run.append("\n")
                continue
            bits = role_bits(attributes) if "=" in attributes else 0
            off = bool(attributes) and bool(_OFF.search(attributes))
            if name in INLINE and not off:
                if name == "a":
                    links += 1
                if bits & ~1:
                    close_run()
                    self._open(name, KIND_NAMES.index("inline"), bits, stack)
                else:
                    stack.append((name, stack[-1][1]))
                continue
            close_run()
            broken = True
            if name in ENDS_P:
                depth = self._within(stack, ("p",))
                if depth:
                    pop_to(depth)
            if name in SAME:
                depth = self._within(stack, SAME[name])
                while depth:
                    pop_to(depth)
                    depth = self._within(stack, SAME[name]) if name[0] == "t" else 0
            self._open(name, KIND.get(name, OTHER), bits | (ROLE["popup"] if off else 0), stack)
            if name[0] == "h" and len(name) == 2 and name[1] in "123456":
                self.level[-1] = int(name[1])
        close_run()

    def _open(self, name: str, kind: int, bits: int, stack: list) -> None:
        stack.append((name, len(self.parent)))
        self.parent.append(stack[-2][1])
        self.kind.append(kind)
        self.roles.append(bits)
        self.level.append(0)

    @staticmethod
    def _within(stack: list, names: tuple) -> int:
        """Depth of the nearest open element of these names in its scope, or 0."""
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                return depth
            if stack[depth][0] in SCOPES:
                return 0
        return 0

    def _end(self, name: str, stack: list, close_run, pop_to) -> None:
        block = name not in INLINE
        if block:
            close_run()
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] == name:
                if not block:
                    if self.kind[stack[depth][1]] == KIND_NAMES.index("inline") and stack[depth][1] != stack[depth - 1][1]:
                        close_run()
                pop_to(depth)
                return
            if not block and stack[depth][0] not in INLINE:
                return


def joined(texts: list[str], breaks: list[bool], chosen: list[bool]) -> str:
    """The chosen leaves in page order, blocks apart by one space, white space as one space."""
    out, apart = [], True
    for text, broken, take in zip(texts, breaks, chosen):
        apart = apart or broken
        if take:
            out.append(("\n" if apart else "") + text)
            apart = False
        else:
            apart = True
    return " ".join("".join(out).split())


class Forest:
    """Many pages' nodes as arrays. Elements without text are left out; ``levels`` are the nodes by depth."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        flat = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
        parent, page = flat("parent"), np.repeat(np.arange(len(pages)), sizes)
        parent = np.where(parent < 0, -1, parent + start[page])
        leaf = flat("leaf") + np.repeat(start, [len(p.leaf) for p in pages])
        up = parent.tolist()
        depths = [0] * len(up)
        for i, p in enumerate(up):  # parents come first
            depths[i] = depths[p] + 1 if p >= 0 else 0
        depth = np.array(depths, np.int64)
        holds = np.zeros(len(parent), bool)
        holds[leaf] = True
        held = holds.tolist()
        for i in range(len(up) - 1, -1, -1):
            if held[i] and up[i] >= 0:
                held[up[i]] = True
        keep = np.array(held, bool)
        number = np.cumsum(keep) - 1
        self.parent = np.where(parent[keep] < 0, -1, number[parent[keep]])
        self.depth, self.page, self.pages = depth[keep], page[keep], len(pages)
        self.kind, self.roles, self.level = flat("kind")[keep], flat("roles")[keep], flat("level")[keep]
        self.leaf = number[leaf]
        by = np.argsort(self.depth, kind="stable")
        self.levels = np.split(by, np.flatnonzero(np.diff(self.depth[by])) + 1) if len(by) else []
        # by level the parents and where each one's children begin: children of one parent stand together
        self.parents = [(self.parent[nodes][first], first) for nodes in self.levels[1:] for first in [np.flatnonzero(np.diff(self.parent[nodes], prepend=-1))]]
        self.texts = [t for p in pages for t in p.text]
        self.linked = np.array([x for p in pages for x in p.linked], np.float64)

    def above(self, values: np.ndarray) -> np.ndarray:
        """Sums of leaf values over each node's leaves."""
        out = np.zeros(len(self.parent))
        out[self.leaf] = values
        self.to_parents(out)
        return out

    def to_parents(self, values: np.ndarray, of=np.add) -> None:
        """Adds (or takes the maximum of) each node's final value to its parent's, from the deepest level up."""
        for nodes, (parents, first) in zip(self.levels[:0:-1], self.parents[::-1]):
            values[parents] = of(values[parents], of.reduceat(values[nodes], first))
