"""A tolerant HTML tree in flat lists: elements, their parents, and the text between them.

Follows the parts of the HTML parsing rules that matter for text: void and raw-text
elements, comments, optional end tags (p, li, dt, dd, option, table parts), end tags that
close what was left open inside, and stray end tags, which are ignored. Quotes group only
the value after a sign, as in the standard; elsewhere in a tag they are plain characters.
The stack keeps the places of its elements by name, so a page takes time in proportion to
its length however deep it is.
"""

from __future__ import annotations

import re

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul script style textarea noscript template iframe".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: A start tag on the left ends an open element on the right, unless one of the scope stands between.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
SCOPE = frozenset("article aside body button caption div fieldset footer form header html main nav section table td th".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Stack:
    """Open elements, with the places of every name; place 0 is the root's."""

    def __init__(self):
        self.nodes, self.names = [0], ["#root"]
        self.places: dict[str, list[int]] = {}
        #: places of elements in a set of names, kept for the sets that are asked for on every tag
        self.kept = {id(SCOPE): (SCOPE, []), id(BLOCK): (BLOCK, [])}
        self.top = 0

    def push(self, node: int, name: str) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.names.append(name)
        self.places.setdefault(name, []).append(k)
        for names, places in self.kept.values():
            if name in names:
                places.append(k)
        self.top = node

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else 0

    def last_of(self, names) -> int:
        """The highest place of an element with one of the names, 0 if none is open."""
        if own := self.kept.get(id(names)):
            return own[1][-1] if own[1] else 0
        return max(map(self.last, names))

    def cut(self, k: int) -> None:
        """Close the element at place k and all above it."""
        while len(self.nodes) > k:
            self.nodes.pop()
            self.places[self.names.pop()].pop()
        for _, places in self.kept.values():
            while places and places[-1] >= k:
                places.pop()
        self.top = self.nodes[-1]


class Tree:
    """Element i has tag[i], parent[i] (before it; the root is 0) and attributes[i].

    runs: (element, raw text) in page order; None as text marks a line or block edge.
    """

    __slots__ = ("attributes", "parent", "runs", "tag")

    def __init__(self, html: str):
        self.tag, self.parent, self.attributes = ["#root"], [-1], [""]
        self.runs: list[tuple[int, str | None]] = []
        stack = Stack()
        at, size = 0, len(html)
        for token in iter(lambda: TOKEN.search(html, at), None):
            if token.start() > at:
                self.runs.append((stack.top, html[at : token.start()]))
            at = token.end()
            name = token.group(2)
            if name is None:
                if token.end() == token.start():
                    break
                continue
            name = name.lower()
            if token.group(1):
                k = stack.last(name)
                if k:
                    if name in BLOCK or stack.last_of(SCOPE) <= k:
                        if stack.last_of(BLOCK) >= k:
                            self.runs.append((stack.top, None))
                        stack.cut(k)
                elif name in ("p", "br"):
                    self.runs.append((stack.top, None if name == "p" else " "))
                continue
            if name in CLOSES_P:
                self._close(stack, ("p",), SCOPE)
            if name in ENDS:
                self._close(stack, *ENDS[name])
            if name in BLOCK:
                self.runs.append((stack.top, None))
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack.top)
            self.attributes.append(token.group(3))
            if name in VOID or token.group(3).endswith("/") and name not in BLOCK and name not in RAW:
                if name == "br" or name == "wbr":
                    self.runs.append((node, " " if name == "br" else ""))
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                self.runs.append((node, html[at : end.start() if end else size]))
                self.runs.append((stack.top, None))
                at = size if not end else (html.find(">", end.end()) + 1 or size)
                continue
            stack.push(node, name)
        if at < size:
            self.runs.append((stack.top, html[at:]))

    def _close(self, stack: Stack, ended, scope) -> None:
        k = stack.last_of(ended)
        if k and k >= stack.last_of(scope):
            self.runs.append((stack.top, None))
            stack.cut(k)


def marks(attributes: str) -> str:
    """The values of class, id and role, in lower case."""
    if "=" not in attributes:
        return ""
    return " ".join((a or b or c) for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role", "itemprop", "aria-label")).lower()
