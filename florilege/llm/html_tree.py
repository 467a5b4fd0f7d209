"""A forgiving HTML parser that is linear in the page's length."""

from __future__ import annotations

import re
from collections import defaultdict

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_HINT = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")

#: Fixed values of HTML: elements without content, with raw text, that break lines, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math select button option xmp noembed noframes object audio video canvas".split())
VERBATIM = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tr td th thead tbody", "table"), "tfoot": ("tr td th thead tbody", "table")}
_CLOSES = {k: (a.split(), b.split()) for k, (a, b) in CLOSES.items()}
_SCOPE = frozenset("td th table article section div main body html aside nav footer header li blockquote".split())
_HEAD = frozenset("html head body base link meta title script style noscript template".split())


class Tree:
    """Elements in page order (a parent comes before its children) and pieces of text with their element."""

    __slots__ = ("hints", "parents", "pieces", "tags")

    def __init__(self) -> None:
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.hints: list[frozenset[str]] = [frozenset()]
        self.pieces: list[tuple[int, str | None]] = []  # None: a block begins or ends


class _Open:
    """The stack of open elements; knows the innermost element of a tag, block or scope at once."""

    def __init__(self, tree: Tree):
        self.tree, self.stack = tree, [0]
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.blocks, self.scopes = [0], [0]

    def push(self, tag: str, hints: frozenset[str]) -> int:
        tree, number = self.tree, len(self.tree.tags)
        tree.tags.append(tag)
        tree.parents.append(self.stack[-1])
        tree.hints.append(hints)
        depth = len(self.stack)
        self.depths[tag].append(depth)
        if tag in BLOCK:
            self.blocks.append(depth)
        if tag in _SCOPE:
            self.scopes.append(depth)
        self.stack.append(number)
        return number

    def cut(self, depth: int) -> None:
        """Close the element at this depth and all inside it."""
        while len(self.stack) > depth:
            tag = self.tree.tags[self.stack.pop()]
            self.depths[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in _SCOPE:
                self.scopes.pop()

    def innermost(self, tags) -> int:
        """The depth of the innermost element of these tags, or 0."""
        return max((found[-1] for t in tags if (found := self.depths.get(t))), default=0)


def parse(page: str) -> Tree:
    """Unclosed and stray tags are mended as browsers roughly do, and a body that isn't there is made.

    An unfinished tag or comment at the page's end is no text. Quoted attribute values may hold `>`; in a page with a quote
    that never ends, tags from that one on end at the next `>`.
    """
    tree = Tree()
    open_ = _Open(tree)
    pieces, at, end, quoted = tree.pieces, 0, len(page), True

    def text(piece: str) -> None:
        if open_.blocks[-1] == 0 or tree.tags[open_.stack[open_.blocks[-1]]] == "html":
            if not piece.strip():
                return
            open_.push("body", frozenset())
        pieces.append((open_.stack[-1], piece))

    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        if begin > at:
            text(page[at:begin])
        m = _NAME.match(page, begin + 1)
        if not m:
            if page.startswith(("!", "?"), begin + 1):
                mark = "-->" if page.startswith("!--", begin + 1) else ">"
                stop = page.find(mark, begin + (4 if mark == "-->" else 1))
                at = end if stop < 0 else stop + len(mark)
            else:
                text("<")
                at = begin + 1
            continue
        q = _QUOTED.match(page, m.end()) if quoted else None
        stop = q.end() if q else page.find(">", m.end()) + 1
        quoted = quoted and q is not None
        if not stop:
            break
        at, attributes = stop, page[m.end() : stop - 1]
        tag = m[2].lower()
        if m[1]:
            depth = open_.innermost((tag,))
            if depth and (tag in BLOCK or depth > open_.blocks[-1]):
                if tag in BLOCK:
                    pieces.append((open_.stack[-1], None))
                open_.cut(depth)
            continue
        if tag in ("html", "body") and open_.depths.get(tag):
            continue
        if tag not in _HEAD and (len(open_.stack) == 1 or (len(open_.stack) == 2 and open_.depths.get("html"))):
            open_.push("body", frozenset())
        if tag in BLOCK:
            pieces.append((open_.stack[-1], None))
            paragraph = open_.innermost(("p",))
            if paragraph > open_.scopes[-1]:  # a block ends an open paragraph
                open_.cut(paragraph)
        if tag == "body":
            open_.cut(2 if open_.depths.get("html") else 1)
        if tag in _CLOSES:
            ends, scope = _CLOSES[tag]
            limit = open_.innermost(scope)
            while (depth := open_.innermost(ends)) > limit:
                open_.cut(depth)
        if tag == "br":
            pieces.append((open_.stack[-1], " "))
        if tag in VOID:
            continue
        hints = frozenset(_WORD.findall(" ".join(a or b or c for a, b, c in _HINT.findall(attributes)).lower())) if "=" in attributes else frozenset()
        number = open_.push(tag, hints)
        if attributes.endswith("/") and tag in ("svg", "path", "use"):
            open_.cut(len(open_.stack) - 1)
        elif tag in VERBATIM:
            close = re.compile(rf"</{tag}\s*+>", re.IGNORECASE).search(page, at)
            pieces.append((number, page[at : close.start() if close else end]))
            at = close.end() if close else end
            open_.cut(len(open_.stack) - 1)
    return tree
