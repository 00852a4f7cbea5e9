"""An HTML tokenizer and tree builder after the public HTML standard, as far as text extraction needs it.

Handled: raw-text elements, void elements, implied end tags, inserted table sections, a head and a body, and formatting
elements that are reopened after a block closes over them. Not handled: foster parenting, templates, foreign content.
"""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp".split())
RCDATA = frozenset(("title", "textarea"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD_ONLY = frozenset("base link meta script style title noscript template".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: Which open elements a start tag ends, and which elements stop the search for them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("table td th caption html body button object".split())

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)|<!(?P<decl>[^>]*)(?:>|\Z)|<\?(?P<pi>[^>]*)(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.S,
)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: "Node | None" = None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs or {}, [], parent

    def walk(self):
        """This element and all below it, in document order, without recursion."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def find(self, *tags: str) -> "Node | None":
        return next((n for n in self.walk() if n.tag in tags), None)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo.extend(reversed(node.kids))
        return "".join(out)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTR.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


class TreeBuilder:
    """Feed with start, end and text; `root` is the document element."""

    def __init__(self):
        self.root = Node("html")
        self.head = Node("head", parent=self.root)
        self.body = Node("body", parent=self.root)
        self.root.kids = [self.head, self.body]
        self.stack: list[Node] = [self.root, self.body]
        self.formatting: list[Node] = []
        self.started = False

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def _pop_to(self, tags, stops=SCOPE) -> bool:
        for i in range(len(self.stack) - 1, 1, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return True
            if self.stack[i].tag in stops:
                return False
        return False

    def _append(self, tag: str, attrs: dict[str, str] | None = None, push: bool = True) -> Node:
        node = Node(tag, attrs, self.top)
        self.top.kids.append(node)
        if push:
            self.stack.append(node)
        return node

    def _reopen(self) -> None:
        """Opens again what was left open when a block closed over it."""
        if not self.formatting:
            return
        on = set(map(id, self.stack))
        for i, node in enumerate(self.formatting):
            if id(node) not in on:
                self.formatting[i] = self._append(node.tag, node.attrs)

    def start(self, tag: str, attrs: dict[str, str] | None = None, closed: bool = False) -> Node | None:
        if tag in ("html", "body", "head"):
            target = {"html": self.root, "body": self.body, "head": self.head}[tag]
            for k, v in (attrs or {}).items():
                target.attrs.setdefault(k, v)
            self.started |= tag == "body"
            return None
        if tag in HEAD_ONLY and not self.started:
            node = Node(tag, attrs, self.head)
            self.head.kids.append(node)
            if tag not in VOID:
                self.stack.append(node)
            return node
        self.started = True
        if tag in CLOSES_P:
            self._pop_to(("p",), SCOPE | {"li", "dd", "dt", "blockquote", "div", "section", "article"})
        if tag in HEADINGS and self.top.tag in HEADINGS:
            self.stack.pop()
        if tag in ENDS:
            targets, stops = ENDS[tag]
            if tag == "tr" or tag in ("thead", "tbody", "tfoot"):
                while self._pop_to(targets, stops):
                    pass
            else:
                self._pop_to(targets, stops)
        if tag in ("td", "th") and self.top.tag in ("table", "thead", "tbody", "tfoot"):
            if self.top.tag == "table":
                self._append("tbody")
            self._append("tr")
        elif tag == "tr" and self.top.tag == "table":
            self._append("tbody")
        if tag in FORMATTING or tag not in CLOSES_P and tag not in ENDS:
            self._reopen()
        if tag == "a" and any(n.tag == "a" for n in self.formatting):
            self.end("a")
        node = self._append(tag, attrs, push=tag not in VOID)
        if tag in FORMATTING:
            if closed:
                self.stack.pop()
            else:
                self.formatting.append(node)
        return node

    def end(self, tag: str) -> bool:
        """Whether there was something to end."""
        if tag in ("html", "body", "head"):
            return True
        if tag == "br":
            self.start("br")
            return True
        if tag == "p" and not any(n.tag == "p" for n in self.stack[2:]):
            self._append("p", push=False)
            return False
        if tag in FORMATTING:
            node = next((n for n in reversed(self.formatting) if n.tag == tag), None)
            if node is None:
                return False
            self.formatting.remove(node)
            at = next((i for i in range(len(self.stack) - 1, 1, -1) if self.stack[i] is node), None)
            if at is not None and not any(n.tag in CLOSES_P or n.tag in ENDS for n in self.stack[at + 1 :]):
                del self.stack[at:]
            elif at is not None:
                del self.stack[at]
            return True
        if tag in HEADINGS:
            return self._pop_to(HEADINGS)
        if tag == "table":
            return self._pop_to(("table",), ())
        stops = ("table",) if tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else SCOPE - {tag}
        return self._pop_to((tag,), stops)

    def text(self, text: str) -> None:
        if not text:
            return
        if self.top.tag in RAW or self.top.tag in RCDATA:
            self.top.kids.append(text)
            return
        if not text.isspace():
            self.started = True
            if self.top.tag in ("head",):
                self.stack.pop()
            self._reopen()
        kids = self.top.kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += text
        else:
            kids.append(text)


def parse(source: str) -> Node:
    """The document element of the page. Never fails; what can't be understood is text."""
    builder, at, size = TreeBuilder(), 0, len(source)
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            builder.text(html.unescape(source[at:]))
            break
        m = TOKEN.match(source, lt)
        if m is None:
            builder.text(html.unescape(source[at : lt + 1]))
            at = lt + 1
            continue
        if lt > at:
            builder.text(html.unescape(source[at:lt]))
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("close"):
            builder.end(tag)
            continue
        builder.start(tag, attributes(m.group("attrs")), m.group("attrs").endswith("/"))
        if tag in RAW or tag in RCDATA:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            inside = source[at : stop.start()] if stop else source[at:]
            builder.text(html.unescape(inside) if tag in RCDATA else inside)
            at = stop.end() if stop else size
            if builder.top.tag == tag:
                builder.stack.pop()
    return builder.root
