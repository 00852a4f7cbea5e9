"""HTML pages to trees: the content root is chosen, its elements become blocks. Never fails; ranges are not known."""

from __future__ import annotations

from marlstone.ir import tree
from marlstone.parsers import dom
from marlstone.parsers.markdown import GENERIC_CONFIDENCE

POLICY = "html1"
# What is never content, what is only a wrapper, what the search for the root may enter.
CHROME = frozenset("script style noscript template nav header footer aside form iframe svg canvas button dialog select input textarea".split())
WRAPPERS = frozenset("div section article main body html figure figcaption details summary dl hgroup".split())
ENTERED = frozenset("div section article main body".split())
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p pre table ul ol blockquote hr dt dd li tr td th thead tbody tfoot caption".split())
STYLES = {"strong": "Strong", "b": "Strong", "em": "Emphasis", "i": "Emphasis", "del": "Strikethrough", "s": "Strikethrough", "strike": "Strikethrough"}
CODE = frozenset("code kbd samp".split())
FLAT = frozenset("span abbr small sub sup u mark time cite q".split())
INLINE = STYLES.keys() | CODE | FLAT | {"a", "img", "br", "wbr"}
#: A wrapper is entered while the longest element in it has four fifths of its text.
DENSITY = 4, 5


def content_length(node: dom.Node) -> int:
    """Bytes of text outside chrome, white space not counted."""
    total, todo = 0, [node]
    while todo:
        for kid in todo.pop().kids:
            if isinstance(kid, str):
                total += sum(len(w.encode()) for w in kid.split())
            elif kid.tag not in CHROME:
                todo.append(kid)
    return total


def _last_longest(nodes) -> tuple[dom.Node | None, int]:
    best, length = None, 0
    for n in nodes:
        if (size := content_length(n)) >= length:
            best, length = n, size
    return best, length


def collapse(text: str) -> str:
    """Runs of white space as one blank. A text of nothing else is empty."""
    if not text.strip():
        return ""
    return (" " if text[0].isspace() else "") + " ".join(text.split()) + (" " if text[-1].isspace() else "")


class Page:
    """`blanks` keeps the blank between two inline elements, which is otherwise dropped with all texts of white space."""

    def __init__(self, source: str, extract: bool = True, blanks: bool = False):
        self.root = dom.parse(source)
        self.body = self.root.kids[1]
        self.section = tree.SectionPath()
        self.diagnostics: list[dict] = []
        self.reported: set[str] = set()
        self.blanks = blanks
        self.content = self.content_root() if extract else self.body

    def note(self, key: str, kind: str, message: str) -> None:
        """Once for each key."""
        if key not in self.reported:
            self.reported.add(key)
            self.diagnostics.append(tree.diagnostic(kind, message))

    # Where the content is

    def content_root(self) -> dom.Node:
        marked = (n for n in self.root.walk() if n.tag in ("main", "article") or n.attrs.get("role") == "main")
        at, length = _last_longest(marked)
        if not length:
            at = self.body
            while total := content_length(at):
                inner, length = _last_longest(k for k in at.kids if isinstance(k, dom.Node) and k.tag in ENTERED)
                if inner is None or length * DENSITY[1] < total * DENSITY[0]:
                    break
                at = inner
        if at is not self.body:
            mark = f' id="{at.attrs["id"]}"' if "id" in at.attrs else f' class="{at.attrs["class"]}"' if "class" in at.attrs else ""
            self.diagnostics.append(tree.diagnostic("Normalized", f"content extraction selected <{at.tag}{mark}> as the content root"))
        return at

    # Inlines

    def put(self, out: list, raw: str) -> None:
        text = collapse(raw)
        if not text and self.blanks and raw:
            text = " "
        if text and out and out[-1]["kind"] == "text":
            out[-1] = tree.text(out[-1]["text"] + text)
        elif text:
            out.append(tree.text(text))

    def inlines(self, node: dom.Node) -> list[dict]:
        return self.trimmed(self.loose(node, []))

    def trimmed(self, nodes: list[dict]) -> list[dict]:
        """Neighbouring texts joined, without blanks at both ends."""
        out: list[dict] = []
        for n in nodes:
            if n["kind"] == "text" and out and out[-1]["kind"] == "text":
                out[-1] = tree.text(collapse(out[-1]["text"] + n["text"]) or (" " if self.blanks else ""))
            else:
                out.append(n)
        if out and out[0]["kind"] == "text":
            out[0] = tree.text(out[0]["text"].lstrip())
        if out and out[-1]["kind"] == "text":
            out[-1] = tree.text(out[-1]["text"].rstrip())
        return [n for n in out if n["kind"] != "text" or n["text"]]

    def loose(self, node: dom.Node, out: list) -> list[dict]:
        for kid in node.kids:
            if isinstance(kid, str):
                self.put(out, kid)
            elif kid.tag in CHROME:
                continue
            elif kid.tag in INLINE:
                self.inline(kid, out)
            else:
                self.put(out, " ")
                self.loose(kid, out)
                self.put(out, " ")
        return out

    def inline(self, node: dom.Node, out: list) -> None:
        tag = node.tag
        if tag in STYLES:
            if inner := self.inlines(node):
                out.append(tree.styled(STYLES[tag], inner))
        elif tag in CODE:
            if text := collapse(node.text()).strip():
                out.append(tree.code(text))
        elif tag == "a":
            inner, url = self.inlines(node), node.attrs.get("href", "")
            if not url:
                self.note("link-no-href", "Lossy", "anchor without href was flattened to its text")
                out.extend(inner)
            elif inner:
                out.append(tree.link(url, inner))
        elif tag == "img":
            url = node.attrs.get("src", "")
            if url:
                out.append(tree.image(url, node.attrs.get("alt", "").strip()))
            else:
                self.note("img-no-src", "Lossy", "image without src was dropped")
        elif tag == "br":
            out.append(dict(tree.LINE_BREAK))
        elif tag in FLAT:
            self.loose(node, out)

    # Blocks

    def block(self, kind: str, **payload) -> dict:
        return tree.block(kind, self.section.current(), None, **payload)

    def paragraph(self, inlines: list[dict]) -> list[dict]:
        return [self.block("paragraph", content=inlines)] if inlines else []

    def blocks(self, node: dom.Node) -> list[dict]:
        """Inlines between blocks become paragraphs."""
        out: list[dict] = []
        open_: list[dict] = []
        for kid in node.kids:
            if isinstance(kid, str):
                self.put(open_, kid)
            elif kid.tag in INLINE:
                self.inline(kid, open_)
            elif kid.tag not in CHROME:
                out += self.paragraph(self.trimmed(open_))
                open_ = []
                out += self.element(kid)
        return out + self.paragraph(self.trimmed(open_))

    def element(self, node: dom.Node) -> list[dict]:
        tag = node.tag
        if tag in dom.HEADINGS:
            content = self.inlines(node)
            if not content:
                return []
            above = self.section.enter(int(tag[1]), tree.plain(content))
            return [tree.block("heading", above, None, level=int(tag[1]), content=content)]
        if tag in ("p", "dt", "dd", "caption"):
            return self.paragraph(self.inlines(node))
        if tag == "pre":
            named = (c[9:] for n in node.walk() if n is node or n.tag == "code" for c in n.classes if c.startswith("language-") and c[9:])
            return [self.block("code_block", language=next(named, None), code=node.text().rstrip("\n"))]
        if tag == "table":
            return self.table(node)
        if tag in ("ul", "ol"):
            return self.list(node)
        if tag == "blockquote":
            inner = self.blocks(node)
            return [self.block("block_quote", children=inner)]
        if tag == "hr":
            return [self.block("thematic_break")]
        if tag in WRAPPERS:
            return self.blocks(node)
        if any(isinstance(k, dom.Node) and (k.tag in BLOCKS or k.tag in WRAPPERS) for k in node.kids):
            self.note(f"flattened:{tag}", "Unsupported", f"unclassified element <{tag}> was flattened into its children")
            return self.blocks(node)
        content = self.inlines(node)
        if not content:
            return []
        hint = " ".join(node.classes) or tag
        self.note(f"generic:{tag}", "Unsupported", f"unclassified element <{tag}> degraded to GenericBlock (hint: {hint})")
        return [self.block("generic", content=content, hint=hint, confidence=GENERIC_CONFIDENCE)]

    def list(self, node: dom.Node) -> list[dict]:
        items = []
        for kid in node.kids:
            if isinstance(kid, str) or kid.tag in CHROME:
                continue
            if kid.tag == "li":
                items.append(self.blocks(kid))
            else:
                self.note("list-non-li", "Lossy", f"non-<li> element <{kid.tag}> inside a list was ignored")
        if not items:
            self.note("empty-list", "Normalized", "empty <ul>/<ol> without <li> items was skipped")
            return []
        return [self.block("list", ordered=node.tag == "ol", items=items)]

    def table(self, node: dom.Node) -> list[dict]:
        heads, rows, spans = [], [], False
        for part in node.kids:
            if isinstance(part, str) or part.tag not in ("thead", "tbody", "tfoot"):
                continue
            for line in part.kids:
                cells = [c for c in line.kids if isinstance(c, dom.Node) and c.tag in ("td", "th")] if isinstance(line, dom.Node) and line.tag == "tr" else []
                spans = spans or any("colspan" in c.attrs or "rowspan" in c.attrs for c in cells)
                if cells:
                    (heads if part.tag == "thead" else rows).append([self.inlines(c) for c in cells])
        if spans:
            self.note("table-span", "Lossy", "table colspan/rowspan attributes are not represented; cells were flattened")
        if len(heads) > 1:
            self.note("table-multi-head", "Lossy", "table had multiple header rows; only the first was kept as the header")
        elif not heads and rows:
            self.note("table-headerless", "Normalized", "table without a header row; first row was promoted to header")
        lines = heads + rows
        if not lines:
            return []
        columns = max(map(len, lines))
        if min(map(len, lines)) < columns:
            self.note("table-ragged", "Normalized", "ragged table rows were padded with empty cells to a uniform width")
        lines = [r + [[] for _ in range(columns - len(r))] for r in lines]
        return [self.block("table", headers=lines[0], rows=lines[1:])]

    def title(self, body: list[dict]) -> str | None:
        head = self.root.find("title")
        if head is not None and (text := collapse(head.text()).strip()):
            return text
        for b in body:
            if b["kind"] == "heading" and b["level"] == 1 and (text := tree.plain(b["content"]).strip()):
                return text
        for n in self.root.walk():
            if n.tag == "meta" and n.attrs.get("property") == "og:title" and "content" in n.attrs:
                return n.attrs["content"].strip() or None
        return None


def parse(source: str, extract: bool = True, blanks: bool = False) -> dict:
    """{title, format, frontmatter, body, diagnostics} of a page."""
    page = Page(source, extract, blanks)
    body = page.blocks(page.content)
    return {"title": page.title(body), "format": "Html", "frontmatter": None, "body": body, "diagnostics": page.diagnostics}
