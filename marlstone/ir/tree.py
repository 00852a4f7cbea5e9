"""Document trees as plain Python values, their stored JSON form, and walks over them.

A block is a dict with `kind` and, by kind: heading (level, content), paragraph (content), code_block (language, code),
list (ordered, items, each a list of blocks), block_quote (children), table (headers, rows), generic (hint, confidence,
content), thematic_break. Every block has `path`, the headings above it, and `range`, its bytes in the source or None.
An inline is a dict with `kind`: text (text), code (text), break, styled (style, children), link (url, children),
image (url, alt).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from marlstone.errors import ParseError

STYLES = ("Strong", "Emphasis", "Strikethrough")
BLOCK_NAMES = {
    "heading": "Heading",
    "paragraph": "Paragraph",
    "code_block": "CodeBlock",
    "list": "List",
    "block_quote": "BlockQuote",
    "table": "Table",
    "generic": "GenericBlock",
    "thematic_break": "ThematicBreak",
}
KINDS = {v: k for k, v in BLOCK_NAMES.items()}


def text(value: str) -> dict:
    return {"kind": "text", "text": value}


def code(value: str) -> dict:
    return {"kind": "code", "text": value}


LINE_BREAK = {"kind": "break"}


def styled(style: str, children: list) -> dict:
    return {"kind": "styled", "style": style, "children": children}


def link(url: str, children: list) -> dict:
    return {"kind": "link", "url": url, "children": children}


def image(url: str, alt: str) -> dict:
    return {"kind": "image", "url": url, "alt": alt}


def block(kind: str, path: list[str] | tuple = (), range_: tuple[int, int] | None = None, **payload) -> dict:
    return {"kind": kind, "path": list(path), "range": range_} | payload


def diagnostic(kind: str, message: str, range_: tuple[int, int] | None = None) -> dict:
    return {"kind": kind, "message": message, "range": range_}


def plain(inlines: list) -> str:
    """Text and code as they are, breaks as spaces, images by their alt text; addresses dropped."""
    out, todo = [], list(reversed(inlines))
    while todo:
        node = todo.pop()
        kind = node["kind"]
        if kind in ("text", "code"):
            out.append(node["text"])
        elif kind == "break":
            out.append(" ")
        elif kind == "image":
            out.append(node["alt"])
        else:
            todo.extend(reversed(node["children"]))
    return "".join(out)


def children(node: dict) -> Iterator[list[dict]]:
    """The lists of blocks directly below a block."""
    if node["kind"] == "block_quote":
        yield node["children"]
    elif node["kind"] == "list":
        yield from node["items"]


def inline_lists(node: dict) -> Iterator[list[dict]]:
    """The lists of inlines that a block itself holds."""
    if "content" in node:
        yield node["content"]
    if node["kind"] == "table":
        yield from node["headers"]
        for row in node["rows"]:
            yield from row


def walk(blocks: list[dict]) -> Iterator[dict]:
    """All blocks in document order."""
    todo = list(reversed(blocks))
    while todo:
        node = todo.pop()
        yield node
        below = [b for part in children(node) for b in part]
        todo.extend(reversed(below))


class SectionPath:
    """The headings above the current place."""

    def __init__(self):
        self.stack: list[tuple[int, str]] = []

    def current(self) -> list[str]:
        return [title for _, title in self.stack]

    def enter(self, level: int, title: str) -> list[str]:
        """Opens a heading and gives the path above it."""
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        above = self.current()
        self.stack.append((level, title))
        return above


# The stored form


def _inline_out(node: dict):
    kind = node["kind"]
    if kind == "text":
        return {"Text": node["text"]}
    if kind == "code":
        return {"Code": node["text"]}
    if kind == "break":
        return "LineBreak"
    if kind == "styled":
        return {"Styled": {"style": node["style"], "children": [_inline_out(c) for c in node["children"]]}}
    if kind == "link":
        return {"Link": {"url": node["url"], "children": [_inline_out(c) for c in node["children"]]}}
    return {"Image": {"url": node["url"], "alt": node["alt"]}}


def _inline_in(node) -> dict:
    if node == "LineBreak":
        return dict(LINE_BREAK)
    (name, value), = node.items()
    if name in ("Text", "Code"):
        return {"kind": name.lower(), "text": value}
    if name == "Styled":
        return styled(value["style"], [_inline_in(c) for c in value["children"]])
    if name == "Link":
        return link(value["url"], [_inline_in(c) for c in value["children"]])
    if name == "Image":
        return image(value["url"], value.get("alt") or "")
    raise ParseError(f"unknown inline {name}")


def block_out(node: dict, document_id: str) -> dict:
    kind, payload = node["kind"], {}
    if "content" in node:
        payload["content"] = [_inline_out(i) for i in node["content"]]
    if kind == "heading":
        payload = {"level": node["level"]} | payload
    elif kind == "code_block":
        payload = {"language": node["language"], "content": node["code"]}
    elif kind == "list":
        payload = {"ordered": node["ordered"], "items": [{"content": [block_out(b, document_id) for b in item]} for item in node["items"]]}
    elif kind == "block_quote":
        payload = {"children": [block_out(b, document_id) for b in node["children"]]}
    elif kind == "table":
        payload = {"headers": [[_inline_out(i) for i in c] for c in node["headers"]], "rows": [[[_inline_out(i) for i in c] for c in r] for r in node["rows"]]}
    elif kind == "generic":
        payload |= {"hint": node["hint"], "confidence": node["confidence"]}
    span = node["range"] and {"start": node["range"][0], "end": node["range"][1]}
    return {
        "block": BLOCK_NAMES[kind] if kind == "thematic_break" else {BLOCK_NAMES[kind]: payload},
        "prov": {"document_id": document_id, "section_path": node["path"], "byte_range": span},
    }


def block_in(node: dict) -> dict:
    body, prov = node["block"], node.get("prov") or {}
    name, value = (body, {}) if isinstance(body, str) else next(iter(body.items()))
    if name not in KINDS:
        raise ParseError(f"unknown block {name}")
    span = prov.get("byte_range")
    out = block(KINDS[name], prov.get("section_path") or [], (span["start"], span["end"]) if span else None)
    kind = out["kind"]
    if kind in ("heading", "paragraph", "generic"):
        out["content"] = [_inline_in(i) for i in value["content"]]
    if kind == "heading":
        out["level"] = value["level"]
    elif kind == "code_block":
        out |= {"language": value.get("language"), "code": value["content"]}
    elif kind == "list":
        out |= {"ordered": value["ordered"], "items": [[block_in(b) for b in item["content"]] for item in value["items"]]}
    elif kind == "block_quote":
        out["children"] = [block_in(b) for b in value["children"]]
    elif kind == "table":
        out |= {"headers": [[_inline_in(i) for i in c] for c in value["headers"]], "rows": [[[_inline_in(i) for i in c] for c in r] for r in value["rows"]]}
    elif kind == "generic":
        out |= {"hint": value.get("hint"), "confidence": value.get("confidence")}
    return out


def loads(source: str) -> dict:
    """{title, format, frontmatter, body, diagnostics, ...} of a stored tree. ParseError if it isn't one."""
    try:
        data = json.loads(source)
        meta = data.get("meta") or {}
        return {
            "title": meta.get("title"),
            "format": meta.get("format"),
            "frontmatter": (meta.get("frontmatter") or {}).get("yaml") if meta.get("frontmatter") else None,
            "document_id": meta.get("id"),
            "body": [block_in(b) for b in data["body"]],
            "diagnostics": [
                diagnostic(d["kind"], d["message"], (d["byte_range"]["start"], d["byte_range"]["end"]) if d.get("byte_range") else None)
                for d in data.get("diagnostics") or []
            ],
        }
    except (ValueError, KeyError, TypeError, AttributeError, StopIteration) as e:
        raise ParseError(f"stored document: {e}") from None


def dumps(document: dict, meta: dict) -> str:
    body = [block_out(b, meta.get("id", "")) for b in document["body"]]
    notes = [{"kind": d["kind"], "message": d["message"], "byte_range": d["range"] and {"start": d["range"][0], "end": d["range"][1]}} for d in document["diagnostics"]]
    return json.dumps({"meta": meta, "body": body, "diagnostics": notes}, ensure_ascii=False)
