"""Validation, normalization and structural comparison of trees."""

from __future__ import annotations

from marlstone.ir import tree


def _inline_fault(inlines: list) -> str | None:
    todo = list(reversed(inlines))
    while todo:
        node = todo.pop()
        if node["kind"] == "link" and not node["url"]:
            return "link with empty url"
        if node["kind"] == "image" and not node["url"]:
            return "image with empty url"
        todo.extend(reversed(node.get("children", [])))
    return None


def fault(blocks: list[dict], source_length: int | None = None) -> str | None:
    """The first violation in depth-first order, or None."""
    for node in blocks:
        span = node["range"]
        if span and span[0] > span[1]:
            return f"inverted byte range {span[0]}..{span[1]}"
        if span and source_length is not None and span[1] > source_length:
            return f"byte range {span[0]}..{span[1]} exceeds source length {source_length}"
        kind = node["kind"]
        if kind == "heading" and not 1 <= node["level"] <= 6:
            return f"heading level {node['level']} out of range"
        if kind == "generic" and not (node["confidence"] is not None and 0 <= node["confidence"] <= 1):
            return f"confidence {node['confidence']} out of range"
        if kind == "list" and not node["items"]:
            return "empty list"
        if kind == "table":
            if node["rows"] and not node["headers"]:
                return "table rows without header"
            for row in node["rows"]:
                if len(row) != len(node["headers"]):
                    return f"table row width {len(row)} differs from header width {len(node['headers'])}"
        for inlines in tree.inline_lists(node):
            if found := _inline_fault(inlines):
                return found
        for below in tree.children(node):
            if found := fault(below, source_length):
                return found
    return None


def merged(inlines: list) -> list:
    """Without empty texts, neighbouring texts joined, at every depth."""
    out: list[dict] = []
    for node in inlines:
        if "children" in node:
            node = node | {"children": merged(node["children"])}
        if node["kind"] == "text":
            if not node["text"]:
                continue
            if out and out[-1]["kind"] == "text":
                out[-1] = tree.text(out[-1]["text"] + node["text"])
                continue
        out.append(node)
    return out


def normalized(blocks: list[dict]) -> list[dict]:
    """The same blocks with merged inlines. Doing it twice changes nothing."""
    out = []
    for node in blocks:
        node = dict(node)
        if "content" in node:
            node["content"] = merged(node["content"])
        if node["kind"] == "table":
            node["headers"] = [merged(c) for c in node["headers"]]
            node["rows"] = [[merged(c) for c in r] for r in node["rows"]]
        if node["kind"] == "list":
            node["items"] = [normalized(i) for i in node["items"]]
        if node["kind"] == "block_quote":
            node["children"] = normalized(node["children"])
        out.append(node)
    return out


_COMPARED = {
    "heading": ("level", "content"),
    "paragraph": ("content",),
    "code_block": ("language", "code"),
    "list": ("ordered",),
    "block_quote": (),
    "table": ("headers", "rows"),
    "generic": ("hint", "content"),
    "thematic_break": (),
}


def difference(a: list[dict], b: list[dict], at: str = "body") -> str | None:
    """Where two bodies first differ in structure. Paths, ranges and confidence don't count."""
    for i, (x, y) in enumerate(zip(a, b)):
        here = f"{at}[{i}]"
        if x["kind"] != y["kind"]:
            return f"{here}: {x['kind']} vs {y['kind']}"
        for name in _COMPARED[x["kind"]]:
            if x[name] != y[name]:
                return f"{here}.{name}: {x[name]!r} vs {y[name]!r}"
        if x["kind"] == "list":
            if len(x["items"]) != len(y["items"]):
                return f"{here}: {len(x['items'])} vs {len(y['items'])} items"
            for j, (p, q) in enumerate(zip(x["items"], y["items"])):
                if found := difference(p, q, f"{here}.items[{j}]"):
                    return found
        elif x["kind"] == "block_quote" and (found := difference(x["children"], y["children"], f"{here}.children")):
            return found
    return f"{at}: {len(a)} vs {len(b)} blocks" if len(a) != len(b) else None


def document_difference(a: dict, b: dict) -> str | None:
    for name in ("title", "format", "frontmatter"):
        if a.get(name) != b.get(name):
            return f"{name}: {a.get(name)!r} vs {b.get(name)!r}"
    return difference(a["body"], b["body"])
