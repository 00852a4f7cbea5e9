"""Trees as plain text: headings in capitals, code indented by four, quotes behind `| `, links as `text (url)`."""

from __future__ import annotations


def inlines(nodes: list, one_line: bool = False) -> str:
    out = []
    for node in nodes:
        kind = node["kind"]
        if kind in ("text", "code"):
            out.append(node["text"])
        elif kind == "break":
            out.append(" " if one_line else "\n")
        elif kind == "styled":
            out.append(inlines(node["children"], one_line))
        elif kind == "link":
            shown = inlines(node["children"], True)
            out.append(f"{shown} ({node['url']})" if shown else f"({node['url']})")
        else:
            out.append(f"{node['alt']} (image: {node['url']})" if node["alt"] else f"(image: {node['url']})")
    return "".join(out)


def lines(text: str) -> list[str]:
    """As a reader of lines sees them: the newline at the end begins none."""
    out = text.split("\n")
    return out[:-1] if out[-1] == "" else out


def item(mark: str, content: list[dict]) -> str:
    first, *rest = lines(blocks(content)) or [""]
    return "\n".join([mark + first, *(" " * len(mark) + x if x else "" for x in rest)])


def one(node: dict) -> str:
    kind = node["kind"]
    if kind == "heading":
        return inlines(node["content"], True).upper()
    if kind in ("paragraph", "generic"):
        return inlines(node["content"])
    if kind == "code_block":
        return "\n".join("    " + x for x in lines(node["code"]))
    if kind == "list":
        return "\n".join(item(f"{i}. " if node["ordered"] else "- ", content) for i, content in enumerate(node["items"], 1))
    if kind == "block_quote":
        return "\n".join("| " + x if x else "|" for x in lines(blocks(node["children"])))
    if kind == "table":
        rows = ([node["headers"]] if node["headers"] else []) + node["rows"]
        return "\n".join(row(r) for r in rows)
    return "----"


def row(cells: list) -> str:
    return " | ".join(inlines(c, True) for c in cells)


def blocks(nodes: list[dict]) -> str:
    return "\n\n".join(t for t in map(one, nodes) if t)


def emit(document: dict) -> str:
    return blocks(document["body"])
