"""Trees as canonical Markdown: blocks apart by one blank line, `-` and `N.` items, `---` rules."""

from __future__ import annotations

import re

from marlstone.emitters.text import lines

MATHS = re.compile(r"[\\=^{}]")
MARKS = {"Emphasis": "*", "Strong": "**", "Strikethrough": "~~"}
#: Spans that stay as they are, bracketed formulas without their backslashes, and characters to escape.
_literal = re.compile(r"(?P<kept>\[\[.*?\]\]|\[!.*?\]|\$[^$]*\$|\\\[.*?\\\])|\[(?P<maths>[^\]]*[\\=^{}][^\]]*)\]|(?P<escaped>[\\`*_~])", re.S)


def escape(text: str) -> str:
    def change(m: re.Match) -> str:
        if m.group("kept") is not None:
            return m.group()
        return f"\\[{m.group('maths')}\\]" if m.group("maths") is not None else "\\" + m.group()

    return _literal.sub(change, text)


def code_span(text: str) -> str:
    ticks = "`" * (max((len(r) for r in re.findall("`+", text)), default=0) + 1)
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{ticks}{pad}{text}{pad}{ticks}"


def bracketed(nodes: list, at: int) -> tuple[int, str] | None:
    """A formula whose brackets are texts of their own: (position after it, its Markdown)."""
    if nodes[at]["kind"] != "text" or nodes[at]["text"].strip() != "[":
        return None
    inner = ""
    for i in range(at + 1, len(nodes)):
        node = nodes[i]
        if node["kind"] == "break":
            inner += "\n"
        elif node["kind"] != "text":
            return None
        elif node["text"].strip() == "]":
            inner = inner.strip()
            return (i + 1, f"\\[ {inner} \\]") if MATHS.search(inner) else None
        else:
            inner += node["text"]
    return None


def inlines(nodes: list) -> str:
    out, i = [], 0
    while i < len(nodes):
        if found := bracketed(nodes, i):
            i = found[0]
            out.append(found[1])
            continue
        node = nodes[i]
        kind = node["kind"]
        if kind == "text":
            out.append(escape(node["text"]))
        elif kind == "code":
            out.append(code_span(node["text"]))
        elif kind == "break":
            out.append("  \n")
        elif kind == "styled":
            mark = MARKS[node["style"]]
            out.append(mark + inlines(node["children"]) + mark)
        elif kind == "link":
            out.append(f"[{inlines(node['children'])}]({node['url']})")
        else:
            out.append(f"![{escape(node['alt'])}]({node['url']})")
        i += 1
    return "".join(out)


def display(nodes: list) -> str | None:
    """A paragraph that is one display formula, as it is written."""
    if any(n["kind"] not in ("text", "break") for n in nodes):
        return None
    flat = "".join("\n" if n["kind"] == "break" else n["text"] for n in nodes).strip()
    inner = flat[2:-2] if len(flat) > 4 and flat.startswith("\\[") and flat.endswith("\\]") else ""
    return f"\\[{inner}\\]" if MATHS.search(inner) else None


def cell(nodes: list) -> str:
    return inlines(nodes).replace("|", "\\|").replace("\n", " ")


def one(node: dict) -> str:
    kind = node["kind"]
    if kind == "heading":
        return "#" * min(6, max(1, node["level"])) + " " + inlines(node["content"])
    if kind == "paragraph":
        return display(node["content"]) or inlines(node["content"])
    if kind == "generic":
        return inlines(node["content"])
    if kind == "code_block":
        # A fence longer than any in the code, so that the code comes back whole.
        longest = max((len(r) for r in re.findall(r"^ {0,3}(`{3,})", node["code"], re.M)), default=2)
        fence = "`" * (longest + 1)
        return "\n".join([fence + (node["language"] or ""), *([node["code"]] if node["code"] else []), fence])
    if kind == "list":
        out = []
        for i, content in enumerate(node["items"], 1):
            mark = f"{i}. " if node["ordered"] else "- "
            first, *rest = lines(blocks(content)) or [""]
            out.append("\n".join([(mark + first).rstrip() if not first else mark + first, *(" " * len(mark) + x if x else "" for x in rest)]))
        return "\n".join(out)
    if kind == "block_quote":
        return "\n".join(f"> {x}" if x else ">" for x in lines(blocks(node["children"])))
    if kind == "table":
        rows = [[cell(c) for c in r] for r in [node["headers"], *node["rows"]]]
        rows.insert(1, ["---"] * len(rows[0]))
        return "\n".join("| " + " | ".join(r) + " |" for r in rows)
    return "---"


def blocks(nodes: list[dict]) -> str:
    return "\n\n".join(map(one, nodes))


def emit(document: dict) -> str:
    header = document.get("frontmatter")
    front = "" if header is None else "---\n" + "".join(x.rstrip() + "\n" for x in header.rstrip("\n").split("\n")) + "---\n"
    return front + ("\n" if front and document["body"] else "") + blocks(document["body"])
