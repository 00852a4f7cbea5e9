"""Trees as an HTML fragment."""

from __future__ import annotations

TAGS = {"Strong": "strong", "Emphasis": "em", "Strikethrough": "del"}


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def attribute(text: str) -> str:
    return escape(text).replace('"', "&quot;")


def within(tag: str, inner: str, attrs: str = "") -> str:
    return f"<{tag}{attrs}>{inner}</{tag}>"


def inlines(nodes: list) -> str:
    out = []
    for node in nodes:
        kind = node["kind"]
        if kind == "text":
            out.append(escape(node["text"]))
        elif kind == "code":
            out.append(within("code", escape(node["text"])))
        elif kind == "break":
            out.append("<br>")
        elif kind == "styled":
            out.append(within(TAGS[node["style"]], inlines(node["children"])))
        elif kind == "link":
            out.append(within("a", inlines(node["children"]), f' href="{attribute(node["url"])}"'))
        else:
            out.append(f'<img src="{attribute(node["url"])}" alt="{attribute(node["alt"])}">')
    return "".join(out)


def one(node: dict) -> str:
    kind = node["kind"]
    if kind == "heading":
        return within(f"h{min(6, max(1, node['level']))}", inlines(node["content"]))
    if kind == "paragraph":
        return within("p", inlines(node["content"]))
    if kind == "generic":
        return within("div", inlines(node["content"]), ' class="generic-block"')
    if kind == "code_block":
        language = f' class="language-{attribute(node["language"])}"' if node["language"] else ""
        return within("pre", within("code", escape(node["code"]), language))
    if kind == "list":
        return within("ol" if node["ordered"] else "ul", "".join(within("li", item(i)) for i in node["items"]))
    if kind == "block_quote":
        return within("blockquote", blocks(node["children"]))
    if kind == "table":
        head = within("thead", within("tr", "".join(within("th", inlines(c)) for c in node["headers"]))) if node["headers"] else ""
        rows = "".join(within("tr", "".join(within("td", inlines(c)) for c in r)) for r in node["rows"])
        return within("table", head + within("tbody", rows))
    return "<hr>"


def item(content: list[dict]) -> str:
    """A single paragraph stands without its tag."""
    return inlines(content[0]["content"]) if len(content) == 1 and content[0]["kind"] == "paragraph" else blocks(content)


def blocks(nodes: list[dict]) -> str:
    return "\n".join(map(one, nodes))


def emit(document: dict) -> str:
    return blocks(document["body"])
