"""Trees as flat arrays for Spark: nodes in document order that name their parents, and their inlines."""

from __future__ import annotations

from pyspark.sql import types as T

from marlstone.ir import tree

S, I, L, B, F_ = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.FloatType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


NODE = _struct(
    node_id=I, parent_id=I, ord=I, depth=I, kind=S, level=I, ordered=B, language=S, code=S, hint=S, confidence=F_,
    n_rows=I, n_cols=I, section_path=T.ArrayType(S), byte_start=L, byte_end=L,
)
INLINE = _struct(inline_id=I, node_id=I, row_idx=I, col_idx=I, parent_inline=I, ord=I, kind=S, style=S, text=S, url=S, alt=S)
DIAGNOSTIC = _struct(kind=S, message=S, byte_start=L, byte_end=L)
DOCUMENT = _struct(
    title=S, format=S, frontmatter=S, nodes=T.ArrayType(NODE), inlines=T.ArrayType(INLINE), diagnostics=T.ArrayType(DIAGNOSTIC)
)


def flatten(document: dict) -> dict:
    """nodes, inlines and diagnostics as lists of dicts in the shape of the schema above."""
    nodes: list[dict] = []
    inlines: list[dict] = []

    def span(r):
        return {"byte_start": r[0] if r else None, "byte_end": r[1] if r else None}

    def put_inlines(items: list, node_id: int, row, col, parent) -> None:
        for i, n in enumerate(items):
            at = len(inlines)
            inlines.append(
                {"inline_id": at, "node_id": node_id, "row_idx": row, "col_idx": col, "parent_inline": parent, "ord": i, "kind": n["kind"]}
                | {k: n.get(k) for k in ("style", "text", "url", "alt")}
            )
            if "children" in n:
                put_inlines(n["children"], node_id, row, col, at)

    def put(node: dict, parent: int | None, ord_: int, depth: int) -> None:
        at = len(nodes)
        made = dict.fromkeys(NODE.names) | {k: node.get(k) for k in ("kind", "level", "ordered", "language", "code", "hint", "confidence")}
        made |= {"node_id": at, "parent_id": parent, "ord": ord_, "depth": depth, "section_path": node.get("path"), **span(node.get("range"))}
        nodes.append(made)
        if "content" in node:
            put_inlines(node["content"], at, None, None, None)
        if node["kind"] == "table":
            made |= {"n_rows": len(node["rows"]), "n_cols": len(node["headers"])}
            for r, row in enumerate([node["headers"], *node["rows"]], -1):
                for c, content in enumerate(row):
                    put_inlines(content, at, r, c, None)
        for i, part in enumerate(node.get("items", ())):
            item = len(nodes)
            nodes.append(dict.fromkeys(NODE.names) | {"node_id": item, "parent_id": at, "ord": i, "depth": depth + 1, "kind": "list_item", "section_path": node["path"]})
            for j, b in enumerate(part):
                put(b, item, j, depth + 2)
        for j, b in enumerate(node.get("children", ()) if node["kind"] == "block_quote" else ()):
            put(b, at, j, depth + 1)

    for i, b in enumerate(document["body"]):
        put(b, None, i, 0)
    notes = [{"kind": d["kind"], "message": d["message"], **span(d["range"])} for d in document["diagnostics"]]
    return {"title": document["title"], "format": document["format"], "frontmatter": document["frontmatter"], "nodes": nodes, "inlines": inlines, "diagnostics": notes}


def build(document) -> dict:
    """The tree of a flattened document: the inverse of `flatten`."""
    get = (lambda x, k: x[k]) if isinstance(document, dict) else (lambda x, k: x[k])
    inner: dict = {}
    made_inline: dict[int, dict] = {}
    for n in document["inlines"]:
        kind = get(n, "kind")
        one = {"kind": kind}
        if kind in ("text", "code"):
            one["text"] = get(n, "text")
        elif kind == "styled":
            one |= {"style": get(n, "style"), "children": []}
        elif kind == "link":
            one |= {"url": get(n, "url"), "children": []}
        elif kind == "image":
            one |= {"url": get(n, "url"), "alt": get(n, "alt") or ""}
        made_inline[get(n, "inline_id")] = one
        parent = get(n, "parent_inline")
        if parent is None:
            inner.setdefault((get(n, "node_id"), get(n, "row_idx"), get(n, "col_idx")), []).append(one)
        else:
            made_inline[parent]["children"].append(one)
    body: list[dict] = []
    made: dict[int, dict | list] = {}
    for n in document["nodes"]:
        at, kind, parent = get(n, "node_id"), get(n, "kind"), get(n, "parent_id")
        if kind == "list_item":
            made[at] = []
            made[parent]["items"].append(made[at])
            continue
        start = get(n, "byte_start")
        one = tree.block(kind, list(get(n, "section_path") or []), None if start is None else (start, get(n, "byte_end")))
        if kind in ("heading", "paragraph", "generic"):
            one["content"] = inner.get((at, None, None), [])
        if kind == "heading":
            one["level"] = get(n, "level")
        elif kind == "generic":
            one |= {"hint": get(n, "hint"), "confidence": get(n, "confidence")}
        elif kind == "code_block":
            one |= {"language": get(n, "language"), "code": get(n, "code")}
        elif kind == "list":
            one |= {"ordered": get(n, "ordered"), "items": []}
        elif kind == "block_quote":
            one["children"] = []
        elif kind == "table":
            cells = range(get(n, "n_cols"))
            one["headers"] = [inner.get((at, -1, c), []) for c in cells]
            one["rows"] = [[inner.get((at, r, c), []) for c in cells] for r in range(get(n, "n_rows"))]
        made[at] = one
        if parent is None:
            body.append(one)
        elif isinstance(made[parent], list):
            made[parent].append(one)
        else:
            made[parent]["children"].append(one)
    notes = [tree.diagnostic(get(d, "kind"), get(d, "message"), None if get(d, "byte_start") is None else (get(d, "byte_start"), get(d, "byte_end"))) for d in document["diagnostics"]]
    return {"title": document["title"], "format": document["format"], "frontmatter": document["frontmatter"], "body": body, "diagnostics": notes}
