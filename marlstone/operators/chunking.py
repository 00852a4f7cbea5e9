"""Structural chunks of a tree under a token budget.

A run of blocks of one section is a chunk; code blocks and tables are chunks of their own. What exceeds the budget is cut
between blocks, then between sentences, then at tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from marlstone.emitters import text as text_emitter
from marlstone.functions.tokens import TOKENIZER, count_tokens, token_spans

VERSION = f"structural2+{TOKENIZER}"
DEFAULT_BUDGET = 512
PROSE, CODE, TABLE = "Prose", "Code", "Table"


def split_sentences(text: str) -> list[str]:
    """After `.`, `?` or `!` before white space or the end, and at line ends; trimmed, empty ones dropped."""
    out, begin = [], 0
    for i, c in enumerate(text):
        if c == "\n" or c in ".?!" and (i + 1 == len(text) or text[i + 1].isspace()):
            out.append(text[begin : i + 1].strip())
            begin = i + 1
    out.append(text[begin:].strip())
    return [s for s in out if s] or [text.strip()]


def windows(text: str, budget: int) -> list[str]:
    """Pieces of exactly `budget` tokens, the last maybe shorter; nothing between two tokens is lost."""
    spans = token_spans(text)
    if len(spans) <= budget:
        return [text]
    starts = [0] + [spans[i][0] for i in range(budget, len(spans), budget)] + [len(text)]
    return [text[a:b] for a, b in zip(starts, starts[1:])]


def pack(units: list[str], budget: int, joiner: str, presplit: Callable[[str], list[str]]) -> list[str]:
    """Units joined in order as long as the counts of their tokens add up to the budget. Blank units are dropped."""
    extra, out, size = count_tokens(joiner), [], 0
    for unit in units:
        for piece in [unit] if count_tokens(unit) <= budget else presplit(unit):
            if not piece.strip():
                continue
            n = count_tokens(piece)
            if out and size + extra + n <= budget:
                out[-1] += joiner + piece
                size += extra + n
            else:
                out.append(piece)
                size = n
    return out


def table_parts(node: dict, budget: int) -> list[str]:
    """Rows under their repeated header, as many as fit. A row that doesn't fit with the header is cut at tokens."""
    head = text_emitter.row(node["headers"])
    rows = [text_emitter.row(r) for r in node["rows"]]
    if not rows:
        return windows(head, budget)
    out: list[str] = []
    open_: str | None = None
    for row in rows:
        if open_ is not None and count_tokens(open_ + "\n" + row) <= budget:
            open_ += "\n" + row
            continue
        if open_ is not None:
            out.append(open_)
        open_ = f"{head}\n{row}"
        if count_tokens(open_) > budget:
            out += windows(open_, budget)
            open_ = None
    return out + ([open_] if open_ is not None else [])


def chunk(document: dict, budget: int = DEFAULT_BUDGET) -> list[dict]:
    """section_path, content, block_type, sequence_index from 0, token_count. Headings live in the paths only."""
    budget = max(1, budget)
    out: list[dict] = []

    def put(content: str, kind: str, path: list[str]) -> None:
        if content.strip():
            out.append({"section_path": path, "content": content, "block_type": kind, "sequence_index": len(out), "token_count": count_tokens(content)})

    def sentences(unit: str) -> list[str]:
        return pack(split_sentences(unit), budget, " ", lambda s: windows(s, budget))

    def flush() -> None:
        if prose:
            whole = text_emitter.blocks(prose)
            parts = [whole] if count_tokens(whole) <= budget else pack([text_emitter.one(b) for b in prose], budget, "\n\n", sentences)
            for part in parts:
                put(part, PROSE, prose[0]["path"])
            prose.clear()

    prose: list[dict] = []
    for node in document["body"]:
        if node["kind"] == "heading":
            flush()  # equal headings in a row stay sections of their own
            continue
        if prose and prose[0]["path"] != node["path"]:
            flush()
        if node["kind"] == "table":
            flush()
            for part in table_parts(node, budget):
                put(part, TABLE, node["path"])
        elif node["kind"] == "code_block":
            flush()
            for part in pack(node["code"].split("\n\n"), budget, "\n\n", lambda s: windows(s, budget)) if count_tokens(node["code"]) > budget else [node["code"]]:
                put(part, CODE, node["path"])
        else:
            prose.append(node)
    flush()
    return out
