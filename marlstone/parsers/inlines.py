"""Inline Markdown: code spans, emphasis, strikethrough, links, images, autolinks, escapes, breaks.

Follows the published CommonMark algorithm: brackets and delimiter runs are put on stacks and resolved once their text is
read. Raw HTML is dropped and reported.
"""

from __future__ import annotations

import html
import re
import unicodedata

from marlstone.ir import tree

ESCAPABLE = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_entity = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
_auto = re.compile(r"<([A-Za-z][A-Za-z0-9.+-]{1,31}:[^\s<>]*)>|<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
_raw = re.compile(
    r"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?"
    r"|/[A-Za-z][A-Za-z0-9-]*\s*|!--(?!-?>)(?:[^-]|-(?!->))*--|\?.*?\?|![A-Z]+\s+[^>]*|!\[CDATA\[.*?\]\])>",
    re.S,
)
_special = re.compile(r"[\\`*_~\[\]!<&\n]")
_label = re.compile(r"\[((?:[^\\\[\]]|\\.){0,999})\]", re.S)


def normal_label(label: str) -> str:
    return " ".join(label.split()).casefold()


def _unescape(text: str) -> str:
    text = re.sub(r"\\([!-/:-@\[-`{-~])|" + _entity.pattern, lambda m: m.group(1) or html.unescape(m.group()), text)
    return text


def destination(text: str, at: int) -> tuple[str, int] | None:
    """(address, position after it) of a link destination."""
    if at < len(text) and text[at] == "<":
        m = re.compile(r"<((?:[^<>\\\n]|\\.)*)>").match(text, at)
        return (_unescape(m.group(1)), m.end()) if m else None
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in ESCAPABLE:
            i += 2
            continue
        if c <= " " or c == "\x7f":
            break
        if c == "(":
            depth += 1
        elif c == ")":
            if not depth:
                break
            depth -= 1
        i += 1
    return None if depth else (_unescape(text[at:i]), i)


_title = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)", re.S)
_space = re.compile(r"[ \t]*\n?[ \t]*")


def link_tail(text: str, at: int) -> tuple[str, int] | None:
    """The part of an inline link after its text: (address, position after)."""
    if at >= len(text) or text[at] != "(":
        return None
    i = _space.match(text, at + 1).end()
    found = destination(text, i)
    if found is None:
        return None
    url, i = found
    j = _space.match(text, i).end()
    if j > i and (m := _title.match(text, j)):
        j = _space.match(text, m.end()).end()
    return (url, j + 1) if j < len(text) and text[j] == ")" else None


def _punctuation(c: str) -> bool:
    return c in ESCAPABLE or unicodedata.category(c)[0] in "PS"


class _Run:
    __slots__ = ("char", "count", "opens", "closes", "at", "length")

    def __init__(self, char, count, opens, closes, at):
        self.char, self.count, self.opens, self.closes, self.at, self.length = char, count, opens, closes, at, count


def parse(text: str, references: dict[str, str], quoted: bool = False, notes: list | None = None, where=lambda i: i) -> list[dict]:
    """Inlines of a text. Soft breaks are spaces, newlines inside quotes. `where` maps positions to ranges of notes."""
    nodes: list = []  # dicts, or _Run markers
    brackets: list[list] = []  # [index in nodes, is image, position after it, active]
    i, size = 0, len(text)

    def put(s: str) -> None:
        if s:
            nodes.append(tree.text(s))

    while i < size:
        m = _special.search(text, i)
        if m is None:
            put(text[i:])
            break
        if m.start() > i:
            put(text[i : m.start()])
            i = m.start()
        c = text[i]
        if c == "\\":
            if i + 1 < size and text[i + 1] in ESCAPABLE:
                # Escaped brackets stay as they are: they are how display formulas are written.
                put(text[i : i + 2] if text[i + 1] in "[]" else text[i + 1])
                i += 2
            elif i + 1 < size and text[i + 1] == "\n":
                nodes.append(dict(tree.LINE_BREAK))
                i += 2
                while i < size and text[i] == " ":
                    i += 1
            else:
                put("\\")
                i += 1
        elif c == "`":
            j = i
            while j < size and text[j] == "`":
                j += 1
            ticks = text[i:j]
            close = re.compile(rf"(?<!`){ticks}(?!`)").search(text, j)
            if close:
                inner = text[j : close.start()].replace("\n", " ")
                if len(inner) > 2 and inner[0] == inner[-1] == " " and inner.strip():
                    inner = inner[1:-1]
                nodes.append(tree.code(inner))
                i = close.end()
            else:
                put(ticks)
                i = j
        elif c == "\n":
            if nodes and nodes[-1] and isinstance(nodes[-1], dict) and nodes[-1]["kind"] == "text" and nodes[-1]["text"].endswith("  "):
                nodes[-1] = tree.text(nodes[-1]["text"].rstrip(" "))
                nodes.append(dict(tree.LINE_BREAK))
            else:
                if nodes and isinstance(nodes[-1], dict) and nodes[-1]["kind"] == "text":
                    nodes[-1] = tree.text(nodes[-1]["text"].rstrip(" "))
                put("\n" if quoted else " ")
            i += 1
            while i < size and text[i] == " ":
                i += 1
        elif c == "&":
            m = _entity.match(text, i)
            decoded = html.unescape(m.group()) if m else None
            if m and decoded != m.group():
                put(decoded)
                i = m.end()
            else:
                put("&")
                i += 1
        elif c == "<":
            if m := _auto.match(text, i):
                url = m.group(1) or f"mailto:{m.group(2)}"
                nodes.append(tree.link(url, [tree.text(m.group(1) or m.group(2))]))
                i = m.end()
            elif m := _raw.match(text, i):
                if notes is not None:
                    notes.append((where(i), where(m.end())))
                i = m.end()
            else:
                put("<")
                i += 1
        elif c == "!" and i + 1 < size and text[i + 1] == "[":
            brackets.append([len(nodes), True, i + 2, True])
            put("![")
            i += 2
        elif c == "[":
            brackets.append([len(nodes), False, i + 1, True])
            put("[")
            i += 1
        elif c == "]":
            if not brackets:
                put("]")
                i += 1
                continue
            at, is_image, begin, active = brackets.pop()
            found = None
            if active:
                found = link_tail(text, i + 1)
                if found is None:
                    m = _label.match(text, i + 1)
                    label = m.group(1) if m and m.group(1).strip() else text[begin:i]
                    url = references.get(normal_label(label))
                    if url is not None:
                        found = (url, m.end() if m else i + 1)
                    elif m and m.group(1).strip() == "" or m is None:
                        url = references.get(normal_label(text[begin:i]))
                        if url is not None:
                            found = (url, m.end() if m else i + 1)
            if found is None:
                put("]")
                i += 1
                continue
            inner = _emphasis(nodes[at + 1 :])
            del nodes[at:]
            if is_image:
                nodes.append(tree.image(found[0], tree.plain(inner)))
            else:
                nodes.append(tree.link(found[0], inner))
                for b in brackets:
                    if not b[1]:
                        b[3] = False
            i = found[1]
        elif c in "*_~":
            j = i
            while j < size and text[j] == c:
                j += 1
            before, after = text[i - 1] if i else " ", text[j] if j < size else " "
            left = not after.isspace() and (not _punctuation(after) or before.isspace() or _punctuation(before))
            right = not before.isspace() and (not _punctuation(before) or after.isspace() or _punctuation(after))
            if c == "_":
                opens, closes = left and (not right or _punctuation(before)), right and (not left or _punctuation(after))
            else:
                opens, closes = left, right
            if c == "~" and j - i > 2:
                opens = closes = False
            if opens or closes:
                nodes.append(_Run(c, j - i, opens, closes, i))
            else:
                put(text[i:j])
            i = j
        else:
            put(c)
            i += 1
    return _emphasis(nodes)


def _emphasis(nodes: list) -> list[dict]:
    """Resolves delimiter runs; what opens or closes nothing is text."""
    nodes = list(nodes)
    i = 0
    while i < len(nodes):
        closer = nodes[i]
        if not isinstance(closer, _Run) or not closer.closes or not closer.count:
            i += 1
            continue
        j = i - 1
        while j >= 0:
            opener = nodes[j]
            if isinstance(opener, _Run) and opener.char == closer.char and opener.opens and opener.count:
                if closer.char == "~":
                    if opener.count == closer.count:
                        break
                elif not ((opener.closes or closer.opens) and (opener.length + closer.length) % 3 == 0 and not (opener.length % 3 == 0 and closer.length % 3 == 0)):
                    break
            j -= 1
        if j < 0:
            i += 1
            continue
        opener = nodes[j]
        used = closer.count if closer.char == "~" else 2 if opener.count >= 2 and closer.count >= 2 else 1
        style = "Strikethrough" if closer.char == "~" else "Strong" if used == 2 else "Emphasis"
        inner = [tree.text(n.char * n.count) if isinstance(n, _Run) else n for n in nodes[j + 1 : i]]
        inner = [n for n in inner if n["kind"] != "text" or n["text"]]
        opener.count -= used
        closer.count -= used
        nodes[j + 1 : i] = [tree.styled(style, inner)]
        i = j + 2
        if not opener.count:
            del nodes[j]
            i -= 1
        if not closer.count:
            del nodes[i]
    out = []
    for n in nodes:
        if isinstance(n, _Run):
            if n.count:
                out.append(tree.text(n.char * n.count))
        else:
            out.append(n)
    return out
