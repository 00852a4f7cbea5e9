"""Repairs of Markdown input before it is parsed, and of paragraphs after."""

from __future__ import annotations

import re

from marlstone.ir import tree
from marlstone.parsers.offsets import OffsetMap

#: Formulas are kept from the parser behind characters of a private plane: one for each, or as many as their number needs.
SHIELD = 0xF0000
SHIELDS = 0xFFFD
RESERVED = "¤"
_shields = re.compile("[\U000f0000-\U000ffffd]")
#: A formula, a mark that opens none, or an escape, whichever is next.
_formula = re.compile(r"\\\[(?P<display>(?:\\[^\]]|[^\\])*?)\\\]|\$(?P<inline>(?:\\.|[^\\$])*)\$|(?P<open>\$|\\\[)|\\.", re.S)
#: A repeated first heading counts from so many bytes on, and past a third of the input.
REPEAT_GAP = 128

_fenced = re.compile(r"\A---\r*\n(.*?)^---\r*(?:\n|\Z)", re.S | re.M)
_pair = re.compile(r"[ \t]*[A-Za-z0-9_-]+:")


def is_escaped_stream(text: str) -> bool:
    text = text.rstrip("\r\n")
    return "\n" not in text and "\\n" in text


def frontmatter(text: str) -> tuple[str | None, int, bool]:
    """(header, characters it takes, whether it was inferred from two or more leading `key: value` lines)."""
    if m := _fenced.match(text):
        return m.group(1).replace("\r\n", "\n"), m.end(), False
    if text.startswith("---"):
        return None, 0, False
    at = count = 0
    for line in text.splitlines(keepends=True):
        if not line.strip() or not _pair.match(line):
            break
        at += len(line)
        count += 1
    return (text[:at].replace("\r\n", "\n"), at, True) if count >= 2 else (None, 0, False)


def repeated_segment(text: str, begin: int, header: str | None) -> tuple[int, str] | None:
    """(character where the first heading stands again, signature of the segment)."""
    first, at, size = None, begin, len(text[:begin].encode())
    for line in text[begin:].split("\n"):
        if first is None and line.strip().startswith("#"):
            first = line.strip(), size
        elif first and line == first[0] and size - 1 - first[1] >= REPEAT_GAP and at + len(line) < len(text):
            break
        at += len(line) + 1
        size += len(line.encode()) + 1
    else:
        return None
    if size < len(text.encode()) // 3:
        return None
    names = [x.partition(":")[0].strip() for x in (header or "").split("\n") if ":" in x]
    return at, ",".join([f"fm:{n}" for n in [n for n in names if n][:4]] + [f"h:{first[0].lstrip('#').strip()}"])


def _shield(number: int, width: int) -> str:
    """The characters that stand for a formula, all of one width in a text."""
    out = ""
    for _ in range(width):
        number, digit = divmod(number, SHIELDS)
        out = chr(SHIELD + digit) + out
    return out


def _width(payloads: list[str]) -> int:
    return 1 if len(payloads) <= SHIELDS else 2


def shield(text: str, base: int) -> tuple[str, list[str], list[dict], OffsetMap]:
    """(text with formulas shielded, formulas, diagnostics in its bytes, map back to the bytes before). `base` is added to all."""
    edits = OffsetMap()
    if RESERVED in text or _shields.search(text):
        # Fixed value: a text that users see.
        note = "input contains the reserved math-shielding sentinel U+00A4; math shielding disabled for this document"
        return text, [], [tree.diagnostic("Unsupported", note)], edits
    pieces: list[tuple[str, str]] = []  # (plain, text), (formula, text) or (note, text it is about)
    at = copied = 0
    while m := _formula.search(text, at):
        kind, stop, what = m.lastgroup, m.end(), None
        if kind == "display":
            what = "formula"
            if "\n\n" in m.group():
                kind, stop = "open", m.start() + 2
        if kind == "inline":
            what = "formula" if m.group(kind) and "\n" not in m.group(kind) else "a '$…$' that is empty or spans lines is kept as text"
        elif kind == "open":
            what = f"unmatched '{text[m.start() : stop]}' is kept as text"
        if what:
            pieces += [("plain", text[copied : m.start()]), (what, text[m.start() : stop])]
            copied = stop
        at = stop
    pieces.append(("plain", text[copied:]))
    payloads = [t for what, t in pieces if what == "formula"]
    width, out, notes, size, number = _width(payloads), [], [], base, 0
    for what, t in pieces:
        length = len(t.encode())
        if what == "formula":
            t = _shield(number, width)
            number += 1
            edits.edit(size, 4 * width, length)
            length = 4 * width
        elif what != "plain":
            notes.append(tree.diagnostic("Normalized", what, (size, size + length)))
        out.append(t)
        size += length
    return "".join(out), payloads, notes, edits


def unshield(text: str, payloads: list[str]) -> str:
    if not payloads or not _shields.search(text):
        return text
    if _width(payloads) == 1:
        return _shields.sub(lambda m: payloads[ord(m.group()) - SHIELD], text)
    pair = re.compile(f"({_shields.pattern})({_shields.pattern})")
    return pair.sub(lambda m: payloads[(ord(m.group(1)) - SHIELD) * SHIELDS + ord(m.group(2)) - SHIELD], text)


def tabbed(source: str) -> tuple[str, object, object] | None:
    """("table", headers, rows) or ("generic", text, None) of a paragraph of tab-separated lines."""
    text = source.strip().replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    cells = [line.split("\t") for line in lines]
    widths = [len(c) for c in cells]
    if len(lines) < 2 or sum(w > 1 for w in widths) < 2:
        return None
    if min(widths) == max(widths):
        rows = [[[tree.text(c.strip())] for c in row] for row in cells]
        return "table", rows[0], rows[1:]
    return "generic", text, None


_callout = re.compile(r"\[![A-Za-z0-9-]+\]")


def callout(source: str) -> str | None:
    """The text of a bare callout, its lines without blanks at their ends."""
    text = source.strip().replace("\r\n", "\n").replace("\r", "\n")
    return "\n".join(x.rstrip() for x in text.split("\n")) if _callout.match(text) else None
