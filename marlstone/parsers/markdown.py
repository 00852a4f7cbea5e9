"""Markdown to trees: CommonMark with tables and strikethrough, behind repairs of the input. Never fails."""

from __future__ import annotations

import re
from typing import NamedTuple

from marlstone.ir import tree
from marlstone.parsers import inlines, repairs
from marlstone.parsers.offsets import OffsetMap, decode_newlines

POLICY = "md1"
GENERIC_CONFIDENCE = 0.5


class Line(NamedTuple):
    text: str
    at: int  # byte at which it begins
    lazy: bool = False

    def cut(self, n: int) -> "Line":
        return Line(self.text[n:], self.at + len(self.text[:n].encode()))


_rule = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_atx = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_fence = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$")
_item = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
_quote = re.compile(r" {0,3}>[ \t]?")
_setext = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_html_start = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (
        re.compile(
            r" {0,3}</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt"
            r"|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav"
            r"|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$)",
            re.I,
        ),
        None,
    ),
]
_html_any = re.compile(r" {0,3}(?:" + inlines._raw.pattern + r")[ \t]*$", re.S)
_delimiter = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_reference = re.compile(r" {0,3}\[((?:[^\\\[\]]|\\.)+)\]:[ \t]*\n?[ \t]*", re.S)


def indent(text: str) -> int:
    n = 0
    for c in text:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def drop_indent(line: Line, width: int) -> Line:
    """Without so many columns of white space; what is left of a cut tab becomes spaces."""
    n = i = 0
    while i < len(line.text) and n < width and line.text[i] in " \t":
        n += 1 if line.text[i] == " " else 4 - n % 4
        i += 1
    rest = line.cut(i)
    return Line(" " * (n - width) + rest.text, rest.at) if n > width else rest


def cells(text: str) -> list[str]:
    text = text.strip()
    if text.startswith("|"):
        text = text[1:]
    out, cell, i = [], "", 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text) and text[i + 1] == "|":
            cell += "|"
            i += 2
            continue
        if text[i] == "|":
            out.append(cell)
            cell = ""
        else:
            cell += text[i]
        i += 1
    if cell.strip() or not text.endswith("|"):
        out.append(cell)
    return [c.strip() for c in out]


class Blocks:
    """The block phase. Blocks keep the source of their inlines as `raw` until all references are known."""

    def __init__(self):
        self.references: dict[str, str] = {}
        self.skipped: list[tuple[int, int]] = []

    def starts_block(self, line: Line, in_list: bool = False) -> bool:
        """Whether the line ends a paragraph before it."""
        t = line.text
        if indent(t) > 3:
            return False
        if _rule.match(t) or _atx.match(t) or _quote.match(t) or ((m := _fence.match(t)) and not (m.group(2)[0] == "`" and "`" in m.group(3))):
            return True
        if m := _item.match(t):
            return bool(t[m.end() :].strip()) and (not m.group(2)[0].isdigit() or m.group(2)[:-1] == "1" or in_list)
        return any(start.match(t) for start, _ in _html_start)

    def read(self, lines: list[Line], quoted: bool = False) -> list[dict]:
        out, i = [], 0
        while i < len(lines):
            line = lines[i]
            t = line.text
            if not t.strip():
                i += 1
            elif indent(t) >= 4:
                i = self.indented(lines, i, out)
            elif (m := _fence.match(t)) and not (m.group(2)[0] == "`" and "`" in m.group(3)):
                i = self.fenced(lines, i, out, m)
            elif m := _atx.match(t):
                out.append(tree.block("heading", (), (line.at + len(t) - len(t.lstrip()), line.at + len(t.encode())), level=len(m.group(1)), raw=m.group(2) or "", raw_at=line.at + m.start(2) if m.group(2) else line.at))
                i += 1
            elif _rule.match(t):
                out.append(tree.block("thematic_break", (), (line.at, line.at + len(t.encode()))))
                i += 1
            elif _quote.match(t):
                i = self.quote(lines, i, out)
            elif _item.match(t):
                i = self.list(lines, i, out)
            elif (end := self.html(lines, i)) is not None:
                self.skipped.append((line.at, lines[end - 1].at + len(lines[end - 1].text.encode())))
                i = end
            elif i + 1 < len(lines) and "|" in t and _delimiter.match(lines[i + 1].text) and "-" in lines[i + 1].text and len(cells(t)) == len(cells(lines[i + 1].text)):
                i = self.table(lines, i, out)
            else:
                i = self.paragraph(lines, i, out, quoted)
        return out

    def indented(self, lines: list[Line], i: int, out: list) -> int:
        begin, kept = i, []
        while i < len(lines) and (indent(lines[i].text) >= 4 or not lines[i].text.strip()):
            kept.append(drop_indent(lines[i], 4).text)
            i += 1
        while not kept[-1].strip():
            kept.pop()
            i -= 1
        out.append(tree.block("code_block", (), (lines[begin].at, lines[i - 1].at + len(lines[i - 1].text.encode())), language=None, code="\n".join(kept)))
        return i

    def fenced(self, lines: list[Line], i: int, out: list, m: re.Match) -> int:
        begin, width = i, len(m.group(1))
        close = re.compile(rf" {{0,3}}{re.escape(m.group(2)[0])}{{{len(m.group(2))},}}[ \t]*$")
        kept = []
        i += 1
        while i < len(lines) and not close.match(lines[i].text):
            kept.append(drop_indent(lines[i], min(width, indent(lines[i].text))).text)
            i += 1
        i = min(i + 1, len(lines))
        end = lines[i - 1]
        language = inlines._unescape(m.group(3)) or None
        out.append(tree.block("code_block", (), (lines[begin].at, end.at + len(end.text.encode())), language=language, code="\n".join(kept).rstrip("\n")))
        return i

    def quote(self, lines: list[Line], i: int, out: list) -> int:
        begin, inner, lazy_ok = i, [], False
        while i < len(lines):
            line = lines[i]
            if m := _quote.match(line.text) if indent(line.text) < 4 else None:
                rest = line.cut(m.end())
                inner.append(rest)
                lazy_ok = bool(rest.text.strip()) and indent(rest.text) < 4 and not _fence.match(rest.text) and not _atx.match(rest.text) and not _rule.match(rest.text)
            elif lazy_ok and line.text.strip() and not self.starts_block(line):
                inner.append(Line(line.text.lstrip() if indent(line.text) >= 4 else line.text, line.at, True))
            else:
                break
            i += 1
        end = lines[i - 1]
        out.append(tree.block("block_quote", (), (lines[begin].at, end.at + len(end.text.encode())), children=self.read(inner, True)))
        return i

    def list(self, lines: list[Line], i: int, out: list) -> int:
        m = _item.match(lines[i].text)
        sign, begin = m.group(2)[-1], i
        items, last = [], i
        while i < len(lines) and (m := _item.match(lines[i].text)) and m.group(2)[-1] == sign and not _rule.match(lines[i].text):
            after = lines[i].text[m.end() :]
            pad = indent(after)
            width = len(m.group(0)) + (pad if 1 <= pad <= 4 and after.strip() else 1)
            first = lines[i].cut(m.end())
            inner = [drop_indent(first, width - len(m.group(0))) if after.strip() else Line("", first.at)]
            blank = not after.strip()
            last = i
            i += 1
            while i < len(lines):
                line = lines[i]
                if not line.text.strip():
                    if blank and len(inner) == 1 and not inner[0].text.strip():
                        break
                    inner.append(Line("", line.at))
                    blank = True
                elif indent(line.text) >= width:
                    inner.append(drop_indent(line, width))
                    blank, last = False, i
                elif not blank and not self.starts_block(line, True) and self.open_paragraph(inner):
                    inner.append(Line(line.text.lstrip(), line.at, True))
                    last = i
                else:
                    break
                i += 1
            items.append(self.read(inner))
        while last + 1 < i and not lines[last + 1].text.strip():
            break
        end = lines[last]
        out.append(tree.block("list", (), (lines[begin].at, end.at + len(end.text.encode())), ordered=sign in ".)", items=items))
        return i

    def open_paragraph(self, inner: list[Line]) -> bool:
        """Whether text that goes on lazily would continue a paragraph."""
        fences = sum(1 for x in inner if _fence.match(x.text) and indent(x.text) < 4)
        t = inner[-1].text
        return bool(t.strip()) and fences % 2 == 0 and not _atx.match(t) and not _rule.match(t)

    def html(self, lines: list[Line], i: int) -> int | None:
        t = lines[i].text
        for start, stop in _html_start:
            if start.match(t):
                break
        else:
            if not _html_any.match(t):
                return None
            stop = None
        while i < len(lines):
            if stop is None:
                if not lines[i].text.strip():
                    return i
            elif stop.search(lines[i].text):
                return i + 1
            i += 1
        return i

    def table(self, lines: list[Line], i: int, out: list) -> int:
        begin, head = i, cells(lines[i].text)
        rows = []
        i += 2
        while i < len(lines) and lines[i].text.strip() and not self.starts_block(lines[i]):
            row = cells(lines[i].text)
            rows.append((row + [""] * len(head))[: len(head)])
            i += 1
        end = lines[i - 1]
        out.append(tree.block("table", (), (lines[begin].at, end.at + len(end.text.encode())), headers=head, rows=rows, raw_at=lines[begin].at))
        return i

    def paragraph(self, lines: list[Line], i: int, out: list, quoted: bool) -> int:
        begin, kept = i, []
        while i < len(lines):
            line = lines[i]
            if not line.text.strip():
                break
            if i > begin:
                if (m := _setext.match(line.text)) and not line.lazy and indent(line.text) < 4:
                    text = self.define("\n".join(kept))
                    if text.strip():
                        level = 1 if m.group(1)[0] == "=" else 2
                        out.append(tree.block("heading", (), (lines[begin].at, line.at + len(line.text.encode())), level=level, raw=text.strip(), raw_at=lines[begin].at))
                        return i + 1
                if self.starts_block(line):
                    break
                if "|" in line.text and i + 1 < len(lines) and _delimiter.match(lines[i + 1].text) and "|" in lines[i + 1].text and len(cells(line.text)) == len(cells(lines[i + 1].text)):
                    break
            kept.append(line.text.lstrip(" \t") if i > begin else line.text.lstrip(" "))
            i += 1
        text = self.define("\n".join(kept))
        if text.strip():
            end = lines[i - 1]
            source = "\n".join(x.text for x in lines[begin:i])
            first = lines[begin].at + len(lines[begin].text) - len(lines[begin].text.lstrip(" "))
            out.append(tree.block("paragraph", (), (first, end.at + len(end.text.encode())), raw=text.rstrip(" \t"), raw_at=first, source=source, quoted=quoted))
        return i

    def define(self, text: str) -> str:
        """Takes link reference definitions off the front of a paragraph."""
        while m := _reference.match(text):
            found = inlines.destination(text, m.end())
            if found is None or not m.group(1).strip() or (found[1] == m.end() and text[m.end() : m.end() + 1] != "<"):
                break
            url, at = found
            tail = re.compile(r"[ \t]*(?:\n|\Z)")
            title = re.compile(r"(?:[ \t]+|[ \t]*\n[ \t]*)(?:" + inlines._title.pattern + r")[ \t]*(?:\n|\Z)", re.S).match(text, at)
            end = title or tail.match(text, at)
            if end is None:
                break
            self.references.setdefault(inlines.normal_label(m.group(1)), url)
            text = text[end.end() :]
        return text


def finish(blocks: list[dict], parser: Blocks, section: tree.SectionPath, payloads: list[str], notes: list, callouts: bool, quoted: bool = False) -> list[dict]:
    """The inline phase: inlines, paths, and the repairs of paragraphs."""

    def read(raw: str, at: int) -> list[dict]:
        skipped: list = []
        made = inlines.parse(raw, parser.references, quoted, skipped, lambda i: at + len(raw[:i].encode()))
        notes.extend(skipped)
        return restore(made, payloads)

    out = []
    for node in blocks:
        kind = node["kind"]
        if kind == "heading":
            node["content"] = read(node.pop("raw"), node.pop("raw_at"))
            node["path"] = section.enter(node["level"], tree.plain(node["content"]))
        elif kind == "paragraph":
            raw, at, source, in_quote = node.pop("raw"), node.pop("raw_at"), node.pop("source"), node.pop("quoted")
            node["path"] = section.current()
            source = repairs.unshield(source, payloads)
            bare = repairs.callout(source) if callouts and not in_quote and not quoted else None
            if bare is not None:
                inner = tree.block("paragraph", node["path"], node["range"], content=[tree.text(bare)])
                node = tree.block("block_quote", node["path"], node["range"], children=[inner])
            elif found := repairs.tabbed(source):
                if found[0] == "table":
                    node = tree.block("table", node["path"], node["range"], headers=found[1], rows=found[2])
                else:
                    notes.append(("Lossy", "tab-delimited table-like paragraph had inconsistent row widths; preserved as GenericBlock", node["range"]))
                    node = tree.block("generic", node["path"], node["range"], hint="table-like:tab-delimited", confidence=GENERIC_CONFIDENCE, content=[tree.text(found[1])])
            else:
                node["content"] = read(raw, at)
                if not node["content"]:
                    continue
        elif kind == "table":
            at = node.pop("raw_at")
            node["headers"] = [read(c, at) for c in node["headers"]]
            node["rows"] = [[read(c, at) for c in r] for r in node["rows"]]
            node["path"] = section.current()
        elif kind == "list":
            node["items"] = [finish(i, parser, section, payloads, notes, callouts, quoted) for i in node["items"]]
            node["path"] = section.current()
        elif kind == "block_quote":
            node["children"] = finish(node["children"], parser, section, payloads, notes, callouts, True)
            node["path"] = section.current()
        else:
            if kind == "code_block":
                node["code"] = repairs.unshield(node["code"], payloads)
                node["language"] = node["language"] and repairs.unshield(node["language"], payloads)
            node["path"] = section.current()
        out.append(node)
    return out


def restore(nodes: list[dict], payloads: list[str]) -> list[dict]:
    if not payloads:
        return nodes
    out = []
    for n in nodes:
        n = {k: repairs.unshield(v, payloads) if k in ("text", "url", "alt") else v for k, v in n.items()}
        if "children" in n:
            n["children"] = restore(n["children"], payloads)
        out.append(n)
    return out


def parse(source: str, normalize_repeated_leading_segment: bool = False, normalize_bare_callouts: bool = False) -> dict:
    """{title, format, frontmatter, body, diagnostics} of Markdown. Ranges are bytes of the source."""
    diagnostics: list[dict] = []
    text, decode = source, OffsetMap()
    if repairs.is_escaped_stream(source):
        text, decode = decode_newlines(source)
        diagnostics.append(tree.diagnostic("Normalized", "decoded escaped newline stream before markdown parse"))
    header, begin, inferred = repairs.frontmatter(text)
    if inferred:
        diagnostics.append(tree.diagnostic("Normalized", "inferred unfenced YAML-like frontmatter block at document start"))
    end = len(text)
    if repeat := repairs.repeated_segment(text, begin, header):
        at, signature = repeat
        span = decode.range((len(text[:at].encode()), len(text.encode())))
        if normalize_repeated_leading_segment:
            diagnostics.append(tree.diagnostic("Lossy", f"suspected duplicated leading segment removed at byte {span[0]} using signature [{signature}]", span))
            end = at
        else:
            note = f"suspected duplicated leading segment starts at byte {span[0]} (signature [{signature}]); content kept unchanged"
            diagnostics.append(tree.diagnostic("Normalized", note, span))
    base = len(text[:begin].encode())
    body, payloads, notes, shielded = repairs.shield(text[begin:end], base)
    lines, at = [], base
    for raw in body.split("\n"):
        lines.append(Line(raw[:-1] if raw.endswith("\r") else raw, at))
        at += len(raw.encode()) + 1
    parser, events = Blocks(), []
    blocks = parser.read(lines)
    blocks = finish(blocks, parser, tree.SectionPath(), payloads, events, normalize_bare_callouts)

    def original(span):
        return span and decode.range(shielded.range(span))

    for node in tree.walk(blocks):
        node["range"] = original(node["range"])
    diagnostics += [d | {"range": original(d["range"])} for d in notes]
    raw_html = "raw HTML is left out of the tree"
    found = [("Unsupported", raw_html, s) for s in parser.skipped for s in (s, None)] + [e if isinstance(e[0], str) else ("Unsupported", raw_html, e) for e in events]
    diagnostics += [tree.diagnostic(kind, note, original(span)) for kind, note, span in found]
    title = next((tree.plain(b["content"]) for b in blocks if b["kind"] == "heading" and b["level"] == 1), None)
    return {"title": title, "format": "Markdown", "frontmatter": header, "body": blocks, "diagnostics": diagnostics}
