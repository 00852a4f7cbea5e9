"""Layout-aware rendering of texts with HTML, Markdown, wiki or LaTeX markup in them.

All four notations are read into one tree, with the implied tags of the HTML tree builder. What a browser would show is
then written as plain text: blocks apart by a blank line, headings in capitals, list items with `- ` or `1. `, quotes
with `| `, code blocks indented by four, cells in aligned columns joined by ` | `, links as `text (url)`. Formulas stay.

A text is read once. Code is opaque: between backticks, in fences and in verbatim nothing is markup; in code elements of
HTML tags are dropped and references decoded, once. Elsewhere tags that were written as references are tags, and text that
was escaped twice is decoded twice. Neither reading nor writing recurses with the depth of a page.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.parsers import dom

# Names that make `<name` a tag, character references apart.
HTML_NAMES = frozenset(
    """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption
    center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer
    form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark
    menu meta meter nav noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script
    search section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th
    thead time title tr track tt u ul var video wbr""".split()
)
WIKI_NAMES = frozenset("ref references nowiki gallery includeonly noinclude onlyinclude poem syntaxhighlight math".split())
# LaTeX commands of running text. All others belong to formulas and stay.
LATEX_INLINE = frozenset(
    "emph textbf textit texttt textsc textsf textsl textrm text underline uline mbox enquote bf it tt em sc sl rm sf".split()
)
LATEX_HEADINGS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "title": 1}
LATEX_DROPPED = frozenset(
    """label index vspace hspace noindent newpage clearpage pagebreak maketitle tableofcontents centering usepackage documentclass
    bibliographystyle bibliography hline toprule midrule bottomrule smallskip medskip bigskip""".split()
)
LATEX_NAMES = (
    LATEX_INLINE | LATEX_HEADINGS.keys() | LATEX_DROPPED
    | frozenset("begin end item cite citep citet ref eqref pageref autoref url href footnote caption includegraphics ldots dots LaTeX TeX".split())
)
#: Elements whose content is code: tags and references are read there, no other notation.
OPAQUE = frozenset("pre code samp kbd tt xmp textarea source syntaxhighlight nowiki math script style".split())
HIDDEN = frozenset("head script style template noscript iframe object embed audio video canvas svg select datalist input ref".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr
    ul caption poem gallery""".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr article section address details".split())

FORMULA = r"(?<!\\)\\\[(?:(?!\n\s*\n)[^\]]|\](?!\s*$))*?\\\]|(?<![\\$\w])\$(?![\s$\d])[^$\n]*?(?<![\s\\])\$(?![\w$])|(?<![\\$\w])\$\d[^$\n]*[\\^_={}][^$\n]*(?<![\s\\])\$(?![\w$])|\\\((?:(?!\n\s*\n).)*?\\\)"
TAGS = "|".join(sorted(HTML_NAMES | WIKI_NAMES, key=lambda t: (-len(t), t)))
ENTITY = r"&(?:amp;)*(?:\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
TAG = rf"<(?P<close>/?)(?P<name>{TAGS})(?P<attrs>(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
COMMENT = r"<!--.*?(?:-->|\Z)|<![A-Za-z][^>]*>|<\?[^>]*>"
#: The line below the head of a Markdown table.
RULED = r"[ ]*(?::?-{3,}:?|:-+:?|-+:)[ ]*"
DELIMITER = rf"(?=[^\n]*\|)[ ]*\|?{RULED}(?:\|{RULED})*\|?[ ]*"
_lexer = re.compile(
    rf"""
      (?P<formula>{FORMULA})
    | (?P<fence>(?m:^)[ ]{{0,3}}(?P<ticks>```+|~~~+)[^\n`]*\n(?P<fenced>.*?)(?:\n?[ ]{{0,3}}(?P=ticks)[ ]*(?:\n|\Z)|\Z))
    | (?P<tex_quote>``(?P<tex_quoted>[^`'\n]+)'')
    | (?P<code>(?<!`)(?P<tick>`+)(?!`)(?P<coded>[^\n]*?[^`\n])(?P=tick)(?!`))
    | (?P<comment>{COMMENT})
    | (?P<autolink><(?P<auto>(?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>)
    | (?P<tag>{TAG})
    | (?P<hidden_comment>&(?:amp;)*lt;!--.*?--&(?:amp;)*gt;)
    | (?P<hidden_tag>&(?:amp;)*lt;(?P<hidden_close>/?)(?P<hidden_name>{TAGS})(?P<hidden_attrs>(?=[\s/&])(?:[^<>&]|&(?:amp;)*(?:quot|apos|\#39|amp);)*?)&(?:amp;)*gt;)
    | (?P<entity>(?:{ENTITY})+)
    | (?P<tex_verbatim>\\begin\{{(?P<verbatim_env>verbatim\*?|lstlisting|Verbatim)\}}(?:\[[^\]\n]*\])?\n?(?P<verbatim>.*?)\\end\{{(?P=verbatim_env)\}})
    | (?P<tex_verb>\\verb\*?(?P<verb_mark>[^\sA-Za-z*\\])(?P<verbed>[^\n]*?)(?P=verb_mark))
    | (?P<tex_table>\\begin\{{(?P<table_env>tabular\*?|tabularx|longtable|tabulary)\}}(?:\[[^\]\n]*\])?(?:\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*(?P<tex_rows>.*?)\\end\{{(?P=table_env)\}})
    | (?P<tex_env>\\(?P<env_end>begin|end)\{{(?P<env>[A-Za-z]+\*?)\}}(?:\[[^\]\n]*\])?)
    | (?P<tex_break>\\\\(?:\[[^\]\n]*\]|(?=\s|$)))
    | (?P<tex_group>\{{\\(?P<switch>bf|it|tt|em|sc|sl|rm|sf|small|large|Large)\b[ ]?(?P<switched>[^{{}}]*)\}})
    | (?P<tex>~?\\(?P<cmd>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?(?P<args>(?:\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*)[ ]?)
    | (?P<template>\{{\{{(?P<inside>(?:[^{{}}]|\{{(?!\{{)|\}}(?!\}})|\{{\{{(?:[^{{}}])*\}}\}})*)\}}\}})
    | (?P<wiki_link>\[\[(?P<target>[^\[\]\n|]+)(?:\|(?P<label>[^\[\]\n]*))?\]\])
    | (?P<wiki_ext>\[(?P<ext>(?:https?|ftp)://[^\s\]]+)(?:[ ]+(?P<ext_label>[^\]\n]+))?\](?!\())
    | (?P<magic>(?<!\w)__(?:NO|FORCE)?(?:TOC|EDITSECTION|INDEX|GALLERY|NEWSECTIONLINK)__)
    | (?P<wiki_bold>'''''(?P<wb5>[^'\n]+(?:'[^'\n]+)*)'''''|'''(?P<wb3>[^'\n]+(?:'[^'\n]+)*)'''|''(?P<wb2>[^'\n]+(?:'[^'\n]+)*)'')
    | (?P<wiki_head>(?m:^)(?P<eqs>={{1,6}})[ ]*(?P<wh>[^=\n]+?)[ ]*(?P=eqs)[ ]*(?m:$))
    | (?P<md_table>(?m:^)(?P<md_top>[^\n|]*\|[^\n]*)\n{DELIMITER}(?m:$)(?P<md_rows>(?:\n(?=[^\n]*\|)[^\n]*\S[^\n]*)*))
    | (?P<delim>(?m:^){DELIMITER}(?m:$))
    | (?P<wiki_grid>(?m:^)\{{\|[^\n]*\n(?P<wiki_rows>.*?)(?:(?<=\n)|\n)\|\}}[ ]*(?m:$))
    | (?P<wiki_table>(?m:^)(?:\{{\|[^\n]*|\|\}}[ ]*|\|-[^\n]*)(?m:$))
    | (?P<md_head>(?m:^)(?P<hashes>\#{{1,6}})[ ]+(?P<mh>[^\n]*?)[ ]*\#*(?m:$))
    | (?P<setext>(?m:^)(?P<sh>[^\s][^\n]*)\n[ ]{{0,3}}(?P<under>={{2,}}|-{{2,}})[ ]*(?m:$))
    | (?P<rule>(?m:^)[ ]{{0,3}}(?:(?:\*[ ]*){{3,}}|(?:-[ ]*){{3,}}|(?:_[ ]*){{3,}})(?m:$))
    | (?P<quote>(?m:^)[ ]{{0,3}}>(?=[ ]|$)[ ]?)
    | (?P<bullet>(?m:^)[ ]*[*+][ ]+(?=\S))
    | (?P<footdef>(?m:^)\[\^[^\]\n]+\]:[ ]*)
    | (?P<refdef>(?m:^)[ ]{{0,3}}\[[^\]\n]+\]:[ ]*<?\S+>?(?:[ ]+["'(][^\n]*)?(?m:$))
    | (?P<footref>\[\^[^\]\s]+\])
    | (?P<image>!\[(?P<alt>[^\]\n]*)\](?:\((?P<src>[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:[ ]+"[^"\n]*")?\)|\[[^\]\n]*\]))
    | (?P<link>\[(?P<shown>(?:[^\[\]\n]|\[[^\[\]\n]*\])+)\](?:\([ ]*<?(?P<url>[^()\s<>]*(?:\([^()\s]*\)[^()\s]*)*)>?(?:[ ]+["'][^"'\n]*["'])?[ ]*\)|\[(?P<ref>[^\]\n]*)\]))
    | (?P<strong>(?<![\w*])(?P<stars>\*{{1,3}})(?![\s*])(?P<starred>(?:[^*\n]|\*(?!\*))*?[^\s*])(?P=stars)(?![\w*]))
    | (?P<under2>(?<![\w_])(?P<bars>_{{1,3}})(?![\s_])(?P<barred>[^_\n]*?(?:(?<=\w)_(?=\w)[^_\n]*?)*[^\s_])(?P=bars)(?![\w_]))
    | (?P<strike>~~(?![\s~])(?P<struck>[^~\n]*[^\s~])~~)
    | (?P<escape>\\(?P<escaped>[\#$%&*_`{{}}~]))
    """,
    re.X | re.S | re.I,
)

#: Where a piece of markup can begin. Everything between is plain text.
_gate = re.compile(r"[<&`\\$\[{*_~'!]|^(?:[ =|:>+#-]|(?=[^\s][^\n]*\n {0,3}(?:={2,}|-{2,}) *$)|(?=[^\n|]*\|[^\n]*\n[ |:]*-[ |:-]*$))", re.M)
_inside_code = re.compile(rf"{COMMENT}|{TAG}|(?P<entity>&[#A-Za-z0-9]+;)", re.S | re.I)

#: Texts without any of these hold no markup. For Java and for Python.
SUSPECT = (
    r"(?m)<[A-Za-z/!?]|&(?:#[0-9]|#?[A-Za-z0-9]{2,32});|`|\\[^\s]|(?<![\s])\*|\*(?![\s])|~~|__|(?<!\w)_|''|\[\[|\{\{|\]\(|\]\[|\[\^|\]:|\[(?:https?|ftp):|\{\\"
    r"|^#{1,6} |^ *[>*+] |^={1,}|^ *-{2,} *$|^ *[-*_]( *[-*_]){2,} *$|-:? *\||\| *:?-|^\{\||^\|[-}]|^>"
)
_suspect = re.compile(SUSPECT)
HEAD_PREFIX = "category file image datei fichier archivo plik soubor файл категория catégorie kategorie categoría".split()


class Reader:
    """Reads marked-up text into a tree and notes the kinds of markup it met."""

    def __init__(self):
        self.build = dom.TreeBuilder()
        self.build.started = True
        self.kinds: list[str] = []

    def note(self, kind: str) -> None:
        self.kinds.append(kind)

    def inside(self, tag: str, text: str, attrs: dict | None = None) -> None:
        self.build.start(tag, attrs)
        self.read(text)
        self.build.end(tag)

    def cells(self, tag: str, texts: list[str]) -> None:
        self.build.start("tr")
        for t in texts:
            self.inside(tag, t.strip())
        self.build.end("tr")

    def code(self, tag: str, text: str, literal: bool = True) -> None:
        """A code element. Unless its content is literal, tags in it are dropped and references decoded, once."""
        self.build.start(tag)
        if literal:
            self.build.text(text)
        else:
            self.build.text(_inside_code.sub(lambda m: html.unescape(m.group()) if m.group("entity") else "", text))
        self.build.end(tag)

    def read(self, text: str) -> None:
        at = seen = 0
        while gate := _gate.search(text, seen):
            m = _lexer.match(text, gate.start())
            if m is None:
                seen = gate.start() + 1
                continue
            kind = m.lastgroup if m.lastgroup in HANDLERS else next(k for k in HANDLERS if m.group(k) is not None)
            if m.start() > at:
                self.build.text(text[at : m.start()])
            went = HANDLERS[kind](self, m)
            if went is False:  # not markup after all
                self.build.text(m.group()[0])
                at = seen = m.start() + 1
            else:
                at = seen = m.end() if went is None else went
        if at < len(text):
            self.build.text(text[at:])


def _formula(r: Reader, m: re.Match):
    r.build.text(m.group())


def _fence(r: Reader, m: re.Match):
    r.note("markdown")
    r.code("pre", m.group("fenced"))


def _code(r: Reader, m: re.Match):
    r.note("markdown")
    text = m.group("coded")
    # A blank on each side belongs to the marks.
    r.code("code", text[1:-1] if len(m.group("tick")) > 1 and text[:1] == text[-1:] == " " and text.strip() else text)


def _verbatim(tag: str, group: str):
    def handle(r: Reader, m: re.Match):
        r.note("latex")
        r.code(tag, m.group(group))

    return handle


@lru_cache(None)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def _tag(r: Reader, m: re.Match):
    name = m.group("name").lower()
    r.note("wiki" if name in WIKI_NAMES else "html")
    attrs = m.group("attrs")
    if not m.group("close") and name in OPAQUE and not attrs.endswith("/") and (end := _closing(name).search(m.string, m.end())):
        inside = m.string[m.end() : end.start()]
        if name in ("nowiki", "math"):
            r.build.text(html.unescape(inside) if name == "nowiki" else inside)
        else:
            r.code("pre" if name in ("source", "syntaxhighlight") else name, inside, name in dom.RAW or name in WIKI_NAMES or name == "source")
        return end.end()
    _element(r, name, bool(m.group("close")), attrs)


def _hidden_tag(r: Reader, m: re.Match):
    """A tag that was written as character references."""
    r.note("html")
    _element(r, m.group("hidden_name").lower(), bool(m.group("hidden_close")), html.unescape(html.unescape(m.group("hidden_attrs"))))


def _element(r: Reader, name: str, close: bool, attrs: str) -> None:
    if name == "nowiki" or name in WIKI_NAMES and attrs.endswith("/"):
        return
    if close:
        r.build.end(name)
    else:
        r.build.start(name, dom.attributes(attrs), attrs.endswith("/"))


_escaped_again = re.compile(r"&(?:amp;)+(?=#|[A-Za-z])")
_entities = re.compile(rf"(?:{ENTITY})+", re.I)


def _entity(r: Reader, m: re.Match):
    text = html.unescape(_escaped_again.sub("&", m.group()))
    if _entities.fullmatch(text):
        return False
    r.note("html")
    r.build.text(text)


_row_end = re.compile(r"\\\\(?:\[[^\]\n]*\])?|\\tabularnewline\b")
_row_rule = re.compile(r"\\(?:hline|toprule|midrule|bottomrule|endhead|endfirsthead|endfoot|endlastfoot)\b|\\c(?:line|midrule)(?:\([^)]*\))?\{[^}]*\}")
_tex_cell = re.compile(r"(?<!\\)&")
_md_cell = re.compile(r"((?:[^|\\`]|\\.|(`+)(?!`).*?(?<!`)\2(?!`)|`)*)(?:\||$)", re.S)
_cell_attributes = re.compile(r"(?:\s*[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s|]+))+\s*\|(?!\|)")


def _tex_table(r: Reader, m: re.Match):
    r.note("latex")
    r.build.start("table")
    for row in _row_end.split(m.group("tex_rows")):
        row = _row_rule.sub("", row)
        if row.strip():
            r.cells("td", _tex_cell.split(row))
    r.build.end("table")


def md_row(line: str) -> list[str]:
    """The cells of a row of a Markdown table; a pipe that is escaped or in code ends none."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    found = [c.group(1) for c in _md_cell.finditer(line)]
    if found and not found[-1].strip():
        found.pop()
    if len(found) > 1 and line.endswith("|") and not found[-1].strip():
        found.pop()
    return [re.sub(r"\\\|", "|", c) for c in found]


def _md_table(r: Reader, m: re.Match):
    r.note("markdown")
    r.build.start("table")
    r.cells("th", md_row(m.group("md_top")))
    for line in m.group("md_rows").split("\n")[1:]:
        r.cells("td", md_row(line))
    r.build.end("table")


def _wiki_grid(r: Reader, m: re.Match):
    r.note("wiki")
    r.build.start("table")
    row: list[tuple[str, str]] = []

    def flush():
        if row:
            r.build.start("tr")
            for tag, text in row:
                r.inside(tag, text.strip())
            r.build.end("tr")
            row.clear()

    for line in m.group("wiki_rows").split("\n"):
        start = line.lstrip()
        if start.startswith("|+"):
            flush()
            r.inside("caption", start[2:].strip())
        elif start.startswith("|-"):
            flush()
        elif start[:1] in ("|", "!"):
            head = start[0] == "!"
            for cell in re.split(r"\|\||!!" if head else r"\|\|", start[1:]):
                row.append(("th" if head else "td", _cell_attributes.sub("", cell, 1) if _cell_attributes.match(cell) else cell))
        elif row:
            row[-1] = (row[-1][0], row[-1][1] + "\n" + line)
        elif start:
            r.inside("caption", start)
    flush()
    r.build.end("table")


def _tex(r: Reader, m: re.Match):
    cmd = m.group("cmd")
    if cmd not in LATEX_NAMES or (not m.group("args") and cmd not in ("item", "ldots", "dots", "LaTeX", "TeX") and cmd not in LATEX_DROPPED | LATEX_INLINE):
        return False
    args = re.findall(r"\{((?:[^{}]|\{[^{}]*\})*)\}", m.group("args"))
    r.note("latex")
    if m.group().startswith("~"):
        r.build.text(" ")
    last = args[-1] if args else ""
    if cmd in LATEX_HEADINGS:
        r.inside(f"h{LATEX_HEADINGS[cmd]}", last)
    elif cmd == "item":
        r.build.start("li")
    elif cmd in ("ldots", "dots"):
        r.build.text("…")
    elif cmd in ("LaTeX", "TeX"):
        r.build.text(cmd)
    elif cmd.startswith("cite"):
        r.build.text(f"[{last}]")
    elif cmd == "footnote":
        r.build.text(" (")
        r.read(last)
        r.build.text(")")
    elif cmd == "href" and len(args) > 1:
        r.inside("a", last, {"href": args[0]})
    elif cmd not in LATEX_DROPPED and cmd != "includegraphics":
        r.read(last)
    if m.group().endswith(" ") and cmd not in LATEX_HEADINGS and cmd != "item":
        r.build.text(" ")


_ENVIRONMENTS = {"itemize": "ul", "enumerate": "ol", "description": "ul", "quote": "blockquote", "quotation": "blockquote", "verbatim": "pre", "lstlisting": "pre"}


def _tex_env(r: Reader, m: re.Match):
    env = m.group("env").rstrip("*")
    if env in ("equation", "align", "gather", "math", "displaymath", "eqnarray", "matrix", "pmatrix", "bmatrix", "cases", "split", "aligned"):
        return False
    r.note("latex")
    tag = _ENVIRONMENTS.get(env, "div")
    r.build.start(tag) if m.group("env_end").lower() == "begin" else r.build.end(tag)


def _template(r: Reader, m: re.Match):
    """A template shows its values; its name and the names of its parameters are dropped."""
    r.note("wiki")
    parts = re.split(r"[|;\n]", m.group("inside"))
    name, _, rest = parts[0].partition(":")
    values = [rest] + [p.partition("=")[2] if re.match(r"\s*[\w -]+=", p) else p for p in parts[1:]]
    shown = " ".join(v.strip() for v in values if v.strip())
    if shown:
        r.read(shown)


def _wiki_link(r: Reader, m: re.Match):
    r.note("wiki")
    target, label = m.group("target"), m.group("label")
    prefix, colon, rest = target.partition(":")
    if colon and prefix.strip().lower() in HEAD_PREFIX:
        shown = label or rest
    else:
        shown = label if label else target.rpartition("#")[2]
    r.read(shown)


def _link(r: Reader, m: re.Match):
    r.note("markdown")
    r.inside("a", m.group("shown"), {"href": m.group("url") or ""})


def _image(r: Reader, m: re.Match):
    r.note("markdown")
    r.build.text(m.group("alt"))


def _around(kind: str, tag: str, *groups: str):
    def handle(r: Reader, m: re.Match):
        r.note(kind)
        r.inside(tag, next(g for g in map(m.group, groups) if g is not None))

    return handle


def _dropped(kind: str):
    def handle(r: Reader, m: re.Match):
        r.note(kind)

    return handle


def _shown(kind: str, text):
    def handle(r: Reader, m: re.Match):
        r.note(kind)
        r.build.text(text(m))

    return handle


def _heading(kind: str, level, group: str):
    def handle(r: Reader, m: re.Match):
        r.note(kind)
        r.inside(f"h{level(m)}", m.group(group))

    return handle


def _break(r: Reader, m: re.Match):
    r.note("latex")
    r.build.start("br")


def _switch(r: Reader, m: re.Match):
    r.note("latex")
    r.read(m.group("switched"))


HANDLERS = {
    "formula": _formula,
    "fence": _fence,
    "code": _code,
    "tex_quote": _shown("latex", lambda m: f"“{m.group('tex_quoted')}”"),
    "comment": _dropped("html"),
    "autolink": _shown("markdown", lambda m: m.group("auto")),
    "tag": _tag,
    "hidden_comment": _dropped("html"),
    "hidden_tag": _hidden_tag,
    "entity": _entity,
    "tex_verbatim": _verbatim("pre", "verbatim"),
    "tex_verb": _verbatim("code", "verbed"),
    "tex_table": _tex_table,
    "tex_env": _tex_env,
    "tex_break": _break,
    "tex_group": _switch,
    "tex": _tex,
    "template": _template,
    "wiki_link": _wiki_link,
    "wiki_ext": _shown("wiki", lambda m: f"{m.group('ext_label')} ({m.group('ext')})" if m.group("ext_label") else m.group("ext")),
    "magic": _dropped("wiki"),
    "wiki_bold": _around("wiki", "b", "wb5", "wb3", "wb2"),
    "wiki_head": _heading("wiki", lambda m: len(m.group("eqs")), "wh"),
    "md_table": _md_table,
    "wiki_grid": _wiki_grid,
    "wiki_table": _dropped("wiki"),
    "md_head": _heading("markdown", lambda m: len(m.group("hashes")), "mh"),
    "setext": _heading("markdown", lambda m: 1 if m.group("under")[0] == "=" else 2, "sh"),
    "rule": _dropped("markdown"),
    "delim": _dropped("markdown"),
    "quote": _shown("markdown", lambda m: "| "),
    "bullet": _shown("markdown", lambda m: re.match(" *", m.group()).group() + "- "),
    "footdef": _dropped("markdown"),
    "refdef": _dropped("markdown"),
    "footref": _dropped("markdown"),
    "image": _image,
    "link": _link,
    "strong": _around("markdown", "em", "starred"),
    "under2": _around("markdown", "em", "barred"),
    "strike": _around("markdown", "s", "struck"),
    "escape": _shown("markdown", lambda m: m.group("escaped")),
}


def width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def align(rows: list[list[str]]) -> list[str]:
    """Rows as lines: cells padded to the width of their column, joined by ` | `."""
    columns = max(map(len, rows), default=0)
    wide = [max((width(r[i]) for r in rows if i < len(r)), default=0) for i in range(columns)]
    return [" | ".join(c + " " * (w - width(c)) for c, w in zip(r + [""] * (columns - len(r)), wide)).rstrip() for r in rows]


def hidden(node: dom.Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return True
    style = node.attrs.get("style", "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style


class Writer:
    """Writes a tree as lines. `kept` keeps line breaks of the source, as plain text has them; pages collapse them."""

    def __init__(self, kept: bool):
        self.kept, self.lines, self.gap = kept, [""], 0

    def apart(self, lines: int) -> None:
        self.gap = max(self.gap, lines)

    def put(self, text: str, pre: bool = False) -> None:
        if not pre and not self.kept:
            text = re.sub(r"[ \t\n\r\f\v]+", " ", text)
            if not self.lines[-1] or self.gap or self.lines[-1].endswith(" "):
                text = text.lstrip(" ")
        if not text:
            return
        if self.gap:
            if not text.strip() and not pre:
                return
            if any(self.lines):
                while len(self.lines) > 1 and not self.lines[-1].strip():
                    self.lines.pop()
                self.lines += [""] * self.gap
            self.gap = 0
            if self.kept and not pre:
                text = text.lstrip("\n ")
        first, *rest = text.split("\n")
        self.lines[-1] += first
        self.lines += rest

    def text(self) -> str:
        lines = [x.rstrip() for x in self.lines]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")

    def node(self, node: dom.Node | str) -> None:
        walk(self.steps(node))

    def steps(self, node: dom.Node | str) -> Iterator:
        """Writes a node; yields the same of what lies below it, for `walk` to do first."""
        if isinstance(node, str):
            self.put(node)
            return
        if hidden(node):
            return
        tag = node.tag
        block = tag in BLOCKS
        if tag == "br":
            self.put("\n", True) if not self.gap else None
            return
        if block:
            self.apart(2 if tag in APART else 1)
        if tag == "table":
            yield self.table(node)
        elif tag in ("ul", "ol", "menu", "dir"):
            yield self.list(node.tag, node.kids)
        elif tag == "blockquote":
            yield self.prefixed(node, "| ", "| ")
        elif tag == "pre":
            for i, line in enumerate(node.text().strip("\n").split("\n")):
                if i:
                    self.apart(1)
                self.put("    " + line, True)
        elif tag in dom.HEADINGS:
            self.put((yield inline(node, self.kept)).upper())
        elif tag == "a":
            shown, url = (yield inline(node, self.kept)), node.attrs.get("href", "").strip()
            self.put(f"{shown} ({url})" if re.match(r"(?i)https?:", url) and url != shown.strip() and shown.strip() else shown)
        elif tag == "img":
            self.put(node.attrs.get("alt", ""))
        elif tag == "li":
            yield self.list("ul", [node])
        elif tag == "hr":
            self.put("----")
        elif tag == "sup" and node.text().strip().isdigit():
            self.put(f"^{node.text().strip()}")
        else:
            for kid in node.kids:
                yield self.steps(kid)
        if block:
            self.apart(2 if tag in APART else 1)

    def prefixed(self, node: dom.Node, first: str, others: str) -> Iterator:
        inner = Writer(self.kept)
        for kid in node.kids:
            yield inner.steps(kid)
        text = inner.text().strip()
        if not text:
            return
        for i, line in enumerate(text.split("\n")):
            if i:
                self.apart(1)
            self.put((first if i == 0 else others) + line if line or others.strip() else "", True)

    def list(self, tag: str, kids: list) -> Iterator:
        number = 0
        for kid in kids:
            if isinstance(kid, dom.Node) and kid.tag == "li":
                number += 1
                mark = f"{number}. " if tag == "ol" else "- "
                self.apart(1)
                if not hidden(kid):
                    yield self.prefixed(kid, mark, " " * len(mark))
                self.apart(1)
            else:
                yield self.steps(kid)

    def table(self, node: dom.Node) -> Iterator:
        rows: list[list[str]] = []
        todo = [node]
        while todo:
            at = todo.pop()
            for kid in at.kids:
                if isinstance(kid, dom.Node) and kid.tag == "caption" and not hidden(kid):
                    self.put((yield inline(kid, self.kept)))
                    self.apart(1)
            if at.tag == "tr":
                cells = [k for k in at.kids if isinstance(k, dom.Node) and k.tag in ("td", "th") and not hidden(k)]
                row = []
                for c in cells:
                    row.append(" ".join((yield inline(c, False)).split()))
                rows.append(row)
            else:
                todo.extend(k for k in reversed(at.kids) if isinstance(k, dom.Node) and k.tag in ("thead", "tbody", "tfoot", "tr") and not hidden(k))
        for line in align(rows):
            self.apart(1)
            self.put(line, True)


def inline(node: dom.Node, kept: bool) -> Iterator:
    """The text of what is in an element, for `walk`."""
    writer = Writer(kept)
    for kid in node.kids:
        yield writer.steps(kid)
    return writer.text() if not kept else writer.text().strip("\n")


def walk(job: Iterator):
    """Runs a job and those it yields, each before the rest of the one that yielded it, and sends back their results."""
    stack, value = [job], None
    while stack:
        try:
            step = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(step)
            value = None
    return value


def render_text(text: str) -> tuple[str, list[str]]:
    """Clean text, and the kinds of markup met, each once for every piece. A text without markup comes back as it is."""
    if not _suspect.search(text):
        return text, []
    reader = Reader()
    reader.read(text)
    if not reader.kinds:
        return text, []
    writer = Writer(kept=True)
    writer.node(reader.build.body)
    return writer.text(), reader.kinds


def render_page(source: str) -> str:
    """The visible text of an HTML page."""
    writer = Writer(kept=False)
    writer.node(dom.parse(source).kids[1])
    return writer.text()


def clean_texts(frame: DataFrame, keep: tuple[str, ...], text: str, markup: Column | None = None) -> DataFrame:
    """The columns of `keep`, clean STRING, markup ARRAY<STRING> (kinds, one for each piece of markup).

    Where `markup` is false the text passes as it is. A null text stays null with no markup, an empty one empty. Texts
    that cannot hold markup don't leave the JVM. Rows are neither dropped nor merged; other columns are dropped.
    """

    @F.pandas_udf("clean string, markup array<string>")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            made = [(None, []) if t is None else render_text(t) for t in batch]
            yield pd.DataFrame({"clean": [m[0] for m in made], "markup": [m[1] for m in made]})

    source = frame.select(F.struct(F.lit(0), *keep).alias("kept"), F.col(text).alias("text"), (F.lit(True) if markup is None else markup).alias("on"))
    held = source.withColumn("held", F.when(F.col("on") & F.col("text").rlike(SUSPECT), F.col("text")))
    return held.withColumn("read", read("held")).select(
        *[F.col(f"kept.{c}").alias(c) for c in keep],
        F.coalesce(F.col("read.clean"), F.col("text")).alias("clean"),
        F.coalesce(F.col("read.markup"), F.array().cast("array<string>")).alias("markup"),
    )


def clean_pages(frame: DataFrame, keep: tuple[str, ...], body: str, kind: str) -> DataFrame:
    """The columns of `keep` and clean STRING: pages of kind Html by their layout, others as marked-up text. Null stays null."""

    @F.pandas_udf("string")
    def read(bodies: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else render_page(b) if k == "Html" else render_text(b)[0] for b, k in zip(bodies, kinds)], dtype=object)

    return frame.select(*keep, read(F.col(body), F.col(kind)).alias("clean"))
