import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.emitters import html as html_emitter
from marlstone.emitters import markdown as markdown_emitter
from marlstone.emitters import text as text_emitter
from marlstone.ir import arena, check, tree
from marlstone.parsers import html, markdown

STABLE = [
    "# Orchard\n\nPick **ripe** and *sound* fruit, ~~not~~ `late` ones.\n\n---\n\nEnd.",
    "- one\n- two\n  - deep\n    1. deeper\n    2. more\n- three",
    "1. first\n\n   second paragraph\n2. next\n   > quoted\n   > on",
    "```python\nx = 1\n\ny = 2\n```\n\n> a\n> b\n>\n> c",
    "See [the map](https://a.test/x) and ![a hill](h.png).",
    "| a | **b** |\n| --- | --- |\n| `c` | [d](e) |\n| | f \\| g |",
    "# A\n\n## B\n\ntext\n\n### C\n\nmore\n\n## D\n\nlast",
    "---\ntitle: T\nkeys:\n  - a\n---\n\nbody",
    "Sum $a_i * b_i$ and \\[ x = \\frac{1}{2} \\] here.\n\n\\[x=y\\]",
    "[[Wiki page]] and [!note] and [see chapter_3].",
    "\\*not emphasis\\* and a\\_b",
    "````\n```\ninner\n```\n````",
]


@pytest.mark.parametrize("source", STABLE)
def test_round_trip(source):
    first = markdown.parse(source)
    written = markdown_emitter.emit(first)
    second = markdown.parse(written)
    assert check.document_difference(first | {"body": check.normalized(first["body"])}, second | {"body": check.normalized(second["body"])}) is None
    assert markdown_emitter.emit(second) == written
    assert check.fault(first["body"], len(source.encode())) is None
    assert arena.build(arena.flatten(first)) == first


@pytest.mark.parametrize("source", STABLE[:6])
def test_cross_format(source):
    body = check.normalized(markdown.parse(source)["body"])
    again = html.parse(f"<body>{html_emitter.blocks(body)}</body>", extract=False, blanks=True)["body"]
    if ">" not in source:  # quoted line breaks collapse in HTML
        assert check.difference(body, check.normalized(again)) is None


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #*_`~[]()!<>&\\|-+.1$\n\t¤é", max_size=60))
def test_never_fails(source):
    d = markdown.parse(source)
    size = len(source.encode())
    for b in tree.walk(d["body"]):
        if b["range"]:
            assert 0 <= b["range"][0] <= b["range"][1] <= size
    markdown_emitter.emit(d), html_emitter.emit(d), text_emitter.emit(d)
    assert arena.build(arena.flatten(d)) == d
    assert check.normalized(check.normalized(d["body"])) == check.normalized(d["body"])


def kinds(d):
    return [b["kind"] for b in d["body"]]


def test_paths_title_and_ranges():
    source = "Vorwort é\n\n# A *b*\n\nx\n\n## C\n\ny\n\n# D\n\nz"
    d = markdown.parse(source)
    assert d["title"] == "A b"
    assert [b["path"] for b in d["body"]] == [[], [], ["A b"], ["A b"], ["A b", "C"], [], ["D"]]
    cut = [source.encode()[slice(*b["range"])].decode() for b in d["body"]]
    assert cut == ["Vorwort é", "# A *b*", "x", "## C", "y", "# D", "z"]


def test_ranges_survive_repairs():
    source = "# T\\n\\nbefore $x*y$ after\\n\\nlast é"
    d = markdown.parse(source)
    assert [source.encode()[slice(*b["range"])].decode() for b in d["body"]] == ["# T", "before $x*y$ after", "last é"]
    assert d["body"][1]["content"] == [tree.text("before $x*y$ after")] or tree.plain(d["body"][1]["content"]) == "before $x*y$ after"
    assert d["diagnostics"][0]["kind"] == "Normalized"


def test_repairs():
    assert markdown.parse("---\na: 1\n---\nx")["frontmatter"] == "a: 1\n"
    assert markdown.parse("---\na: 1\nx")["frontmatter"] is None
    d = markdown.parse("name: x\nkind: y\n\nbody")
    assert d["frontmatter"] == "name: x\nkind: y\n" and d["diagnostics"][0]["kind"] == "Normalized"
    long = "# H\n\n" + "word " * 60 + "\n\n# H\n\nagain"
    assert "kept unchanged" in markdown.parse(long)["diagnostics"][0]["message"]
    cut = markdown.parse(long, normalize_repeated_leading_segment=True)
    assert cut["diagnostics"][0]["kind"] == "Lossy" and len(cut["body"]) == 2
    assert kinds(markdown.parse("a\tb\nc\td")) == ["table"]
    ragged = markdown.parse("a\tb\nc\td\te")
    assert kinds(ragged) == ["generic"] and ragged["diagnostics"][0]["kind"] == "Lossy"
    assert kinds(markdown.parse("[!tip] x", normalize_bare_callouts=True)) == ["block_quote"]
    assert kinds(markdown.parse("[!tip] x")) == ["paragraph"]
    assert markdown.parse("a ¤ $x$")["diagnostics"][0]["kind"] == "Unsupported"
    assert "unmatched" in markdown.parse("costs $5")["diagnostics"][0]["message"]
    assert [d["range"] is None for d in markdown.parse("<div>\nx\n</div>\n\ny")["diagnostics"]] == [False, True]


def test_formulas_do_not_shift():
    d = markdown.parse("[a $x$](u$y$v) then $z$ and `$w$`")
    assert tree.plain(d["body"][0]["content"]) == "a $x$ then $z$ and $w$"
    assert d["body"][0]["content"][0]["url"] == "u$y$v"


def test_validation():
    b = tree.block
    t = [tree.text("x")]
    cases = [
        (b("heading", level=0, content=t), "heading level"),
        (b("heading", level=7, content=t), "heading level"),
        (b("generic", hint="x", confidence=1.5, content=t), "confidence"),
        (b("generic", hint="x", confidence=float("nan"), content=t), "confidence"),
        (b("table", headers=[t], rows=[[t, t]]), "width"),
        (b("table", headers=[], rows=[[t]]), "without header"),
        (b("list", ordered=False, items=[]), "empty list"),
        (b("paragraph", (), (5, 3), content=t), "inverted"),
        (b("paragraph", (), (0, 99), content=t), "exceeds"),
        (b("paragraph", content=[tree.link("", t)]), "link"),
        (b("paragraph", content=[tree.image("", "a")]), "image"),
    ]
    for node, word in cases:
        assert word in check.fault([node], 10)
        assert word in check.fault([b("list", ordered=True, items=[[node]])], 10)
    assert check.fault([b("paragraph", content=t)], 10) is None


def test_difference():
    a, b = markdown.parse("# A\n\nx"), markdown.parse("# A\n\ny")
    assert check.document_difference(a, a) is None
    assert "body[1]" in check.document_difference(a, b)
    assert "title" in check.document_difference(a, markdown.parse("# B\n\nx"))
    assert check.difference(a["body"], a["body"][:1]) == "body: 2 vs 1 blocks"


def test_stored_form():
    for source in STABLE:
        d = markdown.parse(source)
        again = tree.loads(tree.dumps(d, {"id": "i", "title": d["title"], "format": "Markdown", "frontmatter": d["frontmatter"] and {"yaml": d["frontmatter"]}}))
        assert {k: again[k] for k in d} == d
    for bad in ("", "{", "[]", '{"body": [{}]}', '{"body": [{"block": {"Odd": {}}}]}'):
        with pytest.raises(Exception, match="parse error"):
            tree.loads(bad)


def test_text():
    d = markdown.parse("# Top\n\n1. a\n2. b\n\n> q\n>\n> r\n\n```\nc\n```\n\n[t](u) ![i](j)\n\n| a | b |\n|---|---|\n| c | d |\n\n---")
    assert text_emitter.emit(d) == "TOP\n\n1. a\n2. b\n\n| q\n|\n| r\n\n    c\n\nt (u) i (image: j)\n\na | b\nc | d\n\n----"
