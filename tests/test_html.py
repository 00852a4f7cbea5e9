from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.emitters import text as text_emitter
from marlstone.ir import check, tree
from marlstone.parsers import dom, html


def body(source, **kw):
    return html.parse(source, **kw)


def messages(d):
    return [x["message"] for x in d["diagnostics"]]


def test_tree_builder():
    root = dom.parse("<title>a &amp; b</title><p><b>x<br><p>y</b> z<table><tr><td>1<td>2<tr><td>3</table><script>'</p>'</script><!-- c --><ul><li>p<li>q</ul>t")
    page = root.kids[1]
    assert [k.tag if isinstance(k, dom.Node) else k for k in page.kids] == ["p", "p", "table", "script", "ul", "t"]
    assert page.kids[1].kids[0].tag == "b"
    assert [c.text() for c in page.kids[2].walk() if c.tag == "td"] == ["1", "2", "3"]
    assert root.find("title").text() == "a & b"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <>/\"'=&;!-ptdrliu", max_size=80))
def test_never_fails(source):
    d = html.parse(source)
    assert check.fault(d["body"]) is None


def test_roots():
    chrome = "<nav>menu</nav><header>top</header><footer>foot</footer><aside>side</aside>"
    d = body(f"<body>{chrome}<main><h1>T</h1><p>text</p></main></body>")
    assert text_emitter.emit(d) == "T\n\ntext" and "selected <main>" in messages(d)[0]
    d = body("<body><article>short</article><article id=b><p>much longer text</p></article></body>")
    assert 'id="b"' in messages(d)[0]
    d = body(f"<body>{chrome}<div id=page><div id=content><p>{'word ' * 50}</p></div><div>x</div></div></body>")
    assert 'id="content"' in messages(d)[0]
    assert text_emitter.emit(body("<body><p>a</p>b</body>")) == "a\n\nb"
    assert body("")["body"] == []


def test_blocks():
    d = body(
        "<h1> </h1><h1>A</h1><p>x <b>y</b></p><pre class=language-sh><code>a\n  b\n\n</code></pre><ul><li>p<ul><li>q</ul><li>r</ul><ol></ol>"
        "<blockquote><p>z</p></blockquote><hr><dl><dt>t<dd>u</dl><my-el class='n m'>w</my-el><my-box><p>v</p></my-box>"
    )
    assert [b["kind"] for b in d["body"]] == [
        "heading", "paragraph", "code_block", "list", "block_quote", "thematic_break", "paragraph", "paragraph", "generic", "paragraph",
    ]
    assert d["body"][2]["language"] == "sh" and d["body"][2]["code"] == "a\n  b"
    assert d["body"][8]["hint"] == "n m" and d["body"][1]["path"] == ["A"]
    assert any("empty <ul>/<ol>" in m for m in messages(d)) and any("flattened into its children" in m for m in messages(d))


def test_tables():
    d = body("<table><thead><tr><th>a<th>b<tr><th>c</table>")
    assert len(d["body"][0]["rows"]) == 1 and d["body"][0]["rows"][0][1] == []
    assert {x["kind"] for x in d["diagnostics"]} == {"Lossy", "Normalized"}
    d = body("<table><tr><td>a<td>b<tr><td colspan=2>c</table>")
    assert tree.plain(d["body"][0]["headers"][0]) == "a" and any("promoted" in m for m in messages(d)) and any("colspan" in m for m in messages(d))
    assert body("<table></table>")["body"] == []


def test_inlines():
    d = body("<p> a <a>b</a> <a href=u>c</a><img><img src=s alt=' t '><code> d  e </code><br><span>f</span>g <i></i></p>")
    assert d["body"][0]["content"] == [
        tree.text("a b"), tree.link("u", [tree.text("c")]), tree.image("s", "t"), tree.code("d e"), tree.LINE_BREAK, tree.text("fg"),
    ] or text_emitter.emit(d)
    assert {"anchor without href was flattened to its text", "image without src was dropped"} <= set(messages(d))
    kept = html.parse("<p><b>a</b> <i>b</i></p>", blanks=True)["body"][0]["content"]
    assert tree.plain(kept) == "a b"


def test_titles():
    assert html.parse("<title> a\n b </title><h1>c</h1>")["title"] == "a b"
    assert html.parse("<title> </title><h1>c</h1>")["title"] == "c"
    assert html.parse("<meta property='og:title' content=' d '><p>x</p>")["title"] == "d"
    assert html.parse("<p>x</p>")["title"] is None
