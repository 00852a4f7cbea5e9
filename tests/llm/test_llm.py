import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions.tokens import count_tokens
from marlstone.llm import additive, boundaries, bpe, furniture, markup, mixing, mojibake, neardup, packing, vectors

CLASH = ("key", "text", "n", "pieces", "kept", "col", "pos", "class", "band", "task", "role", "group", "host", "hash", "blocks", "bucket", "copies", "content")


def clashing(frame, *own):
    """With more columns whose names the operators use themselves."""
    for c in CLASH:
        if c not in own:
            frame = frame.withColumn(c, F.lit("clash"))
    return frame


# 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(40, 90))
def test_best_two_fit(sizes, capacity):
    where = packing.best_two_fit(sizes, capacity)
    fill = {}
    for s, w in zip(sizes, where):
        fill[w] = fill.get(w, 0) + s
    assert len(where) == len(sizes) and max(fill.values(), default=0) <= capacity
    assert len(fill) <= 2 * sum(sizes) / capacity + 1


def test_two_replace_the_smallest():
    # Greedy takes 6 + 3; the two of 2 fill the gap of 10 that 3 leaves.
    where = packing.best_two_fit([6, 3, 2, 2], 10)
    assert where[0] == where[2] == where[3] != where[1]
    with pytest.raises(ValueError):
        packing.best_two_fit([11], 10)


def test_pack(spark):
    rows = [("a", "w " * 30), ("a", "w " * 30), ("b", ""), ("c", None), (None, "x"), ("d", "one. " * 40), ("e", "w " * 9)]
    frame = clashing(spark.createDataFrame(rows, "chunk_id string, body string"))
    made = packing.pack(frame, "chunk_id", "body", 32).collect()
    assert {r["chunk_id"] for r in made} == {"a", "b", "d", "e"}
    fill = {}
    for r in made:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 32 and sum(fill.values()) == 30 + 0 + 80 + 9
    assert {r["chunk_id"]: r["pieces"] for r in made} == {"a": 1, "b": 1, "d": 3, "e": 1}
    assert packing.pack(frame.limit(0), "chunk_id", "body", 32).count() == 0


# 3


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab1 .,\n。", max_size=400), st.integers(1, 30), st.integers(0, 12))
def test_pieces(text, budget, overlap):
    made = boundaries.pieces(text, budget, overlap)
    assert made[0][0] == 0 and made[-1][1] == len(text)
    for p in made:
        assert count_tokens(text[p[0] : p[1]]) == p[2] <= budget
    for p, q in zip(made, made[1:]):
        assert count_tokens(text[q[0] : p[1]]) == min(overlap, budget - 1)


def test_cuts_fall_on_boundaries():
    text = "\n\n".join("word " * 9 + "end." for _ in range(20))
    made = boundaries.pieces(text, 50, 0)
    assert len(made) <= 6 and all(p[3] == boundaries.PARAGRAPH for p in made)
    assert len(boundaries.pieces("x" * 100_000, 5, 2)) == 1
    assert len(boundaries.pieces("1" * 3000, 100, 0)) == 10


def test_split_oversized(spark):
    rows = [("a", "w " * 30, ["S"]), ("a", "w " * 30, ["S"]), ("b", "", None), ("c", None, []), ("d", "w", ["T"])]
    frame = clashing(spark.createDataFrame(rows, "chunk_id string, body string, section_path array<string>"), "section_path")
    made = sorted(boundaries.split_oversized(frame, "chunk_id", "body", 12, 2, ("section_path",)).collect(), key=lambda r: (r["chunk_id"], r["piece_index"]))
    assert [(r["chunk_id"], r["piece_index"], r["pieces"]) for r in made] == [("a", 0, 3), ("a", 1, 3), ("a", 2, 3), ("b", 0, 1), ("d", 0, 1)]
    assert made[0]["section_path"] == ["S"] and made[3]["content"] == ""
    assert boundaries.split_oversized(frame.limit(0), "chunk_id", "body", 12, 2).count() == 0


# 2

PLAIN = [
    "Ratings: 4/5 stars (***). That is 5 * 3 * 2 cells, or ~30. ~/notes/* and ~/x/* too",
    "(a, b) <= {c, d}; a < b && c > d; -> => >> --; C# #5 2^3 [12] R&D Q&A; x_1 x_2 draft_7_final $5 to $12",
    "$q_u = \\sum_{i} u^{i}$ and \\[ a = \\frac{u}{1+u} \\]",
    "- a\n- b\n\n1. c\n2. d\n\n| q\n\na | b\nc | d\n\nx (https://a.test/y)",
    "",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_stays(text):
    assert markup.render_text(text) == (text, [])


@pytest.mark.parametrize(
    "text, clean, kind",
    [
        ('<em>a <a href="https://x.test">b</a>', "a b (https://x.test)", "html"),
        ("a&nbsp;b &amp;amp; c", "a\xa0b & c", "html"),
        ("a <!-- x --> b", "a  b", "html"),
        ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a  | bbb\ncc | d", "html"),
        ("<ul><li>x<li>y<ol><li>z</ol></ul><p hidden>no</p><script>no</script>", "- x\n- y\n  1. z", "html"),
        ("**a** *b* ~~c~~ `d` [e](f.md) ![g](h.png)", "a b c d e g", "markdown"),
        ("x\n===\n\n## y\n\n> z\n\n```\ncode\n```", "X\n\nY\n\n| z\n\n    code", "markdown"),
        ("'''a''' ''b'' [[c|d]] [[P#e]] {{t|n=f}} __TOC__\n== g ==", "a b d e f\n\nG", "wiki"),
        ("\\emph{a}~\\cite{k} {\\it b} ``c'' \\label{x}\\begin{itemize}\n\\item d\n\\end{itemize}", "a [k] b “c”\n\n- d", "latex"),
    ],
)
def test_markup(text, clean, kind):
    made, kinds = markup.render_text(text)
    assert "\n".join(x.rstrip() for x in made.split("\n")) == clean.rstrip() and set(kinds) == {kind}
    assert markup.render_text(made)[1] == []


@pytest.mark.parametrize(
    "text, clean",
    [
        ("See `<b>x</b>` and `**k**`", "See <b>x</b> and **k**"),
        ("```\n<div>hi</div>\n# not heading\n```", "    <div>hi</div>\n    # not heading"),
        ("`&amp;lt;`, ``a ` b``", "&amp;lt;, a ` b"),
        ("<pre>if a &lt; b:\n  <i>x</i> **y** &amp;lt;</pre>", "    if a < b:\n      x **y** &lt;"),
        ("<code>[[a]] &amp;lt;</code> <nowiki>'''b'''</nowiki>", "[[a]] &lt; '''b'''"),
        ("\\begin{verbatim}\n\\emph{x} **a**\n\\end{verbatim} \\verb|**b**|", "    \\emph{x} **a**\n\n**b**"),
        ("a &amp;amp; b &lt;b&gt;c&lt;/b&gt; &amp;lt;i&amp;gt;d &nosuch;", "a & b c d &nosuch;"),
    ],
)
def test_code_is_kept(text, clean):
    assert markup.render_text(text)[0] == clean


@pytest.mark.parametrize(
    "text, clean, kinds",
    [
        ("| a | b |\n|---|:-:|\n| c`|`d | **ee** |\n| f\\|g | h\nend", "a   | b\nc|d | ee\nf|g | h\n\nend", {"markdown"}),
        ("x | y\n-- | --", "x | y\n-- | --", set()),
        ("|:---:|---:|\nz", "z", {"markdown"}),
        ('{| class="w"\n|+ Cap\n! A !! B\n|-\n| style="x" | one || two\n|-\n| three\nmore\n| four\n|}', "Cap\nA          | B\none        | two\nthree more | four", {"wiki"}),
        ("\\begin{tabular}{l|l}\\hline a & b \\\\ \\cline{1-2}\n cc & d\\& \\\\[2pt] \\end{tabular}", "a  | b\ncc | d&", {"latex", "markdown"}),
        ("[ftp://h.test/x label] &#9;", "label (ftp://h.test/x) ", {"wiki", "html"}),
    ],
)
def test_tables_and_gates(text, clean, kinds):
    made, found = markup.render_text(text)
    assert made == clean.rstrip() and set(found) == kinds


def test_depth_changes_nothing():
    deep = "<div>" * 5000 + "<span hidden>SECRET</span><script>bad()</script><ul><li>a<li>b</ul>ok"
    assert markup.render_text(deep)[0] == markup.render_page(deep) == "- a\n- b\n\nok"
    assert markup.render_page("<blockquote>" * 400 + "x").endswith("| | x")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <>/&;*_`#[](){}|\\'$=-\n\"!", max_size=70))
def test_markup_never_fails(text):
    markup.render_text(text), markup.render_page(text)
    if not markup._suspect.search(text):
        assert markup.render_text(text)[1] == []


def test_clean_texts(spark):
    rows = [(1, "<b>x</b>", True), (2, None, True), (3, "", True), (4, "<b>y</b>", False), (5, "z " * 50_000 + "<i>w</i>", True)]
    frame = clashing(spark.createDataFrame(rows, "id int, body string, on_ boolean"))
    made = {r["id"]: r for r in markup.clean_texts(frame, ("id",), "body", F.col("on_")).collect()}
    assert (made[1]["clean"], made[1]["markup"]) == ("x", ["html", "html"])
    assert made[2]["clean"] is None and made[3]["clean"] == "" and made[4]["clean"] == "<b>y</b>" and made[5]["clean"].endswith("w")
    assert markup.clean_texts(frame.limit(0), ("id",), "body").count() == 0
    pages = spark.createDataFrame([(1, "<p>a</p><p>b", "Html"), (2, "# c", "Markdown"), (3, None, "Html")], "id int, body string, kind string")
    assert [r["clean"] for r in markup.clean_pages(pages, ("id",), "body", "kind").orderBy("id").collect()] == ["a\n\nb", "C", None]


# 4


def test_estimate_follows_similarity():
    sketch, rng = neardup.Sketch(), np.random.default_rng(1)
    for share in (0.0, 0.3, 0.5, 0.8, 1.0):
        off = []
        for _ in range(30):
            common = rng.integers(0, 2**63, int(200 * 2 * share / (1 + share)), dtype=np.uint64)
            own = 200 - len(common)
            a, b = (np.concatenate([common, rng.integers(0, 2**63, own, dtype=np.uint64)]) for _ in range(2))
            x, y = sketch.minima(a), sketch.minima(b)
            p, q = sketch.pack(x), sketch.pack(y)
            lanes = [(int(v) >> s & 15) == (int(w) >> s & 15) for v, w in zip(p, q) for s in range(0, 64, 4)][: sketch.size]
            off.append((sum(lanes) / sketch.size - 1 / 16) / (1 - 1 / 16) - share)
        assert abs(np.mean(off)) < 0.03


def test_neardup(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(4000)}" for _ in range(90)] for _ in range(40)]
    texts = {f"t{i:03}": " ".join(w) for i, w in enumerate(base)}
    for i in range(0, 40, 2):
        w = list(base[i])
        for _ in range(i // 3):
            w[rng.randrange(90)] = "edit"
        texts[f"u{i:03}"] = " ".join(w)
        texts[f"v{i:03}"] = texts[f"t{i:03}"].upper()
    rows = [(k, t) for k, t in texts.items()] + [("t000", texts["t000"]), ("n", None), ("e", ""), ("s", "too short")]
    frame = clashing(spark.createDataFrame(rows, "id string, body string"))
    found = neardup.Groups(frame, "id", "body", neardup.Sketch(shingle=3), 0.5, 60)
    groups = {r["key"]: r for r in found.groups().collect()}
    sets = {k: set(zip(w, w[1:], w[2:])) for k, t in texts.items() if (w := t.lower().split())}
    brute = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    members = {}
    for r in found.members.collect():
        members.setdefault(bytes(r["class"]), []).append(r["key"])
    got = {tuple(sorted(p)) for m in members.values() for p in itertools.combinations(m, 2)}
    got |= {tuple(sorted((x, y))) for r in found.pairs.collect() for x in members[bytes(r["a"])] for y in members[bytes(r["b"])]}
    assert got == brute and len(brute) > 30
    assert set(groups) == set(texts)
    for a, b in brute:
        assert groups[a]["group_id"] == groups[b]["group_id"]
    assert groups["t000"]["class_id"] == groups["v000"]["class_id"] == "t000"
    assert neardup.Groups(frame.limit(0), "id", "body", neardup.Sketch(), 0.8).groups().count() == 0


def test_hot_bands(spark):
    """Bands of many classes give the same pairs in blocks as joined directly."""
    rng, sketch = np.random.default_rng(8), neardup.Sketch(shingle=3)
    common = rng.integers(0, 2**62, 40)
    rows = []
    for i in range(120):
        own = rng.integers(0, 2**62, 20 + i % 7 * 10)
        rows.append((bytes([i]), sorted({int(x) for x in (*common[: 10 + i % 31], *own)})))
    rows += [(b"z" + bytes([i]), rows[i][1][:-1] + [5]) for i in range(30)]
    frame = spark.createDataFrame(rows, "class binary, shingles array<bigint>")
    plain = {(bytes(r["a"]), bytes(r["b"])) for r in neardup.class_pairs(frame, sketch, 0.5).collect()}
    hot = {(bytes(r["a"]), bytes(r["b"])) for r in neardup.class_pairs(frame, sketch, 0.5, hot=7).collect()}
    assert plain == hot and len(plain) >= 30


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    made = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert made == {n: root(n) for a, b in edges if a != b for n in (a, b)}


# 5


def tree(*blocks):
    def one(b):
        kind, value = b
        if kind == "list":
            return {"List": {"ordered": False, "items": [{"content": [{"block": {"Paragraph": {"content": [{"Link": {"url": u, "children": [{"Text": t}]}}]}}}]} for t, u in value]}}
        return {kind: {"level": 1, "content": [{"Text": value}]}}

    return json.dumps({"meta": {}, "body": [{"block": one(b), "prov": {}} for b in blocks]})


WORDS = [a + b + c for a in "ba ce di fo gu la me ni po ru sa te vi".split() for b in "lm nd rk st x".split() for c in "a e i o u an er is om".split()]


def article(i, n=4):
    """Paragraphs that no other page has, with what the site's pages say in theirs as well."""
    rng = random.Random(i)
    said = [("Paragraph", " ".join(rng.choice(WORDS) for _ in range(12)) + f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}.") for _ in range(n)]
    return [("Heading", f"{rng.choice(WORDS)} {rng.choice(WORDS)} {i}x{rng.randrange(10**6)}"), *said[:2], ("Paragraph", "See the table."), *said[2:]]


def furniture_in(spark, rows, **more):
    frame = clashing(spark.createDataFrame(rows, "id int, doc string, site string, sum string, made boolean"))
    made = furniture.tree_furniture(frame, "id", "doc", F.col("site"), F.col("sum"), F.col("made")).collect()
    assert all(r["score"] is not None and r["reason"] in ("recurs", "entries", "form", "alike") for r in made)
    return {(int(r["id"]), r["block_index"]): (r["reason"], r["pages"]) for r in made}


def test_furniture(spark):
    """Wordings and a language that no table has."""
    menu = ("list", [("Altra", "https://a.test/1"), ("Roba", "https://b.test/2"), ("Qui", "https://c.test/3")])
    notice, foot = ("Paragraph", "Wir verwenden Cookies, um Inhalte zu zeigen. Einverstanden"), ("Paragraph", "Vers. 3 del sito, tutti i diritti")
    rows = []
    for i in range(40):
        rows.append((i, tree(*([notice] if i % 2 else []), menu, *article(i), foot), "a.test", f"s{i}", True))
    for i in range(100, 140):
        rows.append((i, tree(*article(i)), "writers", f"s{i}", False))
    false = ["Aspirin is a trademark of Bayer in many countries.", "Printed from woodblocks in 868, the scroll is dated.", "Related: the theorem also holds for rings."]
    rows += [(200 + i, tree(*article(200 + i)[:2], ("Paragraph", f), *article(200 + i)[2:]), "a.test", f"t{i}", True) for i, f in enumerate(false)]
    rows += [(300, None, "a.test", None, True), (301, "{cut", "a.test", None, True), (302, '{"body": []}', None, None, None), (0, rows[0][1], "a.test", "s0", True)]
    made = furniture_in(spark, rows)
    expected = {(i, b): 20 if i % 2 and b == 0 else 40 for i in range(40) for b in ([0, 1, 8] if i % 2 else [0, 7])}
    assert {k: p for k, (r, p) in made.items() if r == "recurs"} == expected
    assert set(made) == set(expected)
    assert furniture_in(spark, rows[:1]) == {}


def test_menus_of_changing_entries(spark):
    """A menu that is never the same twice is told by its entries; a list of an article with one of its words stays."""
    entries, rows = "Altra Roba Qui Dove Quando Perch Ovunque Sempre".split(), []
    for i in range(48):
        rng = random.Random(i)
        some = rng.sample(entries, 5)
        rows.append((i, tree(("Paragraph", " · ".join(some)), *article(i)), "a.test", f"s{i}", True))
        rows.append((100 + i, tree(*article(100 + i)), "writers", f"s{100 + i}", False))
    rows.append((900, tree(*article(900)[:3], ("Paragraph", "balma cendo · Altra · dirker foxan"), *article(900)[3:]), "a.test", "s900", True))
    made = furniture_in(spark, rows)
    assert set(made) == {(i, 0) for i in range(48)} and {r for r, _ in made.values()} <= {"recurs", "entries", "form"}


def test_templates_of_a_large_host(spark):
    foot = ("Paragraph", "Altra roba qui, dal sito")
    rows = [(i, tree(*article(i), *([foot] if i % 150 == 7 else [])), "a.test", f"s{i}", i % 2 == 1) for i in range(1500)]
    made = furniture_in(spark, rows)
    assert {k for k in made} == {(i, 6) for i in range(1500) if i % 150 == 7}


def test_all_blocks_train(spark, monkeypatch):
    """More blocks of authors than a sample once held: each of them, and each hit, is in the rows the model is fitted to."""
    seen, fit = [], furniture.train

    def spy(blocks, *more):
        seen.append(len(blocks) if isinstance(blocks, list) else sum(len(r["labels"]) for r in blocks.collect()))
        return fit(blocks, *more)

    monkeypatch.setattr(furniture, "train", spy)
    foot = ("Paragraph", "Altra roba qui, dal sito")
    rows = [(i, tree(("Paragraph", f"{WORDS[i % 500]} {WORDS[i // 500]} x{i}y"), ("Paragraph", f"{WORDS[i // 500]} z{i}u")), "writers", f"s{i}", False) for i in range(12_000)]
    rows += [(20_000 + i, tree(*article(20_000 + i), foot), "a.test", f"s{20_000 + i}", True) for i in range(40)]
    made = furniture_in(spark, rows)
    hits = {k for k, (r, _) in made.items() if r != "alike"}
    assert hits >= {(20_000 + i, 6) for i in range(40)}
    assert seen == [24_000 + sum(i >= 20_000 for i, _ in hits)]


def test_models_of_all_rows(spark):
    """Fitted over tasks as over one array of all rows."""
    rng = np.random.default_rng(3)
    counts = rng.poisson(rng.choice([[6, 1, 1, 1, 0, 0, 0, 0], [0, 5, 3, 1, 0, 0, 0, 0], [0, 1, 1, 3, 0, 0, 0, 3]], 45_000))
    counts = np.concatenate([counts[counts.sum(1) >= furniture.RATE_PAGES], np.eye(8, dtype=int)[rng.integers(0, 8, 500)]])
    marks = [(4 * n + furniture.BLOCK, *c, sum(c)) for n, c in enumerate(counts.tolist())]
    rates = furniture.rates_of(spark.createDataFrame(marks, "mark long, " + ", ".join(f"p{i} long" for i in range(8)) + ", n long").repartition(3))
    single = counts.sum(1) == 1
    whole = furniture.Rates(counts[single].sum(0).astype(float))
    for _ in range(20):
        whole.learn(whole.sums(counts[~single].astype(float), np.ones((~single).sum())))
    np.testing.assert_allclose(rates.rates, whole.rates, rtol=1e-8)
    np.testing.assert_allclose(rates.shares, whole.shares, rtol=1e-8)

    features = [np.unique(rng.integers(0, 300, rng.integers(1, 30))).astype(np.uint16) for _ in range(3_000)]
    label = np.array([f[0] < 9 for f in features])
    pages = [(np.concatenate(features[i : i + 3]).tobytes(), np.array([len(f) for f in features[i : i + 3]], np.int32).tobytes(), label[i : i + 3].astype(np.uint8).tobytes()) for i in range(0, 3_000, 3)]
    frame = spark.createDataFrame(pages, "features binary, sizes binary, labels binary")
    weight, base = furniture.train(frame.repartition(3), 20)
    dense = np.zeros((3_000, 300))
    for n, f in enumerate(features):
        dense[n, f] = len(f) ** -0.5
    w, b, seen = np.zeros(300), 0.0, np.full(300, 1e-6)
    cost = np.where(label, 1_500 / label.sum(), 1_500 / (~label).sum())
    for _ in range(20):
        slope = (1 / (1 + np.exp(-dense @ w - b)) - label) * cost
        step = slope @ dense + 1e-6 * 3_000 * w
        seen += step * step
        w, b = w - 2.0 * step / np.sqrt(seen), b - 0.5 * slope.mean()
    np.testing.assert_allclose(weight[:300], w, atol=1e-5)
    assert base == pytest.approx(b, abs=1e-5) and furniture.train(frame.limit(0)) is None


def test_copies_are_one_page(spark):
    foot = ("Paragraph", "Altra roba qui, dal sito")
    rows = [(i, tree(*article(i)), "b.test", f"s{i}", i % 2 == 0) for i in range(40)]
    rows += [(100 + i, tree(*article(100), foot), "a.test", f"c{i}", True) for i in range(30)]
    assert furniture_in(spark, rows) == {}
    page = "<main><h1>Head</h1><p>Text.</p><p>More.</p><ul><li>altra cosa<li>roba buona<li>qui vicino</ul></main>"
    pages = spark.createDataFrame([(i, page + " " * i, "b", "u") for i in range(9)], "id int, body string, site string, url string")
    assert all("roba buona" in r["main"] for r in furniture.main_bodies(pages, "id", "body", F.col("site"), F.col("url")).collect())


def test_main_bodies(spark):
    rng = random.Random(2)

    def page(i):
        said = [" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(3)]
        return said, f"<nav>n</nav><div><section><p>Altra roba, accettate {i}</p></section><h1>{said[0][:20]} {i}</h1><p>{said[0]}<p>{said[1]}<p>{said[2]}</div><div>Dal sito di ieri, vers. {i}</div>"

    made = [page(i) for i in range(30)]
    rows = [(i, b, "a", f"u{i}") for i, (_, b) in enumerate(made)] + [(90, None, "a", None), (91, "", "a", None), (3, made[3][1], "a", "u3")]
    frame = clashing(spark.createDataFrame(rows, "id int, html string, site string, url string"))
    got = {r["id"]: r["main"] for r in furniture.main_bodies(frame, "id", "html", F.col("site"), F.col("url")).collect()}
    assert got[90] is None and got[91] == "" and len(got) == 32
    for i, (said, _) in enumerate(made):
        assert all(x in got[i] for x in said) and "roba" not in got[i] and "ieri" not in got[i]
    assert furniture.main_bodies(frame.limit(0), "id", "html", F.col("site")).count() == 0


# 6


def test_codes_approximate():
    rng = np.random.default_rng(2)
    x = additive.unit(rng.normal(size=(3000, 16)))
    books = additive.Codebooks(x, words=32)
    codes, norms = books.encode(x)
    made = books.decode(codes)
    assert ((made - x) ** 2).sum(1).mean() < 0.2
    q = x[:5]
    assert np.allclose(books.scores(q, codes, norms), (made @ q.T) / norms[:, None], atol=1e-4)
    # A beam is never worse than taking the nearest word of each book in turn.
    alone = additive.Codebooks(x, words=32, beam=1)
    assert ((made - x) ** 2).sum() <= ((alone.decode(alone.encode(x)[0]) - x) ** 2).sum() + 1e-3


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    x = {f"v{i:04}": np.round(centres[i % 6] + rng.normal(size=8) * 0.4, 4) for i in range(600)}
    rows = [(k, 8, json.dumps(v.tolist())) for k, v in x.items()]
    rows += [("v0000", 8, " " + json.dumps(x["v0000"].tolist()).replace("0.", "0.0e0+", 0))] + [(f"same{i:02}", 8, "[1,0,0,0,0,0,0,0.0]") for i in range(15)]
    rows += [("p", 2, "[1,0]"), ("q", 2, "[0.5, 0.5]")]
    bad = ["[1,2", "[]", "[0,0]", "[1,null]", '[1,"2"]', "[NaN,1]", "[1,2,3]", None, "x", "[1e400,1]", "[[1,2]]", "[1,true]"]
    rows += [(f"bad{i}", 2, b) for i, b in enumerate(bad)] + [(None, 2, "[1,0]"), ("nodim", None, "[1,0]")]
    frame = clashing(spark.createDataFrame(rows, "chunk_id string, dimension int, vector_json string"))
    made = vectors.neighbours(frame, "chunk_id", "dimension", "vector_json", 10).collect()
    got = {}
    for r in made:
        got.setdefault(r["chunk_id"], {})[r["neighbour"]] = r["cosine"]
    assert set(got) == set(x) | {f"same{i:02}" for i in range(15)} | {"p", "q"}
    assert got["p"] == pytest.approx({"q": 0.5**0.5}) and all(len(got[k]) == 10 for k in x)
    assert set(got["same00"]) == {f"same{i:02}" for i in range(1, 11)} and all(k not in v for k, v in got.items())
    every = {k: v / np.linalg.norm(v) for k, v in x.items()} | {f"same{i:02}": np.eye(8)[0] for i in range(15)}
    names, m = list(every), np.stack(list(every.values()))
    hit = 0
    for i, k in enumerate(names):
        s = m @ m[i]
        s[i] = -2
        worst = np.sort(s)[-10]
        hit += sum(c >= worst - 1e-6 for c in got[k].values())
    assert hit >= 0.97 * 10 * len(names)
    near = vectors.neighbours(frame, "chunk_id", "dimension", "vector_json", 10, 0.97).collect()
    assert {(r["chunk_id"], r["neighbour"], r["rank"]) for r in near} == {(r["chunk_id"], r["neighbour"], r["rank"]) for r in made if r["cosine"] >= 0.97}
    assert vectors.neighbours(frame.limit(0), "chunk_id", "dimension", "vector_json").count() == 0


def test_recall_over_many_cells(spark):
    """Two levels of cells, as many as a large table has: recall against brute force, and near pairs found whole."""
    rng = np.random.default_rng(5)
    topics = rng.normal(size=(40, 32))
    x = topics[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 32)) * 0.5
    x[5000:5600] = x[:600] + rng.normal(size=(600, 32)) * 0.05
    x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 4)
    rows = [(f"v{i:05}", 32, json.dumps(v.tolist())) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "chunk_id string, dimension int, vector_json string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = u @ u.T
    np.fill_diagonal(score, -2)
    assert len(additive.Cells(u.astype(np.float32), 6000 / 8).books) == 2
    got = {}
    for r in vectors.neighbours(frame, "chunk_id", "dimension", "vector_json", 10, cell=100).collect():
        got.setdefault(r["chunk_id"], []).append(r["cosine"])
    asked = range(0, 6000, 10)
    worst = np.sort(score[asked], axis=1)[:, -10]
    recall = np.mean([sum(c >= w - 1e-9 for c in got[f"v{i:05}"]) / 10 for i, w in zip(asked, worst)])
    assert recall >= 0.9
    near = {(r["chunk_id"], r["neighbour"]) for r in vectors.neighbours(frame, "chunk_id", "dimension", "vector_json", 10, 0.95, cell=8).collect()}
    true = {(f"v{i:05}", f"v{j:05}") for i, j in zip(*np.nonzero(score >= 0.95)) if (score[i] > score[i, j]).sum() < 10}
    assert len(true) >= 1000 and near <= true and len(near) >= 0.995 * len(true)


# 7


def test_merge_replay(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{bpe.FOLDER}/{bpe.NAME}.json"
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    rng = random.Random(5)
    texts = ["", "a" * 3000, " \n\n\t x", "don't we'll", "<|endoftext|>", "𝒻 漢字한글 naïve Größe…", "1234567 ,.!?"]
    texts += ["".join(rng.choice("abehorst .,'\n1ßé漢") for _ in range(rng.randrange(80))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000, None), (10_001, texts[7]), (10_001, texts[7])]
    made = bpe.encode(clashing(spark.createDataFrame(rows, "doc_id int, body string")), ("doc_id",), "body").collect()
    got = {r["doc_id"]: r["ids"] for r in made}
    assert len(made) == len(rows) and got[10_000] == [] == got[0]
    assert all(got[i] == other.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))
    counts = bpe.encode(spark.createDataFrame(rows, "doc_id int, body string"), ("doc_id",), "body", counts_only=True).collect()
    assert {r["doc_id"]: r["n_ids"] for r in counts} == {k: len(v) for k, v in got.items()}
    assert bpe.encode(spark.createDataFrame([], "doc_id int, body string"), ("doc_id",), "body").count() == 0
    # Whatever part of the words the dictionary of the corpus holds, the ids are the same.
    frame = spark.createDataFrame(rows, "doc_id int, body string")
    known = bpe.dictionary(frame, "body", path, 40)
    assert 0 < len(known) <= 40 and all(other.encode(w, add_special_tokens=False).ids == ids for w, ids in known.items())
    for most in (0, 40):
        assert {r["doc_id"]: r["ids"] for r in bpe.encode(frame, ("doc_id",), "body", most=most).collect()} == got


# 8


def test_fill_keeps_the_cap():
    mass, weight = np.array([10.0, 10.0, 10.0]), np.array([5.0, 1.0, 1.0])
    made = mixing.fill(mass, weight, 2.0, 40.0)
    assert made.max() <= 2 and (made * mass).sum() == pytest.approx(40)
    assert mixing.fill(mass, weight, 1.0, 99.0).tolist() == [1, 1, 1]


def test_mix(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        source = "big" if i % 3 else rng.choice([" Mid ", "small", "other", None])
        rows.append((i, rng.choice(["alpha ", "beta gamma "]) * rng.randrange(1, 60), rng.choice(["en", "de-DE", "xx!", None]), source))
    rows += [(1000, None, "en", "big"), (1001, "", "en", "mid")]
    documents = clashing(spark.createDataFrame(rows, "doc_id int, body string, lang string, source string").withColumnRenamed("body", "text"), "text")
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.2, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    selection, shares = mixing.mix(documents, targets)
    chosen = {r["doc_id"]: r for r in selection.collect()}
    reached = {r["source"]: r for r in shares.collect()}
    for s, share, cap in (("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.2, 3)):
        # Within half of the largest document, of a few thousand tokens in all.
        assert reached[s]["actual_share"] == pytest.approx(share / 0.9, abs=0.004) and reached[s]["most_copies"] <= cap
    assert reached["none"]["actual_share"] == 0 and not {1000, 1001} & set(chosen) and all(r["source"] in reached for r in chosen.values())
    used = sum(r["tokens"] * r["copies"] for r in chosen.values())
    assert used == sum(r["tokens_used"] for r in reached.values())
    empty, none = mixing.mix(documents.limit(0), targets)
    assert empty.count() == 0 and [r["actual_share"] for r in none.collect()] == [0.0] * 4


def test_topics_of_all_documents(spark):
    """Topics as over one array of all profiles."""
    rng = np.random.default_rng(5)
    kinds = rng.dirichlet(np.full(mixing.FEATURES, 0.1), 11)[rng.integers(0, 11, 12_000)]
    profiles = np.sqrt(np.array([rng.multinomial(40, k) for k in kinds]) / 40).astype(np.float32)
    rows = [(f"d{n // 4}" if n % 2 else "same", 40, p.tobytes()) for n, p in enumerate(profiles)] + [(None, 0, bytes(4 * mixing.FEATURES))]
    frame = spark.createDataFrame(rows, "doc_id string, tokens long, profile binary").repartition(5)
    unit = profiles / np.linalg.norm(profiles, axis=1, keepdims=True)
    centres = mixing.firsts(frame.where("tokens > 0"))
    assert len(np.unique(centres, axis=0)) == mixing.TOPICS
    for _ in range(mixing.TOPIC_ROUNDS):
        near = (unit @ centres.T).argmax(1)
        sums = np.array([unit[near == k].sum(0) for k in range(mixing.TOPICS)])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    np.testing.assert_allclose(mixing.centres_of(frame.where("tokens > 0")), centres, atol=1e-3)
    near = dict(zip([p.tobytes() for p in profiles], (unit @ centres.T).argmax(1)))
    made = [(near[r["profile"]], r["topic"]) for r in mixing.with_topics(frame).where("tokens > 0").collect()]
    assert len(made) == 12_000 and sum(a == b for a, b in made) >= 11_990
    few = mixing.with_topics(frame.limit(3))
    assert few.count() == 3 and len(mixing.centres_of(frame.limit(0))) == 0


def test_topics_of_repeated_ids(spark):
    """Documents of one id; a sample drawn by ids once held none of these."""
    drawn = F.pmod(F.xxhash64(F.lit("twice")), F.lit(1_000_000))
    documents = spark.range(20_000).select(F.lit("twice").alias("doc_id"), F.lit("a").alias("source"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "alpha ").otherwise("beta gamma ").alias("text"))
    assert spark.range(1).select(drawn.alias("d")).first()["d"] > 250_001
    topics = mixing.with_topics(mixing.sized(documents)).groupBy("topic").count().collect()
    assert sorted(r["count"] for r in topics) == [6_667, 13_333]


# 9


def test_segments():
    def brute(s):
        best = max(((sum(s[a:b]), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0))
        return best[0]

    rng = random.Random(6)
    for _ in range(200):
        s = [rng.uniform(-2, 1) for _ in range(rng.randrange(12))]
        found = mojibake.segments(np.array(s))
        assert all(a < b for a, b in found) and all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
        if max(s, default=0) > 0:
            assert max(sum(s[a:b]) for a, b in found) == pytest.approx(brute(s))


def test_restore(spark):
    clean = ["Über den Flüssen liegt schöner Nebel, größer als früher.", "Le café déjà fermé près de la façade où l’été passe.", "Ключи или записи удаляют из очереди.", "もし目次が古いものなら、設定を置き換えます。"] * 30
    rows = [(i, t) for i, t in enumerate(clean)]
    broken = {
        900: clean[0].encode().decode("cp1252", "ignore"),
        901: clean[1].encode().decode("latin-1"),
        902: clean[2].encode("cp1251").decode("cp1252"),
        903: clean[1].encode().decode("latin-1").encode().decode("latin-1"),
        904: clean[0].encode("cp1252").decode("cp437"),
        905: "fine until here: fr�her",
        906: clean[3].encode("cp932").decode("latin-1"),
    }
    whole = {910: "The checker turns `Ã©` back into é.", 911: "NÃO misture ÇA; Ångström µ-values × 5 °C ± 2 — “x” …", 912: None, 913: "", 914: "plain", 915: "shown as Ã¼ here"}
    rows += [*broken.items(), *whole.items(), (1, clean[1])]
    quoted = F.when(F.col("id") == 915, F.array(F.lit("Ã¼"))).otherwise(F.lit(None).cast("array<string>"))
    frame = clashing(spark.createDataFrame(rows, "id int, body string"))
    made = {r["id"]: r for r in mojibake.restore(frame, "id", "body", quoted).collect()}
    assert {k for k, r in made.items() if r["garbled"]} == set(broken)
    assert made[901]["restored"] == clean[1] == made[903]["restored"] and made[902]["restored"] == clean[2] and made[904]["restored"] == clean[0]
    assert made[905]["restored"] is None and made[912]["codes"] == []
    assert mojibake.restore(frame.limit(0), "id", "body").count() == 0


def test_code_spans_pair_by_length():
    text = "```sh\\nx``` then Ã© and `a` or ``b ` c`` d `é"
    assert [text[a:b] for a, b in mojibake.quoted_ranges(text, None)] == ["```sh\\nx```", "`a`", "``b ` c``"]
    assert mojibake.quoted_ranges("ü ü ü", ["ü", "ü"]) == [(0, 1), (2, 3)]


def test_restore_a_large_garbled_source(spark):
    clean = ["Über den Flüssen liegt schöner Nebel, größer als früher.", "Le café déjà fermé près de la façade où l’été passe.", "Ключи или записи удаляют из очереди.", "Er rief: „Spaß“ und ging. Её нет."]
    rows = [(i, clean[i % 4]) for i in range(160)] + [(1000 + i, clean[i % 3].encode().decode("latin-1")) for i in range(120)]
    made = {r["id"]: r for r in mojibake.restore(spark.createDataFrame(rows, "id int, body string"), "id", "body").collect()}
    assert {k for k, r in made.items() if r["garbled"]} == set(range(1000, 1120))
    assert all(made[1000 + i]["restored"] == clean[i % 3] for i in range(120))
