from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.functions.tokens import count_tokens
from marlstone.operators import chunking
from marlstone.parsers import markdown


def chunks(source, budget=512):
    return chunking.chunk(markdown.parse(source), budget)


def test_sections_and_kinds():
    made = chunks("# T\n\nintro\n\n## A\n\nx\n\n```\ncode\n```\n\n| a |\n|---|\n| b |\n\n## B\n\ny")
    assert [(c["section_path"], c["block_type"]) for c in made] == [(["T"], "Prose"), (["T", "A"], "Prose"), (["T", "A"], "Code"), (["T", "A"], "Table"), (["T", "B"], "Prose")]
    assert [c["sequence_index"] for c in made] == list(range(5))
    assert chunks("") == [] and chunks("# only\n\n## headings") == []
    assert len(chunks("# T\n\n## N\n\na\n\n## N\n\nb")) == 2


def test_tables_repeat_their_header():
    rows = "".join(f"| r{i} | v{i} |\n" for i in range(20))
    made = chunks(f"| h | k |\n|---|---|\n{rows}", 20)
    assert len(made) > 1 and all(c["content"].startswith("h | k\n") and c["token_count"] <= 20 for c in made)
    assert sum(c["content"].count("\n") for c in made) == 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc .!?\n|`#", max_size=60), max_size=8), st.integers(1, 12))
def test_within_budget(parts, budget):
    made = chunks("\n\n".join(parts), budget)
    assert all(c["token_count"] == count_tokens(c["content"]) <= budget for c in made)
    assert [c["sequence_index"] for c in made] == list(range(len(made)))


def test_sentences_and_windows():
    assert chunking.split_sentences("One. Two?three! Four\nFive") == ["One.", "Two?three!", "Four", "Five"]
    text = "a b  c\nd e"
    assert chunking.windows(text, 2) == ["a b  ", "c\nd ", "e"] and "".join(chunking.windows(text, 2)) == text
